"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names: every operator on a table made for it."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from mdloom.llm import bpe, chat, decontaminate, langid, licenses, neardup, pages, quality, substring, toxicity

NAMES = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASHING = "id bigint, row string, matches string, places string, ids string, version int, n bigint, score double, kept boolean, band bigint, key bigint"
LONG = " ".join(f"word{i % 7919}x{i % 31}" for i in range(60_000))
PASSAGE = " ".join(f"passage{i}" for i in range(30))
TEXTS = [
    None, "", " \t\n\r\x0b\x0c ", "one", "one two three", LONG, PASSAGE, "before " + PASSAGE + " after", PASSAGE + " " + PASSAGE, "\x00 odd \x01", "a b  c é ΑΣ 漢字", "...", "12345 678",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(TEXTS)] + [(None, "no id here", None, None, None), (None, None, None, None, None)]
    rows += [rows[3], rows[6], rows[0]]  # repeated rows
    extra = ", ".join(f"cast({i} as {kind}) as {name}" for i, (name, kind) in enumerate(x.split() for x in CLASHING.split(", ")) if kind != "boolean")
    return spark.createDataFrame(rows, NAMES).selectExpr("*", *extra.split(", "), "true as kept")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_near_duplicates(docs, empty):
    rows = neardup.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    found = {r.doc_id: r for r in rows}
    for i in (0, 1, 2):
        assert (found[i].n_shingles, found[i].component_id, found[i].kept) == (0, i, True)
    assert found[3].n_shingles == found[4].n_shingles == 1 and found[5].n_shingles > 50_000
    assert found[8].component_id == 6  # 26 shingles of 30 words are nearly all of the doubled passage's
    assert neardup.near_duplicates(empty).count() == 0


def test_near_duplicates_in_open_buckets(spark, monkeypatch):
    """A chain of documents, each linked with the next only: one component, whatever the buckets' leaders are; blocks of two."""
    monkeypatch.setattr(neardup, "BLOCK", 2)
    rng = random.Random(3)
    words = [f"w{rng.randrange(10**9)}" for _ in range(400)]
    chain = [(i, " ".join(words[i * 12 : i * 12 + 104])) for i in range(20)]
    rows = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(chain, "doc_id bigint, text string")).collect()}
    sets = [{tuple(t.split()[k : k + 5]) for k in range(100)} for _, t in chain]
    assert 100 * len(sets[0] & sets[1]) >= 75 * len(sets[0] | sets[1]) and 100 * len(sets[0] & sets[2]) < 75 * len(sets[0] | sets[2])
    assert set(rows.values()) == {0}


@given(st.sets(st.integers(0, 400), min_size=1), st.sets(st.integers(0, 400), min_size=1))
@settings(max_examples=200, deadline=None)
def test_the_parity_bound_never_lies(a, b):
    one, other = (neardup.mix64(np.array(sorted(s), np.uint64)) for s in (a, b))
    bits = neardup.parity_bitmaps([one, other]).view(np.uint64)
    if 100 * len(a & b) >= 75 * len(a | b):
        assert neardup.may_be_linked(np.array([len(a)]), np.array([len(b)]), bits[:1], bits[1:]).all()


def test_odd_sketches_estimate(spark):
    rng = np.random.default_rng(0)
    for share in (0.6, 0.8, 0.95):
        base = rng.integers(0, 1 << 63, 1000, np.uint64)
        k = int(1000 * (1 - share) / (1 + share))
        other = np.concatenate((base[k:], rng.integers(0, 1 << 63, k, np.uint64)))
        sketches = neardup.odd_sketches(np.stack([neardup.min_hashes(base), neardup.min_hashes(other)])).view(np.uint64)
        assert abs(neardup.sketch_similarity(sketches[:1], sketches[1:])[0] - share) < 0.2


def test_repeats(docs, empty):
    rows = substring.remove_repeats(docs).select("row.doc_id", "text", "n_words", "n_removed").collect()
    assert len(rows) == docs.count()
    found = {r.doc_id: r for r in rows}
    assert found[6].n_removed == 0 and found[7].n_removed == 30 and found[7].text == "before after"
    assert found[8].n_removed == 60 and found[8].text == ""
    assert found[0].text is None and found[2].text == TEXTS[2] and found[5].n_removed == 0
    assert substring.remove_repeats(empty).count() == 0


def test_repeats_at_every_shift(spark):
    """Windows are found whatever the two places are modulo the period."""
    rows = [(i, " ".join([f"x{i}y{k}" for k in range(i % 40)] + PASSAGE.split()[:20] + [f"z{i}"])) for i in range(60)]
    found = {r.doc_id: r.n_removed for r in substring.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).select("row.doc_id", "n_removed").collect()}
    assert found[0] == 0 and all(found[i] == 20 for i in range(1, 60))


def test_toxicity(spark, docs, empty):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(13)] + [(3, 1, None), (None, 1, 1)], "doc_id bigint, quality bigint, toxic bigint")
    for model in (toxicity.fit_toxicity(docs, labels), toxicity.fit_toxicity(empty, labels), toxicity.fit_toxicity(docs, labels.limit(0))):
        score = toxicity.toxicity_score(model)
        assert all(0 <= r[0] <= 1 for r in docs.select(score("text")).collect())
        assert empty.select(score("text")).count() == 0


def test_toxicity_finds_marked_texts(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 8))) for _ in range(500)]
    rows = []
    for i in range(1200):
        text = [rng.choice(words) for _ in range(60)]
        if i % 5 == 0:
            for k in rng.sample(range(60), 3):
                text[k] = rng.choice(["grumblefoot", "snarkwad", "blitherpox"])
        rows.append((i, " ".join(text), int(i % 5 == 0)))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    model = toxicity.fit_toxicity(frame, frame.select("doc_id", "toxic"))
    scored = frame.filter(toxicity.held_out(F.col("doc_id"))).select("toxic", toxicity.toxicity_score(model)("text").alias("s")).collect()
    bad, good = ([r.s for r in scored if r.toxic == k] for k in (1, 0))
    assert np.mean([b > g for b in bad for g in good]) > 0.98
    assert np.mean([s >= 0.3 for s in bad]) > 0.9 and np.mean([s >= 0.3 for s in good]) < 0.03


def test_pages(spark):
    source = spark.createDataFrame([(0, None), (1, ""), (2, "<p>unclosed <b>text &amp; more"), (3, "<script>x"), (3, "<script>x"), (None, "<div>" * 3000 + "deep")], "page_id bigint, html string")
    source = source.selectExpr("*", "'x' as text", "1 as n_chars", "'y' as row")
    rows = pages.extract_main_text(source, pages.fit_content(source)).select("row.page_id", "text", "n_chars").collect()
    assert len(rows) == 6 and all(r.n_chars == len(r.text) for r in rows)
    assert all(r.text == "" for r in rows if r.page_id in (0, 1, 3))
    assert pages.extract_main_text(source.limit(0), pages.learn_content([])).count() == 0


def test_page_parts():
    model = pages.learn_content([])
    good = ["The first paragraph of the story, with a clause, and a stop.", "A second one, which goes on for a while, about the same thing."]
    text = "".join(f"<p>{x}</p>" for x in good)
    around = (
        '<header><p>Site name, a long slogan, in a header.</p></header><nav><a href="/">Home</a></nav><div class="cookie-notice"><p>We use cookies, and say so at length.</p></div>{}'
        '<aside class="sidebar"><p>Something else entirely, in a sidebar.</p></aside><form><p>Leave your address, please.</p></form>'
        '<div id="comments"><p>I do not agree, and say so.</p></div><footer><p>All of this is ours, since 1999.</p></footer>'
    )
    for body in (f"<article>{text}</article>", f'<div class="post">{text}</div>', f"<main><div>{text}</div></main>"):
        assert pages.main_texts(model, [around.format(body), None]) == ["\n".join(good), ""]


def test_licenses(docs, empty):
    rows = licenses.scan_licenses(docs).collect()
    assert len(rows) == docs.count() and all(r.licenses == [] and r.sentence_ids == [] for r in rows)
    assert licenses.scan_licenses(empty).count() == 0


def test_license_rules(spark):
    texts = [
        "Words. Released under the MIT License. More.\nLicensed under CC BY-NC 4.0.",
        "Licensed under the Apache License, Version 2.0\nYou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at",
        "released under the mit license",
        "This was released under the MIT License.",
    ]
    found = [r.licenses for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()]
    assert found == [["MIT", "CC-BY-NC-4.0"], ["Apache-2.0"], ["MIT"], []]


MIT_TEXT = """\
MIT License

Copyright (c) 2020 A. Holder

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
BSD_START = """\
Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

"""
BSD_ENDORSE = """\
3. Neither the name of {} nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

"""
BSD_END = """\
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER BE LIABLE FOR ANY DIRECT
DAMAGES.
"""
APACHE_TEXT = """\
Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
GPL_TEXT = """\
This program is free software{} you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation{} either version {} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""


@pytest.mark.parametrize("mark", ["", " * ", "# ", "// ", ";; ", '.\\" ', "! ", "dnl "])
def test_wrapped_licenses(spark, mark):
    body = MIT_TEXT.split("\n", 1)[1]
    texts = {
        MIT_TEXT: ["MIT"],
        body: ["MIT"],
        BSD_START + BSD_END: ["BSD-2-Clause"],
        BSD_START + BSD_ENDORSE.format("the copyright holder") + BSD_END: ["BSD-3-Clause"],
        BSD_START + BSD_ENDORSE.format("Example Inc. and\n   Sons") + BSD_END: ["BSD-3-Clause"],
        APACHE_TEXT: ["Apache-2.0"],
        GPL_TEXT.format(":", ",", 3): ["GPL-3.0"],
        GPL_TEXT.format(";", ";", 2): ["GPL-2.0"],
        "Released under the\n\nMIT License": ["MIT"],  # the title: a blank line ends a sentence
        "Released under the\n\nGNU General\nthings": [],
    }
    rows = [(i, "\n".join((mark + line).rstrip() for line in text.split("\n"))) for i, text in enumerate(texts)]
    found = {r.row.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert [found[i].licenses for i in range(len(texts))] == list(texts.values())
    assert found[0].sentence_ids == ["title:MIT", "mit-grant", "mit-notice", "mit-warranty", "mit-liability"]
    assert found[3].sentence_ids == ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-warranty"]
    assert found[5].sentence_ids == ["name:Apache-2.0", "apache2-comply", "apache2-copy", "url:Apache-2.0", "apache2-basis", "apache2-see"]


ISC_TEXT = """\
Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL DAMAGES.
"""
LGPL_TEXT = """\
This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU
Lesser General Public License for more details.
"""
SAID = {
    "SPDX-License-Identifier: MIT": ["MIT"],
    "/* SPDX-License-Identifier: (GPL-2.0-only WITH Linux-syscall-note) OR BSD-3-Clause */": ["GPL-2.0-only", "BSD-3-Clause"],
    "# SPDX-License-Identifier: Apache-2.0 OR CC-BY-NC-SA-4.0": ["Apache-2.0", "CC-BY-NC-SA-4.0"],
    "SPDX-License-Identifier: LicenseRef-Unknown": [],
    "This software is released under the MIT license.": ["MIT"],
    "This project is licensed under the MIT License - see the [LICENSE.md](LICENSE.md) file for details.": ["MIT"],
    "The source code is available under the terms of the GNU GPL v3 or later.": ["GPL-3.0-or-later"],
    "Licensed under GPLv2.": ["GPL-2.0"],
    "Licenced under the Mozilla Public Licence, version 2.0!": ["MPL-2.0"],
    "Distributed under the Boost Software License, Version 1.0.": ["BSL-1.0"],
    "Text under https://creativecommons.org/licenses/by-sa/4.0/deed.en, as said.": ["CC-BY-SA-4.0"],
    "See <http://creativecommons.org/licenses/by-nc/3.0/>.": ["CC-BY-NC-3.0"],
    "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.": ["CC-BY-NC-4.0"],
    "The Unlicense": ["Unlicense"],
    "It is licensed under the moon.": [],
    "All rights reserved.": ["All-Rights-Reserved"],
    "I never said licensed under the MIT License to anyone.": [],
}


def test_licenses_by_name_address_and_identifier(spark):
    texts = {**SAID, ISC_TEXT: ["ISC"], LGPL_TEXT: ["LGPL-2.1"], "ISC License\n\nCopyright (c) 2020, Me\n\n" + ISC_TEXT: ["ISC"]}
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r.row.doc_id: r.licenses for r in licenses.scan_licenses(frame).collect()}
    assert {t: found[i] for i, t in enumerate(texts)} == texts


def test_license_sentences_apart():
    """Unknown sentences leave a mark: rules of several sentences do not reach over it. Copyright lines and list numbers leave none."""
    notice = "You may not use this file except in compliance with the License."
    copy = "You may obtain a copy of the License at\nhttp://www.apache.org/licenses/LICENSE-2.0"
    far = notice + "\n" + "Foreign words. " * 200 + "\n" + copy
    assert licenses.sequence(far) == ["apache2-comply", "...", "apache2-copy", "url:Apache-2.0"]
    near = notice + "\n\nCopyright (c) 2020 A. B.\n1.\n" + copy
    assert licenses.licences(licenses.sequence("Foreign. " + near + " Foreign.")) == ["Apache-2.0"]
    source, binary = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. ", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
    assert licenses.licences(licenses.sequence(source + binary)) == ["BSD-2-Clause"]
    assert licenses.licences(licenses.sequence(source + "And more. " + binary)) == []


def test_licenses_in_documents_equal_sql(spark, tmp_path):
    """The given documents with licences wrapped into them, between their lines, marked as comments, side by side and apart."""
    import duckdb
    from compare import rows_of_frame, rows_of_sql

    from mdloom.llm.queries import QUERIES, SQL

    rng = random.Random(11)
    con = duckdb.connect()
    given = con.execute("select doc_id, text from '/root/testdata/sf0.001/documents.parquet' order by doc_id").fetchall()
    bodies = [MIT_TEXT, BSD_START + BSD_END, BSD_START + BSD_ENDORSE.format("Example Inc. and\n   Sons") + BSD_END, APACHE_TEXT, GPL_TEXT.format(";", ";", 2), GPL_TEXT.format(":", ",", 3), ISC_TEXT, LGPL_TEXT, *SAID]
    rows = [(10**6 + i, t) for i, t in enumerate([None, "", *bodies])]
    for doc_id, text in given:
        lines = (text or "").split("\n")
        for body in rng.sample(bodies, rng.randrange(4)):
            mark = rng.choice(["", " * ", "# ", "// ", "dnl ", "> "])
            at = rng.randrange(len(lines) + 1)
            lines[at:at] = [mark + line for line in body.split("\n")]
        rows.append((doc_id, "\n".join(lines)))
    rows += rows[-2:]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    found = rows_of_frame(QUERIES["op3_licenses"](spark, str(tmp_path)))
    assert found == rows_of_sql(con, SQL["op3_licenses"])
    assert sum("," in row[1] for row in found[1]) > 50  # documents with several licences


@pytest.mark.parametrize("holder", ["", "B.V. ", "Some Inc. and Sons. " * 200])
def test_license_holders_of_any_length(holder):
    said = BSD_START + BSD_ENDORSE.format(f"A {holder}Co.") + BSD_END
    assert licenses.licences(licenses.sequence(said)) == ["BSD-3-Clause"]


def test_license_scan_takes_linear_time():
    """Starts of sentences that never end, in one paragraph; sentences that all end; one word a line."""
    import time

    hostile = [
        "Neither the name of me\n" * 40_000,
        (BSD_ENDORSE.format("X").strip() + "\n") * 5_000,
        "licensed\nunder\n" * 40_000,
        ". ! ? ; " * 100_000,
        "this software is " * 100_000,
    ]
    for text in hostile:
        start = time.time()
        licenses.sequence(text)
        assert time.time() - start < 20


def test_known_sentences_find_themselves():
    from mdloom.llm import license_list

    for sentence, identifier in license_list.sentences().items():
        assert licenses.sequence(sentence.upper().replace(" ", "  ")) == [identifier], sentence
    for name, licence in license_list.names().items():
        assert licenses.licences(licenses.sequence(f"This file is licensed under the {name}.")) == [licence], name


def test_chat(spark):
    part = lambda kind, text=None, ref=None, size=None: (kind, text, ref, size)
    hard = r"<|im_end|> <\| <\\|im_start|> \n <|image|>" + "\n<|"
    rows = [
        (1, 0, "user", [part("text", "look "), part("image", ref="a.png", size=1000.0), part("odd", "gone"), part("audio", ref="b.wav", size=1.0), part("text", hard)]),
        (1, 1, "assistant", [part("text", hard), part("document", ref="c.pdf", size=2.0), part("text", None)]),
        (1, 1, "assistant", [part("text", hard), part("document", ref="c.pdf", size=2.0), part("text", None)]),
        (2, None, None, None),
        (None, 0, "as\\sis\ntant", [part("text", "x")]),
    ]
    formatted = chat.format_turns(spark.createDataFrame(rows, f"conv_id bigint, turn bigint, role string, parts {chat.PARTS}"))
    turns = {(r.conv_id, r.turn): r for r in formatted.collect()}
    assert [(a.type, a.ref, a.placeholder, a.tokens) for a in turns[1, 0].attachments] == [("image", "a.png", 0, 2), ("audio", "b.wav", 1, 25)]
    assert turns[1, 0].formatted.count("<|image|>") == 1 and turns[1, 0].formatted.count("<|im_end|>") == 1
    r = turns[1, 1]
    assert chat.unescape(r.formatted[r.loss_start : r.loss_end]) == hard + "<|document|>" and r.attachments[0].tokens == 512
    assert chat.unescape_role(chat.TURN.fullmatch(turns[None, 0].formatted)[1]) == "as\\sis\ntant"
    found = {r.conv_id: r for r in chat.conversation_digests(formatted).collect()}
    assert {k: v.n_turns for k, v in found.items()} == {1: 3, 2: 1, None: 1}
    assert found[1].loss_chars == 2 * len(hard + "<|document|>") and found[2].loss_chars == 0
    assert chat.conversation_digests(formatted.limit(0)).count() == 0


def test_chat_ties_follow_the_text_before_escaping(spark):
    texts = ["<|x", "<a", "<\\|", "a", "a!", "a<", "", "\n", "z\nb", "<|im_end|>", None]
    rows = [(1, 0, "user", [("text", t, None, None)]) for t in texts]
    (found,) = chat.conversation_digests(chat.format_turns(spark.createDataFrame(rows, f"conv_id bigint, turn bigint, role string, parts {chat.PARTS}"))).collect()
    wanted = "".join(f"user\n{t}\n" for t in sorted(t or "" for t in texts))
    assert found.turns_sha256 == hashlib.sha256(wanted.encode()).hexdigest()


def test_bpe(docs, empty, spark):
    from tokenizers import Tokenizer

    from mdloom.llm.queries import TOKENIZER

    library = Tokenizer.from_file(TOKENIZER)
    name = bpe.prepare(docs, TOKENIZER, 50)
    rows = bpe.decode(bpe.encode(docs, name), name).select("row.doc_id", "ids", "decoded").collect()
    assert len(rows) == docs.count()
    for r in rows:
        if r.doc_id is not None:
            ids = library.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids
            assert r.ids == ids and r.decoded == library.decode(ids, skip_special_tokens=False)
    name = bpe.prepare(empty, TOKENIZER)
    assert bpe.encode_and_decode_digests(empty, name).count() == 0
    assert bpe.encode(docs, name).filter("size(ids) > 0").count() == bpe.encode(docs, name).filter("row.doc_id > 2 or row.doc_id is null").filter("size(ids) > 0").count()


def test_bpe_equals_the_library(tmp_path):
    from tokenizers import Tokenizer

    from mdloom.llm.queries import TOKENIZER

    library, rng = Tokenizer.from_file(TOKENIZER), random.Random(4)
    (tmp_path / "book").write_bytes(bpe.pack(bpe.build_book(TOKENIZER, ["the", "then", "hat", "hats", "don", "'t", "."])))
    book = bpe.map_book(str(tmp_path / "book"))
    texts = ["".join(rng.choice("ab'sdtmrevl \n.!1é́ΣİÀ漢<|endoftext|>😀") for _ in range(rng.randrange(60))) for _ in range(500)]
    texts += ["<|endoftext|>the<|startoftext|> <|endoftext|", "a" * 3000, "the" * 400, "don't 'S ''s'll", ""]
    ids, offsets = bpe.encode_texts(book, texts)
    for text, low, high in zip(texts, offsets[:-1], offsets[1:], strict=True):
        expected = library.encode(text, add_special_tokens=False).ids
        assert ids[low:high].tolist() == expected
        assert bpe.decode_ids(book, ids[low:high].astype(np.int64)).decode() == library.decode(expected, skip_special_tokens=False)


def test_automaton_shares_states_and_ranks_words():
    words = sorted({"tap", "taps", "top", "tops", "stop", "stops", "é", "漢字"})
    auto = bpe.minimal_automaton(words)
    letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    size = np.array([len(w) for w in words])
    end = np.cumsum(size)
    assert bpe.ranks_of(auto, letters, end - size, end).tolist() == list(range(len(words)))
    assert bpe.ranks_of(auto, letters, end - size, end - 1).tolist() == [words.index(w[:-1]) if w[:-1] in words else -1 for w in words]
    assert len(auto["final"]) < sum(map(len, words)) // 2 + 1


def test_languages(spark, docs, empty):
    for model in (langid.fit_languages(docs), langid.fit_languages(empty)):
        rows = langid.identify_languages(docs, model).select("row.doc_id", "lang_pred", "score").collect()
        assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
        assert all(r.lang_pred == "und" for r in rows if r.doc_id in (0, 1, 2, 11, 12))
        assert langid.identify_languages(empty, model).count() == 0


def plain_kneser_ney(texts: list[str], alphabet: set[str]):
    """Interpolated Kneser-Ney 4-grams of one language by dictionaries; ``alphabet`` is that of all languages."""
    counts = {4: {}}
    for text in texts:
        letters = re.sub("[^a-z]+", " ", text.lower())
        padded = "   " + letters
        for i in range(3, len(padded)):
            gram = padded[i - 3 : i + 1]
            counts[4][gram] = counts[4].get(gram, 0) + 1
    for order in (3, 2, 1):
        counts[order] = {}
        for gram in counts[order + 1]:
            counts[order][gram[1:]] = counts[order].get(gram[1:], 0) + 1

    def probability(gram: str) -> float:
        if not gram:
            return 1 / (len(alphabet) + 1)
        own = counts[len(gram)]
        ones, twos = (sum(n == k for n in own.values()) for k in (1, 2))
        discount = min(max(ones / max(ones + 2 * twos, 1), 0.1), 0.9)
        follow = [n for g, n in own.items() if g[:-1] == gram[:-1]]
        below = probability(gram[1:])
        if not follow:
            return below
        return max(own.get(gram, 0) - discount, 0) / sum(follow) + discount * len(follow) / sum(follow) * below

    return probability


def test_kneser_ney_equals_plain_dictionaries(spark):
    rng = random.Random(5)
    rows = [(i, " ".join("".join(rng.choice("abcd" if i % 2 else "bcde") for _ in range(rng.randrange(1, 6))) for _ in range(30)), "xy"[i % 2]) for i in range(24)]
    model = langid.fit_languages(spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(5))
    learned = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    alphabet = set("abcde ")
    plain = [plain_kneser_ney([t for _, t, lang in learned if lang == own], alphabet) for own in model.langs]
    grams = ["".join(rng.choice("abcde ") for _ in range(4)) for _ in range(300)] + ["   a", "   e"]
    found = np.exp(langid.log_probabilities(model, np.array([[*map(ord, g)] for g in grams], np.uint32)))
    assert np.allclose(found, [[p(g) for p in plain] for g in grams], rtol=1e-5)
    texts = ["abca ddca", "edce bceb", "abe"]
    for text, costs in zip(texts, langid.entropies(model, texts)[0], strict=True):
        padded = "   " + text
        assert np.allclose(costs, [-np.mean([np.log(p(padded[i - 3 : i + 1])) for i in range(3, len(padded))]) for p in plain], rtol=1e-5)


def test_language_files_join_in_order(tmp_path, monkeypatch):
    """Files of a model come in any order; some are without rows."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    keys = np.sort(np.random.default_rng(1).integers(0, 2**64, 900, np.uint64))
    keys[-1] = 2**64 - 1
    values = np.arange(1800, dtype="<f4").reshape(900, 2)
    names = []
    for n, (low, high) in enumerate([(400, 900), (0, 300), (300, 300), (300, 400)]):
        cut = [(low + i, min(low + i + 70, high)) for i in range(0, high - low, 70)]
        table = pa.table({"keys": pa.array([keys[a:b].tobytes() for a, b in cut], pa.binary()), "values": pa.array([values[a:b].tobytes() for a, b in cut], pa.binary())})
        names.append(f"part-{n}.parquet")
        pq.write_table(table, tmp_path / names[-1])
    monkeypatch.setattr(langid.SparkFiles, "get", classmethod(lambda cls, name: str(tmp_path / name)))
    monkeypatch.setattr(langid.SparkFiles, "getRootDirectory", classmethod(lambda cls: str(tmp_path)))
    found = langid._mapped(tuple(names))
    assert (found[0] == keys).all() and (found[1] == values).all()


def test_language_models_keep_every_gram(spark):
    rng = np.random.default_rng(7)
    symbols = rng.integers(0x4E00, 0x4E00 + 20_000, (30, 18_000)).astype("<u4")
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 4 != 2][: len(symbols)]  # outside the held-out fold
    rows = [(i, s.tobytes().decode("utf-32-le"), "zh") for i, s in zip(ids, symbols, strict=True)]
    model = langid.fit_languages(spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(8))
    grams = np.stack([symbols[:, j : j + 17_997].ravel() for j in range(4)], axis=1)  # over 500 000, nearly all of them once
    assert langid.log_probabilities(model, grams).min() > -3
    other = grams[:1000].copy()
    other[:, 3] = grams[-1000:, 3]
    assert langid.log_probabilities(model, other).max() < -3


def test_quality(spark, docs, empty):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(13)] + [(3, None, 1), (None, 1, 1)], "doc_id bigint, quality bigint, toxic bigint")
    for rules in (quality.fit_quality(docs, labels), quality.fit_quality(empty, labels), quality.fit_quality(docs, labels.limit(0))):
        rows = quality.judge_quality(docs, rules).select("row.doc_id", "n_words", "base_failed", "kept").collect()
        assert len(rows) == docs.count() and all(not r.kept for r in rows if r.base_failed)
        assert quality.judge_quality(empty, rules).count() == 0


def test_quality_learns_a_list():
    import pandas as pd

    rng = np.random.default_rng(2)
    rows = pd.DataFrame({f: rng.random(3000) for f in quality.FEATURES})
    bad = ((rows["symbol_share"] > 0.8) | ((rows["n_words"] <= 0.3) & (rows["digit_share"] > 0.7))).to_numpy()
    rules = quality.learn_rules(rows, bad)
    said = np.zeros(len(rows), bool)
    for rule in rules:
        said |= quality.covers(rule, rows)
    assert len(rules) >= 2 and (said & bad).sum() > 0.9 * bad.sum() and (said & ~bad).sum() < 0.05 * bad.sum()
    assert quality.rules_sql(rules).startswith("case when ") and quality.rules_sql([]) == "0"


def test_leaks(spark, docs, empty):
    items = spark.createDataFrame([(1, PASSAGE), (2, None), (3, ""), (4, "one two three"), (1, PASSAGE)], "item_id bigint, text string")
    rows = decontaminate.find_leaks(docs, items).select("row.doc_id", "text", "matches").collect()
    assert len(rows) == docs.count()
    found = {r.doc_id: [m.item_id for m in r.matches] for r in rows}
    assert [i for i, m in found.items() if m == [1]] == [6, 7, 8] and found[4] == [4] and not found[0] and not found[5]
    assert decontaminate.find_leaks(empty, items).count() == 0
    assert decontaminate.find_leaks(docs, items.limit(0)).filter("size(matches) > 0").count() == 0


def test_leaks_with_edits_and_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 300)
    rng, rows, items = random.Random(9), [], []
    for i in range(40):
        words = [f"k{rng.randrange(10**6)}" for _ in range(rng.randrange(10, 60))]
        items.append((i, " ".join(words)))
        changed = list(words)
        for _ in range(len(words) // decontaminate.ERROR_EVERY):
            at = rng.randrange(len(changed))
            kind = rng.randrange(3)
            changed[at : at + (kind > 0)] = [] if kind == 1 else ["new"]
        rows.append((i, "Some text, " + ", ".join(changed).upper() + "! And more."))
    items.append((40, "ΟΔΟΣ ΝΕΟΣ ΦΙΛΟΣ İSTANBUL"))
    rows.append((40, "before ΟΔΟΣ ΝΕΟΣ ΦΙΛΟΣ İSTANBUL after"))
    found = decontaminate.find_leaks(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    assert {r.doc_id: r.ids for r in found.selectExpr("row.doc_id", "matches.item_id as ids").collect()} == {i: [i] for i in range(41)}


@given(st.lists(st.integers(0, 3), min_size=1, max_size=8), st.lists(st.integers(0, 3), max_size=14))
@settings(max_examples=300, deadline=None)
def test_bit_parallel_distance(item, text):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    expected = min(distance(item, text[i:j]) for i in range(len(text) + 1) for j in range(i, len(text) + 1))
    assert decontaminate.best_match(np.array(item, np.uint64), np.array(text, np.uint64))[0] == expected


def test_stages(spark, docs, empty, tmp_path):
    for table, kind in (("labels", "doc_id bigint, quality bigint, toxic bigint"), ("benchmark", "item_id bigint, text string")):
        spark.createDataFrame([(3, 1, 0), (4, 0, 1)] if table == "labels" else [(1, "one two three")], kind).write.parquet(f"{tmp_path}/{table}.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name
        assert stage(spark, docs, str(tmp_path)).count() <= docs.count()
        assert stage(spark, empty, str(tmp_path)).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == docs.count()


def test_rows_without_or_with_one_id_stay_apart(spark):
    rng = random.Random(3)
    text = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))
    base, nine = text(), text()
    copy = base.rsplit(" ", 2)[0] + " other words"
    rows = [(5, base), (7, text()), (None, copy), (None, text()), (None, text()), (9, nine), (9, text()), (9, text()), (9, nine + " more"), (None, None), (10, ""), (10, ""), (7, base + " x")]
    frame = spark.createDataFrame([(i, t, "extra", 1) for i, t in rows], "doc_id bigint, text string, id string, hash int").repartition(3)
    kept = sorted(map(tuple, neardup.one_of_each(frame).select("doc_id", "text").collect()), key=repr)
    assert neardup.one_of_each(frame).columns == frame.columns
    gone = [(None, copy), (7, base + " x")]
    nines = [k for k in kept if k[1] in (nine, nine + " more")]
    assert len(nines) == 1  # one of the two that are linked
    expected = sorted({r for r in rows if r not in gone and r not in [(9, nine), (9, nine + " more")]} | set(nines), key=repr)
    assert kept == expected
    found = neardup.near_duplicates(frame).collect()
    assert len(found) == len(rows)
    assert sorted((r.component_id, r.n_shingles) for r in found if r.doc_id is None and r.component_id is not None) == [(5, len(copy.split()) - 4)]
    assert all(r.kept == (r.doc_id == r.component_id) for r in found if r.doc_id is not None)


def test_hot_rows_without_id(spark):
    rows = [(None, PASSAGE)] * 300 + [(None, PASSAGE + " z")] * 300 + [(None, "a b c d e f")]
    kept = neardup.one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()
    assert len(kept) == 2


def test_hostile_pages():
    model = pages.learn_content([])
    good = "The first paragraph of the story, with a clause, and a stop."
    article = f"<article data-gold='x'><p>{good}</p><p>So <math>E=mc2</math> it is, with <object>a fallback</object> and <canvas>more</canvas>.</p><noscript><p>Also here, in a sentence of its own.</p></noscript></article>"
    wanted = f"{good}\nSo E=mc2 it is, with a fallback and more.\nAlso here, in a sentence of its own."
    assert pages.main_texts(model, [article, article.replace("'x'", '"0"'), article.replace("'x'", "")]) == [wanted] * 3
    for tag in ("object", "template", "svg", "select", "canvas", "math", "noscript"):
        assert pages.main_texts(model, [f"<article><p>{good}</p><{tag}><p>{good}</p></article>"]) == [f"{good}\n{good}"], tag
    assert pages.main_texts(model, [f"<article><p>{good}</p><svg><text>axis</text></svg><template><p>{good}</p></template><script>x"]) == [good]
    assert pages.main_texts(model, ["<svg>" * 20_000 + good])  # linear


@given(st.integers(0, 10**6), st.integers(1, 9))
@settings(max_examples=60, deadline=None)
def test_marginals_equal_enumeration(seed, size):
    import itertools

    rng = random.Random(seed)
    model, trees = pages.learn_content([]), pages.Trees()
    kinds = sorted(model.links)
    for i in range(size):
        trees.add(0, rng.randrange(i) if i else -1, rng.choice(kinds), (), "t" if rng.random() < 0.5 else None, None)
        trees.signs[-1] = (rng.choice(sorted(model.signs)),)
    own, link = model.unary(trees), model.pairwise(trees)
    total, content = 0.0, np.zeros(size)
    for labels in itertools.product((0, 1), repeat=size):
        # a root is given a parent of either label, evenly
        weight = np.exp(sum(own[i, x] + (link[i, labels[trees.parent[i]], x] if i else np.logaddexp(link[0, 0, x], link[0, 1, x]) + np.log(0.5)) for i, x in enumerate(labels)))
        total += weight
        content += weight * np.array(labels)
    assert np.allclose(pages.content_marginals(model, trees), content / total, atol=1e-9)


def test_language_limits_cover_every_labelled_text(spark):
    rng = np.random.default_rng(5)
    rows = [(i, "".join(rng.choice(list("aeiou nrst"), int(rng.integers(3, 60)))), "xx" if i % 5 else "yy") for i in range(1500)]
    rows += [(1500 + i, "".join(rng.choice(list("kqwz x"), 25_000)), "xx") for i in range(8)] + [(2000, "", "xx"), (None, "zzz qqq", "yy")]
    model = langid.fit_languages(spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(6))
    learned = [(t, model.langs.index(lang)) for i, t, lang in rows if t and (i is None or zlib.crc32(str(i).encode()) % 4 != 2)]
    costs = langid.entropies(model, [t for t, _ in learned])[0]
    for at in range(len(model.langs)):
        assert model.limit[at] == pytest.approx(np.quantile([c[at] for c, (_, own) in zip(costs, learned, strict=True) if own == at], 0.999), abs=1e-9)
