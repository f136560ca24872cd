"""Registered queries against their SQL, and the others against brute force, at the smallest scale."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections import Counter

import duckdb
import pytest
from compare import connect, rows_of_frame, rows_of_sql
from tokenizers import Tokenizer

import corpus_pipeline
from mdloom.llm.queries import QUERIES, SQL, TOKENIZER

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows(sql: str) -> list[tuple]:
    con = duckdb.connect()
    return con.execute(sql.replace("@", FOLDER)).fetchall()


def texts() -> dict[int, str]:
    return {i: t or "" for i, t in rows("select doc_id, text from '@/documents.parquet'")}


def result(spark, name: str) -> dict[int, dict]:
    found = [r.asDict() for r in QUERIES[name](spark, FOLDER).collect()]
    key = next(iter(found[0]))
    return {r[key]: r for r in found}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    assert rows_of_frame(QUERIES[name](spark, FOLDER)) == rows_of_sql(connect(FOLDER), SQL[name])


def test_every_operator_has_one_query():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))


def test_toxicity_scores(spark):
    found = result(spark, "op1_toxicity")
    assert found.keys() == texts().keys()
    for i, r in found.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)


def test_main_text_is_the_article(spark):
    import html

    found = result(spark, "op2_main_text")
    for page_id, source in rows("select page_id, html from '@/pages.parquet'"):
        article = source[source.index("<article>") + 9 : source.index("</article>")]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        expected = "\n".join(b for b in blocks if b)
        assert (found[page_id]["text"], found[page_id]["n_chars"]) == (expected, len(expected))


def test_tokens_equal_the_library(spark):
    library, found = Tokenizer.from_file(TOKENIZER), result(spark, "op6_bpe")
    for i, text in texts().items():
        ids = library.encode(text, add_special_tokens=False).ids
        digest = hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        decoded = hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        assert (found[i]["n_tokens"], found[i]["ids_sha256"], found[i]["decoded_sha256"]) == (len(ids), digest, decoded)


def test_language_of_held_out_documents(spark):
    found = result(spark, "op7_language")
    langs = dict(rows("select doc_id, lang from '@/documents.parquet' where lang is not null"))
    held = [i for i in langs if found[i]["held_out"]]
    assert sum(found[i]["lang_pred"] == langs[i] for i in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in found.values())


def quality_base(text: str) -> tuple:
    words = WORD.findall(text)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    count = Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if count[w] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def test_quality_counts(spark):
    found = result(spark, "op9_quality")
    for i, text in texts().items():
        r = found[i]
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == quality_base(text)
        assert not (r["base_failed"] and r["kept"])


def test_benchmark_passages_are_found(spark):
    found = result(spark, "op10_decontamination")
    items = rows("select item_id, text from '@/benchmark.parquet'")
    for i, text in texts().items():
        assert {k for k, t in items if t in text} <= set(found[i]["item_ids"])
    assert sum(r["contaminated"] for r in found.values()) < 0.1 * len(found)


def test_pipeline_by_hand(spark):
    """Each stage's decisions, recomputed on the stage's own input."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns
        before = {r.doc_id: r.text for r in docs.collect()}
        out = spark.createDataFrame(out.collect(), docs.schema)
        kept[name] = (before, {r.doc_id: r.text for r in out.collect()})
        docs = out
    for before, after in kept.values():
        assert after.keys() <= before.keys()
    before, after = kept["near_dedup"]
    assert all(after[i] == before[i] for i in after) and len(after) < len(before)
    before, after = kept["substring_dedup"]
    assert after.keys() == before.keys()
    seen = set()
    for i in sorted(before):
        words = WORD.findall(before[i])
        gone = set()
        for k in range(len(words) - 19):
            window = tuple(words[k : k + 20])
            gone |= set(range(k, k + 20)) if window in seen else set()
            seen.add(window)
        assert after[i] == (" ".join(w for k, w in enumerate(words) if k not in gone) if gone else before[i])
    before, after = kept["decontamination"]
    items = [t for (t,) in rows("select text from '@/benchmark.parquet'")]
    assert all(i not in after for i, t in before.items() if any(x in t for x in items))
    library = Tokenizer.from_file(TOKENIZER)
    last = {r.doc_id: r.n_tokens for r in corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()}
    assert last == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in after.items()}
    assert {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, FOLDER).collect()} == last
