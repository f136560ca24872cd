"""Benchmark passages in documents: pigeonhole pieces find them, Myers' bit-parallel distance verifies them.

Texts are compared as lower-cased words, where a word is a run of characters other than ASCII white space and punctuation. A test item of n
words tolerates e = n // ERROR_EVERY word edits (insertion, deletion, replacement). Cut into e + 1 pieces, at least one piece stands
unchanged wherever the item occurs with e edits or fewer. Pieces are found by hash in every window of their length; each hit names a
stretch of the document, and Myers' algorithm finds the least distance of the whole item to any part of it. Items under ERROR_EVERY words
must occur exactly; items without words never match.

Test items are held by every task, in blocks of about ``BLOCK_BYTES`` of text (measured first). A larger set of items takes several passes, and
the rows are written down between two of them, so that driver and tasks hold one block at a time; documents are never shuffled.

Null and empty texts and items match nothing; repeated documents are judged alike; repeated items count once; items without id are kept
under a null id. Other columns are carried along in a struct, so that no name can clash.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mdloom.llm.common import STEP, Stage, Words, mix64, text_runs, words_of

ERROR_EVERY = 7
BLOCK_BYTES = 8 << 20
SIEVE_BITS = 20
MATCHES = "array<struct<item_id:bigint,distance:int,first_word:int,last_word:int>>"
_MATCHES_ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("first_word", pa.int32()), ("last_word", pa.int32())]))
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[x for x in range(128) if not chr(x).isalnum()]] = True


def item_words(text: str | None) -> np.ndarray:
    folded = pc.utf8_lower(pa.scalar(text or "")).as_py()  # as the documents are
    data = np.frombuffer(folded.encode(), np.uint8)
    return words_of(data, np.array([0, len(data)]), space=SEPARATOR).hash


def pieces_of(count: int) -> list[tuple[int, int]]:
    """(offset, length) of the pieces of an item of ``count`` words: one more than the edits it tolerates."""
    parts = count // ERROR_EVERY + 1
    cuts = [count * k // parts for k in range(parts + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def best_match(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Myers: least edit distance of the whole item to any stretch of the text, and the stretch's last word (-1: the empty one)."""
    size = len(item)
    place = defaultdict(int)
    for i, word in enumerate(item.tolist()):
        place[word] |= 1 << i
    full, top = (1 << size) - 1, 1 << (size - 1)
    up, down, distance, best, last = full, 0, size, size, -1
    for j, word in enumerate(text.tolist()):
        equal = place.get(word, 0)
        across = (((equal & up) + up) ^ up) | equal | down
        plus, minus = down | (full & ~(across | up)), up & across
        distance += bool(plus & top) - bool(minus & top)
        plus, minus = (plus << 1) & full, (minus << 1) & full
        vertical = equal | down
        up, down = minus | (full & ~(vertical | plus)), plus & vertical
        if distance < best:
            best, last = distance, j
    return best, last


@dataclass
class Items:
    """A block of test items and its pieces, sorted by hash within each length."""

    ids: list[int | None]
    words: list[np.ndarray]
    pieces: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def item_block(rows: list[tuple[int | None, str | None]]) -> Items:
    ids, words, pieces = [], [], defaultdict(list)
    for item_id, text in sorted(set(rows), key=lambda x: (x[0] is None, x[0] or 0, x[1] or "")):
        found = item_words(text)
        if not len(found):
            continue
        for offset, length in pieces_of(len(found)):
            value = np.zeros(1, np.uint64)
            for word in found[offset : offset + length]:
                value = value * STEP + word
            pieces[length].append((int(mix64(value)[0]), len(ids), offset))
        ids.append(item_id)
        words.append(found)
    tables = {}
    for length, entries in pieces.items():
        entries.sort()
        hashes = np.array([e[0] for e in entries], np.uint64)
        sieve = np.zeros(1 << SIEVE_BITS, bool)
        sieve[(hashes >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)] = True
        tables[length] = (hashes, np.array([e[1] for e in entries]), np.array([e[2] for e in entries]), sieve)
    return Items(ids, words, tables)


def _piece_hits(items: Items, words: Words) -> set[tuple[int, int, int]]:
    """(text, item, word at which the item would begin) for each piece that occurs."""
    hits: set[tuple[int, int, int]] = set()
    value = np.zeros(len(words.hash), np.uint64)
    for length in range(1, max(items.pieces, default=0) + 1):
        count = len(words.hash) - length + 1
        if count <= 0:
            break
        value = value[:count] * STEP + words.hash[length - 1 :]
        if length not in items.pieces:
            continue
        hashes, owner, offset, sieve = items.pieces[length]
        windows = mix64(value)
        some = np.flatnonzero(sieve[(windows >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)])
        some = some[words.text[some] == words.text[some + length - 1]]
        low, high = np.searchsorted(hashes, windows[some]), np.searchsorted(hashes, windows[some], "right")
        for at, a, b in zip(some[high > low].tolist(), low[high > low].tolist(), high[high > low].tolist(), strict=True):
            hits.update((int(words.text[at]), int(owner[k]), at - int(offset[k])) for k in range(a, b))
    return hits


def _verified(items: Items, words: Words) -> dict[int, list[tuple[int | None, int, int, int]]]:
    """Matches by text: item, distance, first and last word of the stretch searched that the match ends in."""
    found = defaultdict(dict)
    stretches: dict[tuple[int, int], list[list[int]]] = defaultdict(list)
    for text, item, begin in sorted(_piece_hits(items, words)):
        size = len(items.words[item])
        slack = size // ERROR_EVERY
        low, high = max(begin - slack, int(words.first[text])), min(begin + size + slack, int(words.first[text + 1]))
        known = stretches[text, item]
        if known and low <= known[-1][1] - size:  # the same place again, or next to it
            known[-1][1] = max(known[-1][1], high)
        else:
            known.append([low, high])
    for (text, item), places in stretches.items():
        for low, high in places:
            distance, last = best_match(items.words[item], words.hash[low:high])
            if distance <= len(items.words[item]) // ERROR_EVERY:
                begin = int(words.first[text])
                match = (distance, max(low, low + last - len(items.words[item]) - distance + 1) - begin, low + last - begin)
                key = items.ids[item]
                found[text][key] = min(found[text].get(key, match), match)
    return {t: [(k, *m) for k, m in sorted(by.items(), key=lambda x: (x[0] is None, x[0] or 0))] for t, by in found.items()}


def _search(items: Items) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            folded = batch.set_column(batch.schema.get_field_index("text"), "text", pc.utf8_lower(batch.column("text")))
            matches = [[dict(zip(("item_id", "distance", "first_word", "last_word"), m.values(), strict=True)) for m in x] for x in batch.column("matches").to_pylist()]
            for low, _high, data, offsets in text_runs(folded):
                for text, rows in _verified(items, words_of(data, offsets, space=SEPARATOR)).items():
                    matches[low + text] += [dict(zip(("item_id", "distance", "first_word", "last_word"), r, strict=True)) for r in rows]
            yield batch.set_column(batch.schema.get_field_index("matches"), "matches", pa.array(matches, _MATCHES_ARROW))

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs(text, ...)`` as ``row`` (all columns but ``text``), ``text`` and ``matches``: per item its best match.

    ``matches`` holds item_id, distance in words, and the first and last word of the stretch; it is empty for clean documents.
    """
    items = benchmark.select(F.col("item_id").cast("bigint"), "text").filter("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-int(total) // BLOCK_BYTES))
    stage = Stage(docs.sparkSession, "decontaminate")
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*rest).alias("row") if rest else F.lit(None).alias("row"), "text", F.array().cast(MATCHES).alias("matches"))
    for k in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) if blocks > 1 else items
        rows = rows.mapInArrow(_search(item_block([tuple(r) for r in part.collect()])), rows.schema)
        if k < blocks - 1:
            rows = stage.write(rows, f"block-{k}")
            if k:
                stage.drop(f"block-{k - 1}")
    return rows
