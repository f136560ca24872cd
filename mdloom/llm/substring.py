"""Repeated passages: remove each word that an earlier-started 20-word window covers again.

Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. A window is 20 consecutive words of one document. It repeats when the same words also start
earlier: in a document with a smaller doc_id, or earlier in the same document. All words of repeating windows are removed, judged on the
input.

* **Anchors.** {0, 1, 3, 9} is a difference cover of 13: for any two positions i, j there is k < 13 so that both (i + k) mod 13 and
  (j + k) mod 13 are in the cover. Two equal 20-word windows so share an aligned 8-word anchor that starts at a cover position in both.
  Only anchors (4 of 13 positions) are hashed and shuffled, and those that occur twice are found.
* **Extension.** Only windows that contain an anchor found twice can repeat. Their full hashes are shuffled, and the earliest start of
  each is found: every other occurrence repeats. So chance anchors and short matches fall out here.
* **Skew.** A task settles all but one occurrence of a hash among the entries it holds; a hash that a third of all documents share reaches
  the shuffle once per ``HELD`` entries. Entries travel in packed rows per bucket (of hashes, then of documents); a partition is sorted by
  bucket, and one bucket is held at a time. What is known about a document's places comes back as one row of intervals.

Windows are compared by 64-bit hashes of their words. Null and empty texts have no words. Repeated rows tie, so neither makes the other
repeat; rows of one doc_id are versions of one document; rows without doc_id count as one document behind all others. Other columns are
carried along unread.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mdloom.llm.common import NO_ID, mix64, partitions, text_runs, window_hashes, words_of

WINDOW_WORDS = 20
PERIOD = 13
COVER = (0, 1, 3, 9)  # fixed values: every difference modulo 13 occurs
ANCHOR_WORDS = WINDOW_WORDS - PERIOD + 1
HELD = 500_000  # entries that a task holds before it packs them
BUCKETS_EACH = 2  # buckets of hashes per shuffle partition; of documents, one
SETTLED_ROW = 50_000  # entries of a packed row that need no more comparing
PACKED = "bucket int, settled boolean, keys binary, ids binary, versions binary, places binary"
INTERVALS = "id bigint, version int, begins array<int>, ends array<int>"
ENTRY = np.dtype([("key", "<u8"), ("id", "<i8"), ("version", "<i4"), ("at", "<i4")])
Batches = Iterator[pa.RecordBatch]


def _entries(keys: np.ndarray, ids: np.ndarray, versions: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = np.empty(len(keys), ENTRY)
    out["key"], out["id"], out["version"], out["at"] = keys, ids, versions, at
    return out


def _settle(entries: np.ndarray, every: bool, partial: bool) -> tuple[np.ndarray, np.ndarray]:
    """Entries whose place is known to repeat, and those to be compared with entries elsewhere.

    ``every``: any occurrence of a key that occurs twice repeats (anchors); else only those that start later than the first (windows).
    ``partial``: other entries of these keys may be elsewhere, so the first of each key goes on to meet them.
    """
    order = np.lexsort((entries["at"], entries["id"], entries["key"]))
    entries = entries[order]
    key = entries["key"]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    lead = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    if every:
        repeats = ~new
        repeats[:-1] |= ~new[1:]
    else:
        first = entries[lead]
        repeats = (entries["id"] != first["id"]) | (entries["at"] != first["at"])
    return entries[repeats], entries[new if every else ~repeats] if partial else entries[:0]


def _narrow(values: np.ndarray) -> bytes:
    """Whole numbers from 0 on in as few bytes each as the largest needs; nothing if all are 0."""
    most = int(values.max(initial=0))
    if int(values.min(initial=0)) < 0:
        return b"q" + values.astype("<i8").tobytes()
    kind = "" if most == 0 else next(k for k, top in (("B", 1 << 8), ("H", 1 << 16), ("I", 1 << 32), ("q", 1 << 63)) if most < top)
    return kind.encode() + values.astype(f"<{kind}").tobytes() if kind else b""


def _wide(data: bytes, count: int) -> np.ndarray:
    return np.frombuffer(data, f"<{data[:1].decode()}", offset=1).astype(np.int64) if data else np.zeros(count, np.int64)


def _packed(entries: np.ndarray, bucket: np.ndarray, settled: bool) -> pa.RecordBatch:
    """One row per bucket; in it entries by document and place, which compress well."""
    order = np.lexsort((entries["at"], entries["version"], entries["id"], bucket))
    entries, bucket = entries[order], bucket[order]
    cuts = np.concatenate(([0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]))
    spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
    column = lambda cut: pa.array([cut(entries[a:b]) for a, b in spans], pa.binary())
    ids = column(lambda e: e["id"][:1].tobytes() + len(e).to_bytes(8, "little") + _narrow(np.diff(e["id"])))
    keys = column(lambda e: b"" if settled else e["key"].tobytes())
    versions, places = column(lambda e: _narrow(e["version"])), column(lambda e: _narrow(e["at"]))
    return pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]].astype(np.int32)), pa.array([settled] * len(spans)), keys, ids, versions, places], names=["bucket", "settled", "keys", "ids", "versions", "places"])


def _unpacked(keys: bytes, ids: bytes, versions: bytes, places: bytes) -> np.ndarray:
    first, count = np.frombuffer(ids, "<i8", 2).tolist()
    steps = np.concatenate(([first], _wide(ids[16:], count - 1)))
    return _entries(np.frombuffer(keys, "<u8") if keys else np.zeros(count, np.uint64), np.cumsum(steps), _wide(versions, count), _wide(places, count))


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)


def _sent(parts: Iterator[np.ndarray], every: bool, buckets: int) -> Batches:
    def given(held: list[np.ndarray]) -> Batches:
        settled, open_ = _settle(np.concatenate(held), every, partial=True)
        if len(open_):
            yield _packed(open_, _bucket(open_["key"], buckets), settled=False)
        settled = settled[np.lexsort((settled["at"], settled["id"]))]
        for low in range(0, len(settled), SETTLED_ROW):
            part = settled[low : low + SETTLED_ROW]
            yield _packed(part, np.repeat(_bucket(part["key"][:1], buckets), len(part)), settled=True)

    held: list[np.ndarray] = []
    for part in parts:
        held.append(part)
        if sum(map(len, held)) >= HELD:
            yield from given(held)
            held = []
    if held:
        yield from given(held)


def _of_words(batch: pa.RecordBatch, low: int, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return tuple(batch.column(c).to_numpy(zero_copy_only=False)[low + text] for c in ("id", "version"))


def _anchors(batches: Batches) -> Iterator[np.ndarray]:
    for batch in batches:
        for low, _high, data, offsets in text_runs(batch):
            words = words_of(data, offsets)
            hashes, inside = window_hashes(words, ANCHOR_WORDS)
            count = len(hashes)
            at = np.arange(len(words.hash)) - words.first[words.text]
            long_enough = np.diff(words.first)[words.text] >= WINDOW_WORDS
            chosen = np.flatnonzero(inside & np.isin(at % PERIOD, COVER)[:count] & long_enough[:count])
            yield _entries(hashes[chosen], *_of_words(batch, low, words.text[chosen]), at[chosen])


def _candidate_windows(batches: Batches) -> Iterator[np.ndarray]:
    """Windows that contain an anchor found twice."""
    for batch in batches:
        for low, high, data, offsets in text_runs(batch):
            words = words_of(data, offsets)
            hashes, inside = window_hashes(words, WINDOW_WORDS)
            if not len(hashes):
                continue
            edge = np.zeros(len(words.hash) + 1, np.int64)
            begins, ends = (batch.column(c).slice(low, high - low) for c in ("begins", "ends"))
            count = np.diff(begins.offsets.to_numpy())
            base = np.repeat(words.first[:-1], count)
            np.add.at(edge, base + np.maximum(begins.flatten().to_numpy() - PERIOD + 1, 0), 1)
            np.add.at(edge, base + ends.flatten().to_numpy() + 1, -1)
            chosen = np.flatnonzero(inside & (np.cumsum(edge)[: len(hashes)] > 0))
            yield _entries(hashes[chosen], *_of_words(batch, low, words.text[chosen]), chosen - words.first[words.text[chosen]])


def _received(every: bool, buckets: int) -> Callable[[Batches], Batches]:
    """Packed rows sorted by bucket of hashes to the places that repeat, packed by bucket of documents."""

    def run(batches: Batches) -> Batches:
        bucket, open_, done = None, [], []

        def given() -> pa.RecordBatch:
            entries = np.concatenate(done)
            done.clear()
            return _packed(entries, _bucket(mix64(entries["id"].view(np.uint64)), buckets), settled=True)

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("bucket", "settled", "keys", "ids", "versions", "places")]
            for at, known, *packed in zip(*columns, strict=True):
                if at != bucket and open_:
                    done.append(_settle(np.concatenate(open_), every, partial=False)[0])
                    open_ = []
                bucket = at
                (done if known else open_).append(_unpacked(*packed))
                if sum(map(len, done)) >= HELD:
                    yield given()
        if open_:
            done.append(_settle(np.concatenate(open_), every, partial=False)[0])
        if sum(map(len, done)):
            yield given()

    return run


def _merged(reach: int) -> Callable[[Batches], Batches]:
    """Packed rows sorted by bucket of documents to one row per document: intervals of places at most ``reach`` apart."""

    def intervals(entries: np.ndarray) -> pa.RecordBatch:
        entries = entries[np.lexsort((entries["at"], entries["version"], entries["id"]))]
        new = np.ones(len(entries), bool)
        new[1:] = (entries["id"][1:] != entries["id"][:-1]) | (entries["version"][1:] != entries["version"][:-1])
        apart = new.copy()
        apart[1:] |= np.diff(entries["at"]) > reach
        begin = np.flatnonzero(apart)
        end = np.concatenate((begin[1:], [len(entries)])) - 1
        offsets = pa.array(np.concatenate((np.searchsorted(begin, np.flatnonzero(new)), [len(begin)])).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(entries["at"][x])) for x in (begin, end)]
        return pa.RecordBatch.from_arrays([pa.array(entries["id"][new]), pa.array(entries["version"][new]), *lists], names=["id", "version", "begins", "ends"])

    def run(batches: Batches) -> Batches:
        bucket, open_ = None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("bucket", "keys", "ids", "versions", "places")]
            for at, *packed in zip(*columns, strict=True):
                if at != bucket and open_:
                    yield intervals(np.concatenate(open_))
                    open_ = []
                bucket = at
                open_.append(_unpacked(*packed))
        if open_:
            yield intervals(np.concatenate(open_))

    return run


def _kept(batches: Batches) -> Batches:
    for batch in batches:
        kept, counts, removed, left = [], [], [], []
        for text, begins, ends in zip(batch.column("text"), batch.column("begins"), batch.column("ends"), strict=True):
            words = (text.as_py() or "").encode().split()
            counts.append(len(words))
            if not begins.is_valid:
                removed.append(0)
                kept.append(b" ".join(words))
                left.append(text.as_py())
                continue
            keep = np.ones(len(words), bool)
            for low, high in zip(begins.values.to_pylist(), ends.values.to_pylist(), strict=True):
                keep[low : high + WINDOW_WORDS] = False
            removed.append(int(len(words) - np.count_nonzero(keep)))
            kept.append(b" ".join(compress(words, keep.tolist())))
            left.append(kept[-1].decode())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("row"),
                pa.array(left, pa.string()),
                pa.array(counts, pa.int64()),
                pa.array(removed, pa.int64()),
                pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
            ],
            names=["row", "text", "n_words", "n_removed", "kept_sha256"],
        )


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Rows of ``docs(doc_id, text, ...)`` as ``row`` (all input columns but ``text``), ``text, n_words, n_removed, kept_sha256``.

    ``text`` is the input's where nothing is removed, else the words left joined by one space; ``kept_sha256`` is the digest of the words
    left, joined by one space, for every row. Input columns stay apart in the struct ``row``, so that no name can clash.
    """
    count = partitions(docs.sparkSession)
    buckets = count * BUCKETS_EACH
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    key = F.coalesce("doc_id", F.lit(NO_ID))
    once = docs.groupBy(key).count().filter("count > 1").isEmpty()
    # Tells rows of one doc_id apart. Where none are, it is 0, but no literal: that would give the two joins different plans of the texts.
    version = F.hash(key).bitwiseAND(F.lit(0)) if once else F.hash("text")
    texts = docs.select(key.alias("id"), version.alias("version"), F.struct(*rest).alias("row"), "text")
    by_id = texts.repartition(count, "id", "version")  # one exchange of the texts, read twice

    def dealt(packed: DataFrame, each: int) -> DataFrame:  # every partition gets as many buckets
        return packed.repartitionById(count, (F.col("bucket") / each).cast("int")).sortWithinPartitions("bucket")

    def places(packed: DataFrame, every: bool, reach: int) -> DataFrame:
        found = dealt(packed, BUCKETS_EACH).mapInArrow(_received(every, count), PACKED)
        return dealt(found, 1).mapInArrow(_merged(reach), INTERVALS)

    anchors = texts.select("id", "version", "text").mapInArrow(lambda batches: _sent(_anchors(batches), True, buckets), PACKED)
    marked = by_id.join(places(anchors, every=True, reach=PERIOD), ["id", "version"]).select("id", "version", "row", "text", "begins", "ends")
    windows = marked.mapInArrow(lambda batches: _sent(_candidate_windows(batches), False, buckets), PACKED)
    schema = f"row {texts.schema['row'].dataType.simpleString()}, text string, n_words bigint, n_removed bigint, kept_sha256 string"
    marks = places(windows, every=False, reach=WINDOW_WORDS)
    return by_id.join(marks, ["id", "version"], "left").select("row", "text", "begins", "ends").mapInArrow(_kept, schema)
