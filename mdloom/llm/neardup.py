"""Near-duplicate documents: MinHash bands propose, odd sketches estimate, full shingle sets decide.

A document's set is its distinct 5-word shingles (A-Z lower-cased); fewer words are one shingle; without words it is empty and linked
with nothing. Documents are linked when 100 * intersection >= 75 * union, decided on the full sets.

1. One pass computes 128 MinHash values of each set, 32 band keys of 4 values, an odd sketch (the values folded into a parity bitmap of
   1024 bits) and a 128-bit fingerprint of the set. Documents with equal sets are one class from here on, whatever their number.
2. Classes that share a band key are candidates. A bucket's members are compared with its smallest member, not with each other. A pair
   with 75 % similarity misses all bands with probability 5e-6.
3. The population count of the XOR of two odd sketches estimates the similarity; pairs estimated below ``SKETCH_FLOOR`` (over six standard
   errors under the threshold) are dropped, all others are decided on their full sets.
4. Connected components. Pairs of one component need no check. In buckets whose members are still in several components, members of
   different components are compared in blocks of about ``BLOCK`` members, inside the tasks: only pairs that pass go out, to be decided on
   their full sets. What they must pass, besides the sketch, is certain: an odd sketch of the full set itself, whose XOR population count
   never exceeds the number of elements in which two sets differ. So no link between components is left out, and no pairs of a group are
   emitted.

Sets are compared by 64-bit shingle hashes. A class of equal sets is a node of its own number, whatever ids its documents have or share, so rows
without doc_id, or of one doc_id, are linked only if their texts are. Such rows count as documents with the largest id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mdloom.llm.common import NO_ID, STEP, Stage, mix64, signed, text_runs, window_hashes, words_of

SHINGLE_WORDS = 5
THRESHOLD_PERCENT = 75
BANDS, ROWS = 32, 4
SAMPLES = BANDS * ROWS
SKETCH_BITS = 1024
SKETCH_FLOOR = 0.5
PARITY_BITS = 1024
BLOCK = 1024  # members of an open bucket that a task compares with as many others
_rng = np.random.default_rng(20240229)
_A = _rng.integers(0, 1 << 32, SAMPLES, np.uint32) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, SAMPLES, np.uint32) | np.uint32(1)
_SALT = _rng.integers(0, 1 << 63, SAMPLES, np.uint64)
_BAND_SALT = _rng.integers(0, 1 << 63, BANDS, np.uint64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Per text its sorted distinct shingle hashes."""
    words = words_of(data, offsets, fold=True)
    windows, inside = window_hashes(words, SHINGLE_WORDS)
    sets = []
    for low, high in zip(words.first[:-1], words.first[1:], strict=True):
        if high - low >= SHINGLE_WORDS:
            found = np.sort(windows[low : high - SHINGLE_WORDS + 1])
            sets.append(found[np.concatenate(([True], found[1:] != found[:-1]))])
        elif high > low:
            whole = np.array([high - low], np.uint64)
            for word in words.hash[low:high]:
                whole = whole * STEP + word
            sets.append(mix64(whole))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def min_hashes(found: np.ndarray) -> np.ndarray:
    best = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    short = (found >> np.uint64(32)).astype(np.uint32)
    for low in range(0, len(short), 2048):
        y = short[low : low + 2048][None, :] * _A[:, None]
        y ^= y >> np.uint32(15)
        y *= _B[:, None]
        np.minimum(best, y.min(axis=1), out=best)
    return best


def band_keys(mins: np.ndarray) -> np.ndarray:
    wide = mins.astype(np.uint64).reshape(len(mins), BANDS, ROWS)
    key = np.broadcast_to(_BAND_SALT, wide.shape[:2]).copy()
    for j in range(ROWS):
        key = mix64(key * STEP + wide[:, :, j])
    return key


def odd_sketches(mins: np.ndarray) -> np.ndarray:
    """Parity bitmaps of (sample number, value) pairs, packed to bytes."""
    bit = (mix64(mins.astype(np.uint64) ^ _SALT) % np.uint64(SKETCH_BITS)).astype(np.int64)
    bit += np.arange(len(mins))[:, None] * SKETCH_BITS
    odd = np.bincount(bit.ravel(), minlength=len(mins) * SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8).reshape(len(mins), SKETCH_BITS), axis=1)


def sketch_similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity: samples that differ put two entries each into the XOR."""
    odd = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)
    share = np.minimum(2.0 * odd / SKETCH_BITS, 1 - 1e-9)
    differ = np.log1p(-share) / np.log1p(-2.0 / SKETCH_BITS) / 2
    return 1 - differ / SAMPLES


def parity_bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """Odd sketches of the full sets."""
    odd = [np.bincount((s >> np.uint64(20)).astype(np.int64) % PARITY_BITS, minlength=PARITY_BITS) & 1 for s in sets]
    return np.packbits(np.array(odd, np.uint8).reshape(len(sets), PARITY_BITS), axis=1)


def may_be_linked(n: np.ndarray, m: np.ndarray, parity_n: np.ndarray, parity_m: np.ndarray) -> np.ndarray:
    """False only for pairs of sets (sizes and parity bitmaps) that cannot reach the threshold."""
    differ = np.bitwise_count(parity_n ^ parity_m).sum(axis=1, dtype=np.int64)
    return ((100 + THRESHOLD_PERCENT) * differ <= (100 - THRESHOLD_PERCENT) * (n + m)) & (100 * np.minimum(n, m) >= THRESHOLD_PERCENT * np.maximum(n, m))


SIGNATURE = "id bigint, hash bigint, n bigint, print_a bigint, print_b bigint, bands array<bigint>, sketch binary, parity binary"


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, data, offsets in text_runs(batch):
            sets = shingle_sets(data, offsets)
            mins = np.stack([min_hashes(s) for s in sets])
            bands = signed(band_keys(mins))
            with np.errstate(over="ignore"):
                a = np.array([s.sum(dtype=np.uint64) for s in sets])
                b = np.array([mix64(s ^ STEP).sum(dtype=np.uint64) for s in sets])
            sketches = odd_sketches(mins)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").slice(low, high - low),
                    batch.column("hash").slice(low, high - low),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(signed(a)),
                    pa.array(signed(b)),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, BANDS, dtype=np.int32)), pa.array(bands.ravel())),
                    pa.array([row.tobytes() for row in sketches], pa.binary()),
                    pa.array([row.tobytes() for row in parity_bitmaps(sets)], pa.binary()),
                ],
                names=["id", "hash", "n", "print_a", "print_b", "bands", "sketch", "parity"],
            )


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, data, offsets in text_runs(batch):
            packed = [s.tobytes() for s in shingle_sets(data, offsets)]
            yield pa.RecordBatch.from_arrays([batch.column("node").slice(low, high - low), pa.array(packed, pa.binary())], names=["node", "shingles"])


def _words_matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)


def _by_sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            get = lambda c: _words_matrix(batch.column(c))  # noqa: E731, B023
            sizes = [batch.column(c).to_numpy() for c in ("n_a", "n_b")]
            keep = may_be_linked(*sizes, get("parity_a"), get("parity_b")) & (sketch_similarity(get("sketch_a"), get("sketch_b")) >= SKETCH_FLOOR)
            yield batch.select(["a", "b"]).filter(pa.array(keep))


def _by_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
            x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
            both = np.sort(np.concatenate((x, y)))
            common = int(np.count_nonzero(both[1:] == both[:-1]))
            keep.append(100 * common >= THRESHOLD_PERCENT * (len(x) + len(y) - common))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _compared(group: pa.Table) -> pa.RecordBatch:
    """Pairs of two blocks (or of one) of a bucket, in different components, that size, parity and sketch allow."""
    node, comp, n, block = (group.column(c).to_numpy() for c in ("node", "comp", "n", "block"))
    sketch, parity = (_words_matrix(group.column(c).combine_chunks()) for c in ("sketch", "parity"))
    two = block[0] != block[-1]  # sorted by block
    found = [np.zeros((0, 2), np.int64)]
    for i in range(1, len(node)):
        others = np.flatnonzero((comp[:i] != comp[i]) & ((block[:i] != block[i]) | (not two)))
        others = others[may_be_linked(n[others], n[i], parity[others], parity[i])]
        others = others[sketch_similarity(sketch[others], sketch[[i]]) >= SKETCH_FLOOR]
        found.append(np.stack((np.minimum(node[others], node[i]), np.maximum(node[others], node[i])), axis=1))
    pairs = np.concatenate(found)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def _blocks_compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket and pair of blocks; one such group is held at a time."""
    open_: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy() for c in ("band", "low", "high")], axis=1)
        cuts = np.concatenate(([0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(keys)]))
        for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            key = tuple(keys[low])
            if key != last and open_:
                yield _compared(pa.Table.from_batches(open_))
                open_ = []
            last = key
            open_.append(batch.slice(low, high - low))
    if open_:
        yield _compared(pa.Table.from_batches(open_))


def components(edges: DataFrame, stage: Stage, name: str) -> DataFrame:
    """``(node, comp)``: the smallest node reachable over ``edges(a, b)``, by alternating large and small stars."""
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    before, turn = None, 0
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        edges = stage.write(small.filter("u <> v").distinct(), f"{name}-{turn}")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("comp"))
        before, turn = state, turn + 1


def row_keys() -> list:
    """What tells documents apart: doc_id, and a hash of the text for rows that share one or have none."""
    return [F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.xxhash64("text").alias("hash")]


def label_documents(docs: DataFrame) -> DataFrame:
    """Per row of ``docs(doc_id, text, ...)``: ``id, hash`` (``row_keys``), ``n_shingles``, ``component`` and ``first``.

    ``component`` is the smallest id reachable over links, the row's own included; ``first`` marks the row of each component with the smallest
    id and then hash, all of them if it is repeated. Rows without shingles stand alone and are first.
    """
    spark = docs.sparkSession
    stage = Stage(spark, "neardup")
    texts = docs.select(*row_keys(), "text")
    signatures = stage.write(texts.mapInArrow(_signatures, SIGNATURE), "signatures")
    # Written down, it meets the documents by a plain join, whose hot keys (thousands of equal copies) Spark splits; and its numbers stay.
    prints = ["print_a", "print_b"]
    rep = signatures.filter("n > 0").groupBy(*prints).agg(F.min(F.struct("id", "hash")).alias("rep")).select(*prints, "rep.id", "rep.hash")
    # Numbers rise with the id: the leader of a bucket is its smallest id, which the copies of a document share, and few buckets stay open.
    ordered = rep.repartitionByRange("id", "hash").sortWithinPartitions("id", "hash")
    least = stage.write(ordered.withColumn("node", F.monotonically_increasing_id()), "least")
    classes = stage.write(
        signatures.filter("n > 0")
        .join(least.withColumnsRenamed({"id": "rep_id", "hash": "rep_hash"}), prints)
        .filter("id = rep_id and hash = rep_hash")
        .select("node", "n", "bands", "sketch", "parity"),
        "classes",
    )
    by_band = classes.select("node", F.explode("bands").alias("band"))
    shared = by_band.groupBy("band").agg(F.min("node").alias("leader"), F.count("*").alias("members")).filter("members > 1")
    members = stage.write(by_band.join(shared.drop("members"), "band").distinct(), "members")
    compared = members.select("node").distinct()
    # A row that is repeated is there as often; one of them goes on.
    sketches = classes.select("node", "n", "sketch", "parity").join(compared, "node", "left_semi").dropDuplicates(["node"])
    wanted = least.join(compared, "node", "left_semi").select("id", "hash", "node")
    found = texts.join(wanted, ["id", "hash"]).select("node", "text").mapInArrow(_full_sets, "node bigint, shingles binary")
    sets = stage.write(found.dropDuplicates(["node"]), "sets")

    def linked(pairs: DataFrame) -> DataFrame:
        a, b = (sets.select(F.col("node").alias(x), F.col("shingles").alias(f"set_{x}")) for x in "ab")
        return pairs.distinct().join(a, "a").join(b, "b").mapInArrow(_by_sets, "a bigint, b bigint")

    a, b = (sketches.select(*(F.col(c).alias(x if c == "node" else f"{c}_{x}") for c in sketches.columns)) for x in "ab")
    first = members.filter("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    links = stage.write(linked(first.join(a, "a").join(b, "b").mapInArrow(_by_sketch, "a bigint, b bigint")), "links")
    comps = components(links, stage, "first")

    labels = members.select("band", "node").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    open_buckets = labels.groupBy("band").agg(F.min("comp").alias("least"), F.max("comp").alias("most"), F.count("*").alias("members")).filter("least <> most")
    blocks = F.ceil(F.col("members") / BLOCK)
    dealt = (
        labels.join(open_buckets, "band")
        .select("band", "node", "comp", F.pmod(F.xxhash64("node"), blocks).alias("block"), F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int"))).alias("other"))
        .join(sketches, "node")
        .select("band", F.least("block", "other").cast("bigint").alias("low"), F.greatest("block", "other").cast("bigint").alias("high"), "block", "node", "comp", "n", "sketch", "parity")
    )
    pairs = dealt.repartition("band", "low", "high").sortWithinPartitions("band", "low", "high", "block").mapInArrow(_blocks_compared, "a bigint, b bigint")
    more = stage.write(linked(pairs), "more")
    if not more.isEmpty():
        comps = components(comps.select(F.col("node").alias("a"), F.col("comp").alias("b")).union(more), stage, "second")

    grouped = least.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    heads = grouped.groupBy("comp").agg(F.min(F.struct("id", "hash")).alias("head"))
    classes_of = stage.write(grouped.join(heads, "comp").select(*prints, "head"), "components")
    rows = signatures.select("id", "hash", "n", *prints).join(classes_of, prints, "left")
    empty = F.col("n") == 0
    return rows.select(
        "id",
        "hash",
        F.col("n").alias("n_shingles"),
        F.when(empty, F.col("id")).otherwise(F.col("head.id")).alias("component"),
        (empty | ((F.col("id") == F.col("head.id")) & (F.col("hash") == F.col("head.hash")))).alias("first"),
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of ``docs(doc_id, text, ...)``: ``doc_id, n_shingles, component_id, kept``.

    ``component_id`` is the smallest doc_id reachable over links, the document's own included; ``kept`` marks the document that has it.
    Null and empty texts have 0 shingles and stand alone; repeated rows get equal results; rows without doc_id, or of one doc_id, are documents
    of their own, by their texts; other columns are not read.
    """
    plain = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return label_documents(docs).select(plain("id").alias("doc_id"), "n_shingles", plain("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are first in their component, repeated rows once: every text that is linked with nothing stays."""
    stays = label_documents(docs.select("doc_id", "text")).filter("first").select("id", "hash").distinct()
    keyed = docs.select(F.struct("*").alias("row"), *row_keys())
    kept = keyed.join(stays, ["id", "hash"], "left_semi").select("row", F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text"))
    return kept.dropDuplicates(["doc_id", "text"]).select("row.*")
