"""What the operators share: working tables, and words and windows of many texts as numpy arrays."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 20  # texts are worked on in runs of about this size; a longer text is a run of its own
NO_ID = 2**63 - 1  # stands for a missing doc_id while rows are grouped; sorts behind every other
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
STEP = np.uint64(0xD1342543DE82EF95)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """The fold that no model learns from: crc32 of the id as text, remainder 2 of 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


class Stage:
    """Working tables of one run in the folder that ``spark.checkpoint.dir`` names."""

    def __init__(self, spark: SparkSession, purpose: str):
        self.spark = spark
        root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not root:
            if spark.sparkContext.master.split("[")[0] != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            root = tempfile.mkdtemp(prefix="mdloom-")
            spark.conf.set("spark.checkpoint.dir", root)
        self.folder = f"{root.rstrip('/')}/mdloom/{purpose}-{uuid.uuid4().hex}"

    def write(self, rows: DataFrame, name: str) -> DataFrame:
        rows.write.mode("overwrite").parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(rows.schema).parquet(f"{self.folder}/{name}")

    def drop(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def hashed_sample(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """At most ``limit`` rows, chosen by a hash of ``key``: the same rows in every run.

    The rows are thinned by the hash first, so that sorting them gathers about ``limit`` rows in all and not ``limit`` of each partition.
    """
    share = min(1.0, (1.1 * limit + 200) / max(1, rows.count()))
    thinned = rows.filter(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int(share * (1 << 30)))
    return thinned.orderBy(F.xxhash64(key), key).limit(limit)


def most_frequent(rows: DataFrame, count: str, limit: int) -> DataFrame:
    """The rows of highest ``count``, as many ties as go in whole, at most ``limit``: a filter, so no partition sends more than is kept."""
    total, least = 0, None
    for value, n in rows.groupBy(count).count().orderBy(F.desc(count)).collect():  # how many rows have a count: few values
        total += n
        if total > limit:
            break
        least = value
    return rows.filter(F.col(count) >= least) if least is not None else rows.limit(0)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_runs(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts (null: empty) of a batch: first row, row after the last, their UTF-8 bytes, offsets of the texts in them."""
    array = pc.fill_null(batch.column(column), "").cast(pa.large_string()).cast(pa.large_binary())
    if len(array) == 0:
        return
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    data = np.frombuffer(array.buffers()[2], np.uint8) if array.buffers()[2] else np.zeros(0, np.uint8)
    low = 0
    while low < len(array):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def mix64(x: np.ndarray) -> np.ndarray:
    """Murmur's finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        size = (n | 0xFFFF) + 1
        grown = []
        for base in (BASE, BASE_INVERSE):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            grown.append(np.cumprod(steps))
        if size > 2 * CHUNK_BYTES:
            return grown[0][:n], grown[1][:n]  # one very long text: not kept
        _powers, _inverses = grown
    return _powers[:n], _inverses[:n]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, the same wherever the span stands."""
    up, down = powers(len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mix64((sums[end] - sums[start]) * down[start])


@dataclass
class Words:
    """Words of a run of texts: byte spans, hashes, the text of each, and each text's first word."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    text: np.ndarray
    first: np.ndarray


def words_of(data: np.ndarray, offsets: np.ndarray, fold: bool = False, space: np.ndarray = SPACE) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+``, or runs of bytes outside ``space``; with ``fold``, A-Z count as a-z."""
    n = len(data)
    space = space[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before, after = edge[:n].copy(), edge[1:].copy()
    before[1:] |= space[:-1]
    after[:-1] |= space[1:]
    start = np.flatnonzero(before & ~space)
    end = np.flatnonzero(after & ~space) + 1
    hashes = span_hashes(LOWER[data] if fold else data, start, end)
    first = np.searchsorted(start, offsets)
    return Words(start, end, hashes, np.repeat(np.arange(len(offsets) - 1), np.diff(first)), first)


def window_hashes(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``size`` words by first word, and whether the window lies in one text."""
    count = max(0, len(words.hash) - size + 1)
    out = np.zeros(count, np.uint64)
    for j in range(size):
        out *= STEP
        out += words.hash[j : j + count]
    return mix64(out), words.text[:count] == words.text[size - 1 : size - 1 + count]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
