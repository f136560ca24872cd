"""Exact top-k search by inner product: no-random-access aggregation over sorted lists.

Components are whole numbers, floor(256 * c), scores their integer inner products.

1. The candidates are cut into blocks of about ``CELLS`` numbers where they are read. A block holds two sorted lists per dimension, one for
   each sign a query may have there.
2. A query reads its lists of a block from the top, ``STEPS`` times the same depth further. What it has read of a candidate, with the lists'
   ends for the rest, is the candidate's lower bound; with the depths reached for the rest, its upper bound. A candidate met in no list is
   bounded by the depths alone.
3. Reading stops when candidates not met cannot reach the k-th best lower bound and few others still can; the final scores of those few are
   worked out. Each block starts with the bound that the blocks before it in the same task have left.
4. The k best of each task meet per query.

Queries travel in blocks as well: a task takes a block of queries and a share of the blocks of candidates, so neither side is ever held whole
by one task, by the driver or in a broadcast. Work grows with queries times candidates; what early stops save is reading, not pairs.

Sums stay below 2^53 in float64, and so exact; blocks whose numbers could exceed that are scored in Python's integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mdloom.llm.common import NO_ID, Stage, partitions
from mdloom.llm.vectors import EXACT, LONG, blocks, largest, packed, unpacked, widened

CELLS = 1 << 17  # numbers in a block of candidates: 2048 vectors of 64 components
QUERY_CELLS = 1 << 17
STEPS = 16  # depths at which bounds are compared
RESOLVE = 4  # a quarter of a block may be left when final scores are worked out
BLOCKS_A_SHARE = 4  # blocks that one task takes, where there are enough: all but the first start with a bound
PACKED = "block bigint, share bigint, query boolean, n int, ids binary, keys binary, data binary, kind string"


class SortedLists:
    """A block of candidates: per dimension and sign its members from best to worst, and each member's place there."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x, self.most = ids, x, largest(x)
        self.dims, self.size = x.shape[1], len(ids)
        rising = np.argsort(x, axis=0, kind="stable").T
        self.member = np.ascontiguousarray(np.concatenate((rising[:, ::-1], rising)))
        value = np.take_along_axis(np.concatenate((x.T, x.T)), self.member, axis=1).astype(np.float64)
        self.end = value[:, -1]
        self.above = value - self.end[:, None]  # what reading an entry adds to the list's end
        self.place = np.empty(self.member.shape, np.min_scalar_type(self.size))
        np.put_along_axis(self.place, self.member, np.arange(self.size, dtype=self.place.dtype)[None, :], axis=1)
        self.exact = self.x.astype(np.float64)

    def best(self, query: np.ndarray, own: int, least: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of all candidates that can be among the ``k`` best, given that ``least`` is reached already."""
        if max(1, self.dims) * 4 * self.most * largest(query) >= EXACT:
            left = np.flatnonzero(self.ids != own)
            scores = self.x[left].astype(object) @ query.astype(object)
            return _first(self.ids[left], np.array([min(max(int(s), LONG.min), LONG.max) for s in scores], np.int64), k)
        dims = np.flatnonzero(query)
        lists = np.where(query[dims] > 0, dims, dims + self.dims)
        weight = query[dims].astype(np.float64)
        bottom, step = weight @ self.end[lists], -(-self.size // STEPS)
        lower = np.full(self.size, bottom)
        lower[self.ids == own] = -np.inf
        left = np.flatnonzero(self.ids != own)
        for depth in range(0, self.size, step):
            until = min(self.size, depth + step)
            gain = self.above[lists, depth:until] * weight[:, None]
            lower += np.bincount(self.member[lists, depth:until].ravel(), gain.ravel(), self.size)
            if len(left) >= k:
                least = max(least, float(np.partition(lower[left], len(left) - k)[len(left) - k]))
            gap = gain[:, -1]
            if bottom + gap.sum() >= least:
                continue  # a candidate that no list has shown yet could still qualify
            left = np.flatnonzero(lower + gap @ (self.place[lists] >= until) >= least)
            if len(left) * RESOLVE <= self.size:
                break
        scores = self.exact[left] @ query.astype(np.float64)
        return _first(self.ids[left[scores >= least]], scores[scores >= least].astype(np.int64), k)


def _first(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` highest scores, ties to the smaller id."""
    order = np.lexsort((ids, ~scores))[:k]  # ~s falls as s rises and cannot overflow
    return ids[order], scores[order]


def _packed_blocks(query: bool):
    """Rows ``vec_id, key, block, share, embedding`` in blocks; those of queries are cut where the block number changes."""
    names = ["vec_id", "key", "block"] if query else ["vec_id"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, (others, x) in enumerate(blocks(batches, names, QUERY_CELLS if query else CELLS)):
            groups = np.unique(others[2]) if query else [number]
            for group in groups:
                rows = np.flatnonzero(others[2] == group) if query else np.arange(len(x))
                data, kind = packed(x[rows])
                keys = others[1][rows].tobytes() if query else b""
                yield pa.RecordBatch.from_pylist(
                    [{"block": int(group), "share": 0, "query": query, "n": len(rows), "ids": others[0][rows].astype("<i8").tobytes(), "keys": keys, "data": data, "kind": kind}],
                    schema=_PACKED_ARROW,
                )

    return pack


_PACKED_ARROW = pa.schema(
    [("block", pa.int64()), ("share", pa.int64()), ("query", pa.bool_()), ("n", pa.int32()), ("ids", pa.binary()), ("keys", pa.binary()), ("data", pa.binary()), ("kind", pa.string())]
)


class _Best:
    """A block of queries and the best candidates of each so far."""

    def __init__(self, k: int):
        self.k, self.ids, self.keys, self.x = k, [], [], []
        self.found: list[tuple[np.ndarray, np.ndarray]] = []

    def add_queries(self, row: dict) -> None:
        x = unpacked(row["data"], row["kind"], row["n"])
        self.ids += np.frombuffer(row["ids"], np.int64).tolist()
        self.keys += np.frombuffer(row["keys"], np.int64).tolist()
        self.x += list(x)
        self.found += [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(x)

    def add_candidates(self, row: dict) -> None:
        x = widened(unpacked(row["data"], row["kind"], row["n"]), max((len(q) for q in self.x), default=0))
        lists = SortedLists(np.frombuffer(row["ids"], np.int64), x)
        for j, query in enumerate(self.x):
            query = np.pad(query, (0, lists.dims - len(query)))
            ids, scores = self.found[j]
            more = lists.best(query, self.ids[j], float(scores[-1]) if len(scores) == self.k else -np.inf, self.k)
            self.found[j] = _first(np.concatenate((ids, more[0])), np.concatenate((scores, more[1])), self.k)

    def rows(self) -> Iterator[pa.RecordBatch]:
        size = [len(ids) for ids, _ in self.found]
        if sum(size):
            columns = [np.repeat(np.array(c, np.int64), size) for c in (self.ids, self.keys)]
            columns += [np.concatenate([f[j] for f in self.found]) for j in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "key", "vec_id", "score"])


def _searched(k: int):
    """Per block of queries and share of the candidates (sorted, queries first): the ``k`` best of each query."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, best = None, _Best(k)
        for batch in batches:
            for j in range(batch.num_rows):
                row = {name: batch.column(name)[j].as_py() for name in ("block", "share", "query", "n", "ids", "keys", "data", "kind")}
                if (row["block"], row["share"]) != last:
                    yield from best.rows()
                    last, best = (row["block"], row["share"]), _Best(k)
                best.add_queries(row) if row["query"] else best.add_candidates(row)
        yield from best.rows()

    return search


def exact_top_k(candidates: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` candidates of highest integer inner product with each query, ties to the smaller vec_id.

    Both sides are ``(vec_id, embedding, ...)``; other columns are not read. Rows whose vector is null or holds a null or non-finite component
    take no part. Candidates under the query's own vec_id are its own row and left out; any other row counts, as often as it stands. Query
    rows that repeat in id and vector are one query; an id with several vectors is ranked for each. A candidate without vec_id ranks behind
    equal scores and comes out without; a row without vec_id is no query. Vectors of unlike length meet as if filled up with 0, an empty one
    scores 0. Scores beyond 64 bits become the largest or smallest long. Empty tables give no row.
    """
    spark = candidates.sparkSession
    stage = Stage(spark, "topk")
    rows = candidates.select(F.coalesce("vec_id", F.lit(NO_ID)).cast("bigint").alias("vec_id"), "embedding")
    asked = queries.filter("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("bigint").alias("vec_id"), F.xxhash64("embedding").alias("key"), "embedding")
    asked = asked.dropDuplicates(["vec_id", "key"])
    first = rows.select(F.count("*"), F.max(F.size("embedding"))).first()
    wide = max(1, first[1] or 1)
    query_blocks = max(1, -(-asked.count() * wide // QUERY_CELLS))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id", "key"), F.lit(query_blocks)))
    asked = stage.write(asked.repartition(query_blocks, "block").sortWithinPartitions("block", "vec_id", "key").mapInArrow(_packed_blocks(True), PACKED), "queries")
    enough = max(1, -(-first[0] * wide // CELLS))
    if rows.rdd.getNumPartitions() > enough:
        rows = rows.coalesce(enough)  # many small files make few blocks
    cut = stage.write(rows.mapInArrow(_packed_blocks(False), PACKED), "candidates")
    shares = max(1, min(2 * partitions(spark), cut.count() // BLOCKS_A_SHARE))

    number = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    rest = ["query", "n", "ids", "keys", "data", "kind"]
    met = asked.select("block", number(shares).alias("share"), *rest).unionByName(
        cut.select(number(query_blocks).alias("block"), F.pmod(F.xxhash64("ids", "data"), F.lit(shares)).alias("share"), *rest)
    )
    dealt = met.repartition("block", "share").sortWithinPartitions("block", "share", F.desc("query"))
    best = dealt.mapInArrow(_searched(k), "query_id bigint, key bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(W.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", F.when(F.col("vec_id") != NO_ID, F.col("vec_id")).alias("vec_id"), "score")
