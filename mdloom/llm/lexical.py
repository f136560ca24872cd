"""Ranked lexical search: item tiles times document tiles as dense matrix products, exact in float64.

Terms are the maximal matches of ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` with A-Z as a-z. A term's weight in an item and its impact
in a document are whole numbers; a score is the sum of weight times impact over the item's terms, each once.

1. The items are dealt into blocks of a checked size, at most ``BLOCK_BYTES`` of text unless one item alone is longer. One block at a time is
   broadcast with its vocabulary, so what tasks and driver hold does not grow with the items.
2. A pass over the documents counts, per document, its terms and the occurrences of the vocabulary's terms, and writes these down: from them
   come N, L and the document frequencies.
3. Rows are taken ``TILE_DOCS`` at a time. A tile of items meets them over tiles of the vocabulary: the terms that both have, at most
   ``TILE_TERMS``, as a dense matrix of weights times a dense matrix of impacts. A weight is below 2^17 and an impact at most 10^6, so a partial
   sum stays below 2^53, and float64 holds it exactly; partial sums are added up as longs.
4. A task keeps the best documents per item from tile to tile, ties by doc_id, and sends only those.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mdloom.llm.common import NO_ID, Stage, text_runs, words_of
from mdloom.llm.vectors import EXACT

TOP = 10
BLOCK_BYTES = 1 << 20
TILE_ITEMS = 64
TILE_TERMS = 1024
TILE_DOCS = 512
MOST_IMPACT = 1_000_000
OTHER = np.zeros(256, bool)  # bytes that no term holds
OTHER[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
OTHER[ord("A") : ord("Z") + 1] = False


class ItemBlock:
    """Items as sets of terms, terms by number in the sorted vocabulary of hashes."""

    def __init__(self, ids: list[int | None], texts: list[str]):
        self.ids = ids
        sets = []
        for _, _, data, offsets in text_runs(pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])):
            words = words_of(data, offsets, fold=True, space=OTHER)
            sets += [np.unique(words.hash[a:b]) for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
        self.vocabulary = np.unique(np.concatenate(sets)) if sets else np.zeros(0, np.uint64)
        self.terms = [np.searchsorted(self.vocabulary, s) for s in sets]


def _counted(block: Broadcast):
    """Per document its number of terms, and number and occurrences of those in the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = block.value.vocabulary
        for batch in batches:
            for low, high, data, offsets in text_runs(batch):
                words = words_of(data, offsets, fold=True, space=OTHER)
                place = np.searchsorted(vocabulary, words.hash)
                place[place == len(vocabulary)] = 0
                known = np.flatnonzero(vocabulary[place] == words.hash) if len(vocabulary) else np.zeros(0, np.int64)
                pair, times = np.unique(words.text[known] * max(1, len(vocabulary)) + place[known], return_counts=True)
                text, term = np.divmod(pair, max(1, len(vocabulary)))
                cuts = pa.array(np.searchsorted(text, np.arange(high - low + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(low, high - low),
                        pa.array(np.diff(words.first).astype(np.int64)),
                        pa.ListArray.from_arrays(cuts, pa.array(term.astype(np.int32))),
                        pa.ListArray.from_arrays(cuts, pa.array(times.astype(np.int64))),
                    ],
                    names=["doc_id", "n", "terms", "times"],
                )

    return count


def term_weights(df: np.ndarray, documents: int) -> np.ndarray:
    """floor(1000 * ln((2 * N + 2) / (2 * df + 1))), in doubles."""
    return np.floor(1000 * np.log((2 * documents + 2) / (2 * df + 1))).astype(np.int64)


def length_parts(n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """m = 100 - 90 + (90 * n * N) div L, of 64-bit integers, worked out in Python's where the product has more."""
    wide = 90 * int(n.max(initial=0)) * documents >= 2**63
    return (100 - 90 + (90 * (n.astype(object) if wide else n) * documents) // max(1, length)).astype(np.int64)


class _Best:
    """Per item the best documents so far."""

    def __init__(self, items: int, top: int):
        self.top = top
        self.found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * items

    def add(self, item: int, scores: np.ndarray, docs: np.ndarray) -> None:
        """``scores`` of a tile. A score equal to the last one kept may still win by its doc_id."""
        old_scores, old_docs = self.found[item]
        least = old_scores[-1] if len(old_scores) == self.top else 1
        new = np.flatnonzero(scores >= least)
        if len(new):
            scores, docs = np.concatenate((old_scores, scores[new])), np.concatenate((old_docs, docs[new]))
            order = np.lexsort((docs, -scores))[: self.top]
            self.found[item] = scores[order], docs[order]


def tile_scores(items: list[tuple[np.ndarray, np.ndarray]], terms: np.ndarray, docs: np.ndarray, impacts: np.ndarray, size: int) -> np.ndarray:
    """Scores of ``items`` (terms, weights) by ``size`` documents, whose entries are ``terms``, ``docs`` and ``impacts``."""
    out = np.zeros((len(items), size), np.int64)
    shared = np.intersect1d(np.concatenate([t for t, _ in items]), terms)
    most = max((int(w.max(initial=0)) for _, w in items), default=0)
    width = max(1, min(TILE_TERMS, (EXACT - 1) // max(1, most * MOST_IMPACT)))
    for low in range(0, len(shared), width):
        tile = shared[low : low + width]
        weights = np.zeros((len(items), len(tile)))
        for row, (t, w) in enumerate(items):
            at = np.searchsorted(tile, t)
            has = (at < len(tile)) & (tile[np.minimum(at, len(tile) - 1)] == t)
            weights[row, at[has]] = w[has]
        at = np.searchsorted(tile, terms)
        has = (at < len(tile)) & (tile[np.minimum(at, len(tile) - 1)] == terms)
        dense = np.zeros((len(tile), size))
        dense[at[has], docs[has]] = impacts[has]
        out += (weights @ dense).astype(np.int64)
    return out


def _scored(block: Broadcast, weights: np.ndarray, documents: int, length: int, top: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = [(t, weights[t]) for t in block.value.terms]
        best = _Best(len(items), top)
        for batch in batches:
            for low in range(0, batch.num_rows, TILE_DOCS):
                part = batch.slice(low, TILE_DOCS)
                size = np.diff(part.column("terms").offsets.to_numpy())
                terms, times = (part.column(c).flatten().to_numpy() for c in ("terms", "times"))
                docs = np.repeat(np.arange(part.num_rows), size)
                m = length_parts(part.column("n").to_numpy(), documents, length)
                impacts = (1_000_000_000 * times) // (1000 * times + 8 * m[docs])
                ids = part.column("doc_id").to_numpy()
                for first in range(0, len(items), TILE_ITEMS):
                    scores = tile_scores(items[first : first + TILE_ITEMS], terms, docs, impacts, part.num_rows)
                    for row in np.flatnonzero(scores.max(axis=1, initial=0)):
                        best.add(first + int(row), scores[row], ids)
        size = [len(s) for s, _ in best.found]
        if sum(size):
            columns = [np.repeat(np.arange(len(items)), size), np.concatenate([d for _, d in best.found]), np.concatenate([s for s, _ in best.found])]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["place", "doc_id", "score"])

    return score


def _dealt(items: DataFrame, limit: int) -> tuple[DataFrame, list[int]]:
    """Items by block, and the blocks: no block of several items is over ``limit`` bytes."""
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    number = max(1, -(-2 * size // limit)) if size > limit else 1
    while True:
        dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(number)))
        blocks = dealt.groupBy("block").agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("items")).collect()
        if all(b["bytes"] <= limit or b["items"] == 1 for b in blocks):
            return dealt, sorted(b["block"] for b in blocks)
        number *= 2


def lexical_search(docs: DataFrame, items: DataFrame, top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` documents of score above 0 for each item, equal scores by ascending doc_id.

    ``docs(doc_id, text, ...)`` and ``items(item_id, text, ...)``; other columns are not read. Null and empty texts hold no term: such documents
    are never found and such items find nothing. Items that repeat in id and text are one; an id with several texts is ranked for each.
    Repeated documents count, and rank, as often as they stand; one without doc_id ranks behind equal scores and comes out without. Empty
    tables give no row. Terms are compared by 64-bit hashes.
    """
    spark = docs.sparkSession
    stage = Stage(spark, "lexical")
    texts = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).cast("bigint").alias("doc_id"), "text")
    distinct = stage.write(items.select("item_id", "text").filter("text <> ''").distinct(), "items")
    dealt, blocks = _dealt(distinct, block_bytes)
    kind = items.schema["item_id"].dataType.simpleString()
    results = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    for number in blocks:
        rows = dealt.filter(F.col("block") == number).orderBy("item_id", "text").collect()
        block = spark.sparkContext.broadcast(ItemBlock([r["item_id"] for r in rows], [r["text"] for r in rows]))
        counts = stage.write(texts.mapInArrow(_counted(block), "doc_id bigint, n bigint, terms array<int>, times array<bigint>"), f"counts-{number}")
        documents, length = counts.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(block.value.vocabulary), np.int64)
        for term, n in counts.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
            df[term] = n
        weights = term_weights(df, documents)
        found = counts.filter(F.size("terms") > 0).mapInArrow(_scored(block, weights, documents, length, top), "place bigint, doc_id bigint, score bigint")
        rank = F.row_number().over(W.partitionBy("place").orderBy(F.desc("score"), "doc_id"))
        names = spark.createDataFrame([(p, i) for p, i in enumerate(block.value.ids)], f"place bigint, item_id {kind}")
        ranked = found.withColumn("rank", rank).filter(F.col("rank") <= top).join(names, "place")
        doc_id = F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id")
        results = results.unionByName(stage.write(ranked.select("item_id", "rank", doc_id, "score"), f"found-{number}"))
        stage.drop(f"counts-{number}")
        block.destroy()
    return results
