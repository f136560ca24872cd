"""Language of a text by interpolated Kneser-Ney character models.

Texts are lower-cased letters with one space for everything between them, padded on the left. Per language the 4-grams of all labelled
texts outside the held-out fold are counted; continuation counts of the lower orders, context totals and discounts (n1 / (n1 + 2 n2) of
each order) follow from them in Spark. The interpolated probabilities of all known n-grams, and the weights of all known contexts, are
kept in arrays sorted by a 64-bit hash, with one column per language in which lower orders are already worked in; an n-gram that no
language knows falls back through its context's weights to the next order.

A text goes to the language of least cross-entropy per character; ``score`` is its share among all languages, the entropies weighted with
up to ``SCORE_CHARACTERS`` characters. ``rejected`` tells that the entropy is above what all but one in a thousand of all labelled texts
outside the held-out fold have in their own language. Ties go to the first language by name.

The counts cover all labelled text and every counted n-gram is in the model: its probabilities are computed in Spark and written by tasks,
in ranges of the hashes, to Parquet files in the shared folder; no n-gram passes through the driver program. Spark hands those files to the
executors, where the first task joins them into files that all tasks there map into memory. Null texts and texts without a letter are ``und`` with score 0, and so is everything when nothing was learned.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mdloom.llm.bpe import LETTER, kinds
from mdloom.llm.common import Stage, held_out, mix64, text_runs

ORDER = 4
ACCEPTED = 0.999
SLICES = 4096  # a nat of entropy
SCORE_CHARACTERS = 50
HELD = 1_000_000
UNKNOWN = "und"
DENSE = 1 << 23
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def symbols_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts, ``ORDER - 1`` spaces before, between and after them; the first symbol of each text, and where one more would begin."""
    pad = ORDER - 1
    letters = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    is_letter = kinds()[letters] == LETTER
    count = is_letter.astype(np.int64)
    count[1:] |= is_letter[:-1]  # the first of a gap is its one space
    count[ends] = pad
    body = np.repeat(np.where(is_letter, letters, np.uint32(ord(" "))), count)
    sizes = np.add.reduceat(count, np.concatenate(([0], ends[:-1] + 1)))
    return np.concatenate((np.full(pad, ord(" "), np.uint32), body)), pad + np.concatenate(([0], np.cumsum(sizes)))


def gram_keys(symbols: np.ndarray, order: int) -> np.ndarray:
    """Hash of the ``order`` symbols that end at each position from ``ORDER - 1`` on."""
    count = len(symbols) - ORDER + 1
    key = np.full(count, order, np.uint64)
    for j in range(ORDER - order, ORDER):
        key = key * MULTIPLIER + symbols[j : j + count].astype(np.uint64)
    return mix64(key)


def distinct_grams(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An example position of each distinct ``ORDER``-gram, and which of them stands at each position."""
    count = len(symbols) - ORDER + 1
    alphabet = np.unique(symbols)
    if len(alphabet) ** ORDER <= DENSE:
        number = np.zeros(int(alphabet[-1]) + 1, np.int32)
        number[alphabet] = np.arange(len(alphabet))
        code = np.zeros(count, np.int32)
        for j in range(ORDER):
            code = code * np.int32(len(alphabet)) + number[symbols[j : j + count]]
        example = np.full(len(alphabet) ** ORDER, -1, np.int32)
        example[code] = np.arange(count, dtype=np.int32)
        present = np.flatnonzero(example >= 0)
        at = example[present]
        example[present] = np.arange(len(present), dtype=np.int32)
        return at, example[code]
    _, at, which = np.unique(gram_keys(symbols, ORDER), return_index=True, return_inverse=True)
    return at, which


def _strings(grams: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(grams.astype("<u4")).view(f"<U{ORDER}").ravel().tolist(), pa.string())


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

    def given() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            grams, counts = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
            padded = grams.astype(np.uint64)
            key = padded[:, 0]
            for j in range(1, ORDER):
                key = key * MULTIPLIER + padded[:, j]
            _, example, which = np.unique(mix64(key), return_index=True, return_inverse=True)
            total = np.bincount(which, weights=counts).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(example), pa.string()), _strings(grams[example]), pa.array(total)], names=["lang", "gram", "n"])
        held.clear()

    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        for lang in sorted(set(langs.tolist())):
            own = batch.filter(pa.array(langs == lang))
            for _low, _high, data, offsets in text_runs(own):
                whole = data.tobytes()
                symbols, begins = symbols_of([whole[a:b].decode().lower() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])
                at, which = distinct_grams(symbols)
                edge = np.zeros(len(which) + 1, np.int64)  # grams that end in padding are of no text
                np.add.at(edge, begins[:-1] - ORDER + 1, 1)
                np.add.at(edge, begins[1:] - 2 * (ORDER - 1), -1)
                counts = np.bincount(which[np.cumsum(edge[:-1]) > 0], minlength=len(at))
                at, counts = at[counts > 0], counts[counts > 0]
                held.setdefault(lang, []).append((np.stack([symbols[at + j] for j in range(ORDER)], axis=1), counts))
        if sum(len(c) for parts in held.values() for _, c in parts) > HELD:
            yield from given()
    yield from given()


@dataclass
class LanguageModel:
    """Per order, names of the shipped files of a table: sorted hashes of known n-grams and log-probabilities by language; of contexts, and log-weights."""

    langs: list[str] = field(default_factory=list)
    grams: dict[int, tuple[str, ...]] = field(default_factory=dict)
    contexts: dict[int, tuple[str, ...]] = field(default_factory=dict)
    unknown: np.ndarray | None = None
    limit: np.ndarray | None = None


@lru_cache(maxsize=4 * ORDER)
def _mapped(parts: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Keys and rows of values of a shipped table, mapped into memory: one copy for all workers of an executor."""
    name = f"{SparkFiles.getRootDirectory()}/langid-{hashlib.sha256('/'.join(parts).encode()).hexdigest()}"
    if not os.path.exists(f"{name}.keys"):
        _join_parts([SparkFiles.get(part) for part in parts], name)
    keys, values = (np.asarray(np.memmap(f"{name}.{part}", kind, "r")) for part, kind in (("keys", np.uint64), ("values", np.float32)))
    return keys, values.reshape(len(keys), -1)


def _join_parts(paths: list[str], name: str) -> None:
    """Shipped Parquet files, in the order of their first keys, to one file of keys and one of values; the last worker to finish wins."""

    def rows(path: str) -> Iterator[tuple[bytes, bytes]]:
        for batch in pq.ParquetFile(path).iter_batches(batch_size=1):
            yield from zip(batch.column("keys").to_pylist(), batch.column("values").to_pylist(), strict=True)

    first = {path: int.from_bytes(row[0][:8], "little") for path in paths for row in islice(rows(path), 1)}
    own = f"{name}.{uuid.uuid4().hex}"
    with open(f"{own}.keys", "wb") as keys, open(f"{own}.values", "wb") as values:
        for path in sorted(first, key=first.__getitem__):
            for key, value in rows(path):
                keys.write(key)
                values.write(value)
    os.replace(f"{own}.values", f"{name}.values")
    os.replace(f"{own}.keys", f"{name}.keys")  # the file that is looked for


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    return np.where(keys[at] == wanted, at, -1) if len(keys) else np.full(len(wanted), -1)


def log_probabilities(model: LanguageModel, grams: np.ndarray, highest: int = ORDER) -> np.ndarray:
    """Rows of ``ORDER`` symbols to log-probabilities of the last after the others (at most ``highest - 1`` of them), by language."""
    out = np.zeros((len(grams), len(model.langs)))
    left = np.arange(len(grams))
    for order in range(highest, 0, -1):
        keys, values = _mapped(model.grams[order])
        at = _find(keys, _key(grams[left, ORDER - order :], order))
        known = at >= 0
        out[left[known]] += values[at[known]]
        left = left[~known]
        if order > 1:
            keys, values = _mapped(model.contexts[order])
            at = _find(keys, _key(grams[left, ORDER - order : -1], order))
            out[left[at >= 0]] += values[at[at >= 0]]
    out[left] += model.unknown
    return out


def _key(symbols: np.ndarray, order: int) -> np.ndarray:
    key = np.full(len(symbols), order, np.uint64)
    for j in range(symbols.shape[1]):
        key = key * MULTIPLIER + symbols[:, j].astype(np.uint64)
    return mix64(key)


def _pack_keys(order: int, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow`` over ``(gram, v)``: the hash, with its top bit flipped so that signed order is that of the hash, and the values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            symbols = np.frombuffer("".join(batch.column("gram").to_pylist()).encode("utf-32-le"), np.uint32).reshape(batch.num_rows, width)
            keys = _key(symbols, order) ^ np.uint64(1 << 63)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), batch.column("v")], names=["key", "v"])

    return run


def _pack_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ``(key, v)`` to one row a batch: the bytes of its keys and of its values."""
    for batch in batches:
        if batch.num_rows:
            keys = (batch.column("key").to_numpy().view(np.uint64) ^ np.uint64(1 << 63)).astype("<u8").tobytes()
            values = batch.column("v").flatten().to_numpy().astype("<f4").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([keys], pa.binary()), pa.array([values], pa.binary())], names=["keys", "values"])


def _ship(stage: Stage, rows: DataFrame, order: int, width: int) -> tuple[str, ...]:
    """Tasks write ``rows(gram, v)``, by ranges of the hash and sorted, as Parquet in the shared folder; Spark hands the files to the executors."""
    spark, name = stage.spark, f"shipped-{uuid.uuid4().hex}"
    keyed = rows.mapInArrow(_pack_keys(order, width), "key bigint, v array<double>").orderBy("key")
    stage.write(keyed.mapInArrow(_pack_rows, "keys binary, values binary"), name)
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{stage.folder}/{name}")
    found = [status.getPath() for status in folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)]
    parts = sorted((path.getName(), path.toString()) for path in found if path.getName().startswith("part-"))
    for _, path in parts:
        spark.sparkContext.addFile(path)
    return tuple(part for part, _ in parts)


def entropies(model: LanguageModel, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cross-entropy per symbol of each text in each language, its number of symbols, and whether it has a letter."""
    symbols, begins = symbols_of([t.lower() for t in texts])
    at, which = distinct_grams(symbols)
    values = -log_probabilities(model, np.stack([symbols[at + j] for j in range(ORDER)], axis=1))
    ends = np.maximum(begins[1:] - (ORDER - 1), begins[:-1])  # without the padding that follows
    letters = np.concatenate(([0], np.cumsum(symbols != ord(" "))))
    sums = np.empty((len(texts), len(model.langs)))
    for i in range(len(model.langs)):
        total = np.concatenate(([0.0], np.cumsum(values[which, i])))
        sums[:, i] = total[ends - (ORDER - 1)] - total[begins[:-1] - (ORDER - 1)]
    size = ends - begins[:-1]
    return sums / np.maximum(size, 1)[:, None], size, letters[ends] > letters[begins[:-1]]


def fit_languages(docs: DataFrame) -> LanguageModel:
    """Learn from ``docs(doc_id, text, lang)`` rows outside the held-out fold."""
    stage = Stage(docs.sparkSession, "langid")
    known = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    counts = known.select("text", "lang").mapInArrow(_gram_counts, "lang string, gram string, n bigint")
    long = stage.write(counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "counts")
    langs = sorted(r.lang for r in long.select("lang").distinct().collect())
    if not langs:
        return LanguageModel()
    each = range(len(langs))
    by_lang = lambda column: F.array(*(column(i) for i in each))
    counted = {ORDER: stage.write(long.groupBy("gram").agg(*(F.sum(F.when(F.col("lang") == lang, F.col("n")).otherwise(0)).alias(f"n{i}") for i, lang in enumerate(langs))), f"grams-{ORDER}")}
    for order in range(ORDER - 1, 0, -1):
        below = counted[order + 1].groupBy(F.substring("gram", 2, order).alias("gram"))
        counted[order] = stage.write(below.agg(*(F.count_if(F.col(f"n{i}") > 0).alias(f"n{i}") for i in each)), f"grams-{order}")
    model = LanguageModel(langs)
    lower: Column = F.lit(-float(np.log(counted[1].count() + 1)))
    model.unknown = np.full(len(langs), -np.log(counted[1].count() + 1))
    for order in range(1, ORDER + 1):
        grams = counted[order]
        ones = grams.agg(*(F.count_if(F.col(f"n{i}") == k).alias(f"{k}_{i}") for i in each for k in (1, 2))).first()
        discount = [min(max(ones[f"1_{i}"] / max(ones[f"1_{i}"] + 2 * ones[f"2_{i}"], 1), 0.1), 0.9) for i in each]
        sums = [e for i in each for e in (F.sum(f"n{i}").alias(f"t{i}"), F.count_if(F.col(f"n{i}") > 0).alias(f"k{i}"))]
        if order == 1:  # one context, the empty one
            whole = grams.agg(*sums).first()
            rows = grams.select("*", *(F.lit(whole[c]).alias(c) for i in each for c in (f"t{i}", f"k{i}")))
            was = lambda i: lower
        else:
            heads = stage.write(grams.groupBy(F.substring("gram", 1, order - 1).alias("context")).agg(*sums), f"contexts-{order}")
            # a context that a language does not know has no weight there: the next order counts in full
            weight = by_lang(lambda i, d=discount: F.when(F.col(f"k{i}") > 0, F.log(F.lit(d[i]) * F.col(f"k{i}") / F.col(f"t{i}"))).otherwise(0.0))
            model.contexts[order] = _ship(stage, heads.select(F.col("context").alias("gram"), weight.alias("v")), order, order - 1)
            tail = probabilities.select(F.col("gram").alias("tail"), F.col("v").alias("below"))
            rows = grams.withColumns({"context": F.substring("gram", 1, order - 1), "tail": F.substring("gram", 2, order - 1)}).join(heads, "context").join(tail, "tail")
            was = lambda i: F.col("below")[i]

        def value(i: int, d: list[float] = discount, was: Callable[[int], Column] = was) -> Column:
            seen = F.greatest(F.col(f"n{i}") - F.lit(d[i]), F.lit(0.0)) / F.greatest(F.col(f"t{i}"), F.lit(1))
            share = F.when(F.col(f"k{i}") > 0, F.lit(d[i]) * F.col(f"k{i}") / F.col(f"t{i}")).otherwise(1.0)
            return F.log(seen + share * F.exp(was(i)))

        probabilities = stage.write(rows.select("gram", by_lang(value).alias("v")), f"probabilities-{order}")
        model.grams[order] = _ship(stage, probabilities, order, order)
    model.limit = np.full(len(langs), np.inf)
    costs = known.filter(F.length("text") > 0).select("lang", "text").mapInArrow(_own_entropies(model), "lang string, cost double")
    for lang, limit in _quantiles(stage.write(costs, "own-entropies"), ACCEPTED).items():
        model.limit[langs.index(lang)] = limit
    return model


def _own_entropies(model: LanguageModel) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow`` over ``(lang, text)``: the entropy of each text in its own language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in text_runs(batch):
                whole, langs = data.tobytes(), batch.column("lang").slice(low, high - low)
                at = [model.langs.index(lang) for lang in langs.to_pylist()]
                costs = entropies(model, [whole[a:b].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])[0]
                yield pa.RecordBatch.from_arrays([langs, pa.array(costs[np.arange(len(at)), at])], names=["lang", "cost"])

    return run


def _quantiles(costs: DataFrame, share: float) -> dict[str, float]:
    """The quantile of all ``costs(lang, cost)`` of each language, exact and linear between two neighbours.

    Counts per narrow slice of the costs tell which slices hold the two; only the values in those are ranked.
    """
    costs = costs.withColumn("slice", F.floor(F.col("cost") * SLICES))
    before, n, total = F.col("before"), F.col("n"), F.col("total")
    at = (total - 1) * F.lit(share)
    wanted = (before <= F.least(F.floor(at) + 1, total - 1)) & (before + n > F.floor(at))
    slices = costs.groupBy("lang", "slice").agg(F.count(F.lit(1)).alias("n"))
    ranked = slices.withColumns({"before": F.sum("n").over(W.partitionBy("lang").orderBy("slice")) - n, "total": F.sum("n").over(W.partitionBy("lang"))})
    near = costs.join(F.broadcast(ranked.filter(wanted).drop("n")), ["lang", "slice"]).groupBy("lang", "slice", "cost", "before", "total").agg(F.count(F.lit(1)).alias("n"))
    inside = F.sum("n").over(W.partitionBy("lang", "slice").orderBy("cost")) - n
    found = near.withColumn("before", before + inside).filter(wanted).groupBy("lang").agg(F.min("cost").alias("low"), F.max("cost").alias("high"), F.first(at - F.floor(at)).alias("step"))
    return {r["lang"]: r["low"] + (r["high"] - r["low"]) * r["step"] for r in found.collect()}


def predict_languages(model: LanguageModel) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow`` over ``(row, text)``: ``row, lang_pred, score, entropy, rejected``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in text_runs(batch):
                whole = data.tobytes()
                texts = [whole[a:b].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                lang, score, entropy, rejected = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.full(len(texts), np.nan), np.ones(len(texts), bool)
                if model.langs:
                    costs, size, lettered = entropies(model, texts)
                    best = costs.argmin(axis=1)
                    own = costs[np.arange(len(texts)), best]
                    share = np.exp((own[:, None] - costs) * np.minimum(size, SCORE_CHARACTERS)[:, None])
                    score = np.where(lettered, 1 / share.sum(axis=1), 0.0)
                    entropy = np.where(lettered, own, np.nan)
                    rejected = ~lettered | (own > model.limit[best])
                    lang = [model.langs[b] if y else UNKNOWN for b, y in zip(best.tolist(), lettered.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").slice(low, high - low), pa.array(lang, pa.string()), pa.array(score), pa.array(entropy, from_pandas=True), pa.array(rejected)],
                    names=["row", "lang_pred", "score", "entropy", "rejected"],
                )

    return run


def identify_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Rows of ``docs(text, ...)`` as ``row`` (all columns but ``text``), ``lang_pred, score, entropy, rejected``."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*rest).alias("row"), "text")
    return rows.mapInArrow(predict_languages(model), f"row {rows.schema['row'].dataType.simpleString()}, lang_pred string, score double, entropy double, rejected boolean")
