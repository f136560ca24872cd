"""Toxicity by compression distance: which of two zstandard dictionaries describes a window of text in fewer bytes?

Both dictionaries consist of text of their own class followed, at equal distances, by the same stretch of common text, so that ordinary
wording costs about the same under either and the difference of the two lengths is due to the class:

* the ordinary one is trained by zstandard on windows of ordinary texts;
* the toxic one is trained on the passages that set toxic texts apart: stretches of bytes whose 5-grams occur in many toxic texts and, for
  their number, in hardly any ordinary one.

A text is cut into windows of about 40 bytes at spaces, lower-cased. The gains (ordinary minus toxic length) of all windows are counted
against several thresholds, and a logistic regression on those counts, fitted on the labelled sample with weights that restore the share
of toxic texts among all labels, turns them into a probability.

The sample is bounded by ``TOXIC_SAMPLE``, ``ORDINARY_SAMPLE`` and ``SAMPLE_CHARS`` (documented parameters): labelled rows in the order of
a hash of their id. Everything is scored on whole texts. Without labels of both classes every score is 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mdloom.llm.common import hashed_sample, held_out

TOXIC_SAMPLE, ORDINARY_SAMPLE, SAMPLE_CHARS = 4000, 10_000, 20_000
WINDOW_BYTES = 40
GRAM = 5
LEAST_TEXTS, LEAST_SHARE, LEAST_RATIO = 4, 0.01, 40.0
COMMON_BYTES, CLASS_BYTES, HEADER_BYTES = 8192, 2000, 200
PREDICT_FROM = 0.3


@dataclass
class ToxicityModel:
    ordinary: bytes = b""
    toxic: bytes = b""
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: np.ndarray | None = None


def windows(text: bytes) -> list[bytes]:
    found, low, size = [], 0, len(text)
    while low < size:
        high = low + WINDOW_BYTES
        if high < size:
            high = text.rfind(b" ", low + WINDOW_BYTES // 2, high) + 1 or high
        found.append(text[low:high])
        low = high
    return found or [b""]


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    options = zstandard.ZstdCompressionParameters(
        window_log=17, hash_log=16, chain_log=16, search_log=4, min_match=5, strategy=zstandard.STRATEGY_GREEDY, target_length=32,
        write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
    )
    words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    words.precompute_compress(compression_params=options)
    return zstandard.ZstdCompressor(dict_data=words, compression_params=options)


def gains_of(model: ToxicityModel) -> Callable[[bytes], np.ndarray]:
    ordinary, toxic = (compressor(x).compress for x in (model.ordinary, model.toxic))
    return lambda text: np.array([len(ordinary(w)) - len(toxic(w)) for w in windows(text)], float)


def features(gains: np.ndarray) -> list[float]:
    count = len(gains)
    top = np.sort(gains)[::-1]
    over = [np.maximum(gains - t, 0).sum() for t in (1, 2, 3)]
    return [
        1.0, top[0], top[:2].sum(), top[:4].sum(), *(x / (count + 1) for x in over), (gains >= 3).sum() / (count + 1), (gains >= 5).sum() / (count + 1),
        np.log1p(count), np.minimum(gains, 0).mean(), np.log1p(over[2]), np.log1p(over[0]),
    ]


def _grams(text: bytes) -> np.ndarray:
    letters = np.frombuffer(text, np.uint8).astype(np.uint64)
    count = max(0, len(letters) - GRAM + 1)
    out = np.zeros(count, np.uint64)
    for j in range(GRAM):
        out = out * np.uint64(256) + letters[j : j + count]
    return out


def _text_counts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams and in how many texts each occurs; a bounded number of texts is looked at together."""
    grams, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for low in range(0, len(texts), 500):
        own, n = np.unique(np.concatenate([np.unique(_grams(x)) for x in texts[low : low + 500]]), return_counts=True)
        grams, which = np.unique(np.concatenate((grams, own)), return_inverse=True)
        counts = np.bincount(which, weights=np.concatenate((counts, n))).astype(np.int64)
    return grams, counts


def _telling_passages(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    grams, counts = _text_counts(toxic)
    others, other_counts = _text_counts(ordinary)
    at = np.minimum(np.searchsorted(others, grams), len(others) - 1)
    rare = (np.where(others[at] == grams, other_counts[at], 0) + 0.5) / len(ordinary)
    telling = grams[(counts >= max(LEAST_TEXTS, LEAST_SHARE * len(toxic))) & (counts / len(toxic) / rare >= LEAST_RATIO)]
    passages = []
    for text in toxic:
        hits = np.flatnonzero(np.isin(_grams(text), telling))
        if len(hits):
            cuts = np.flatnonzero(np.diff(hits) > GRAM)
            for low, high in zip(hits[np.concatenate(([0], cuts + 1))], hits[np.concatenate((cuts, [len(hits) - 1]))], strict=True):
                passages.append(text[low : high + GRAM])
    return passages


def _trained(samples: list[bytes], size: int, segment: int) -> bytes:
    """Content of a trained dictionary, without its entropy tables; too little text to train on is the dictionary."""
    padded = [s.ljust(8) for s in samples]
    try:
        return zstandard.train_dictionary(size, padded, k=segment, d=6, level=3).as_bytes()[HEADER_BYTES:]
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(padded))[-size:]


def learn(sample: list[tuple[str, int]], shares: tuple[int, int]) -> ToxicityModel:
    """From (text, label) rows; ``shares``: how many ordinary and toxic rows they stand for."""
    texts = [(x or "").lower().encode() for x, _ in sample]
    label = np.array([y for _, y in sample])
    toxic, ordinary = ([x for x, y in zip(texts, label, strict=True) if y == k and len(x) >= GRAM] for k in (1, 0))
    if not toxic or not ordinary:
        return ToxicityModel()
    plain: list[bytes] = []
    for at in np.random.default_rng(7).permutation(len(ordinary)).tolist():
        plain += windows(ordinary[at])
        if len(plain) > 120_000:
            break
    plain = [plain[i] for i in np.random.default_rng(7).permutation(len(plain))]
    common = _trained(plain[:100_000], COMMON_BYTES, 32)
    own = _trained(_telling_passages(toxic, ordinary), CLASS_BYTES, 16)
    other = _trained(plain[-20_000:], len(own) + HEADER_BYTES, 32)[-len(own) :] if own else b""
    model = ToxicityModel(common + other.rjust(len(own)), common + own)
    gains = gains_of(model)
    design = np.array([features(gains(x)) for x in texts])
    model.mean, model.scale = design.mean(axis=0), design.std(axis=0) + 1e-9
    model.mean[0], model.scale[0] = 0, 1
    design = (design - model.mean) / model.scale
    weight = np.where(label == 1, shares[1] / max(1, (label == 1).sum()), shares[0] / max(1, (label == 0).sum()))
    weight = weight / weight.mean()
    model.weights = np.zeros(design.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(design @ model.weights, -30, 30)))
        slope = (design * (weight * p * (1 - p))[:, None]).T @ design + 0.1 * np.eye(design.shape[1])
        model.weights += np.linalg.solve(slope, design.T @ (weight * (label - p)) - 0.1 * model.weights)
    return model


def fit_toxicity(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Learn from rows outside the held-out fold; labels of one doc_id count once (the largest)."""
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {int(r["toxic"]): r["count"] for r in known.groupBy("toxic").count().collect()}
    chosen = hashed_sample(known.filter("toxic = 1"), "doc_id", TOXIC_SAMPLE).union(hashed_sample(known.filter("toxic = 0"), "doc_id", ORDINARY_SAMPLE))
    short = docs.select("doc_id", "text").filter(F.length("text") <= SAMPLE_CHARS)
    rows = short.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic").toPandas()  # at most the two samples, so bounded on either side
    rows = rows.sort_values(["doc_id", "text"])
    return learn(list(zip(rows["text"], rows["toxic"].astype(int), strict=True)), (counts.get(0, 0), counts.get(1, 0)))


def toxicity_score(model: ToxicityModel) -> Callable[[Column], Column]:
    """A text column to its score from 0 to 1; null counts as empty."""

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        gains = gains_of(model)
        for texts in parts:
            if model.weights is None or not len(texts):
                yield pd.Series(np.zeros(len(texts)))
                continue
            design = np.array([features(gains((x or "").lower().encode())) for x in texts])
            logit = (design - model.mean) / model.scale @ model.weights
            yield pd.Series(1 / (1 + np.exp(-np.clip(logit, -30, 30))))

    return score
