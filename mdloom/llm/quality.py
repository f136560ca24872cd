"""Quality rules: counts of every text, and a learned decision list over them.

The list is grown by sequential covering on labelled rows: a rule is a conjunction of threshold tests, grown test by test by FOIL gain on
two thirds of the rows and cut back on the last third, kept only if it is precise there; rows that it covers leave, until no rule helps.
The rules come out as one ordered Spark conditional expression, readable as SQL.

Words are ``[^\\x20\\x09-\\x0D]+``. Counts are taken of whole texts, null and empty texts have none of anything. The sample is bounded by
``SAMPLE_ROWS`` labelled rows outside the held-out fold, in the order of a hash of their id (documented parameter); of a row only its
counts are gathered. Without labels of both classes the list is empty and keeps what the base rules keep.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mdloom.llm.common import STEP, hashed_sample, held_out, mix64, span_hashes, text_runs, window_hashes, words_of

SAMPLE_ROWS = 20_000
LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50
MOST_RULES, MOST_TESTS, LEAST_COVERED, LEAST_PRECISION = 12, 4, 3, 0.9
CUTS = 32  # thresholds tried per feature
SYMBOLS = "#*$%&|<>"  # fixed values
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_digits", "n_upper", "n_stops", "n_distinct_words")
_CLASSES = {"n_symbols": SYMBOLS, "n_digits": "0123456789", "n_upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "n_stops": ".!?"}


def _among(characters: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[[ord(c) for c in characters]] = True
    return table


_TABLES = {name: _among(characters) for name, characters in _CLASSES.items()}


def text_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of each text of a run."""
    texts = len(offsets) - 1
    per_text = lambda flags: np.diff(np.concatenate(([0], np.cumsum(flags)))[offsets])
    words = words_of(data, offsets)
    out = {"n_words": np.diff(words.first)}
    in_word = np.zeros(len(data) + 1, np.int64)
    np.add.at(in_word, words.start, 1)
    np.add.at(in_word, words.end, -1)
    solid = np.cumsum(in_word[:-1]) > 0
    out["word_chars"] = per_text(solid & ((data & 0xC0) != 0x80))
    out |= {name: per_text(table[data]) for name, table in _TABLES.items()}

    breaks = np.flatnonzero(data == ord("\n"))
    start = np.unique(np.concatenate((offsets[:-1], breaks + 1)))
    start = start[start < len(data)]
    owner = np.searchsorted(offsets, start, "right") - 1
    end = np.minimum(np.concatenate((breaks, [len(data)]))[np.searchsorted(breaks, start)], offsets[owner + 1])
    so_far = np.concatenate(([0], np.cumsum(solid)))
    worded = so_far[end] > so_far[start]
    start, end, owner = start[worded], end[worded], owner[worded]
    lines = np.bincount(owner, minlength=texts)
    distinct = np.unique(mix64(span_hashes(data, start, end) + owner.astype(np.uint64) * STEP), return_index=True)[1]
    out["n_lines"], out["n_dup_lines"] = lines, lines - np.bincount(owner[distinct], minlength=texts)

    distinct = np.unique(mix64(words.hash + words.text.astype(np.uint64) * STEP), return_index=True)[1]
    out["n_distinct_words"] = np.bincount(words.text[distinct], minlength=texts)
    windows, inside = window_hashes(words, 3)
    at = np.flatnonzero(inside)
    _, which, count = np.unique(mix64(windows[at] + words.text[at].astype(np.uint64) * STEP), return_inverse=True, return_counts=True)
    again = at[count[which] > 1]
    covered = np.zeros(len(words.hash), bool)
    for j in range(3):
        covered[again + j] = True
    out["n_repeat_words"] = np.bincount(words.text[covered], minlength=texts)
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, data, offsets in text_runs(batch):
            found = text_counts(data, offsets)
            yield pa.RecordBatch.from_arrays([batch.column("row").slice(low, high - low)] + [pa.array(found[c].astype(np.int64)) for c in COUNTS], names=["row", *COUNTS])


def count_texts(docs: DataFrame) -> DataFrame:
    """Rows of ``docs(text, ...)`` as ``row`` (all columns but ``text``) and the counts."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*rest).alias("row"), "text")
    return rows.mapInArrow(_counted, f"row {rows.schema['row'].dataType.simpleString()}, " + ", ".join(f"{c} bigint" for c in COUNTS))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))


#: What rules may test, as SQL over the counts.
FEATURES = {
    "n_words": "cast(n_words as double)",
    "chars_per_word": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "stops_per_word": "n_stops / greatest(n_words, 1)",
    "distinct_share": "n_distinct_words / greatest(n_words, 1)",
}


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    threshold: float

    def holds(self, rows: pd.DataFrame) -> np.ndarray:
        values = rows[self.feature].to_numpy()
        return values > self.threshold if self.above else values <= self.threshold

    def sql(self) -> str:
        return f"{FEATURES[self.feature]} {'>' if self.above else '<='} {self.threshold!r}D"


Rule = tuple[Test, ...]


def covers(rule: Rule, rows: pd.DataFrame) -> np.ndarray:
    out = np.ones(len(rows), bool)
    for test in rule:
        out &= test.holds(rows)
    return out


def _grown(rows: pd.DataFrame, bad: np.ndarray) -> Rule:
    rule: list[Test] = []
    inside = np.ones(len(rows), bool)
    while len(rule) < MOST_TESTS and (inside & ~bad).any():
        p, n = (inside & bad).sum(), (inside & ~bad).sum()
        best, gain = None, 1e-9
        for feature in FEATURES:
            cuts = np.unique(np.quantile(rows[feature].to_numpy()[inside], np.linspace(0, 1, CUTS + 1)[:-1]))
            for cut in cuts.tolist():
                for above in (True, False):
                    now = inside & Test(feature, above, cut).holds(rows)
                    p1, n1 = (now & bad).sum(), (now & ~bad).sum()
                    if p1 and (now != inside).any():
                        value = p1 * (math.log2(p1 / (p1 + n1)) - math.log2(p / (p + n)))
                        if value > gain:
                            best, gain = Test(feature, above, cut), value
        if best is None:
            break
        rule.append(best)
        inside &= best.holds(rows)
    return tuple(rule)


def _pruned(rule: Rule, rows: pd.DataFrame, bad: np.ndarray) -> Rule:
    def worth(tests: Rule) -> float:
        hit = covers(tests, rows)
        return ((hit & bad).sum() - (hit & ~bad).sum()) / max(1, hit.sum())

    return max((rule[:k] for k in range(len(rule), 0, -1)), key=worth)


def learn_rules(rows: pd.DataFrame, bad: np.ndarray) -> list[Rule]:
    """Rules that name bad rows, in order."""
    rules: list[Rule] = []
    if not bad.any() or bad.all():
        return rules
    part = np.random.default_rng(11).permutation(len(rows)) % 3 == 2
    left = np.ones(len(rows), bool)
    while len(rules) < MOST_RULES and (left & bad & ~part).any():
        grow, prune = rows[left & ~part], rows[left & part]
        rule = _grown(grow, bad[left & ~part])
        if not rule:
            break
        rule = _pruned(rule, prune, bad[left & part])
        hit = covers(rule, rows) & left
        if (hit & bad).sum() < LEAST_COVERED or (hit & bad).sum() < LEAST_PRECISION * hit.sum():
            break
        rules.append(rule)
        left &= ~hit
    return rules


def rules_sql(rules: list[Rule]) -> str:
    """The decision list: the number of the first rule that holds, 0 if none does."""
    cases = " ".join(f"when {' and '.join(t.sql() for t in rule)} then {i}" for i, rule in enumerate(rules, 1))
    return f"case {cases} else 0 end" if rules else "0"


def fit_quality(docs: DataFrame, labels: DataFrame) -> list[Rule]:
    """Learn from rows outside the held-out fold; labels of one doc_id count once (the smallest)."""
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = hashed_sample(known, "doc_id", SAMPLE_ROWS)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most SAMPLE_ROWS narrow rows
    counted = count_texts(sample).filter(~base_failed())
    rows = counted.select("row.doc_id", "row.quality", *(F.expr(sql).alias(name) for name, sql in FEATURES.items())).toPandas().sort_values(["doc_id", "n_words"]).reset_index(drop=True)
    return learn_rules(rows, rows["quality"].to_numpy() == 0)


def judge_quality(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """``count_texts`` plus ``base_failed``, ``rule`` (number of the first rule that rejects, 0: none) and ``kept``."""
    counted = count_texts(docs).withColumn("base_failed", base_failed()).withColumn("rule", F.expr(rules_sql(rules)))
    return counted.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
