"""From raw documents to tokens: each stage takes what the one before kept.

Every stage but the last returns the columns of ``documents``. Null and empty texts pass the filters (nothing in them is toxic, repeated or
leaked); repeated rows become one in the near-duplicate stage; other columns are carried along whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mdloom.llm.bpe import encode_and_decode_digests, prepare
from mdloom.llm.common import Stage, table
from mdloom.llm.decontaminate import find_leaks
from mdloom.llm.neardup import one_of_each
from mdloom.llm.queries import TOKENIZER
from mdloom.llm.substring import remove_repeats
from mdloom.llm.toxicity import PREDICT_FROM, fit_toxicity, toxicity_score


def _columns(docs: DataFrame, **changed: str) -> list:
    """The columns of ``docs`` out of ``row`` and ``text``."""
    return [F.expr(changed[c]).cast(docs.schema[c].dataType).alias(c) if c in changed else F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go."""
    score = toxicity_score(fit_toxicity(docs, table(spark, sf_dir, "labels")))
    return docs.filter(score("text") < PREDICT_FROM)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest doc_id; texts linked with nothing all stay."""
    return one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that started earlier go; a document that loses none keeps its text as it is."""
    return remove_repeats(docs).select(*_columns(docs, n_chars="length(text)"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return find_leaks(docs, table(spark, sf_dir, "benchmark")).filter(F.size("matches") == 0).select(*_columns(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as token ids and back: counts and digests per document."""
    narrow = docs.select("doc_id", "text")
    return encode_and_decode_digests(narrow, prepare(narrow, TOKENIZER)).select("row.doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("tokens", tokens),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage, docs = Stage(spark, "pipeline"), table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage.write(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
