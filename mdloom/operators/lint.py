"""Diagnostics as rows: scanning, counting, reporting."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mdloom.functions import lint
from mdloom.functions.fixed import MAX_REPORT_CHARACTERS, TRUNCATION_LINE
from mdloom.functions.lint import RULES, Rule
from mdloom.operators.repair import scan_documents
from mdloom.sources.staging import staging_folder

PARTITION_BYTES = 64 << 20  # of text that one task of a report sorts
ROW_BYTES = 100  # what a finding takes besides its text


def diagnostics_of(scanned: DataFrame) -> DataFrame:
    """The diagnostics column as rows: doc_id, line_no, col, rule, message."""
    # An expression, not the bare column: Spark adds a filter on a bare column it unnests.
    return scanned.select("doc_id", F.inline(F.coalesce("diagnostics", F.array().cast(lint.DIAGNOSTICS_TYPE))))


def run_rules(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Every finding of every rule, from one walk over each document."""
    return diagnostics_of(scan_documents(docs.select("doc_id", "markdown"), rules))


def format_diagnostics(diagnostics: DataFrame, name: str = "name") -> DataFrame:
    """+text as ``file:line:col: RULE description``."""
    return diagnostics.withColumn(
        "text", lint.diagnostic_text(*(F.col(c) for c in (name, "line_no", "col", "rule", "message")))
    )


def cap_report(diagnostics: DataFrame, limit: int = MAX_REPORT_CHARACTERS, slices: int = 32) -> DataFrame:
    """One report per document from formatted diagnostics, cut to ``limit`` characters.

    A document may own a large share of all findings. Its rows are first ranked in ``slices``
    independent parts; a row with ``limit`` characters before it in its own part has at least as many
    before it overall and can never be reported. What is left per document is bounded.

    The findings are written down first: their size tells how many partitions keep a task's share
    bounded. Spark goes by compressed bytes, and reports may compress fifty times.
    """
    spark = diagnostics.sparkSession
    order = ["line_no", "col", "rule", "text"]
    size = F.length("text") + 1
    part = F.pmod(F.xxhash64("line_no", "col", "rule", "text"), F.lit(slices))

    def before(*keys):
        return F.coalesce(
            F.sum(size).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
        )

    folder = staging_folder(spark, "report")
    diagnostics.select("doc_id", *order).write.parquet(folder)
    findings = spark.read.schema(diagnostics.select("doc_id", *order).schema).parquet(folder)
    total = findings.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(ROW_BYTES)).alias("n")).first()["n"] or 0
    count = max(math.ceil(total / PARTITION_BYTES), spark.sparkContext.defaultParallelism)
    survivors = (
        findings.withColumn("part", part)
        .repartition(count, "doc_id", "part")
        .withColumn("before", before("doc_id", "part"))
        .filter(F.col("before") < limit)
    )
    kept = (
        survivors.repartition(count, "doc_id")
        .withColumn("before", before("doc_id"))
        .filter(F.col("before") < limit)
        .withColumn("text", F.left("text", (F.lit(limit) - F.col("before")).cast("int")))
    )
    lines = F.transform(
        F.sort_array(F.collect_list(F.struct("before", "text"))), lambda row: row["text"]
    )
    report = F.array_join(lines, "\n")
    full = F.sum(size) >= limit
    return kept.groupBy("doc_id").agg(
        F.when(full, F.concat(report, F.lit("\n" + TRUNCATION_LINE))).otherwise(report).alias("report")
    )


def is_clean(docs: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """Documents without a finding."""
    return docs.select("doc_id").join(diagnostics.select("doc_id"), "doc_id", "left_anti")


def rule_summary(diagnostics: DataFrame) -> DataFrame:
    """Findings and documents per rule, aggregated per document first."""
    per_document = diagnostics.groupBy("rule", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return per_document.groupBy("rule").agg(F.sum("n").alias("findings"), F.count(F.lit(1)).alias("docs"))
