"""Outcomes of a run, the merge into the published set, and the quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mdloom.functions import lint
from mdloom.functions.fixed import MAX_ATTEMPTS, MAX_QUARANTINE_CHARACTERS
from mdloom.functions.text import is_blank


def output_name(name: Column) -> Column:
    return F.concat(name, F.lit(".md"))


def route_outcome(results: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """+outcome from reason (refused), io_error with io_attempts (unreadable) and is_clean.

    Only unreadable inputs are tried again; refusals and lint findings are final.
    """
    present = set(results.columns)

    def column(name: str, default) -> Column:
        return F.col(name) if name in present else F.lit(default)

    io_error = column("io_error", False)
    outcome = (
        F.when(column("reason", None).isNotNull(), "rejected")
        .when(io_error & (column("io_attempts", 1) < max_attempts), "retry")
        .when(io_error, "failed")
        .when(F.col("is_clean"), "published")
        .otherwise("quarantined")
    )
    return results.withColumn("outcome", outcome)


def merge_latest_valid(previous: DataFrame, new_clean: DataFrame) -> DataFrame:
    """New valid versions replace old ones by name; everything else keeps its last valid version.

    Only the names of the new versions go into the anti-join, so its build side stays narrow: Spark
    broadcasts it when its measured size allows and shuffles otherwise.
    """
    kept = previous.join(new_clean.select("name"), "name", "left_anti")
    return kept.select("name", "markdown").unionByName(new_clean.select("name", "markdown"))


def quarantine_rows(repaired: DataFrame, max_characters: int = MAX_QUARANTINE_CHARACTERS) -> DataFrame:
    """name, markdown (its first ``max_characters``), report (up to its limit) of the documents that still have findings."""
    return quarantine_full(repaired, max_characters).select("name", "markdown", "report")


def quarantine_full(repaired: DataFrame, max_characters: int = MAX_QUARANTINE_CHARACTERS) -> DataFrame:
    """``quarantine_rows`` with ``full_markdown`` and ``full_report``, from which nothing is cut."""
    dirty = repaired.filter(F.size("diagnostics") > 0)
    return dirty.select(
        "name",
        F.left("markdown", F.lit(max_characters)).alias("markdown"),
        lint.report(F.col("name"), F.col("diagnostics")).alias("report"),
        F.col("markdown").alias("full_markdown"),
        lint.full_report(F.col("name"), F.col("diagnostics")).alias("full_report"),
    )


def run_report(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def empty_document(markdown: Column) -> Column:
    """Blank Markdown is published as the empty text."""
    return F.when(is_blank(markdown), F.lit("")).otherwise(markdown)
