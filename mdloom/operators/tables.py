"""Relational rows to Markdown tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mdloom.functions.fixed import MAX_MARKDOWN_BYTES
from mdloom.sources.staging import staging_folder


def _cell(name: str) -> Column:
    text = F.coalesce(F.col(name).cast("string"), F.lit(""))
    return F.replace(F.regexp_replace(text, r"\r\n?|\n", " "), F.lit("|"), F.lit("\\|"))


def packed_lines(lines: DataFrame, group_by: Sequence[str], max_bytes: int) -> DataFrame:
    """``lines(group..., _order, _line)`` of each group as texts: ``part_no`` from 0 on, ``text`` the part's lines in order.

    The lines of a group are first cut into ranges of the whole order (one shuffle by range, which splits hot groups), a running sum of
    bytes inside each range and over the few ranges of a group numbers the parts, and only the lines of one part are gathered. A part takes
    the lines that start in one half of ``max_bytes`` of the running sum. A line longer than that half is a part of its own; any other line
    reaches at most that far into the next half, so no part is over the limit but a single line that alone is. Nothing is left out.
    """
    spark = lines.sparkSession
    sized = lines.select(*group_by, "_order", "_line").withColumn("_size", F.octet_length("_line") + 1)
    # Ranges are drawn by sampling, anew for each use of the rows; written down, they are the same for both uses.
    stage = staging_folder(spark, "tables")
    sized.repartitionByRange(*group_by, "_order").withColumn("_range", F.spark_partition_id()).write.parquet(stage)
    ranged = spark.read.parquet(stage)
    sizes = ranged.groupBy(*group_by, "_range").agg(F.sum("_size").alias("_bytes"))
    before = Window.partitionBy(*group_by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*group_by, "_range", F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*group_by, "_range").orderBy("_order").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("_own", F.coalesce(F.sum("_size").over(inside), F.lit(0))).join(starts, [*group_by, "_range"])
    half = max(1, max_bytes // 2)
    parts = placed.withColumns({"_part": F.floor((F.col("_start") + F.col("_own")) / F.lit(half)), "_long": F.col("_size") > half})
    ordered = F.sort_array(F.collect_list(F.struct("_order", "_line")))
    text = F.array_join(F.transform(ordered, lambda row: row["_line"]), "\n")
    texts = parts.groupBy(*group_by, "_part", "_long").agg(text.alias("text"))
    number = F.row_number().over(Window.partitionBy(*group_by).orderBy("_part", "_long")) - 1  # a long line may have stepped over a number
    return texts.select(*group_by, number.cast("bigint").alias("part_no"), "text")


def table_to_markdown(
    rows: DataFrame,
    group_by: Sequence[str],
    order_by: Sequence[str],
    columns: Sequence[str],
    max_bytes: int = MAX_MARKDOWN_BYTES,
) -> DataFrame:
    """Markdown tables of each group, rows in order: ``part_no`` from 0 on, each part a table within ``max_bytes`` (see ``packed_lines``)."""
    header = "| " + " | ".join(columns) + " |\n|" + " --- |" * len(columns)
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[_cell(c) for c in columns]), F.lit(" |"))
    lines = rows.select(*group_by, F.struct(*order_by).alias("_order"), line.alias("_line"))
    texts = packed_lines(lines, group_by, max_bytes - len(header.encode()))
    return texts.select(*group_by, "part_no", F.concat(F.lit(header + "\n"), "text").alias("markdown"))
