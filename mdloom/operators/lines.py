"""The line model: documents as rows of lines and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mdloom.functions import lint
from mdloom.functions import patterns as p
from mdloom.functions import text as tx
from mdloom.functions.repair import TABLE_UNITS, rows_are_consistent, table_rows


def explode_lines(docs: DataFrame, column: str = "body") -> DataFrame:
    """doc_id, line_no (from 1), line; empty lines at the end are kept."""
    lines = docs.select("doc_id", F.posexplode(F.split(F.col(column), "\n", -1)).alias("line_no", "line"))
    return lines.withColumn("line_no", F.col("line_no") + 1)


def mark_fences(docs: DataFrame, column: str = "body") -> DataFrame:
    """Lines with is_boundary and in_fence (strictly between the boundaries)."""
    marked = docs.select("doc_id", F.posexplode(lint.marked_lines(F.col(column))).alias("line_no", "x"))
    return marked.select("doc_id", (F.col("line_no") + 1).alias("line_no"), "x.line", "x.is_boundary", "x.in_fence")


def classify_lines(lines: DataFrame) -> DataFrame:
    """+one flag per syntactic class."""
    return lines.withColumns(lint.line_classes(F.col("line")))


def assemble_lines(lines: DataFrame) -> DataFrame:
    """Lines back to one body per document, blank lines at the end dropped.

    A document is bounded by the size limits of the gate, and so is its group.
    """
    ordered = F.sort_array(F.collect_list(F.struct("line_no", "line")))
    body = F.array_join(F.transform(ordered, lambda x: x["line"]), "\n")
    return lines.groupBy("doc_id").agg(tx.drop_trailing_blank_lines(body).alias("body"))


def _blocks(docs: DataFrame, column: str) -> DataFrame:
    blocks = F.filter(tx.units(F.col(column), TABLE_UNITS), lambda u: u.rlike(r"\A" + p.TABLE_LINE))
    rows = docs.select("doc_id", F.posexplode(blocks).alias("block_id", "block"))
    return rows.withColumn("block_id", F.col("block_id") + 1)


def table_blocks(docs: DataFrame, column: str = "body") -> DataFrame:
    """doc_id, block_id, row_no, line: the rows of every run of table lines outside fences."""
    rows = _blocks(docs, column).select("doc_id", "block_id", F.posexplode(F.split("block", "\n", -1)).alias("row_no", "line"))
    return rows.withColumn("row_no", F.col("row_no") + 1)


def table_is_consistent(docs: DataFrame, column: str = "body") -> DataFrame:
    """doc_id, block_id, ok: one row per table block."""
    return _blocks(docs, column).select("doc_id", "block_id", rows_are_consistent(table_rows(F.col("block"))).alias("ok"))
