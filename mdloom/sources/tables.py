"""Document tables as sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mdloom.functions.html import html_title


def docs_from_pages(pages: DataFrame) -> DataFrame:
    """HTML pages as documents; the heading falls back to the page's title."""
    return pages.select(
        F.col("page_id").alias("doc_id"),
        F.concat(F.lit("page"), F.col("page_id").cast("string"), F.lit(".html")).alias("name"),
        html_title(F.col("html"), F.col("url")).alias("title"),
        F.lit("html").alias("format"),
        F.col("html").alias("body"),
    )


def docs_from_documents(documents: DataFrame) -> DataFrame:
    """Plain texts as documents."""
    stem = F.concat(F.lit("doc"), F.col("doc_id").cast("string"))
    return documents.select(
        "doc_id",
        F.concat(stem, F.lit(".txt")).alias("name"),
        stem.alias("title"),
        F.lit("text").alias("format"),
        F.col("text").alias("body"),
    )
