"""The admission gate over a file listing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mdloom.functions import admission as a
from mdloom.functions.fixed import MAX_INPUT_BYTES


def file_parts(files: DataFrame, path: str = "path") -> DataFrame:
    """+name, +suffix, +stem."""
    return (
        files.withColumn("name", a.base_name(F.col(path)))
        .withColumn("suffix", a.suffix_of(F.col("name")))
        .withColumn("stem", F.expr("left(name, length(name) - length(suffix))"))
    )


def drop_hidden(files: DataFrame) -> DataFrame:
    return files.filter(~a.is_hidden(F.col("name")))


def route_format(files: DataFrame) -> DataFrame:
    """+format."""
    return files.withColumn("format", a.format_of(F.col("suffix")))


def admission_verdict(files: DataFrame, root: str, max_bytes: int = MAX_INPUT_BYTES) -> DataFrame:
    """+reason: the first rule that refuses the file, null when admitted.

    The tests on name and size come first; the first bytes (``head`` where there is such a column, else ``content``) are looked at only
    for files that survive them or have an unknown suffix, whatever their size.
    """
    suffix, media = F.col("suffix"), a.has_media_signature(F.col("head" if "head" in files.columns else "content"))
    reason = (
        F.when(a.is_blocked_media_suffix(suffix), "blocked_media")
        .when(~a.is_supported_suffix(suffix) & media, "blocked_media")
        .when(~a.is_supported_suffix(suffix), "unsupported_type")
        .when(~a.inside_root(F.col("path"), root), "outside_root")
        .when(~a.within_input_limit(F.col("length"), max_bytes), "too_large")
        .when(media, "blocked_media")
    )
    return files.withColumn("reason", reason)


def reject_report(verdicts: DataFrame) -> DataFrame:
    """Refused files per reason."""
    return verdicts.filter("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
