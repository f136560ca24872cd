"""Archive audit and bundles.

Only listing an archive needs Python (the standard ``zipfile``); it runs per file inside tasks and emits
one row per member. Every rule works on that member table with map-side aggregation, so an archive
with very many members never gathers in one task. Archives whose bytes are in rows are read here,
those that a path names in ``archive_ranges``.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from functools import reduce
from operator import or_

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from mdloom.functions import admission as a
from mdloom.functions import fixed

MEMBERS_SCHEMA = (
    "path string, is_zip_file boolean, entry_no bigint, entry_name string, is_dir boolean, "
    "file_size bigint, compress_size bigint, head binary, is_zip boolean, unreadable boolean"
)
MEMBERS_A_FRAME = 10_000  # a frame of its own for each file costs more than reading it
PARTS_SCHEMA = "path string, entry_no bigint, entry_name string, content binary, reason string"


def _open(content: bytes) -> zipfile.ZipFile | None:
    try:
        return zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile:
        return None


def _is_zip(member) -> bool:
    try:
        zipfile.ZipFile(member).close()
    except zipfile.BadZipFile:
        return False
    return True


def peek(archive: zipfile.ZipFile, entry: zipfile.ZipInfo) -> tuple[bytes | None, bool, bool]:
    """First bytes, "is itself a ZIP", and "cannot be read" (encrypted, damaged, unknown method)."""
    try:
        with archive.open(entry) as member:
            head = member.read(16)
        with archive.open(entry) as member:
            return head, _is_zip(member), False
    except Exception:  # whatever a hostile archive provokes concerns this archive only
        return None, False, True


def _member_rows(path: str, content: bytes, most: int | None = None) -> list[tuple]:
    """All members; with more than ``most`` of them, none is opened."""
    archive = _open(content)
    if archive is None:
        return [(path, False, *[None] * 8)]
    with archive:
        entries = archive.infolist()
        if not entries:
            return [(path, True, *[None] * 8)]
        read = most is None or len(entries) <= most
        rows = []
        for number, entry in enumerate(entries):
            peeked = peek(archive, entry) if read and not entry.is_dir() else (None, False, False)
            rows.append(
                (path, True, number, entry.filename, entry.is_dir(), entry.file_size, entry.compress_size, *peeked)
            )
        return rows


def archive_members(files: DataFrame) -> DataFrame:
    """One row per archive member; a file that is no ZIP gives one row with ``is_zip_file`` false."""
    columns = [field.split()[0] for field in MEMBERS_SCHEMA.split(", ")]

    def framed(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=columns).astype({"entry_no": "Int64", "file_size": "Int64", "compress_size": "Int64"})

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                rows += _member_rows(path, content)
                if len(rows) >= MEMBERS_A_FRAME:
                    yield framed(rows)
                    rows = []
        yield framed(rows)

    return files.select("path", "content").mapInPandas(members, MEMBERS_SCHEMA)


_MEMBER_TYPE = (
    T.StructType()
    .add("entry_name", T.StringType())
    .add("is_dir", T.BooleanType())
    .add("head", T.BinaryType())
    .add("is_zip", T.BooleanType())
    .add("unreadable", T.BooleanType())
)
_ARCHIVE_TYPE = (
    T.StructType()
    .add("is_zip_file", T.BooleanType())
    .add("entries", T.LongType())
    .add("expanded", T.LongType())
    .add("compressed", T.LongType())
    .add("members", T.ArrayType(_MEMBER_TYPE))
)
_ARCHIVE_ARROW = to_arrow_type(_ARCHIVE_TYPE)


@F.arrow_udf(_ARCHIVE_TYPE)
def inspect_archive(content: pa.Array) -> pa.Array:
    """The listing of ``archive_members`` folded into the file's own row; null content is no archive.

    Of a batch, one file at a time is a Python object.
    """
    rows = []
    for item in content:
        data = item.as_py()
        # Archives with too many entries are refused by count alone: their members stay unread.
        listing = _member_rows("", data, fixed.MAX_ARCHIVE_ENTRIES) if data is not None else [("", False, *[None] * 8)]
        found = [row for row in listing if row[2] is not None]
        members = [dict(zip(("entry_name", "is_dir", "head", "is_zip", "unreadable"), (r[3], r[4], *r[7:]))) for r in found]
        rows.append(
            {
                "is_zip_file": listing[0][1],
                "entries": len(found),
                "expanded": sum(r[5] for r in found),
                "compressed": sum(r[6] for r in found),
                "members": members if len(found) <= fixed.MAX_ARCHIVE_ENTRIES else [],
            }
        )
    return pa.array(rows, _ARCHIVE_ARROW)


def is_zip_suffix(suffix: Column) -> Column:
    return suffix.isin(*fixed.ZIP_SUFFIXES)


def archive_type_mismatch(files: DataFrame) -> DataFrame:
    """+reason from ``suffix`` and ``is_zip_file``: damaged, or a ZIP under another suffix."""
    zip_name, zip_file = is_zip_suffix(F.col("suffix")), F.col("is_zip_file")
    reason = F.when(zip_name & ~zip_file, "damaged_archive").when(~zip_name & zip_file, "archive_in_disguise")
    return files.withColumn("reason", reason)


def member_reason(member: Callable[[str], Column] = F.col) -> Column:
    """Why a member is refused, null when it is not. ``member`` gives its fields by name."""
    name = a.base_name(member("entry_name"))
    suffix = a.suffix_of(name)
    allowed = (
        name.isin(*fixed.ARCHIVE_PLUMBING_NAMES)
        | a.is_supported_suffix(suffix)
        | (suffix == fixed.ARCHIVE_PLUMBING_SUFFIX)
    )
    return (
        F.when(member("is_dir"), F.lit(None).cast("string"))
        .when(is_zip_suffix(suffix), "nested_archive")
        .when(a.is_blocked_media_suffix(suffix), "blocked_media")
        .when(~allowed, "unsupported_member")
        .when(member("unreadable"), "unreadable_member")
        .when(a.has_media_signature(member("head")), "blocked_media")
        .when(member("is_zip"), "nested_archive")
    )


def member_verdict(members: DataFrame) -> DataFrame:
    """The first refused member decides for its archive."""
    judged = members.select("path", "entry_no", member_reason().alias("reason")).filter("reason is not null")
    return judged.groupBy("path").agg(F.min_by("reason", "entry_no").alias("reason"))


def _totals() -> dict[str, Column]:
    return {
        "entries": F.count("entry_no"),
        "expanded": F.coalesce(F.sum("file_size"), F.lit(0)),
        "compressed": F.coalesce(F.sum("compress_size"), F.lit(0)),
    }


def limit_reason(fact: Callable[[str], Column] = F.col, member: Column | None = None) -> Column:
    """Entry count, then the first refused member, then size and ratio."""
    dense = fact("expanded") / F.nullif(fact("compressed"), F.lit(0)) > fixed.MAX_COMPRESSION_RATIO
    return (
        F.when(fact("entries") > fixed.MAX_ARCHIVE_ENTRIES, F.lit("too_many_entries"))
        .when(F.lit(False) if member is None else member.isNotNull(), F.lit(None) if member is None else member)
        .when(fact("expanded") > fixed.MAX_EXPANDED_BYTES, "expands_too_far")
        .when((fact("compressed") > 0) & dense, "unsafe_ratio")
    )


def archive_totals(members: DataFrame) -> DataFrame:
    """Entries and sizes per archive, with the limit they break; directories count too."""
    totals = members.groupBy("path").agg(*[total.alias(name) for name, total in _totals().items()])
    return totals.withColumn("reason", limit_reason())


def inspected_reason(archive: Column) -> Column:
    """The verdict on one file from its ``inspect_archive`` struct."""
    reasons = F.transform(archive["members"], lambda m: member_reason(lambda field: m[field]))
    first = F.get(F.filter(reasons, lambda reason: reason.isNotNull()), F.lit(0))
    return F.when(archive["is_zip_file"], limit_reason(lambda field: archive[field], first))


def archive_verdict(members: DataFrame) -> DataFrame:
    """One reason per archive, null when it may be opened.

    Members are judged and summed in the same aggregation: one exchange of partial sums.
    """
    judged = members.withColumn("member_reason", member_reason())
    first = F.min_by("member_reason", F.when(F.col("member_reason").isNotNull(), F.col("entry_no")))
    facts = judged.groupBy("path").agg(
        first.alias("member_reason"), *[total.alias(name) for name, total in _totals().items()]
    )
    return facts.select("path", limit_reason(member=F.col("member_reason")).alias("reason"))


def expand_bundle(files: DataFrame) -> DataFrame:
    """The members of admitted bundles as documents; their number and size are bounded.

    A member without a converter is a row with reason ``no_converter`` and no content.
    """
    suffixes = fixed.FORMAT_SUFFIXES["text"] + fixed.FORMAT_SUFFIXES["html"] + fixed.FORMAT_SUFFIXES["csv"]

    def content_of(archive: zipfile.ZipFile, entry: zipfile.ZipInfo) -> bytes | None:
        try:
            return archive.read(entry)
        except Exception:  # found damaged only when read to its end
            return None

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for number, entry in enumerate(archive.infolist()):
                        if not entry.is_dir():
                            known = entry.filename.lower().endswith(suffixes)
                            row = (path, number, entry.filename, content_of(archive, entry) if known else None, None if known else "no_converter")
                            yield pd.DataFrame([row], columns=["path", "entry_no", "entry_name", "content", "reason"])

    return named_parts(files.select("path", "content").mapInPandas(parts, PARTS_SCHEMA))


def has_converter(entry_name: Column) -> Column:
    """Members of these names become part of their bundle's text."""
    suffixes = fixed.FORMAT_SUFFIXES["text"] + fixed.FORMAT_SUFFIXES["html"] + fixed.FORMAT_SUFFIXES["csv"]
    lower = F.lower(entry_name)
    return reduce(or_, [lower.endswith(suffix) for suffix in suffixes])


def named_parts(parts: DataFrame) -> DataFrame:
    """+name, +suffix of members."""
    return parts.withColumn("name", F.concat("path", F.lit("!"), "entry_name")).withColumn(
        "suffix", a.suffix_of(a.base_name(F.col("entry_name")))
    )


def join_bundle(members: DataFrame) -> DataFrame:
    """path, markdown: the members' Markdown under one heading each, in archive order; null when one has none.

    An admitted archive has a bounded number of entries and bytes, so one group is bounded too.
    """
    section = F.concat(F.lit("## "), "entry_name", F.lit("\n\n"), "markdown")
    ordered = F.sort_array(F.collect_list(F.struct("entry_no", section.alias("section"))))
    text = F.array_join(F.transform(ordered, lambda part: part["section"]), "\n\n")
    complete = F.bool_and(F.col("markdown").isNotNull())
    return members.groupBy("path").agg(F.when(complete, text).alias("markdown"), F.lit(True).alias("has_members"))
