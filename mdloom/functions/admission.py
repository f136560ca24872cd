"""Admission predicates on file facts: ``Column -> Column`` boolean."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mdloom.functions import fixed


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)\z", 1)


def suffix_of(name: Column) -> Column:
    """Lower-cased last extension; a name that only starts with a dot has none."""
    return F.lower(F.regexp_extract(name, r"\A[\s\S]+(\.[^.]+)\z", 1))


def is_hidden(name: Column) -> Column:
    return name.startswith(".") | name.startswith("~$")


def is_blocked_media_suffix(suffix: Column) -> Column:
    return suffix.isin(*fixed.BLOCKED_MEDIA_SUFFIXES)


def is_supported_suffix(suffix: Column) -> Column:
    return suffix.isin(*fixed.SUPPORTED_SUFFIXES)


def has_media_signature(content: Column) -> Column:
    """Audio or video by the first sixteen bytes. ``FF FE`` is a UTF-16 mark, not an MPEG frame."""
    head = F.hex(F.substring(content, 1, 16))
    kind = F.substring(head, 17, 8)
    known = head.rlike(r"\A(?:" + "|".join(fixed.MEDIA_PREFIXES_HEX) + ")")
    riff = head.startswith(fixed.RIFF_HEX) & kind.isin(*fixed.RIFF_KINDS_HEX)
    form = head.startswith(fixed.FORM_HEX) & kind.isin(*fixed.FORM_KINDS_HEX)
    frame_sync = head.rlike(r"\AFF[EF]") & ~head.startswith("FFFE")
    return known | riff | form | frame_sync | (F.substring(head, 9, 8) == fixed.FTYP_HEX)


def within_input_limit(length: Column, max_bytes: int = fixed.MAX_INPUT_BYTES) -> Column:
    return length <= F.lit(max_bytes)


def resolved(path: Column) -> Column:
    """``.`` and ``..`` segments worked out, as a file system would; what climbs above the top stays there."""

    def step(done: Column, segment: Column) -> Column:
        up = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(segment == "..", up).when(segment == ".", done).otherwise(F.concat(done, F.array(segment)))

    segments = F.reduce(F.split(path, "/"), F.array().cast("array<string>"), step)
    return F.when(F.contains(path, F.lit("/.")), F.array_join(segments, "/")).otherwise(path)


def inside_root(path: Column, root: str) -> Column:
    return resolved(path).startswith(root.rstrip("/") + "/")


def format_of(suffix: Column) -> Column:
    """Converter family; a supported type without a converter is named, not dropped."""
    families = F.when(F.lit(False), F.lit(None).cast("string"))
    for family, suffixes in fixed.FORMAT_SUFFIXES.items():
        families = families.when(suffix.isin(*suffixes), F.lit(family))
    return families.otherwise(F.lit("no_converter"))
