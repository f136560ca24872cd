"""Corpora derived from the given tables, for queries whose input those tables do not hold as such.

Each is one SQL projection over whole tables that Spark and DuckDB evaluate alike; ``archives`` then packs what was projected.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NAME = "concat('doc', doc_id, '.txt')"

SEEDED_MARKDOWN = """
case doc_id % 10
  when 0 then concat('Section ', doc_id, chr(10), '===', chr(10), text)
  when 1 then concat('# Top', chr(10), '# Second?', chr(10), text, chr(10), '# Third:')
  when 2 then concat('Visit https://example.com/', doc_id, '.', chr(10), chr(10), 'Also www.Example.com.', chr(10), chr(10), text)
  when 3 then concat('# L', chr(10), 'intro', chr(10), '- first', chr(10), 'continued', chr(10), '  - nested', chr(10), '- second', chr(10), chr(10), chr(10), chr(10), text)
  when 4 then concat('# T', chr(10), 'Before', chr(10), '| A | B |', chr(10), '| --- | --- |', chr(10), '| 1 | ', doc_id, ' |', chr(10), 'After')
  when 5 then concat('# T', chr(10), '| A | B |', chr(10), '| --- | --- |', chr(10), '| too | many | cells |')
  when 6 then concat('# C', chr(10), '````md', chr(10), '~~~text', chr(10), '## Code?', chr(10), 'https://c.example', chr(10), '~~~', chr(10), '````', chr(10), text)
  when 7 then concat('---', chr(10), 'title: Example ', doc_id, chr(10), '---', chr(10), chr(10), '# Existing', chr(10), chr(10), 'Body')
  when 8 then concat('<span>unrepaired ', doc_id, '</span>')
  else concat('#  Wide', chr(10), text, '   ') end
"""

# Line-level defects the seeded corpus lacks: definitions, reversed links, pragmas, CRLF, marks.
EXTRA_MARKDOWN = """
case doc_id % 7
  when 0 then concat('[ref', doc_id, ']: https://r.example/', doc_id, chr(10), '[w]: www.r.example', chr(10), '[x](y)', chr(10), text)
  when 1 then concat('see (a)[b', doc_id, '] and `(c)[d]`', chr(10), chr(10), repeat('[', 40), 'x http://i.example', repeat(']', 40), '(u) www.o.io', chr(10), chr(10), text)
  when 2 then concat('<!-- pyml disable-next-line -->', chr(10), '<!-- pyml disable-next-line MD013 -->', chr(10), text)
  when 3 then concat('﻿', 'a', chr(13), chr(10), 'b', chr(13), text)
  when 4 then concat('+++', chr(10), 'title = 1', chr(10), '+++', chr(10), text)
  when 5 then concat('Head ', doc_id, chr(10), '---', chr(10), '---', chr(10), '    code ', chr(10), 'hard  ', chr(10), 'soft ', chr(10), text)
  else concat('a `b <i>` <i>c</i> <https://d.example>', chr(10), '```a`b', chr(10), '``` ', chr(10), text) end
"""

MANIFEST_COLUMNS = {
    "path": "concat('bundle', cast(floor(doc_id / 20.0) as bigint), '.zip')",
    "entry_no": "doc_id % 20",
    "entry_name": """concat('d/', doc_id, case when doc_id % 197 = 5 then '.docx' when doc_id % 211 = 7 then '.mp3'
        when doc_id % 223 = 9 then '.opf' else '.txt' end)""",
    "is_dir": "false",
    "file_size": "n_chars * 100",
    "compress_size": "cast(1 + floor(n_chars / (1.0 + doc_id % 3)) as bigint)",
    "is_zip": "doc_id % 229 = 11",
    "unreadable": "doc_id % 227 = 13",
}
# Order lines as members: a third of all lines (the returned ones) in seven archives, the others by supplier.
LINE_MEMBER_COLUMNS = {
    "path": "case when l_returnflag = 'R' then concat('returned', l_linenumber, '.zip') else concat('lines', l_suppkey, '.zip') end",
    "entry_no": "l_orderkey * 8 + l_linenumber",
    "entry_name": "concat('d/', l_orderkey, case when l_suppkey % 10 = 3 and l_returnflag <> 'R' then '.docx' else '.txt' end)",
    "is_dir": "l_linenumber = 7",
    "file_size": "cast(floor(l_quantity) as bigint) * case when l_suppkey % 10 = 5 then 100000 else 1000 end",
    "compress_size": "case when l_suppkey % 10 = 7 then 1 else cast(floor(l_quantity) as bigint) * case when l_suppkey % 10 = 5 then 50000 else 500 end end",
    "is_zip": "false",
    "unreadable": "false",
}
LINE_HEAD = "concat('order ', l_orderkey)"
PAGE_IDS = 1_000_000_000_000  # pages beside documents: their ids start here

# First bytes of a member: its own text, behind a media mark for some.
MEDIA_MARK_HEX = "case when doc_id % 233 = 3 then '494433' else '' end"

FILE_COLUMNS = {
    "path": """concat(case when doc_id % 29 = 4 then 'file:/corpus/out/' else 'file:/corpus/in/' end,
        case when doc_id % 41 = 6 then '.' when doc_id % 43 = 6 then '~$' else '' end, 'doc', doc_id,
        case doc_id % 13 when 0 then '.mp3' when 1 then '.bin' when 2 then '.HTML' when 3 then '.csv'
             when 4 then '.zip' when 5 then '.tar.gz' when 6 then '' when 7 then '.md' when 8 then '.PDF'
             else '.txt' end)""",
    "length": "n_chars * 4000",
}
SIGNATURE_HEX = """case doc_id % 17 when 0 then '4F676753' when 1 then '524946460000000057415645'
    when 2 then '5249464600000000414243' when 3 then 'FFFA' when 4 then 'FFFE' when 5 then '0000001866747970'
    when 6 then '464F524D0000000041494646' when 7 then '3026B275' else '' end"""


# Archives with members of their own, one file per document: ZIPs under right and wrong names, and texts named like ZIPs.
ARCHIVE_COLUMNS = {
    "path": "concat('file:/corpus/in/doc', doc_id, case doc_id % 5 when 0 then '.zip' when 1 then '.txt' when 2 then '.ZIP' when 3 then '.md' else '.epub' end)",
    "packed": "doc_id % 5 in (0, 1, 4)",
}
# Members in their order: name, whether the archive has it, content as hex (a folder has none). An empty ZIP stands for a nested one.
EMPTY_ZIP_HEX = "concat('504B0506', repeat('00', 18))"
ARCHIVE_MEMBERS = (
    ("'d/'", "doc_id % 3 = 0", "''"),
    ("concat('d/', doc_id, '.txt')", "true", "hex({text})"),
    ("concat('d/', doc_id, '.csv')", "doc_id % 4 = 1", "hex({text})"),
    ("'inner.txt'", "doc_id % 11 = 0", EMPTY_ZIP_HEX),
    ("'sound.bin'", "doc_id % 7 = 2", "concat('494433', hex({text}))"),
)


def _projected(documents: DataFrame, columns: dict[str, str]) -> list:
    return [F.expr(sql).alias(name) for name, sql in columns.items()]


def seeded(documents: DataFrame, markdown: str = SEEDED_MARKDOWN) -> DataFrame:
    """doc_id, name, title, markdown."""
    return documents.select(
        "doc_id",
        F.expr(_NAME).alias("name"),
        F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("title"),
        F.expr(markdown).alias("markdown"),
    )


def extra(documents: DataFrame) -> DataFrame:
    return seeded(documents, EXTRA_MARKDOWN)


def manifest(documents: DataFrame) -> DataFrame:
    """A listing of archive members: twenty documents to a bundle."""
    marked = F.concat(F.unhex(F.expr(MEDIA_MARK_HEX)), F.encode("text", "UTF-8"))
    return documents.select(*_projected(documents, MANIFEST_COLUMNS), F.substring(marked, 1, 16).alias("head"))


def line_manifest(lineitem: DataFrame) -> DataFrame:
    """A listing of archive members, one per order line."""
    head = F.substring(F.encode(F.expr(LINE_HEAD), "UTF-8"), 1, 16)
    return lineitem.select(*_projected(lineitem, LINE_MEMBER_COLUMNS), head.alias("head"))


def files(documents: DataFrame) -> DataFrame:
    """A file listing in the shape of the binaryFile source."""
    return documents.select(*_file_columns())


def _file_columns() -> list:
    content = F.concat(F.unhex(F.expr(SIGNATURE_HEX)), F.encode("text", "UTF-8"))
    modified = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id") * 60)
    return [
        F.expr(FILE_COLUMNS["path"]).alias("path"),
        modified.alias("modificationTime"),
        F.expr(FILE_COLUMNS["length"]).alias("length"),
        content.alias("content"),
    ]


def seeded_files(documents: DataFrame) -> DataFrame:
    """The file listing beside doc_id, title and the Markdown of the defect corpus."""
    title = F.concat(F.lit("doc"), F.col("doc_id").cast("string"))
    return documents.select("doc_id", title.alias("title"), F.expr(SEEDED_MARKDOWN).alias("markdown"), *_file_columns())


def archives(documents: DataFrame) -> DataFrame:
    """path, content: one file per document, a ZIP written in the tasks or the text itself."""
    text = "encode(coalesce(text, ''), 'UTF-8')"
    members = [
        F.when(F.expr(has), F.struct(F.expr(name).alias("name"), F.unhex(F.expr(content.format(text=text))).alias("content")))
        for name, has, content in ARCHIVE_MEMBERS
    ]
    packed = F.coalesce(F.expr(ARCHIVE_COLUMNS["packed"]), F.lit(False))  # a task gets the members or the text, never both
    held = F.when(packed, F.array_compact(F.array(*members))).alias("members"), F.when(~packed, F.expr(text)).alias("content")
    rows = documents.select(*_projected(documents, ARCHIVE_COLUMNS), *held)
    return rows.mapInArrow(_packed, "path string, content binary")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            path, packed, members, content = (column[row].as_py() for column in batch.columns)
            if packed:
                held = io.BytesIO()
                with zipfile.ZipFile(held, "w") as archive:
                    for member in members:
                        archive.writestr(zipfile.ZipInfo(member["name"]), member["content"])
                content = held.getvalue()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([content], pa.binary())], names=["path", "content"])


EVENT_KIND = """case event_type when 'error' then 'os_error' when 'click' then 'changed' when 'signup' then 'event'
    when 'purchase' then 'lint_error' else 'success' end"""


def attempts(events: DataFrame) -> DataFrame:
    """The event table as a log of attempts on paths."""
    return events.select(
        F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("path"),
        "ts",
        F.col("event_id").alias("seq"),
        F.expr(EVENT_KIND).alias("kind"),
    )


def defects(documents: DataFrame) -> DataFrame:
    """Both defect corpora; the second one under negative ids."""
    second = extra(documents).withColumn("doc_id", -F.col("doc_id") - 1)
    return seeded(documents).unionByName(second)
