"""Folders as sources, versioned Parquet tables as sinks."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as stores
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mdloom.functions.fixed import MAX_INPUT_BYTES, MAX_MARKDOWN_BYTES, ZIP_SUFFIXES
from mdloom.functions.text import rstrip, within_output_limit
from mdloom.sources import versions

LISTING_SCHEMA = "path string, modificationTime timestamp, length bigint"
FILES_SCHEMA = f"{LISTING_SCHEMA}, content binary"
READ_SCHEMA = f"{FILES_SCHEMA}, head binary"
HEAD_BYTES = 16
TASK_BYTES = 128 << 20  # what one task reads
BATCH_BYTES = 4 << 20  # what it holds before it passes rows on, besides one file
_TIME = pa.timestamp("us", tz="UTC")
_LISTING = pa.schema([("path", pa.string()), ("modificationTime", _TIME), ("length", pa.int64())])
_READ = pa.schema([*_LISTING, ("content", pa.binary()), ("head", pa.binary())])


def root_of(folder: str) -> str:
    """The folder as listings write it into ``path``."""
    if folder.startswith("file:"):
        return "file:" + os.path.normpath("/" + folder.removeprefix("file:").lstrip("/"))
    return folder.rstrip("/") if "://" in folder else "file:" + os.path.abspath(folder)


def store_of(path: str) -> tuple[stores.FileSystem, str]:
    """The store that holds a path, and the path there. Names are taken as they are, never as patterns or escapes."""
    if path.startswith("file:"):
        return stores.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    scheme, _, rest = path.partition("://")
    host, _, name = rest.partition("/")
    store, top = stores.FileSystem.from_uri(f"{scheme}://{host}/")
    return store, f"{top.rstrip('/')}/{name}"


def listing_row(path: str, info: stores.FileInfo) -> dict:
    return {"path": path, "modificationTime": (info.mtime_ns or 0) // 1_000_000 * 1000, "length": info.size}  # milliseconds, as Hadoop has them


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for folder in batch.column("folder").to_pylist():
            store, top = store_of(folder)
            files = [i for i in store.get_file_info(stores.FileSelector(top)) if i.type == stores.FileType.File]
            yield pa.RecordBatch.from_pylist([listing_row(f"{folder}/{i.base_name}", i) for i in files], schema=_LISTING)


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """Path, time and length of every file directly in a folder, whatever its name; nothing is opened. A task lists, not the driver."""
    return spark.range(0, 1, 1, 1).select(F.lit(root_of(folder)).alias("folder")).mapInArrow(_listed, LISTING_SCHEMA)


def _opened(max_bytes: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for path in batch.column("path").to_pylist():
                try:
                    store, name = store_of(path)
                    info = store.get_file_info(name)
                    with store.open_input_stream(name) as file:
                        head = file.read(HEAD_BYTES)
                        content = head + file.read() if info.size <= max_bytes and not path.lower().endswith(ZIP_SUFFIXES) else None
                    after = store.get_file_info(name)
                except OSError:
                    continue
                if content is not None and len(content) != after.size:
                    content = None  # it grew or shrank meanwhile; its time and length say so
                rows.append(listing_row(path, after) | {"content": content, "head": head})
                held += len(content or b"")
                if held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema=_READ)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_READ)

    return read


def read_files(listing: DataFrame, max_bytes: int = MAX_INPUT_BYTES) -> DataFrame:
    """The files of a listing: time and length as they are when read, ``head`` (first 16 bytes) and ``content`` (null over
    ``max_bytes``, and of ZIP archives, which stay closed: their members are read by range).

    Each path is opened by the task that has it, so a file is read exactly when the listing names it, whatever else is in its folder. Files
    that are gone or cannot be read are left out.
    """
    known = listing.select("path", "length")
    size, count = known.agg(F.sum(F.least("length", F.lit(max_bytes))), F.count("*")).first()
    cores = listing.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, min(count, max(2 * cores, (size or 0) // TASK_BYTES)))
    return known.repartition(tasks, "path").select("path").mapInArrow(_opened(max_bytes), READ_SCHEMA)


def scan_files(spark: SparkSession, folder: str, max_bytes: int = MAX_INPUT_BYTES) -> DataFrame:
    """Files directly in a folder, read."""
    return read_files(list_files(spark, folder), max_bytes)


def stream_files(spark: SparkSession, folder: str) -> DataFrame:
    """New files of a folder. The file source leaves out names that start with ``_``."""
    return spark.readStream.format("binaryFile").schema(FILES_SCHEMA).load(folder)


def valid_markdown(published: DataFrame, max_bytes: int = MAX_MARKDOWN_BYTES) -> DataFrame:
    """name, markdown. Oversized Markdown fails the job, and so the version, before it commits."""
    checked = F.when(within_output_limit(F.col("markdown"), max_bytes), F.col("markdown")).otherwise(
        F.raise_error(F.concat(F.lit("Markdown exceeds the size limit: "), F.col("name")))
    )
    return published.select("name", checked.alias("markdown"))


def ended_reports(quarantine: DataFrame) -> DataFrame:
    """A report ends with exactly one line feed."""
    ends = {c: F.concat(rstrip(F.col(c)), F.lit("\n")) for c in ("report", "full_report") if c in quarantine.columns}
    return quarantine.withColumns(ends)


def _split(folder: str) -> tuple[str, str]:
    root, _, table = folder.rstrip("/").rpartition("/")
    return root, table


def write_version(rows: DataFrame, folder: str, version: int) -> None:
    """A version of one table, committed by itself."""
    root, table = _split(folder)
    new = versions.NewVersion(rows.sparkSession, root, version)
    new.write(rows, table)
    new.commit(name=table)


def publish_sink(published: DataFrame, folder: str, version: int, max_bytes: int = MAX_MARKDOWN_BYTES) -> None:
    """Write name, markdown as a new version."""
    write_version(valid_markdown(published, max_bytes), folder, version)


def quarantine_sink(quarantine: DataFrame, folder: str, version: int) -> None:
    """Write name, markdown, report as a new version."""
    write_version(ended_reports(quarantine), folder, version)


def read_versions(spark: SparkSession, folder: str, version: int, empty: str | None = None) -> DataFrame:
    """All versions up to ``version``, with their number."""
    return versions.read_versions(spark, *_split(folder), version, empty)


def read_latest(spark: SparkSession, folder: str, version: int, key: str = "name", empty: str | None = None) -> DataFrame:
    """Per key the row of its latest version."""
    return versions.read_latest(spark, *_split(folder), version, key, empty)


def read_version(spark: SparkSession, folder: str, version: int, empty: str | None = None) -> DataFrame:
    """The rows that one version has written."""
    return versions.read_version(spark, *_split(folder), version, empty)
