"""ZIP archives by range: directories first, then groups of members, each read by a task of its own.

An archive is never held whole. A task reads the directory at its end and lists the members, cut into groups by their expanded size; the
groups are dealt out, and a task that has one seeks to its members in the archive. Every row says which length and time the archive had when
it was read (null length: it was gone), so that a change in between is seen.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mdloom.operators.archive import peek
from mdloom.sources.files import LISTING_SCHEMA, TASK_BYTES, listing_row, store_of

GROUP_BYTES = 8 << 20  # of expanded members
BATCH_ROWS = 4096
SEEK_BUFFER = 1 << 16
DIRECTORY_SCHEMA = (
    f"{LISTING_SCHEMA}, is_zip_file boolean, entry_no bigint, entry_name string, is_dir boolean, "
    "file_size bigint, compress_size bigint, group_no bigint"
)
PEEK_SCHEMA = f"{LISTING_SCHEMA}, entry_no bigint, head binary, is_zip boolean, unreadable boolean"
CONTENT_SCHEMA = f"{LISTING_SCHEMA}, entry_no bigint, entry_name string, content binary"
_TYPES = {"string": pa.string(), "timestamp": pa.timestamp("us", tz="UTC"), "bigint": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}


def _arrow(schema: str) -> pa.Schema:
    return pa.schema([(name, _TYPES[kind]) for name, kind in (field.split() for field in schema.split(", "))])


class _Ranged(io.RawIOBase):
    """A store's file for ``zipfile``, which takes OSError, and no other error, as "there is nothing before the first byte"."""

    def __init__(self, file: pa.NativeFile):
        self.file = file

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        at = offset + {io.SEEK_SET: 0, io.SEEK_CUR: self.file.tell(), io.SEEK_END: self.file.size()}[whence]
        if at < 0:
            raise OSError("before the first byte")
        self.file.seek(at)
        return at

    def readinto(self, buffer) -> int:
        data = self.file.read(len(buffer))
        buffer[: len(data)] = data
        return len(data)

    def close(self) -> None:
        self.file.close()
        super().close()


def _opened(path: str) -> io.BufferedReader:
    store, name = store_of(path)
    return io.BufferedReader(_Ranged(store.open_input_file(name)), SEEK_BUFFER)


def _seen(path: str) -> dict:
    """The listing's row as it is now; the length of what is gone is null."""
    store, name = store_of(path)
    try:
        return listing_row(path, store.get_file_info(name))
    except OSError:
        return {"path": path, "modificationTime": 0, "length": None}


def _directory(path: str, group_bytes: int) -> Iterator[dict]:
    with _opened(path) as file:
        try:
            archive = zipfile.ZipFile(file)
        except zipfile.BadZipFile:
            yield {"is_zip_file": False}
            return
        expanded, number = 0, -1
        for number, entry in enumerate(archive.infolist()):
            yield {
                "is_zip_file": True, "entry_no": number, "entry_name": entry.filename, "is_dir": entry.is_dir(),
                "file_size": entry.file_size, "compress_size": entry.compress_size, "group_no": expanded // group_bytes,
            }
            expanded += entry.file_size
        if number < 0:
            yield {"is_zip_file": True}


def list_members(files: DataFrame, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """One row per member of the files at ``path``, from their directories alone; no member is opened.

    A file that is no ZIP, and a ZIP without members, give one row without ``entry_no``. Files that are gone give none. ``group_no`` counts
    groups of about ``group_bytes`` by the sizes that the directory states.
    """
    schema = _arrow(DIRECTORY_SCHEMA)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                seen, rows = _seen(path), []
                try:
                    for row in _directory(path, group_bytes):
                        rows.append(seen | row)
                        if len(rows) == BATCH_ROWS:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows = []
                except OSError:
                    if seen["length"] is None:
                        continue
                    rows = [seen | {"is_zip_file": False}]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    paths = files.select("path")
    return paths.repartition(_tasks(paths.count(), 0, paths), "path").mapInArrow(listed, DIRECTORY_SCHEMA)


def _tasks(groups: int, size: int, frame: DataFrame) -> int:
    """Tasks for so many groups: two a core, more when they are large."""
    return max(1, min(groups, max(2 * frame.sparkSession.sparkContext.defaultParallelism, size // TASK_BYTES)))


def _by_group(members: DataFrame, schema: str, read: Callable[[zipfile.ZipFile | None, int, str], dict]) -> DataFrame:
    """Deal out groups of members and read each member of them. ``read`` gets None for an archive that no longer opens."""
    arrow = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in ("path", "entry_no", "entry_name")), strict=True))
        for path, members_of in groupby(rows, key=lambda r: r[0]):
            try:
                file = _opened(path)
            except OSError:
                file = None
            try:
                archive = zipfile.ZipFile(file) if file else None
            except (OSError, zipfile.BadZipFile):
                archive = None
            for _, number, name in members_of:
                row = read(archive, number, name)
                yield pa.RecordBatch.from_pylist([_seen(path) | row], schema=arrow)
            if file:
                file.close()

    groups, size = members.groupBy("path", "group_no").agg(F.sum("file_size").alias("size")).agg(F.count("*"), F.sum("size")).first()
    dealt = members.repartition(_tasks(groups, size or 0, members), "path", "group_no").sortWithinPartitions("path", "entry_no")
    return dealt.select("path", "entry_no", "entry_name").mapInArrow(run, schema)


def peek_members(members: DataFrame) -> DataFrame:
    """First bytes of each member, "is itself a ZIP" and "cannot be read"."""

    def peeked(archive: zipfile.ZipFile | None, number: int, _: str) -> dict:
        try:
            found = peek(archive, archive.infolist()[number])
        except Exception:  # the archive was replaced meanwhile; length and time say so
            found = None, False, True
        return {"entry_no": number, **dict(zip(("head", "is_zip", "unreadable"), found, strict=True))}

    return _by_group(members, PEEK_SCHEMA, peeked)


def read_members(members: DataFrame) -> DataFrame:
    """Content of each member, null for one that is found damaged only when read to its end."""

    def content(archive: zipfile.ZipFile | None, number: int, name: str) -> dict:
        try:
            data = archive.read(archive.infolist()[number])
        except Exception:  # whatever a hostile archive provokes concerns this archive only
            data = None
        return {"entry_no": number, "entry_name": name, "content": data}

    return _by_group(members, CONTENT_SCHEMA, content)
