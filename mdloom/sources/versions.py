"""Versions of a set of tables that appear whole or not at all.

A run writes each table into a folder of its own, ``<root>/<table>/version=<n>/run=<id>``, and last of all one commit file,
``<root>/commits/<n>.<id or table>.json``, that names those folders. Readers go by commit files only, so what a run that stopped halfway has left is
never read, and the run can simply be made again: it writes into new folders. A commit file is renamed into place without overwriting, so of
two runs that make the same version one fails. (A store whose rename copies needs a store of its own for the commit files.)
``remove_uncommitted`` deletes what stopped runs have left.

A commit may carry the name of what it was made from, such as a batch of a stream: ``committed_from`` tells a replay that its work is done.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class VersionExists(ValueError):
    """The version already exists."""


@dataclass(frozen=True)
class Commit:
    version: int
    run: str
    tables: dict[str, str]  # name to schema as JSON
    whole: tuple[str, ...]  # tables that need no earlier version
    source: str | None

    def folder(self, root: str, table: str) -> str:
        return f"{root}/{table}/version={self.version}/run={self.run}"


def _store(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def commits(spark: SparkSession, root: str, version: int | None = None) -> list[Commit]:
    """Commits up to ``version``, in order."""
    root = root.rstrip("/")
    store, path = _store(spark, f"{root}/commits")
    if not store.exists(path):
        return []
    found = [json.loads(r.value) for r in spark.read.text(f"{root}/commits", wholetext=True).collect()]  # a few lines per version
    known = [Commit(c["version"], c["run"], c["tables"], tuple(c["whole"]), c["source"]) for c in found]
    return sorted((c for c in known if version is None or c.version <= version), key=lambda c: (c.version, c.run))


def latest_version(spark: SparkSession, root: str) -> int:
    """The highest version, 0 when there is none."""
    return max((c.version for c in commits(spark, root)), default=0)


def committed_from(spark: SparkSession, root: str, source: str) -> Commit | None:
    return next((c for c in commits(spark, root) if c.source == source), None)


class NewVersion:
    """A version in the making: ``write`` its tables, then ``commit`` them together."""

    def __init__(self, spark: SparkSession, root: str, version: int, source: str | None = None):
        self.spark, self.root, self.version, self.source = spark, root.rstrip("/"), version, source
        self.run, self.tables = f"r{uuid.uuid4().hex}", {}

    def _free(self, tables: Iterable[str]) -> None:
        for commit in commits(self.spark, self.root):
            if commit.version == self.version and set(tables) & set(commit.tables):
                raise VersionExists(f"version {self.version} already exists in {self.root}")

    def write(self, rows: DataFrame, table: str) -> None:
        self._free([table])
        rows.write.mode("errorifexists").parquet(f"{self.root}/{table}/version={self.version}/run={self.run}")
        self.tables[table] = rows.schema.json()

    def commit(self, whole: Iterable[str] = (), name: str = "run") -> Commit:
        """Make the version visible; ``whole`` tables need no earlier version from now on."""
        self._free(self.tables)
        done = Commit(self.version, self.run, self.tables, tuple(whole), self.source)
        said = json.dumps({"version": done.version, "run": done.run, "tables": done.tables, "whole": done.whole, "source": done.source})
        jvm, folder = self.spark._jvm, f"{self.root}/commits"
        store, path = _store(self.spark, f"{folder}/.{self.run}.tmp")
        stream = store.create(path, True)
        try:
            stream.write(bytearray(said.encode()))
        finally:
            stream.close()
        target = jvm.org.apache.hadoop.fs.Path(f"{folder}/{self.version:010d}.{name}.json")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(store.getUri(), self.spark._jsc.hadoopConfiguration())
        never = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        never[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(store.makeQualified(path), store.makeQualified(target), never)
        except Exception as error:
            store.delete(path, False)
            if store.exists(target):
                raise VersionExists(f"version {self.version} already exists in {self.root}") from error
            raise
        return done


def _read(spark: SparkSession, root: str, table: str, taken: list[Commit], empty: str | None) -> DataFrame:
    """Rows of the committed folders with their version; no folder is listed that no commit names."""
    if not taken:
        if empty is None:
            raise ValueError(f"no version of {table} in {root}")
        return spark.createDataFrame([], f"{empty}, version int")
    schema = T.StructType.fromJson(json.loads(taken[-1].tables[table]))
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("version", T.IntegerType()), T.StructField("run", T.StringType())]))
    return rows.option("basePath", f"{root}/{table}").parquet(*(c.folder(root, table) for c in taken)).drop("run")


def read_versions(spark: SparkSession, root: str, table: str, version: int, empty: str | None = None) -> DataFrame:
    """All rows of a table up to ``version``, with their version; ``empty`` is the schema when there is none."""
    root = root.rstrip("/")
    taken = [c for c in commits(spark, root, version) if table in c.tables]
    whole = max((i for i, c in enumerate(taken) if table in c.whole), default=0)
    return _read(spark, root, table, taken[whole:], empty)


def read_version(spark: SparkSession, root: str, table: str, version: int, empty: str | None = None) -> DataFrame:
    """The rows that one version has written."""
    root = root.rstrip("/")
    return _read(spark, root, table, [c for c in commits(spark, root, version) if table in c.tables and c.version == version], empty).drop("version")


def read_newest(spark: SparkSession, root: str, table: str, version: int, empty: str | None = None) -> DataFrame:
    """The rows of the newest version up to ``version`` that has written the table."""
    root = root.rstrip("/")
    return _read(spark, root, table, [c for c in commits(spark, root, version) if table in c.tables][-1:], empty).drop("version")


def read_latest(spark: SparkSession, root: str, table: str, version: int, key: str = "name", empty: str | None = None) -> DataFrame:
    """Per key the rows of its latest version. Only keys and version numbers are aggregated; the rows are scanned once."""
    rows = read_versions(spark, root, table, version, empty)
    latest = rows.groupBy(key).agg(F.max("version").alias("version"))
    return rows.join(latest, [key, "version"], "left_semi")


def remove_uncommitted(spark: SparkSession, root: str, older_than_seconds: float = 86_400) -> list[str]:
    """Delete the folders that no commit names and that have not been touched for a day: a run may still be writing younger ones."""
    root = root.rstrip("/")
    named = {f"{table}/version={c.version}/run={c.run}" for c in commits(spark, root) for table in c.tables}
    store, path = _store(spark, f"{root}/*/version=*/run=*")
    gone, before = [], (time.time() - older_than_seconds) * 1000
    for status in store.globStatus(path) or []:
        found = status.getPath().toString()
        if "/".join(found.split("/")[-3:]) not in named and status.getModificationTime() <= before:
            store.delete(status.getPath(), True)
            gone.append(found)
    return sorted(gone)
