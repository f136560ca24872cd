"""Versions that appear whole, streams that replay, jobs that wait for their time, files read by path."""

from __future__ import annotations

import os
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from mdloom.operators import intake
from mdloom.plans import pipeline
from mdloom.plans.pipeline import Settings, compact, process_files, publish_stream, read_ledger, read_published, read_quarantine, refresh_folder, refresh_until_idle
from mdloom.sources import files as fs
from mdloom.sources import versions
from mdloom.streaming import intake as streams

TABLES = ("published", "quarantine", "refused", "outcomes", "retries", "ledger")


@pytest.fixture
def light(monkeypatch):
    """Files to outcomes without conversion and repair, which the tests here are not about: a text that starts with ``<`` is quarantined."""

    def process(files, root, settings=Settings(), stage=None):
        taken = pipeline._staged(files, "light").withColumn("text", F.col("content").cast("string"))
        bad = F.col("text").startswith("<")
        finding = F.array(F.struct(F.lit(1).alias("line_no"), F.lit(1).alias("col"), F.lit("MD033").alias("rule"), F.lit("m").alias("message")))
        return taken.select(
            "path", "length", "modificationTime", F.regexp_extract("path", r"([^/]+)\z", 1).alias("name"), F.col("text").alias("markdown"), F.lit(None).cast("string").alias("reason"),
            F.when(bad, finding).otherwise(F.slice(finding, 1, 0)).alias("diagnostics"), F.when(bad, "quarantined").otherwise("published").alias("outcome"),
        )

    monkeypatch.setattr(pipeline, "process_files", process)


def write(folder, **texts):
    folder.mkdir(exist_ok=True)
    for name, text in texts.items():
        (folder / f"{name}.txt").write_text(text)


def state(spark, out, version):
    """All that a reader can see as of a version."""
    published = sorted(map(tuple, read_published(spark, out, version).collect()))
    quarantine = sorted(map(tuple, read_quarantine(spark, out, version, full=True).collect()))
    ledger = sorted((r.path.rsplit("/", 1)[1], r.length) for r in read_ledger(spark, out, version).collect())
    return published, quarantine, ledger


@pytest.mark.parametrize("stop", [0, 3, 6])
def test_a_run_that_stops_leaves_nothing_and_can_be_made_again(spark, tmp_path, monkeypatch, stop, light):
    source, out = tmp_path / "in", f"{tmp_path}/out"
    write(source, a="text of a", b="text of b")
    refresh_folder(spark, str(source), out, 1)
    before = state(spark, out, 1)
    write(source, a="new text of a", b="<b>no longer valid</b>", c="text of c")
    plain_write, plain_commit, written = versions.NewVersion.write, versions.NewVersion.commit, []

    def failing(self, rows, table):
        if len(written) == stop:
            raise RuntimeError("stopped")
        plain_write(self, rows, table)
        written.append(table)

    def never(self, *args, **kwargs):
        raise RuntimeError("stopped")

    monkeypatch.setattr(versions.NewVersion, "write", failing)
    monkeypatch.setattr(versions.NewVersion, "commit", never)
    with pytest.raises(RuntimeError, match="stopped"):
        refresh_folder(spark, str(source), out, 2, previous=1)
    assert tuple(written) == TABLES[:stop]
    assert versions.latest_version(spark, out) == 1 and state(spark, out, 2) == before  # half a version is no version
    monkeypatch.setattr(versions.NewVersion, "write", plain_write)
    monkeypatch.setattr(versions.NewVersion, "commit", plain_commit)
    refresh_folder(spark, str(source), out, 2, previous=1)
    published, quarantine, ledger = state(spark, out, 2)
    assert [n for n, _ in published] == ["a.txt.md", "b.txt.md", "c.txt.md"] and published[0][1] == "new text of a"
    assert [q[0] for q in quarantine] == ["b.txt.md"] and [n for n, _ in ledger] == ["a.txt", "b.txt", "c.txt"]
    left = versions.remove_uncommitted(spark, out, older_than_seconds=0)
    assert len(left) == stop and state(spark, out, 2) == (published, quarantine, ledger)


def test_a_version_is_made_once(spark, tmp_path):
    rows = spark.createDataFrame([("a.md", "x")], "name string, markdown string")
    one, two = (versions.NewVersion(spark, str(tmp_path), 1) for _ in range(2))
    one.write(rows, "published")
    two.write(rows.limit(0), "published")
    one.commit()
    with pytest.raises(versions.VersionExists):
        two.commit()
    with pytest.raises(versions.VersionExists):
        versions.NewVersion(spark, str(tmp_path), 1).write(rows, "published")
    assert read_published(spark, str(tmp_path), 9).count() == 1 and read_published(spark, str(tmp_path), 0).isEmpty()
    assert not [n for n in os.listdir(tmp_path / "commits") if n.endswith(".tmp")]


def test_compaction_needs_no_earlier_version(spark, tmp_path, light):
    source, out = tmp_path / "in", f"{tmp_path}/out"
    write(source, a="text of a", b="<b>bad</b>")
    refresh_folder(spark, str(source), out, 1)
    write(source, c="text of c")
    refresh_folder(spark, str(source), out, 2, previous=1)
    compact(spark, out, 3)
    assert state(spark, out, 3) == state(spark, out, 2)
    assert {c.version for c in versions.commits(spark, out)} == {1, 2, 3}
    paths = versions.read_versions(spark, out, "published", 3).inputFiles()
    assert paths and all("version=3" in p for p in paths)
    write(source, a="newer text of a")
    refresh_folder(spark, str(source), out, 4, previous=3)
    assert [m for n, m in state(spark, out, 4)[0] if n == "a.txt.md"] == ["newer text of a"]


def test_stream_publishes_what_a_refresh_does_and_replays_safely(spark, tmp_path, monkeypatch, light):
    source, out, checkpoint = tmp_path / "in", f"{tmp_path}/out", f"{tmp_path}/checkpoint"
    write(source, a="text of a", b="<b>bad</b>", c="text of c")
    refresh_folder(spark, str(source), f"{tmp_path}/batch", 1)
    take, calls = pipeline._take_due, []

    def stopped(when):
        def run(*args, **kwargs):
            calls.append(when)
            if when == "before":
                raise RuntimeError("stopped")
            take(*args, **kwargs)
            if when == "after":
                raise RuntimeError("stopped")  # published, but the stream does not know

        return run

    def stream(when):
        monkeypatch.setattr(pipeline, "_take_due", stopped(when))
        query = publish_stream(spark, str(source), out, checkpoint)
        try:
            streams.run_until_idle(query)
        except Exception as error:
            assert "stopped" in str(error)

    stream("before")
    assert versions.latest_version(spark, out) == 0
    stream("after")
    assert versions.latest_version(spark, out) == 1
    stream("never")  # replays the batch: its commit is there
    assert versions.latest_version(spark, out) == 1 and calls == ["before", "after"]
    assert state(spark, out, 1) == state(spark, f"{tmp_path}/batch", 1)
    write(source, d="text of d")
    stream("never")
    assert versions.latest_version(spark, out) == 2 and len(state(spark, out, 2)[0]) == 3
    monkeypatch.setattr(pipeline, "_take_due", take)
    write(source, a="overwritten: a file stream does not see it")
    again = refresh_folder(spark, str(source), out, 3, previous=2)
    assert [r["name"] for r in again.collect()] == ["a.txt"]
    with pytest.raises(ValueError):
        publish_stream(spark, str(source), str(source), checkpoint)


def test_files_wait_for_their_time(spark, tmp_path, monkeypatch, light):
    source, out, settings = tmp_path / "in", f"{tmp_path}/out", Settings(debounce_seconds=4, retry_seconds=10, max_attempts=3)
    write(source, a="text of a", b="text of b")
    start = datetime(2024, 5, 1, tzinfo=timezone.utc)
    at = lambda seconds: start + timedelta(seconds=seconds)
    touch = lambda name, seconds: os.utime(source / f"{name}.txt", (at(seconds).timestamp(),) * 2)
    touch("a", 0), touch("b", 2)

    def run(version, seconds):
        rows = refresh_folder(spark, str(source), out, version, version - 1 or None, settings, at(seconds)).collect()
        return {r["name"]: r["outcome"] for r in rows}

    assert run(1, 3) == {}  # both still in their debounce
    assert run(2, 5) == {"a.txt": "published"}
    touch("b", 5)  # a new event starts the debounce again
    assert run(3, 7) == {} and run(4, 9) == {"b.txt": "published"}

    write(source, c="text of c")
    touch("c", 10)
    read = fs.read_files

    def gone(listing, max_bytes):
        (source / "c.txt").rename(tmp_path / "c.txt")
        found = read(listing, max_bytes).collect()
        (tmp_path / "c.txt").rename(source / "c.txt")
        return spark.createDataFrame(found, fs.READ_SCHEMA)

    monkeypatch.setattr(fs, "read_files", gone)
    assert run(5, 20) == {"c.txt": "retry"}
    monkeypatch.setattr(fs, "read_files", read)
    assert run(6, 25) == {}  # due at 30, left alone at 25
    assert run(7, 30) == {"c.txt": "published"}
    assert versions.read_newest(spark, out, "retries", 7).isEmpty()

    write(source, d="text of d")
    touch("d", 31)

    def changing(listing, max_bytes):
        touch("d", 38)
        return read(listing, max_bytes)

    monkeypatch.setattr(fs, "read_files", changing)
    assert run(8, 37) == {}  # no longer the file of its job: queued again
    (job,) = versions.read_newest(spark, out, "retries", 8).orderBy(F.desc("seq")).limit(1).collect()
    assert job["kind"] == "changed"
    monkeypatch.setattr(fs, "read_files", read)
    assert run(9, 40) == {} and run(10, 42) == {"d.txt": "published"}

    write(source, e="text of e")
    touch("e", 50)
    assert run(11, 51) == {}
    (source / "e.txt").unlink()  # gone before its turn: tried as often as allowed, with the delay between
    assert run(12, 54) == {"e.txt": "retry"} and run(13, 60) == {} and run(14, 64) == {"e.txt": "retry"}
    assert run(15, 74) == {"e.txt": "failed"} and run(16, 99) == {}


def test_refresh_until_idle(spark, tmp_path, light):
    source, out = tmp_path / "in", f"{tmp_path}/out"
    write(source, a="text of a")
    assert refresh_until_idle(spark, str(source), out, idle_seconds=2) == 1
    assert [n for n, _ in state(spark, out, 1)[0]] == ["a.txt.md"]


def test_streaming_jobs_come_out_when_due(spark, tmp_path):
    """A file due in 10 s is left alone at 5 s and taken at 10 s, as in ``due_jobs``."""
    schema, folder = "path string, ts timestamp, seq bigint, kind string", f"{tmp_path}/log"
    log = lambda *rows: spark.createDataFrame([(p, datetime.fromtimestamp(1_700_000_000 + t, timezone.utc), s, k) for p, t, s, k in rows], schema)
    os.mkdir(folder)
    jobs = streams.due_jobs_stream(spark.readStream.schema(schema).parquet(folder), max_attempts=3)
    seen = []

    def play(*rows):
        log(*rows).coalesce(1).write.mode("append").parquet(folder)
        query = jobs.writeStream.foreachBatch(lambda b, _: seen.extend((r.path, r.attempts, r.status) for r in b.collect())).option("checkpointLocation", f"{tmp_path}/c")
        query.outputMode("append").trigger(availableNow=True).start().awaitTermination()
        found = sorted(set(seen))
        seen.clear()
        return [f for f in found if f[0] != "clock"]

    assert play(("a", 0, 1, "event"), ("a", 0, 2, "os_error"), ("b", 0, 1, "event"), ("c", 0, 1, "event"), ("c", 0, 2, "success"), ("gone", 0, 1, "os_error"), ("gone", 0, 2, "os_error"), ("gone", 0, 3, "os_error")) == []
    assert play(("clock", 5, 3, "success")) == [("b", 0, "pending")]  # the debounce is one second
    assert play(("clock", 9, 4, "success")) == []
    assert play(("clock", 11, 5, "success")) == [("a", 1, "retry")]
    assert play(("a", 12, 6, "os_error"), ("clock", 13, 7, "success")) == []
    assert play(("clock", 23, 8, "success")) == [("a", 2, "retry")]
    batch = intake.retry_ledger(log(("a", 0, 1, "event"), ("a", 0, 2, "os_error")))
    due = lambda seconds: [r.path for r in intake.due_jobs(batch, F.timestamp_seconds(F.lit(1_700_000_000 + seconds))).collect()]
    assert due(5) == [] and due(10) == ["a"]


def test_files_are_read_by_path_and_large_ones_by_their_head(spark, tmp_path):
    source = tmp_path / "in #1 [x] %20"
    source.mkdir()
    (source / "_x.txt").write_text("text of x")
    (source / "old.txt").write_text("old")
    (source / "wave.bin").write_bytes(b"RIFF\x00\x00\x00\x00WAVEfmt " + b"0" * 100)
    (source / "large.txt").write_bytes(b"0" * 100)
    (source / "ä b.txt").write_text("ä")
    (source / "folder.txt").mkdir()
    os.utime(source / "old.txt", (1, 1))
    rows = process_files(fs.scan_files(spark, str(source), 50), f"file:{source}", Settings(max_input_bytes=50)).collect()
    assert {r["name"]: r["reason"] for r in rows} == {"_x.txt": None, "old.txt": None, "wave.bin": "blocked_media", "large.txt": "too_large", "ä b.txt": None}
    changed = fs.list_files(spark, str(source)).filter("path like '%old.txt'")
    (row,) = fs.read_files(changed).collect()
    assert bytes(row["content"]) == b"old" and row["modificationTime"].timestamp() == 1
    spark_rows = spark.read.format("binaryFile").load(f"{tmp_path}/in*").select("path", "modificationTime", "length")
    assert spark_rows.exceptAll(fs.list_files(spark, str(source)).select(spark_rows.columns)).isEmpty()
    assert fs.read_files(changed.withColumn("path", F.lit("file:/no/such/file"))).isEmpty()


def test_members_left_out_reach_the_outcomes(spark, tmp_path):
    import io
    import zipfile

    source, out, buffer = tmp_path / "in", f"{tmp_path}/out", io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as archive:
        archive.writestr("a.txt", "one")
        archive.writestr("pic.png", "p")
    source.mkdir()
    (source / "bundle.zip").write_bytes(buffer.getvalue())
    refresh_folder(spark, str(source), out, 1)
    outcomes = {r["name"]: r["outcome"] for r in versions.read_version(spark, out, "outcomes", 1).collect()}
    assert outcomes == {"bundle.zip.md": "published", "bundle.zip!pic.png.md": "rejected"}
    (refused,) = versions.read_version(spark, out, "refused", 1).collect()
    assert refused["reason"] == "no_converter"


def test_quarantine_keeps_the_whole_text(spark, tmp_path):
    from mdloom.operators.publish import quarantine_full

    docs = spark.createDataFrame([("a", "x" * 3_000_000)], "name string, markdown string")
    finding = F.struct(F.lit(1).alias("line_no"), F.lit(1).alias("col"), F.lit("MD999").alias("rule"), F.repeat(F.lit("m"), F.lit(1000)).alias("message"))
    row = quarantine_full(docs.withColumn("diagnostics", F.array_repeat(finding, 200))).first()
    assert len(row["markdown"]) == 1_048_576 and len(row["full_markdown"]) == 3_000_000
    assert len(row["report"]) < 70_000 and row["full_report"].count("\n") == 199 and len(row["full_report"]) > 200_000
