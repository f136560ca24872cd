"""Folders in, published and quarantined tables out."""

from __future__ import annotations

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from mdloom.functions import fixed, html, lint
from mdloom.functions import text as tx
from mdloom.functions.admission import inside_root
from mdloom.functions.csv_text import csv_to_markdown
from mdloom.functions.fixed import TRUNCATION_LINE
from mdloom.operators import archive, archive_ranges, intake, publish, tables
from mdloom.operators import lint as lint_ops
from mdloom.operators import repair as repair_ops
from mdloom.plans.pipeline import Settings, compact_published, process_documents, process_files, publish_run, read_published, read_quarantine, refresh_folder
from mdloom.sources import files as fs
from mdloom.streaming import intake as streams


def zipped(members, method=zipfile.ZIP_DEFLATED) -> bytes:
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", method) as archive:
        for name, data in members.items():
            archive.writestr(name, data)
    return buffer.getvalue()


FILES = {
    "plain.txt": b"#  Heading.\ntext   ",
    "utf16.txt": "# Grüße\nhallo".encode("utf-16"),
    "empty.txt": b"  \n",
    "page.html": b"<html><head><title>P</title></head><body><h1>Hi</h1><p>x &amp; y<ul><li>a<li>b</ul></body></html>",
    "table.csv": b'a,b\n1,"x, y"\n2\n3,4,5\n',
    "span.txt": b"<span>kept</span>",
    "song.mp3": b"not a song",
    "wave.bin": b"RIFF\x00\x00\x00\x00WAVEfmt ",
    "frame.txt": b"\xff\xfa\x00\x00",
    "odd.bin": b"just text",
    "scan.pdf": b"%PDF-1.4",
    "damaged.zip": b"no archive",
    "hidden.bmp": zipped({"a.txt": b"x"}),
    "prefixed.rtf": b"{\\rtf1 A\n" + zipped({"a.txt": b"x"}),
    "nested.zip": zipped({"a.bmp": zipped({"b.txt": b"x"})}),
    "nestedname.zip": zipped({"a.docx": b"x"}),
    "media.zip": zipped({"a.txt": b"RIFF\x00\x00\x00\x00AVI x"}),
    "bomb.zip": zipped({"large.txt": b"0" * (2 * 1024 * 1024)}),
    "many.zip": zipped({f"{i}.txt": b"" for i in range(1001)}),
    "book.epub": zipped({"mimetype": b"application/epub+zip", "a.xhtml": b"<p>x</p>"}),
    "bundle.zip": zipped({"b/two.html": b"<h1>Two</h1>", "a.txt": b"one", "_rels/.rels": b"x", "pic.png": b"p"}),
    "latin.txt": "# Grüße".encode("latin-1"),
    "broken16.txt": b"\xff\xfe\x00\xd8x\x00",
    "locked.zip": zipped({"a.txt": b"secret"}).replace(b"PK\x01\x02\x14\x03\x14\x00\x00\x00", b"PK\x01\x02\x14\x03\x14\x00\x01\x00"),
    "crc.zip": zipped({"a.txt": b"abc" * 99}, zipfile.ZIP_STORED).replace(b"abcabcabc", b"abcabcabX", 1),
    ".secret.txt": b"x",
    "~$lock.txt": b"x",
}
REASONS = {
    "song.mp3": "blocked_media", "wave.bin": "blocked_media", "frame.txt": "blocked_media", "odd.bin": "unsupported_type",
    "scan.pdf": "no_converter", "damaged.zip": "damaged_archive", "hidden.bmp": "archive_in_disguise",
    "prefixed.rtf": "archive_in_disguise", "nested.zip": "nested_archive", "nestedname.zip": "nested_archive",
    "media.zip": "blocked_media", "bomb.zip": "unsafe_ratio", "many.zip": "too_many_entries", "book.epub": "unsupported_member",
    "broken16.txt": "undecodable_text", "locked.zip": "unreadable_member", "crc.zip": "unreadable_member",
}


@pytest.fixture
def folder(tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for name, data in FILES.items():
        (source / name).write_bytes(data)
    return source


def test_files_to_outcomes(spark, folder, tmp_path):
    results = process_files(fs.scan_files(spark, str(folder)), f"file:{folder}", Settings(max_attempts=2))
    rows = {r["name"]: r for r in results.collect()}
    assert set(rows) == {n for n in FILES if not n.startswith((".", "~$"))}
    assert {n: r["reason"] for n, r in rows.items() if r["reason"]} == REASONS
    assert rows["plain.txt"]["markdown"] == "# Heading\n\ntext\n"
    assert rows["utf16.txt"]["markdown"] == "# Grüße\n\nhallo\n"
    assert rows["latin.txt"]["markdown"] == "# Grüße\n"
    assert rows["empty.txt"]["markdown"] == "" and rows["empty.txt"]["attempts"] == 0
    assert rows["page.html"]["markdown"] == "# Hi\n\nx & y\n\n- a\n- b\n"
    assert rows["table.csv"]["markdown"] == "# table\n\n| a | b |  |\n| --- | --- | --- |\n| 1 | x, y |  |\n| 2 |  |  |\n| 3 | 4 | 5 |\n"
    assert rows["bundle.zip"]["markdown"].startswith("# bundle\n\n## b/two.html\n\n")
    assert "## a.txt\n\none" in rows["bundle.zip"]["markdown"]
    assert rows["span.txt"]["outcome"] == "quarantined" and rows["span.txt"]["attempts"] == 2
    report = {r["outcome"]: r["n"] for r in publish.run_report(results).collect()}
    assert report == {"published": 7, "quarantined": 1, "rejected": len(REASONS)}

    old = spark.createDataFrame([("span.txt.md", "old span"), ("plain.txt.md", "old plain")], "name string, markdown string")
    fs.publish_sink(old, f"{tmp_path}/out/published", 1)
    publish_run(results, f"{tmp_path}/out", 2)
    published = {r["name"]: r["markdown"] for r in read_published(spark, f"{tmp_path}/out", 2).collect()}
    assert published["span.txt.md"] == "old span" and published["plain.txt.md"] == "# Heading\n\ntext\n"
    (kept,) = read_quarantine(spark, f"{tmp_path}/out", 2).collect()
    assert kept["name"] == "span.txt.md" and "MD033" in kept["report"] and kept["report"].endswith("\n")


def test_files_outside_and_too_large(spark, folder):
    files = fs.scan_files(spark, str(folder)).filter("path like '%plain.txt'")
    assert process_files(files, "file:/elsewhere").first()["reason"] == "outside_root"
    small = Settings(max_input_bytes=3)
    assert process_files(files, f"file:{folder}", small).first()["reason"] == "too_large"


def test_sinks_keep_versions_and_limits(spark, tmp_path):
    rows = spark.createDataFrame([("a.md", "x" * 10)], "name string, markdown string")
    fs.publish_sink(rows, f"{tmp_path}/p", 1)
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        fs.publish_sink(rows, f"{tmp_path}/p", 1)
    with pytest.raises(Exception, match="size limit"):
        fs.publish_sink(rows, f"{tmp_path}/p", 2, max_bytes=4)
    assert not (tmp_path / "p" / "version=2" / "_SUCCESS").exists()


def test_refresh_takes_only_what_changed(spark, tmp_path):
    source, out = tmp_path / "in", f"{tmp_path}/out"
    source.mkdir()
    for name in ("a.txt", "b.txt", "c.txt"):
        (source / name).write_text(f"text of {name}")
    assert refresh_folder(spark, str(source), out, 1).count() == 3
    (source / "b.txt").write_text("<b>no longer valid</b>")
    (source / "c.txt").write_text("new text of c")
    (source / "d.txt").write_text("text of d")
    second = refresh_folder(spark, str(source), out, 2, previous=1)
    assert {r["name"]: r["outcome"] for r in second.collect()} == {"b.txt": "quarantined", "c.txt": "published", "d.txt": "published"}
    published = {r["name"]: r["markdown"] for r in read_published(spark, out, 2).collect()}
    assert published == {
        "a.txt.md": "# a\n\ntext of a.txt\n", "b.txt.md": "# b\n\ntext of b.txt\n",
        "c.txt.md": "# c\n\nnew text of c\n", "d.txt.md": "# d\n\ntext of d\n",
    }
    assert refresh_folder(spark, str(source), out, 3, previous=2).isEmpty()
    assert [r["name"] for r in read_quarantine(spark, out, 3).collect()] == ["b.txt.md"]  # stands until it is replaced
    assert {p.name for p in (tmp_path / "out" / "published").iterdir()} == {"version=1", "version=2", "version=3"}
    compact_published(spark, out, 4)
    whole = {r["name"]: r["markdown"] for r in fs.read_version(spark, f"{out}/published", 4).collect()}
    assert whole == published == {r["name"]: r["markdown"] for r in read_published(spark, out, 4).collect()}
    (source / "b.txt").write_text("valid again")
    refresh_folder(spark, str(source), out, 5, previous=3)
    assert read_quarantine(spark, out, 5).isEmpty() and read_published(spark, out, 5).filter("name = 'b.txt.md'").first()["markdown"] == "# b\n\nvalid again\n"


def test_names_like_patterns_and_roots_with_schemes(spark, tmp_path):
    source = tmp_path / "in [1]"
    source.mkdir()
    for name in ("a[1].txt", "b{c}.txt", "d.txt"):
        (source / name).write_text(f"text of {name}")
    assert fs.root_of("file:///x/in/") == fs.root_of("file:/x/in") == fs.root_of("/x/y/../in") == "file:/x/in"
    plain = tmp_path / "in"
    plain.mkdir()
    for name in ("a[1].txt", "b.txt"):
        (plain / name).write_text(f"text of {name}")
    results = refresh_folder(spark, f"file://{plain}", f"{tmp_path}/out", 1)
    assert {r["name"]: r["outcome"] for r in results.collect()} == {"a[1].txt": "published", "b.txt": "published"}


def test_dot_segments_do_not_leave_the_root(spark):
    paths = ["file:/corpus/in/a.txt", "file:/corpus/in/x/../a.txt", "file:/corpus/in/../secret/a.txt", "file:/corpus/in/./b..txt", "file:/corpus/inside/a.txt"]
    rows = spark.createDataFrame([(p,) for p in paths], "path string").select(inside_root(F.col("path"), "file:/corpus/in").alias("inside"))
    assert [r["inside"] for r in rows.collect()] == [True, True, False, True, False]


def test_a_file_that_vanishes_is_tried_again(spark, tmp_path, monkeypatch):
    source, out = tmp_path / "in", f"{tmp_path}/out"
    source.mkdir()
    (source / "a.txt").write_text("text of a")
    (source / "b.txt").write_text("text of b")
    read = fs.read_files

    def late(listing, max_bytes):
        (source / "b.txt").unlink()
        return read(listing, max_bytes)

    monkeypatch.setattr(fs, "read_files", late)
    first = refresh_folder(spark, str(source), out, 1)
    assert {r["name"]: r["outcome"] for r in first.collect()} == {"a.txt": "published", "b.txt": "retry"}
    assert [r["outcome"] for r in fs.read_version(spark, f"{out}/refused", 1).collect()] == ["retry"]
    monkeypatch.setattr(fs, "read_files", read)
    (source / "b.txt").write_text("text of b")
    second = refresh_folder(spark, str(source), out, 2, previous=1)
    assert {r["name"]: r["outcome"] for r in second.collect()} == {"b.txt": "published"}
    assert fs.read_version(spark, f"{out}/retries", 2).isEmpty()


@pytest.mark.parametrize("width", [80, 200])
def test_lines_are_checked_at_the_width_they_are_wrapped_to(spark, width):
    docs = spark.createDataFrame([("a.txt", "a", "text", " ".join(["word"] * 200), None)], "name string, title string, format string, body string, reason string")
    row = process_documents(docs, Settings(line_length=width)).first()
    assert row["outcome"] == "published" and width - 5 < max(map(len, row["markdown"].split("\n"))) <= width


@pytest.mark.parametrize(
    ("source", "expected"),
    [
        ("<a href='http://u'>t</a> <a href=http://v>s</a>", "[t](http://u) [s](http://v)"),
        ('<b class="k">x</b> <em id=e>y</em>', "**x** *y*"),
        ("<p>caf&eacute; &pound;5 &amp;eacute; &nosuch;</p>", "caf\u00e9 \u00a35 &eacute; &nosuch;"),
        ("<table><caption>Sales 2020</caption><tr><td>1</td></tr></table>", "Sales 2020\n\n| 1 |\n| --- |"),
    ],
)
def test_html_forms(spark, source, expected):
    assert spark.range(1).select(html.html_to_markdown(F.lit(source)).alias("m")).first()["m"] == expected


def test_csv_keeps_every_cell(spark):
    row = spark.range(1).select(csv_to_markdown(F.lit("a,b\n1,2,KEEP\n3")).alias("m")).first()
    assert row["m"] == "| a | b |  |\n| --- | --- | --- |\n| 1 | 2 | KEEP |\n| 3 |  |  |"


def test_tables_in_parts_lose_no_row(spark):
    rows = spark.range(3000).select((F.col("id") % 7 == 0).alias("g"), "id", F.repeat(F.lit("x"), F.when(F.col("id") == 5, 900).otherwise(3)).alias("v"))
    parts = tables.table_to_markdown(rows, ["g"], ["id"], ["id", "v"], max_bytes=500).collect()
    for group in (True, False):
        own = sorted((r["part_no"], r["markdown"]) for r in parts if r["g"] == group)
        assert [n for n, _ in own] == list(range(len(own))) and len(own) > 5
        assert all(len(text.encode()) <= 500 or text.count("\n") == 2 for _, text in own)
        ids = [int(line.split(" | ")[0][2:]) for _, text in own for line in text.split("\n")[2:]]
        assert ids == [i for i in range(3000) if (i % 7 == 0) == group]


def test_front_matter_titles(spark):
    texts = ["---\ntitle: x\n---", "---\nTITLE\u00a0: x\n---", "---\nx\u2028title: y\n---", "---\nsubtitle: y\n---"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(tx.front_matter_has_title(F.col("t")).alias("has"))
    assert [r["has"] for r in rows.collect()] == [True, True, False, False]


def test_stream_equals_batch_and_skips_done_files(spark, folder, tmp_path):
    batches = []

    def sink(batch, batch_id):
        done = process_files(batch, f"file:{folder}").select("name", "markdown", "outcome")
        done.write.mode("append").parquet(f"{tmp_path}/out")
        batches.append(batch_id)

    def run():
        streams.run_until_idle(
            streams.stream_new_files(spark, str(folder), sink, f"{tmp_path}/checkpoint", target=f"{tmp_path}/out")
        )
        return sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()), key=repr)

    first = run()
    batch = process_files(fs.scan_files(spark, str(folder)), f"file:{folder}").select("name", "markdown", "outcome")
    assert first == sorted(map(tuple, batch.collect()), key=repr)
    (folder / "late.txt").write_bytes(b"late")
    assert len(run()) == len(first) + 1 and len(batches) == 2
    with pytest.raises(ValueError):
        streams.stream_new_files(spark, str(folder), sink, f"{tmp_path}/c2", target=f"file:{folder}/")


def test_changed_files_see_overwrites(spark):
    schema = "path string, length bigint, modificationTime timestamp"
    time = "timestamp '2024-01-01'"
    listing = spark.sql(f"select * from values ('a', 1L, {time}), ('b', 2L, {time}), ('c', 3L, {time}) t(path, length, modificationTime)")
    ledger = spark.sql(f"select * from values ('a', 1L, {time}), ('b', 9L, {time}) t(path, length, modificationTime)")
    assert schema and {r["path"] for r in intake.changed_files(listing, ledger).collect()} == {"b", "c"}


def test_streaming_bursts_equal_batch_bursts(spark, tmp_path):
    events = spark.range(200).selectExpr(
        "id as event_id", "timestamp_seconds(1700000000 + id * 2 + (id % 7) * 3) as ts", "id % 3 as path", "concat('s', id) as state"
    )
    events.write.parquet(f"{tmp_path}/events")
    batch = intake.debounce(events, "path", gap_seconds=7, bucket_seconds=20)
    assert batch.agg(F.sum("events")).first()[0] == 200
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/events")
    bursts = streams.debounce_stream(stream, "path", gap_seconds=7)
    query = bursts.writeStream.format("memory").queryName("bursts").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    streamed = spark.table("bursts")
    # The last burst of a path stays open until the watermark passes it.
    assert streamed.count() > 0
    columns = ["path", "started", "ended", "events", "state"]
    assert streamed.select(columns).exceptAll(batch.select(columns)).isEmpty()
    one_bucket = intake.debounce(events, "path", gap_seconds=7, bucket_seconds=10**6)
    assert one_bucket.exceptAll(batch).isEmpty() and batch.exceptAll(one_bucket).isEmpty()


def test_retry_ledger(spark):
    log = spark.sql(
        """select path, timestamp_seconds(seq) as ts, seq, kind from values
        ('new', 1, 'event'), ('busy', 1, 'event'), ('busy', 2, 'os_error'), ('busy', 3, 'os_error'),
        ('gone', 1, 'os_error'), ('gone', 2, 'os_error'), ('gone', 3, 'os_error'), ('gone', 4, 'os_error'), ('gone', 5, 'os_error'),
        ('again', 1, 'os_error'), ('again', 200000, 'event'), ('again', 400000, 'os_error'),
        ('moving', 1, 'changed'), ('moving', 2, 'changed'), ('bad', 1, 'value_error'), ('lint', 1, 'lint_error'), ('ok', 1, 'success')
        t(path, seq, kind)"""
    )
    rows = {r["path"]: (r["attempts"], r["status"]) for r in intake.retry_ledger(log).collect()}
    assert rows == {
        "new": (0, "pending"), "busy": (2, "retry"), "gone": (5, "failed"), "again": (1, "retry"), "moving": (2, "requeued"),
        "bad": (0, "rejected"), "lint": (0, "quarantined"), "ok": (0, "done"),
    }
    due = intake.due_jobs(intake.retry_ledger(log), F.timestamp_seconds(F.lit(13)))
    assert {r["path"] for r in due.collect()} == {"new", "busy", "moving"}


def test_report_is_cut_the_same_way_as_rows_and_as_text(spark):
    rows = spark.range(3).crossJoin(spark.range(1000).withColumnRenamed("id", "n"))
    found = rows.selectExpr("id as doc_id", "'f' as name", "cast(n as int) as line_no", "1 as col", "'MD999' as rule", "repeat('x', 100 * cast(id as int)) as message")
    by_rows = lint_ops.cap_report(lint_ops.format_diagnostics(found))
    arrays = found.groupBy("doc_id").agg(F.collect_list(F.struct("line_no", "col", "rule", "message")).alias("d"))
    by_text = arrays.select("doc_id", lint.report(F.lit("f"), F.col("d")).alias("report"))
    a, b = (dict(map(tuple, x.collect())) for x in (by_rows, by_text))
    assert a == b
    assert a[2].endswith("\n" + TRUNCATION_LINE) and len(a[2]) <= 65536 + 30 and not a[0].endswith(TRUNCATION_LINE)


def test_limits_count_bytes(spark):
    wide = spark.range(1).select(F.repeat(F.lit("漢"), 16 * 1024 * 1024 // 3 + 1).alias("t"))
    assert wide.select(tx.within_output_limit(F.col("t"))).first()[0] is False
    docs = spark.createDataFrame([(1, "t", "word " * 50)], "doc_id long, title string, markdown string")
    row = repair_ops.repair_until_clean(docs, max_bytes=40).first()
    assert not row["is_clean"] and row["diagnostics"][0]["rule"] == repair_ops.TOO_LARGE


HTML = {
    "<p>a&lt;b&gt; &#8364;&#x41;&#0;": "a&lt;b&gt; €A�",
    "<!-- x --><b>x</b> <i>y</i> <code>z</code>": "**x** *y* `z`",
    "<b>open <p>text": "open\n\ntext",
    '<a class="k" href="u">t</a> <img src="s" alt="i">': "[t](u) ![i](s)",
    "<table><tr><th>A</th><th>B|C</th></tr><tr><td>1<td>2</tr></table>": "| A | B\\|C |\n| --- | --- |\n| 1 | 2 |",
    "<p>x</p><pre>  a &lt; b\n\n\n  c</pre><p>y</p>": "x\n\n```\n  a < b\n\n\n  c\n```\n\ny",
    "<script>x<p></script>y<style>z": "y",
    "<h2>a<br>b</h2>": "## a\nb",
    "a < b": "a < b",
}


def test_missing_values_are_blank_documents(spark):
    docs = spark.createDataFrame([(1, None, None), (2, None, "text")], "doc_id long, title string, markdown string")
    rows = {r["doc_id"]: (r["markdown"], r["is_clean"]) for r in repair_ops.repair_until_clean(docs).collect()}
    assert rows == {1: ("", True), 2: ("# Document\n\ntext\n", True)}


def test_html(spark):
    frame = spark.createDataFrame(list(HTML.items()), "given string, wanted string")
    rows = frame.withColumn("got", html.html_to_markdown(F.col("given"))).filter("got != wanted").collect()
    assert not rows


def test_csv(spark):
    text = 'h,"a ""q"""\r\n"two\nlines",x|y\n'
    got = spark.createDataFrame([(text,)], "t string").select(csv_to_markdown(F.col("t"))).first()[0]
    assert got == '| h | a "q" |\n| --- | --- |\n| two lines | x\\|y |'


def test_repair_needs_no_exchange(spark, folder):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id", "'t' as title", "text as markdown")
    for frame in (repair_ops.prepare_documents(docs), repair_ops.scan_documents(docs)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Python" not in plan


def test_large_and_hostile_documents_stay_linear(spark):
    n = 20_000
    texts = {
        "fence": "```\n" + "code\n" * n + "```\nx", "unclosed": "```\n" + "~~~\n" * n, "fences": "```\na\n```\n" * n,
        "blank": "\n" * n + "x", "table": "| a | b |\n| --- | --- |\n" + "| 1 | 2 |\n" * n, "broken": "| a | b |\n" * n,
        "list": "- item\n" * n, "headings": "# Head\n" * n, "line": "word " * n, "tags": "<b " * n, "brackets": "[" * n + "http://a",
        "links": "[a](http://b) http://c " * n, "ticks": "` http://a " * n,
    }
    docs = spark.createDataFrame([(k, "t", v) for k, v in texts.items()], "name string, title string, markdown string")
    done = repair_ops.scan_documents(repair_ops.prepare_documents(docs.repartition(8)))
    sizes = {r["name"]: r["n"] for r in done.select("name", F.length("markdown").alias("n"), "diagnostics").collect()}
    assert sizes["blank"] == len("# t\n\nx") and sizes["fence"] > 5 * n and len(sizes) == len(texts)
    pages = {"img": "<img x " * n, "a": "<a " * n, "pre": "<pre>x" * n, "h1": "<h1>x" * n, "lt": "a < b " * n, "comment": "<!-- x" * n}
    frame = spark.createDataFrame(list(pages.items()), "name string, html string")
    assert len(frame.select(html.html_to_markdown(F.col("html"))).collect()) == len(pages)


def test_archives_are_listed_whole(spark):
    many = zipped({f"{i}.txt": b"x" for i in range(1200)})
    rows = archive.archive_members(spark.createDataFrame([("file:/a.zip", bytearray(many))], "path string, content binary")).collect()
    assert len(rows) == 1200 and all(bytes(r["head"]) == b"x" for r in rows)


def test_files_with_their_bytes_in_rows(spark, folder):
    """Archives in rows and archives by path give the same."""
    files = fs.scan_files(spark, str(folder))
    data = spark.createDataFrame([(f"file:{folder}/{n}", bytearray(d)) for n, d in FILES.items()], "path string, bytes binary")
    whole = files.drop("content").join(data.withColumnRenamed("bytes", "content"), "path")
    columns = ["name", "markdown", "reason", "outcome", "attempts", "length", "modificationTime", "refused_members"]
    rows = [sorted(process_files(f, f"file:{folder}", Settings(max_attempts=1)).select(*columns).collect()) for f in (files, whole)]
    assert files.filter("path like '%.zip' and content is not null").isEmpty() and rows[0] == rows[1]


def test_one_archive_by_several_tasks(spark, tmp_path):
    members = {f"d/{i}.txt": bytes([97 + i % 26]) * (1000 + i) for i in range(40)} | {"d/": b"", "pic.png": b"p"}
    (tmp_path / "big.zip").write_bytes(zipped(members))
    (tmp_path / "none.zip").write_bytes(zipped({}))
    (tmp_path / "short.zip").write_bytes(b"PK")
    paths = [f"file:{tmp_path}/{n}.zip" for n in ("big", "none", "short", "gone")]
    listed = archive_ranges.list_members(spark.createDataFrame([(p,) for p in paths], "path string"), group_bytes=5000).cache()
    empty = {r["path"].rsplit("/")[-1]: r["is_zip_file"] for r in listed.filter("entry_no is null").collect()}
    assert empty == {"none.zip": True, "short.zip": False}
    own = listed.filter("entry_no is not null")
    assert own.count() == len(members) and own.select("group_no").distinct().count() > 5
    read = archive_ranges.read_members(own.filter("not is_dir")).withColumn("task", F.spark_partition_id()).cache()
    assert {r["entry_name"]: bytes(r["content"]) for r in read.collect()} == {n: d for n, d in members.items() if n != "d/"}
    assert read.select("task").distinct().count() > 2
    by_range = {r["entry_no"]: (bytes(r["head"]), r["is_zip"], r["unreadable"]) for r in archive_ranges.peek_members(own.filter("not is_dir")).collect()}
    in_rows = archive.archive_members(spark.createDataFrame([(paths[0], bytearray((tmp_path / "big.zip").read_bytes()))], "path string, content binary"))
    assert by_range == {r["entry_no"]: (bytes(r["head"]), r["is_zip"], r["unreadable"]) for r in in_rows.filter("not is_dir").collect()}


def test_an_archive_that_changes_or_goes_meanwhile(spark, tmp_path, monkeypatch):
    source = tmp_path / "in"
    source.mkdir()
    for name in ("stays", "grows", "goes"):
        (source / f"{name}.zip").write_bytes(zipped({"a.txt": b"one"}))
    before = archive_ranges.read_members

    def meanwhile(members):
        (source / "grows.zip").write_bytes(zipped({"a.txt": b"one", "b.txt": b"two"}))
        (source / "goes.zip").rename(tmp_path / "goes.zip")
        return before(members)

    monkeypatch.setattr(archive_ranges, "read_members", meanwhile)
    results = refresh_folder(spark, str(source), f"{tmp_path}/out", 1)
    assert {r["name"]: r["outcome"] for r in results.collect()} == {"stays.zip": "published", "goes.zip": "retry"}
    monkeypatch.setattr(archive_ranges, "read_members", before)
    results = refresh_folder(spark, str(source), f"{tmp_path}/out", 2, previous=1)
    again = {r["name"]: r["outcome"] for r in results.collect()}  # with the other one, if its retry has come due by now
    assert again["grows.zip"] == "published" and "stays.zip" not in again
    assert "two" in read_published(spark, f"{tmp_path}/out", 2).filter("name = 'grows.zip.md'").first()["markdown"]


def test_members_without_converter_are_rows_with_a_reason(spark):
    rows = archive.expand_bundle(spark.createDataFrame([("file:/b.zip", bytearray(FILES["bundle.zip"]))], "path string, content binary")).collect()
    assert {r["entry_name"]: r["reason"] for r in rows} == {"b/two.html": None, "a.txt": None, "_rels/.rels": "no_converter", "pic.png": "no_converter"}


def test_fixed_values():
    """What both the queries and their SQL take from one place, pinned."""
    assert (fixed.MAX_INPUT_BYTES, fixed.MAX_MARKDOWN_BYTES, fixed.MAX_REPORT_CHARACTERS, fixed.MAX_QUARANTINE_CHARACTERS) == (52_428_800, 16_777_216, 65_536, 1_048_576)
    assert (fixed.MAX_ARCHIVE_ENTRIES, fixed.MAX_EXPANDED_BYTES, fixed.MAX_COMPRESSION_RATIO) == (1000, 268_435_456, 200)
    assert (fixed.LINE_LENGTH, fixed.MAX_ATTEMPTS, fixed.DEBOUNCE_SECONDS, fixed.RETRY_SECONDS) == (120, 5, 1, 10)
    assert " ".join(fixed.BLOCKED_MEDIA_SUFFIXES) == ".aac .avi .flac .m4a .mkv .mov .mp3 .mp4 .ogg .wav .webm .wma"
    assert " ".join(fixed.ZIP_SUFFIXES) == ".docx .epub .odp .ods .odt .pptx .xlsx .zip"


def test_report_partitions_follow_the_size_of_the_findings(spark, monkeypatch):
    rows = [(i % 40, i, 1, "R", "x" * 500) for i in range(400)]
    found = spark.createDataFrame(rows, "doc_id bigint, line_no int, col int, rule string, text string")
    monkeypatch.setattr(lint_ops, "PARTITION_BYTES", 4_000)
    reports = lint_ops.cap_report(found)
    assert reports.rdd.getNumPartitions() >= 400 * 500 / 4_000  # more than shuffle partitions: compressed sizes decide nothing
    assert {r["doc_id"]: r["report"] for r in reports.collect()} == {d: "\n".join(["x" * 500] * 10) for d in range(40)}


def test_archives_of_a_batch_are_inspected_one_at_a_time():
    import tracemalloc

    import pyarrow as pa

    def many():
        yield None
        for _ in range(200):
            yield bytes(1 << 18)

    batch = pa.array(many(), pa.binary())
    tracemalloc.start()
    found = archive.inspect_archive.func(batch)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.to_pylist() == [{"is_zip_file": False, "entries": 0, "expanded": 0, "compressed": 0, "members": []}] * 201
    assert peak < 4 << 20
