"""From inputs to outcomes: admission, conversion, repair, publication."""

from __future__ import annotations

import json
import time
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mdloom.functions import fixed
from mdloom.functions import text as tx
from mdloom.functions.csv_text import csv_to_markdown
from mdloom.functions.html import html_to_markdown
from mdloom.functions.lint import RULES, Rule, rules_for
from mdloom.operators import admission, archive, archive_ranges, intake, publish
from mdloom.operators.once import computed_once
from mdloom.operators.repair import repair_until_clean
from mdloom.sources import files as fs
from mdloom.sources import versions
from mdloom.sources.staging import staging_folder
from mdloom.streaming.intake import distinct_paths, stream_new_files

FILE_COLUMNS = ["path", "name", "title", "markdown", "reason", "length", "modificationTime", "refused_members"]
MEMBERS = "array<struct<entry_no bigint, entry_name string, reason string>>"


@dataclass(frozen=True)
class Settings:
    """What a run may vary."""

    max_attempts: int = fixed.MAX_ATTEMPTS
    line_length: int = fixed.LINE_LENGTH
    max_input_bytes: int = fixed.MAX_INPUT_BYTES
    debounce_seconds: float = fixed.DEBOUNCE_SECONDS
    retry_seconds: float = fixed.RETRY_SECONDS
    rules: Sequence[Rule] = RULES


def convert_documents(docs: DataFrame) -> DataFrame:
    """+markdown from format and body, +reason when the converted text is too large."""
    body, kind = F.col("body"), F.col("format")
    markdown = (
        F.when(kind == "html", html_to_markdown(body))
        .when(kind == "csv", csv_to_markdown(body))
        .otherwise(tx.text_to_markdown(body))
    )
    converted = docs.withColumn("markdown", markdown)
    reason = F.when(~tx.converted_size_guard(F.col("markdown")), "converted_too_large")
    return converted.withColumn("reason", reason)


def process_documents(docs: DataFrame, settings: Settings = Settings(), stage: str | None = None) -> DataFrame:
    """Documents (name, title, format, body) to outcomes, without any exchange."""
    return process_markdown(convert_documents(docs).drop("format", "body"), settings, stage)


def process_markdown(docs: DataFrame, settings: Settings = Settings(), stage: str | None = None) -> DataFrame:
    """Repair what has no refusal yet; +is_clean, +attempts, +diagnostics, +outcome."""
    pending = docs.withColumn("markdown", F.when(F.col("reason").isNull(), F.col("markdown")))
    repaired = repair_until_clean(pending, rules_for(settings.rules, settings.line_length), settings.max_attempts, settings.line_length, stage=stage)
    return publish.route_outcome(repaired)


def _gate(files: DataFrame, root: str, settings: Settings) -> DataFrame:
    """Verdicts over a listing. Of files over the size limit only the first bytes are looked at."""
    if "head" not in files.columns:
        files = files.withColumn("head", F.substring("content", 1, fs.HEAD_BYTES))
    content = F.when(F.col("length") <= settings.max_input_bytes, F.col("content"))
    judged = computed_once(files.withColumn("content", content), "content", "head")
    parts = admission.drop_hidden(admission.file_parts(judged))
    return admission.route_format(admission.admission_verdict(parts, root, settings.max_input_bytes))


def _judged(files: DataFrame, root: str, settings: Settings) -> DataFrame:
    """Gate and archive audit in the file's own row; ``closed``: an archive without its bytes, to be audited by range.

    Every ZIP ends with a directory record, so only files that hold its mark, or have a ZIP name,
    are handed to Python.
    """
    mark = F.contains(F.col("content"), F.unhex(F.lit("504B0506")))
    zip_name, closed = archive.is_zip_suffix(F.col("suffix")), F.col("closed")
    candidate = F.col("reason").isNull() & ~closed & (zip_name | mark)
    verdicts = _gate(files, root, settings).withColumn("closed", F.col("reason").isNull() & zip_name & F.col("content").isNull())
    verdicts = verdicts.withColumn("candidate", candidate)
    inspected = verdicts.withColumn("archive", archive.inspect_archive(F.when(F.col("candidate"), F.col("content"))))
    wrong_type = archive.archive_type_mismatch(
        inspected.withColumnRenamed("reason", "refused").withColumn("is_zip_file", F.when(closed, True).otherwise(F.col("archive.is_zip_file")))
    )
    audit = F.when(F.col("candidate"), F.coalesce(F.col("reason"), archive.inspected_reason(F.col("archive"))))
    no_converter = F.when(~closed & (F.col("format") == "no_converter"), "no_converter")
    return wrong_type.withColumn("reason", F.coalesce("refused", audit, no_converter)).drop("refused", "archive", "is_zip_file")


def _intake(files: DataFrame, root: str, settings: Settings) -> DataFrame:
    """Every file judged and, unless it is an archive, converted; bundles keep the bytes they came with."""
    judged = _judged(files, root, settings)
    admitted, bundle, closed = F.col("reason").isNull(), (F.col("format") == "bundle") | F.col("closed"), F.col("closed")
    read = judged.withColumn("body", F.when(admitted & ~bundle, tx.decode_text(F.col("content"))))
    undecodable = F.when(admitted & ~bundle & F.col("body").isNull(), "undecodable_text")
    refused = read.withColumn("refused", F.coalesce("reason", undecodable))
    converted = convert_documents(refused.drop("reason")).withColumn("reason", F.coalesce("refused", "reason"))
    kind = F.when(closed, "closed").when(admitted & bundle, "bundle").otherwise("single")
    return converted.select(
        "path", "name", F.col("stem").alias("title"), "format", "markdown", "reason", "length", "modificationTime",
        F.when(admitted & bundle, F.col("content")).alias("content"), kind.alias("kind"),
    )


def _bundles(bundles: DataFrame, parts: DataFrame) -> DataFrame:
    """Members become documents of their own, are converted, and are joined again per bundle; members without converter are listed."""
    members = admission.route_format(parts.filter("reason is null").drop("reason"))
    texts = archive.join_bundle(convert_documents(members.withColumn("body", tx.decode_text(F.col("content")))))
    entry = F.struct("entry_no", "entry_name", "reason")
    refused = parts.filter("reason is not null").groupBy("path").agg(F.sort_array(F.collect_list(entry)).alias("refused_members"))
    joined = bundles.select("path", "name", "title", "length", "modificationTime").join(texts, "path", "left").join(refused, "path", "left")
    # A bundle without a convertible member is an empty document, not a missing one.
    markdown = F.when(F.col("has_members").isNull(), F.lit("")).otherwise(F.col("markdown"))
    reason = F.when(F.col("markdown").isNull(), "unreadable_member").when(
        ~tx.converted_size_guard(F.col("markdown")), "converted_too_large"
    )
    return joined.withColumn("markdown", markdown).withColumn("reason", reason).select(*FILE_COLUMNS)


def _closed_archives(closed: DataFrame) -> DataFrame:
    """Archives known by path: judged by their directories and first bytes of members, joined from the members that are converted.

    Each step is a table of members, so the work on one archive is dealt out by groups of them. An archive that is gone before its last member
    is read is left out; of one that has changed, length or time are no longer those it was admitted with.
    """
    listed = _staged(archive_ranges.list_members(closed), "directories")
    few = listed.groupBy("path").agg(F.count("entry_no").alias("n")).filter(F.col("n") <= fixed.MAX_ARCHIVE_ENTRIES)
    opened = listed.filter("not is_dir").join(few, "path", "left_semi")  # one with too many entries is refused by count alone
    peeked = _staged(archive_ranges.peek_members(opened), "peeked")
    members = listed.join(peeked.select("path", "entry_no", "head", "is_zip", "unreadable"), ["path", "entry_no"], "left")
    verdicts = archive.archive_verdict(members).withColumnRenamed("reason", "verdict")
    zips = listed.groupBy("path").agg(F.bool_or("is_zip_file").alias("is_zip_file"))
    reason = F.coalesce(F.when(~F.col("is_zip_file"), "damaged_archive"), "verdict", F.when(F.col("format") == "no_converter", "no_converter"))
    refused_members = F.lit(None).cast(MEMBERS).alias("refused_members")
    judged = closed.join(zips, "path").join(verdicts, "path").withColumn("reason", reason)
    judged = _staged(judged.select(*FILE_COLUMNS[:-1], refused_members), "audited")

    admitted = judged.filter("reason is null")
    parts = listed.filter("not is_dir").join(admitted, "path", "left_semi")
    known = archive.has_converter(F.col("entry_name"))
    read = _staged(archive_ranges.read_members(parts.filter(known)), "members")
    columns = ["path", "entry_no", "entry_name", "content"]
    rest = parts.filter(~known).withColumn("content", F.lit(None).cast("binary")).select(*columns, F.lit("no_converter").alias("reason"))
    contents = read.select(*columns, F.lit(None).cast("string").alias("reason")).unionByName(rest)
    rows = judged.filter("reason is not null").unionByName(_bundles(admitted, archive.named_parts(contents)))

    times = F.struct("length", "modificationTime")
    looks = reduce(DataFrame.union, [t.select("path", times.alias("seen")) for t in (listed, peeked, read)])
    gone = F.bool_or(F.col("seen.length").isNull()).alias("gone")
    seen = looks.groupBy("path").agg(F.min("seen").alias("low"), F.max("seen").alias("high"), gone)
    last = F.when(F.col("low") != times, F.col("low")).otherwise(F.col("high"))
    found = rows.join(seen.filter("not gone"), "path").withColumn("seen", last)
    return found.withColumns({"length": F.col("seen.length"), "modificationTime": F.col("seen.modificationTime")}).select(*FILE_COLUMNS)


def process_files(files: DataFrame, root: str, settings: Settings = Settings(), stage: str | None = None) -> DataFrame:
    """A file listing with content to outcomes, one row per file that is not hidden.

    The files are read once: judged and converted rows are staged, archives apart. Archives that came with their bytes are opened in their rows,
    those that ``read_files`` leaves closed by ranges of members. ``refused_members`` lists the members of a bundle that have no converter,
    with the reason.
    """
    spark = files.sparkSession
    stage = stage or staging_folder(spark, "files")
    taken = _intake(files, root, settings)
    taken.write.mode("errorifexists").partitionBy("kind").parquet(f"{stage}/intake")
    staged = spark.read.schema(taken.schema).parquet(f"{stage}/intake")
    docs = staged.filter("kind = 'single'").withColumn("refused_members", F.lit(None).cast(MEMBERS)).select(*FILE_COLUMNS)
    bundles, closed = staged.filter("kind = 'bundle'"), staged.filter("kind = 'closed'")
    if not bundles.isEmpty():
        docs = docs.unionByName(_bundles(bundles, archive.expand_bundle(bundles)))
    if not closed.isEmpty():
        docs = docs.unionByName(_closed_archives(closed))
    return process_markdown(docs, settings, stage)


def _outcomes(named: DataFrame) -> DataFrame:
    """name, outcome, reason of every document and of every member of a bundle that was left out."""
    rows = named.select("name", "outcome", "reason")
    if "refused_members" not in named.columns:
        return rows
    left_out = F.col("member.entry_name")
    members = named.select("path", F.explode("refused_members").alias("member"))
    name = publish.output_name(F.concat(F.regexp_extract("path", r"([^/]+)\z", 1), F.lit("!"), left_out))
    return rows.unionByName(members.select(name.alias("name"), F.lit("rejected").alias("outcome"), F.col("member.reason").alias("reason")))


def publish_run(results: DataFrame, folder: str, version: int, source: str | None = None, **more: DataFrame) -> None:
    """Write what a run changes, all of it or nothing: valid documents, quarantined ones, refusals with their reasons, every outcome.

    The tables, and ``more`` of them, become visible by one commit at the end; a run that stops before that can simply be made again. A
    version holds the documents of its run only, so a refresh costs what changed. ``read_published`` and ``read_quarantine`` put the versions
    together; ``compact`` folds them into one. ``results`` reads the staged tables of the repair loop, so no write repairs anything again.
    """
    new = versions.NewVersion(results.sparkSession, folder, version, source)
    named = results.withColumn("name", publish.output_name(F.col("name")))
    outcomes = _outcomes(named)
    new.write(fs.valid_markdown(named.filter("outcome = 'published'")), "published")
    new.write(fs.ended_reports(publish.quarantine_full(named.filter("outcome = 'quarantined'"))), "quarantine")
    new.write(outcomes.filter("outcome in ('rejected', 'retry', 'failed')"), "refused")
    new.write(outcomes.select("name", "outcome"), "outcomes")
    for table, rows in more.items():
        new.write(rows, table)
    new.commit()


PUBLISHED = "name string, markdown string"
QUARANTINE = "name string, markdown string, report string, full_markdown string, full_report string"
OUTCOMES = "name string, outcome string"
LEDGER = "path string, length bigint, modificationTime timestamp"


def read_published(spark: SparkSession, folder: str, version: int) -> DataFrame:
    """Per name its latest valid Markdown as of a version."""
    return versions.read_latest(spark, folder, "published", version, empty=PUBLISHED).select("name", "markdown")


def read_quarantine(spark: SparkSession, folder: str, version: int, full: bool = False) -> DataFrame:
    """Documents whose latest run left them in the quarantine, as of a version; ``full`` adds the uncut text and report."""
    standing = versions.read_latest(spark, folder, "outcomes", version, empty=OUTCOMES).filter("outcome = 'quarantined'").select("name", "version")
    rows = versions.read_versions(spark, folder, "quarantine", version, QUARANTINE).join(standing, ["name", "version"], "left_semi")
    return rows.select("name", "markdown", "report", *(["full_markdown", "full_report"] if full else []))


def read_ledger(spark: SparkSession, folder: str, version: int) -> DataFrame:
    """Per path the length and time it had when it was last taken."""
    return versions.read_latest(spark, folder, "ledger", version, "path", LEDGER).select("path", "length", "modificationTime")


def compact_published(spark: SparkSession, folder: str, version: int) -> None:
    """Write the whole published set as ``version``; earlier versions are not needed to read it or later ones."""
    new = versions.NewVersion(spark, folder, version)
    new.write(fs.valid_markdown(read_published(spark, folder, version - 1)), "published")
    new.commit(whole=["published"])


def compact(spark: SparkSession, folder: str, version: int) -> None:
    """Write the published set, the standing quarantine, the outcomes and the ledger whole as ``version``, in one commit."""
    new, before = versions.NewVersion(spark, folder, version), version - 1
    new.write(fs.valid_markdown(read_published(spark, folder, before)), "published")
    new.write(read_quarantine(spark, folder, before, full=True), "quarantine")
    new.write(versions.read_latest(spark, folder, "outcomes", before, empty=OUTCOMES).select("name", "outcome"), "outcomes")
    new.write(read_ledger(spark, folder, before), "ledger")
    new.commit(whole=["published", "quarantine", "outcomes", "ledger"])


def refresh_folder(
    spark: SparkSession,
    folder: str,
    out: str,
    version: int,
    previous: int | None = None,
    settings: Settings = Settings(),
    now: datetime | None = None,
) -> DataFrame:
    """Process what is new or changed since ``previous`` and due at ``now``, and publish it with the ledger and what still waits.

    A new or changed file is due ``debounce_seconds`` after its last change. With the clock as ``now``, the run waits for files that only have
    that left to wait for; with a given ``now``, files that are not due yet wait for a later run. A file that cannot be read when its turn
    comes is a row with outcome ``retry``, due again after ``retry_seconds``, until ``max_attempts`` make it ``failed``. A file whose length or
    time are no longer those of its job is not published: it waits out the debounce again.
    """
    distinct_paths(folder, out)
    listing = fs.list_files(spark, folder).select("path", "length", "modificationTime")
    return _take_due(spark, listing, folder, out, version, previous or 0, settings, now)


def _staged(rows: DataFrame, purpose: str) -> DataFrame:
    folder = staging_folder(rows.sparkSession, purpose)
    rows.write.parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


def _take_due(
    spark: SparkSession, listing: DataFrame, folder: str, out: str, version: int, previous: int, settings: Settings, now: datetime | None, source: str | None = None
) -> DataFrame:
    """One version from a listing: of the whole folder, or of the files that a batch of a stream has found."""
    listing = _staged(listing, "listing")  # so that the ledger holds exactly what this run has looked at
    moment = now or datetime.now(timezone.utc)
    waited = versions.read_newest(spark, out, "retries", previous, intake.LOG_SCHEMA).select(*(f.split()[0] for f in intake.LOG_SCHEMA.split(", ")))
    log = _staged(intake.waiting_log(listing, read_ledger(spark, out, previous), waited, moment, 2 * version), "log")
    jobs = _staged(intake.waiting_jobs(log, settings.max_attempts, settings.retry_seconds, settings.debounce_seconds), "jobs")
    if now is None:
        soon = jobs.filter("status in ('pending', 'requeued')").agg(F.unix_micros(F.max("next_due"))).first()[0]
        if soon is not None and soon / 1e6 > moment.timestamp():
            time.sleep(min(settings.debounce_seconds, soon / 1e6 - moment.timestamp()))
            moment = datetime.now(timezone.utc)
    due = intake.due_jobs(jobs, moment)
    taken = process_files(fs.read_files(due, settings.max_input_bytes), fs.root_of(folder), settings)

    seen = due.join(admission.drop_hidden(admission.file_parts(due.select("path"))).select("path", "name"), "path")
    met = seen.join(taken.select("path", F.struct("length", "modificationTime").alias("found")), "path", "left")
    moved = met.filter(F.col("found").isNotNull() & (F.col("found") != F.struct("length", "modificationTime")))
    results = taken.join(moved.select("path"), "path", "left_anti").drop("length", "modificationTime")
    unread = met.filter("found is null").select(
        "path", "name", "length", "modificationTime", F.lit(None).cast("string").alias("reason"), F.lit(True).alias("io_error"), (F.col("attempts") + 1).alias("io_attempts"), F.lit(False).alias("is_clean")
    )
    unread = publish.route_outcome(unread, settings.max_attempts)
    entry = lambda kind, source: [F.lit(moment).alias("ts"), F.lit(2 * version + 1).cast("bigint").alias("seq"), F.lit(kind).alias("kind"), F.col(f"{source}length"), F.col(f"{source}modificationTime")]
    failed = unread.filter("outcome = 'retry'").select("path", *entry("os_error", ""))
    again = _staged(failed.unionByName(moved.select("path", *entry("changed", "found."))), "again")
    rest = jobs.filter(F.col("next_due") > F.lit(moment)).select("path").unionByName(again.select("path"))
    results = results.unionByName(unread.drop("io_error", "io_attempts", "length", "modificationTime"), allowMissingColumns=True)
    publish_run(
        results, out, version, source,
        retries=log.unionByName(again).join(rest, "path", "left_semi"),
        ledger=due.join(again, "path", "left_anti").select("path", "length", "modificationTime"),
    )
    return results


def refresh_until_idle(spark: SparkSession, folder: str, out: str, settings: Settings = Settings(), idle_seconds: float = fixed.IDLE_SECONDS, poll_seconds: float = 0.25) -> int:
    """Refresh whenever something is due, until nothing has waited or changed for ``idle_seconds``; the last version."""
    last, quiet = versions.latest_version(spark, out), time.monotonic()
    while time.monotonic() - quiet < idle_seconds:
        listing = fs.list_files(spark, folder).select("path", "length", "modificationTime")
        waiting = versions.read_newest(spark, out, "retries", last, intake.LOG_SCHEMA)
        if not intake.changed_files(listing, read_ledger(spark, out, last)).isEmpty() or not waiting.isEmpty():
            quiet = time.monotonic()
            soon = intake.waiting_jobs(waiting, settings.max_attempts, settings.retry_seconds, settings.debounce_seconds).agg(F.unix_micros(F.min("next_due"))).first()[0]
            fresh = intake.changed_files(listing, read_ledger(spark, out, last)).join(waiting.select("path"), "path", "left_anti")
            if soon is None or soon / 1e6 <= time.time() or not fresh.isEmpty():
                refresh_folder(spark, folder, out, last + 1, last or None, settings)
                last += 1
        time.sleep(poll_seconds)
    return last


def publish_stream(
    spark: SparkSession, folder: str, out: str, checkpoint: str, settings: Settings = Settings(), until_idle: bool = True
) -> StreamingQuery:
    """New files of a folder, published batch by batch; with ``until_idle`` the query stops when none are left.

    A batch becomes one version, committed with the stream's identity and the batch's number: a batch that is replayed after a crash finds its
    commit and does nothing, or none and is made anew. Ledger and waiting jobs are those of ``refresh_folder``: each batch also takes jobs that
    have come due, and a refresh takes what the stream has left waiting, and files that were overwritten, which a file stream does not see.
    """

    def sink(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        stream = json.loads(session.read.text(f"{checkpoint.rstrip('/')}/metadata").first()[0])["id"]
        source = f"{stream}/{number}"
        if versions.committed_from(session, out, source) is None:
            last = versions.latest_version(session, out)
            _take_due(session, batch.select("path", "length", "modificationTime"), folder, out, last + 1, last, settings, None, source)

    return stream_new_files(spark, folder, sink, checkpoint, out, until_idle)
