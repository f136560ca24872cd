"""Incremental intake: changed files, debounced events, the retry ledger, and the jobs of a folder that are due.

A single path may own a large share of all events. Work that needs order is done per (path, time
bucket) first and only bucket summaries meet per path.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mdloom.functions.fixed import DEBOUNCE_SECONDS, MAX_ATTEMPTS, RETRY_SECONDS

BUCKET_SECONDS = 3600
LOG_SCHEMA = "path string, ts timestamp, seq bigint, kind string, length bigint, modificationTime timestamp"


def changed_files(listing: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files that are new or differ in size or time from what was processed."""
    return listing.join(
        ledger.select("path", "length", "modificationTime"), ["path", "length", "modificationTime"], "left_anti"
    )


def _bucket(ts: str, seconds: int) -> Column:
    return F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (seconds * 1_000_000))


def debounce(
    events: DataFrame,
    key: str,
    ts: str = "ts",
    state: str = "state",
    tie: str = "event_id",
    gap_seconds: float = DEBOUNCE_SECONDS,
    bucket_seconds: int = BUCKET_SECONDS,
) -> DataFrame:
    """One job per burst: key, started, ended, events, state (the last one wins).

    A burst ends when the next event is more than the gap away. Events are summed per gap-wide slot,
    bursts are found among the slots of each (key, bucket); only the first and the last burst of a bucket can continue in a neighbour bucket, so
    only those two meet per key.
    """
    gap = F.expr(f"interval {int(gap_seconds * 1_000_000)} microseconds")
    in_bucket = W.partitionBy(key, "_bucket").orderBy("started")

    def islands(rows: DataFrame, window, started: str, ended: str) -> DataFrame:
        new = F.coalesce(F.col(started) > F.lag(ended).over(window) + gap, F.lit(True))
        return rows.withColumn("_new", new.cast("int")).withColumn("_burst", F.sum("_new").over(window)).drop("_new")

    # Events less than a gap apart are of one burst, so a (key, gap-wide slot) is a summary from the start: partial sums before any sort.
    slot = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / int(gap_seconds * 1_000_000))
    slots = (
        events.select(key, ts, F.struct(ts, tie).alias("_at"), F.col(state).alias("state"), slot.alias("_slot"), _bucket(ts, bucket_seconds).alias("_bucket"))
        .groupBy(key, "_bucket", "_slot")
        .agg(
            F.min(ts).alias("started"),
            F.max(ts).alias("ended"),
            F.count(F.lit(1)).alias("events"),
            F.max("_at").alias("_at"),
            F.max_by("state", "_at").alias("state"),
        )
    )
    local = (
        islands(slots, in_bucket, "started", "ended")
        .groupBy(key, "_bucket", "_burst")
        .agg(
            F.min("started").alias("started"),
            F.max("ended").alias("ended"),
            F.sum("events").alias("events"),
            F.max("_at").alias("_at"),
            F.max_by("state", "_at").alias("state"),
        )
    )
    last = F.max("_burst").over(W.partitionBy(key, "_bucket"))
    marked = local.withColumn("_edge", (F.col("_burst") == 1) | (F.col("_burst") == last))
    columns = [key, "started", "ended", "events", "state"]
    inner = marked.filter(~F.col("_edge")).select(*columns)
    edges = (
        islands(marked.filter("_edge").drop("_burst"), W.partitionBy(key).orderBy("started"), "started", "ended")
        .groupBy(key, "_burst")
        .agg(
            F.min("started").alias("started"),
            F.max("ended").alias("ended"),
            F.sum("events").alias("events"),
            F.max_by("state", "_at").alias("state"),
        )
        .select(*columns)
    )
    return inner.unionByName(edges)


def retry_ledger(
    attempts: DataFrame,
    max_attempts: int = MAX_ATTEMPTS,
    retry_seconds: float = RETRY_SECONDS,
    debounce_seconds: float = DEBOUNCE_SECONDS,
    bucket_seconds: int = 24 * BUCKET_SECONDS,
) -> DataFrame:
    """path, attempts, status, next_due from a log of (path, ts, seq, kind).

    Kinds: ``event`` (a new file event: attempts start over), ``os_error`` (tried again after the
    retry delay while attempts remain), ``changed`` (the file changed under the job: queued again
    after the debounce, counted but not capped), ``value_error``, ``lint_error``, ``success`` (final).
    """
    counted = F.col("kind").isin("os_error", "changed")
    at = F.struct("ts", "seq")
    log = attempts.select("path", at.alias("at"), "kind", _bucket("ts", bucket_seconds).alias("_bucket"))
    # Two sums with partial results per task, the second after the last reset of a bucket is known: no events of one path are gathered.
    resets = log.filter("kind = 'event'").groupBy("path", "_bucket").agg(F.max("at").alias("_reset"))
    buckets = (
        log.join(resets, ["path", "_bucket"], "left")
        .groupBy("path", "_bucket")
        .agg(
            F.max("_reset").alias("_reset"),
            F.count_if(counted & (F.col("_reset").isNull() | (F.col("at") > F.col("_reset")))).alias("_since"),
            F.max("at").alias("_last"),
            F.max_by("kind", "at").alias("_kind"),
        )
    )
    # Per path only bucket summaries are left: sum the counts from the last bucket with a reset on.
    last_reset = F.max(F.when(F.col("_reset").isNotNull(), F.col("_bucket"))).over(W.partitionBy("path"))
    paths = (
        buckets.withColumn("_from", last_reset)
        .groupBy("path")
        .agg(
            F.coalesce(
                F.sum(F.when(F.col("_from").isNull() | (F.col("_bucket") >= F.col("_from")), F.col("_since"))), F.lit(0)
            ).alias("attempts"),
            F.max_by("_kind", "_last").alias("_kind"),
            F.max("_last").alias("_last"),
        )
    )
    kind, last = F.col("_kind"), F.col("_last.ts")
    status = (
        F.when(kind == "event", "pending")
        .when(kind == "changed", "requeued")
        .when((kind == "os_error") & (F.col("attempts") < max_attempts), "retry")
        .when(kind == "os_error", "failed")
        .when(kind == "value_error", "rejected")
        .when(kind == "lint_error", "quarantined")
        .otherwise("done")
    )
    wait = F.when(F.col("status").isin("pending", "requeued"), debounce_seconds).when(F.col("status") == "retry", retry_seconds)
    return (
        paths.withColumn("status", status)
        .withColumn("next_due", last + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), wait))
        .select("path", "attempts", "status", "next_due")
    )


def due_jobs(ledger: DataFrame, now: datetime | Column) -> DataFrame:
    """Jobs whose time has come; jobs without a due time are finished."""
    moment = now if isinstance(now, Column) else F.lit(now)
    return ledger.filter(F.col("next_due") <= moment)


def waiting_log(listing: DataFrame, ledger: DataFrame, log: DataFrame, now: datetime | Column, seq: int) -> DataFrame:
    """The log of the files that wait: ``log`` without those settled since, and an event for each file that is new or has changed.

    ``log`` holds what happened to files that still waited (``LOG_SCHEMA``), with their length and time then. A file whose length or time
    differ from its last entry starts over, at the time it was changed. A file that is gone keeps its entries: its next attempt will fail.
    """
    moment = now if isinstance(now, Column) else F.lit(now)
    changed = changed_files(listing, ledger).select("path", "length", "modificationTime")
    last = log.groupBy("path").agg(F.max_by(F.struct("length", "modificationTime"), F.struct("ts", "seq")).alias("last"), F.max("ts").alias("last_ts"))
    met = changed.join(last, "path", "left")
    known = F.col("last.length").eqNullSafe(F.col("length")) & F.col("last.modificationTime").eqNullSafe(F.col("modificationTime"))
    events = met.filter(~known).select(
        "path", F.greatest(F.least("modificationTime", moment), "last_ts").alias("ts"), F.lit(seq).cast("bigint").alias("seq"), F.lit("event").alias("kind"), "length", "modificationTime"
    )
    settled = listing.select("path").join(changed.select("path"), "path", "left_anti")
    return log.join(settled, "path", "left_anti").unionByName(events)


def waiting_jobs(
    log: DataFrame, max_attempts: int = MAX_ATTEMPTS, retry_seconds: float = RETRY_SECONDS, debounce_seconds: float = DEBOUNCE_SECONDS
) -> DataFrame:
    """``retry_ledger`` of a log of waiting files, with the length and time each file had at its last entry."""
    last = log.groupBy("path").agg(F.max_by(F.struct("length", "modificationTime"), F.struct("ts", "seq")).alias("last"))
    ledger = retry_ledger(log, max_attempts, retry_seconds, debounce_seconds)
    return ledger.join(last, "path").select("path", "attempts", "status", "next_due", "last.length", "last.modificationTime")
