"""Structured Streaming intake."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from mdloom.functions.fixed import DEBOUNCE_SECONDS, MAX_ATTEMPTS, RETRY_SECONDS
from mdloom.sources.files import stream_files


def distinct_paths(source: str, target: str) -> None:
    """Input and output must not be the same folder."""

    def plain(path: str) -> tuple[str, str]:
        url = urlparse(path)
        scheme = url.scheme or "file"
        return f"{scheme}://{url.netloc}", os.path.normpath(url.path or path)

    if plain(source) == plain(target):
        raise ValueError("the output folder must differ from the input folder")


def stream_new_files(
    spark: SparkSession,
    folder: str,
    sink: Callable[[DataFrame, int], None],
    checkpoint: str,
    target: str,
    until_idle: bool = True,
) -> StreamingQuery:
    """Hand new files to ``sink`` batch by batch; with ``until_idle`` stop when none are left.

    The file source never repeats a path; overwritten files are found by ``changed_files``.
    """
    distinct_paths(folder, target)
    writer = stream_files(spark, folder).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if until_idle else writer).start()


def run_until_idle(query: StreamingQuery, timeout: int | None = None) -> bool:
    """Wait until an available-now query has worked off its input."""
    return bool(query.awaitTermination(timeout)) if timeout else query.awaitTermination() is None


def debounce_stream(
    events: DataFrame,
    key: str,
    ts: str = "ts",
    state: str = "state",
    tie: str = "event_id",
    gap_seconds: float = DEBOUNCE_SECONDS,
    late: str = "10 seconds",
) -> DataFrame:
    """The streaming form of ``debounce``: a burst is emitted once the watermark has passed its gap."""
    gap = f"{int(gap_seconds * 1_000_000)} microseconds"
    bursts = events.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap).alias("burst"))
    return bursts.agg(
        F.min(ts).alias("started"),
        F.max(ts).alias("ended"),
        F.count(F.lit(1)).alias("events"),
        F.max_by(state, F.struct(ts, tie)).alias("state"),
    ).drop("burst")


DUE_SCHEMA = "path string, attempts bigint, status string, next_due timestamp"
_JOB_STATE = "attempts bigint, status string, due bigint"


def due_jobs_stream(
    log: DataFrame,
    max_attempts: int = MAX_ATTEMPTS,
    retry_seconds: float = RETRY_SECONDS,
    debounce_seconds: float = DEBOUNCE_SECONDS,
    late: str = "0 seconds",
) -> DataFrame:
    """The streaming form of ``retry_ledger`` with ``due_jobs``: a job comes out once the watermark has reached its due time.

    ``log`` is a stream of ``path, ts, seq, kind``. A path keeps three numbers of state and a timer; later entries move the timer (a new event
    or a change starts the debounce again), and success, refusal or too many attempts end it.
    """

    def step(job: tuple, at: int, kind: str) -> tuple:
        attempts, _, _ = job
        if kind == "event":
            return 0, "pending", at + int(debounce_seconds * 1000)
        if kind == "changed":
            return attempts + 1, "requeued", at + int(debounce_seconds * 1000)
        if kind == "os_error" and attempts + 1 < max_attempts:
            return attempts + 1, "retry", at + int(retry_seconds * 1000)
        return attempts + (kind == "os_error"), "done", None

    def jobs(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        job = state.get if state.exists else (0, "done", None)
        for frame in frames:
            for row in frame.sort_values(["at", "seq"]).itertuples():
                job = step(job, int(row.at), row.kind)
        attempts, status, due = job
        if due is None:
            if state.exists:
                state.remove()
        elif state.hasTimedOut or due <= state.getCurrentWatermarkMs():
            yield pd.DataFrame({"path": [key[0]], "attempts": [attempts], "status": [status], "next_due": [pd.Timestamp(due, unit="ms", tz="UTC")]})
            state.update((attempts, status, None))
        else:
            state.update(job)
            state.setTimeoutTimestamp(due)

    stamped = log.withWatermark("ts", late).select("path", "ts", F.unix_millis("ts").alias("at"), "seq", "kind")
    return stamped.groupBy("path").applyInPandasWithState(jobs, DUE_SCHEMA, _JOB_STATE, "append", GroupStateTimeout.EventTimeTimeout)
