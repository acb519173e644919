"""Continuous operators over event streams: debouncing, coalescing, reconciliation, stalls, retries, progress.

Each works on a batch frame and on a stream alike; on a stream, give it a watermark first.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType


def debounce(events: DataFrame, key: str, time: str, gap: str, paths: str | None = None) -> DataFrame:
    """(key, first, last, events[, paths]): bursts of a key's events with no quiet period of ``gap`` within."""
    aggs = [F.min(time).alias("first"), F.max(time).alias("last"), F.count("*").alias("events")]
    if paths:
        aggs.append(F.array_sort(F.collect_set(paths)).alias("paths"))
    return events.groupBy(key, F.session_window(time, gap).alias("burst")).agg(*aggs).drop("burst")


def reconcile(events: DataFrame, time: str, every: str) -> DataFrame:
    """(start, sources, events): what to look at again in each period."""
    g = events.groupBy(F.window(time, every).alias("w")).agg(F.count("*").alias("events"), F.approx_count_distinct("user_id").alias("sources") if events.isStreaming else F.count_distinct("user_id").alias("sources"))
    return g.select(F.col("w.start").alias("start"), "sources", "events")


def stalls(events: DataFrame, key: str, time: str, seconds: float) -> DataFrame:
    """(key, since, until, silence): gaps between a key's signs of life that are too long."""
    w = Window.partitionBy(key).orderBy(time)
    gap = F.col(time).cast("timestamp").cast("double") - F.lag(time).over(w).cast("timestamp").cast("double")
    return events.select(key, F.lag(time).over(w).alias("since"), F.col(time).alias("until"), F.round(gap, 3).alias("silence")).where(F.col("silence") >= seconds)


def due(jobs: DataFrame, now) -> DataFrame:
    """Failed jobs whose time has come, by time and id."""
    return jobs.where((F.col("status") == "retry") & (F.col("next_attempt_at") <= now)).orderBy("next_attempt_at", "id")


#: What coalesce keeps of a key and what it emits.
_STATE = StructType([StructField("status", StringType()), StructField("paths", StringType()), StructField("until", LongType())])
_OUT = StructType([StructField("key", StringType()), StructField("started", LongType()), StructField("paths", IntegerType()), StructField("full", IntegerType())])


def pick_order(now: Column, longest: float) -> list[Column]:
    """The order in which waiting requests (enqueued_at, urgent, place) are taken at ``now``: those that waited ``longest`` seconds and more, the longest first; then urgent ones; then by their place."""
    aged = F.timestamp_diff("SECOND", F.col("enqueued_at"), now) >= longest
    return [F.when(aged, 0).when(F.col("urgent"), 1).otherwise(2), F.when(aged, F.col("enqueued_at")), F.col("place")]


def fold_requests(rows: Iterator[tuple[int, str]], status: str, paths: set[str], until: int, run_ms: int, most: int) -> tuple[list[tuple], str, set[str], int]:
    """Runs started by requests (time in ms, path) in order of time.

    An idle key starts a run of run_ms at once; requests during a run wait for one follow-up with all their paths; more than
    ``most`` paths, or an empty one, make it a full run.
    """
    out = []

    def start(at: int, names: set[str]) -> None:
        full = int("" in names or len(names) > most)
        out.append((at, 0 if full else len(names), full))

    for at, path in rows:
        while status != "idle" and at >= until:
            if status == "waiting":
                start(until, paths)
                status, paths, until = "running", set(), until + run_ms
            else:
                status = "idle"
        if status == "idle":
            start(at, {path})
            status, until = "running", at + run_ms
        else:
            status, paths = "waiting", paths | {path}
    return out, status, paths, until


def coalesce_stream(events: DataFrame, key: str, time: str, path: str, run_ms: int, most: int) -> DataFrame:
    """(key, started, paths, full) of the runs that a stream of requests causes; state a key is its status, waiting paths and the running one's end."""

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, held, until = state.get if state.exists else ("idle", "", 0)
        paths = set(held.split("\u001f")) if held else set()
        if state.hasTimedOut:
            rows, status, paths = ([(until, 0 if "" in paths or len(paths) > most else len(paths), int("" in paths or len(paths) > most))] if status == "waiting" else []), "running" if status == "waiting" else "idle", set()
            until = until + run_ms
        else:
            asked = sorted((int(t), p) for b in batches for t, p in zip(b["ms"], b["path"], strict=True))
            rows, status, paths, until = fold_requests(iter(asked), status, paths, until, run_ms, most)
        if status == "idle":
            if state.exists:
                state.remove()
        else:
            state.update((status, "\u001f".join(sorted(paths)), until))
            state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(str(k[0]), *r) for r in rows], columns=[f.name for f in _OUT])

    ms = (F.col(time).cast("timestamp").cast("double") * 1000).cast("long")
    e = events.withColumn("ms", ms).withColumn("path", F.col(path).cast("string")).select(F.col(key).cast("string").alias("key"), "ms", "path", time)
    return e.groupBy("key").applyInPandasWithState(update, _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def coalesce(events: DataFrame, key: str, time: str, path: str, run_ms: int, most: int) -> DataFrame:
    """The same over a finished table of requests: a key's requests in order are folded, a key a group."""

    def fold(b: pd.DataFrame) -> pd.DataFrame:
        asked = sorted((int(t), p) for t, p in zip(b["ms"], b["path"], strict=True))
        out, status, paths, until = fold_requests(iter(asked), "idle", set(), 0, run_ms, most)
        if status == "waiting":
            full = int("" in paths or len(paths) > most)
            out.append((until, 0 if full else len(paths), full))
        return pd.DataFrame([(str(b["key"].iloc[0]), *r) for r in out], columns=[f.name for f in _OUT])

    ms = (F.col(time).cast("timestamp").cast("double") * 1000).cast("long")
    e = events.select(F.col(key).cast("string").alias("key"), ms.alias("ms"), F.col(path).cast("string").alias("path"))
    return e.groupBy("key").applyInPandas(fold, _OUT)


def progress(events: DataFrame, key: str) -> DataFrame:
    """(key, done, failed, last, phase) of progress events: a keyed roll-up, as a stream keeps it in update mode."""
    g = events.groupBy(key).agg(F.count_if(F.col("event_type") != "error").alias("done"), F.count_if(F.col("event_type") == "error").alias("failed"), F.max("ts").alias("last"), F.max_by("event_type", F.struct("ts", "event_id")).alias("phase"))
    return g
