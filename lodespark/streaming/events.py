"""Streaming forms of the event operators. These go beyond the reference, which has no event time.

State is bounded by watermarks: a key's state is dropped once the watermark has passed it.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from functools import partial
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark: SparkSession, folder: str, like: DataFrame, ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """A stream of the Parquet files that arrive in ``folder``, with the columns of ``like`` and a watermark on ``ts``."""
    stream = spark.readStream.schema(like.schema).parquet(folder)
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def topic(stream: DataFrame, column: str, *names: str) -> DataFrame:
    """The events of some topics: what a subscriber sees."""
    return stream.where(F.col(column).isin(*names))


def unique_within_watermark(stream: DataFrame, keys: list[str]) -> DataFrame:
    """The first of equal events that arrive within the watermark's delay."""
    return stream.dropDuplicatesWithinWatermark(keys)


def tumbling_counts(stream: DataFrame, ts: str, by: str, width: str = "1 hour") -> DataFrame:
    """window_start, by, n: events of each full window."""
    g = stream.groupBy(F.window(ts, width), by).agg(F.count("*").alias("n"))
    return g.select(F.col("window.start").alias("window_start"), by, "n")


TRACKED = "key string, run_count long, first_run string, last_run string, status string"


def _track(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState, keep_ms: int) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    count, first, last, seen_ms = state.get if state.exists else (0, "", "", 0)
    new: set[str] = set()
    for b in batches:
        new |= {str(r) for r in b["run"] if r is not None and str(r) > last}
        seen_ms = max(seen_ms, int(b["ms"].max()))
    if new:
        first = first or min(new)
        count, last = count + len(new), max(new)
    state.update((count, first, last, seen_ms))
    state.setTimeoutTimestamp(max(seen_ms, state.getCurrentWatermarkMs()) + keep_ms)
    yield pd.DataFrame({"key": [str(key[0])], "run_count": [count], "first_run": [first], "last_run": [last], "status": ["open" if count == 1 else "seen_again"]})


def tracked(stream: DataFrame, key: str, run: str, ts: str = "ts", keep: dt.timedelta = dt.timedelta(days=30)) -> DataFrame:
    """For each key that a batch brings: in how many runs it was seen so far, the first and the last; runs arrive in order.

    ``stream`` has a watermark on ``ts``. A key's state goes once the watermark is ``keep`` past its last
    event; seen again later, the key begins anew. Rows without key, run or time are left out.
    """
    ms = F.unix_millis(F.col(ts)).alias("ms")
    rows = stream.select(F.col(key).cast("string").alias("key"), F.col(run).cast("string").alias("run"), ts, ms).where("key is not null and run is not null and ms is not null")
    step = partial(_track, keep_ms=int(keep.total_seconds() * 1000))
    return rows.groupBy("key").applyInPandasWithState(step, TRACKED, "run_count long, first_run string, last_run string, seen_ms long", "update", GroupStateTimeout.EventTimeTimeout)


def drain(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there now and returns what it wrote (for tests and back-fills)."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
