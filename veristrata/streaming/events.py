"""Streams of events: metering windows, duplicates inside the watermark, limiter and quota as state.

State is bounded: windows and duplicates leave with the watermark, the limiter keeps at most
``limit`` times a key and drops idle keys, the quota keeps a counter a key and period.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def metered(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Runs, failures and value by kind in tumbling windows, late rows within the watermark counted."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type")
    return w.agg(F.count("*").alias("runs"), F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("cents")).select(F.col("w.start").alias("start"), "event_type", "runs", "cents")


def once(events: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def limited(events: DataFrame, limit: int, seconds: int, late: str = "1 hour") -> DataFrame:
    """Events a key's sliding window admits; only admitted ones occupy it. Needs user_id, event_id, ts."""
    out = "user_id bigint, event_id bigint, admitted boolean"

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        passed = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        flags = []
        for t in rows["ts"].astype("datetime64[us]").astype("int64"):
            passed = [p for p in passed if t - p < seconds * 1_000_000]
            flags.append(len(passed) < limit)
            if flags[-1]:
                passed.append(int(t))
        state.update((passed,))
        state.setTimeoutTimestamp(max(max(passed, default=0) // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"].to_numpy(), "admitted": flags})

    own = events.select("user_id", "event_id", "ts").withWatermark("ts", late)
    return own.groupBy("user_id").applyInPandasWithState(step, out, "passed array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)


def within_quota(events: DataFrame, quota: int, period_days: int = 30, late: str = "1 hour") -> DataFrame:
    """The first ``quota`` events of each key in each period; the counter of a period leaves when the watermark has passed its end."""
    width = period_days * 86_400

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        used = state.get[0] if state.exists else 0
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"]).head(max(0, quota - used))
        state.update((used + len(rows),))
        state.setTimeoutTimestamp(max((int(key[1]) + 1) * width * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"].to_numpy()})

    own = events.select("user_id", "event_id", "ts").withWatermark("ts", late).withColumn("period", F.floor(F.unix_seconds("ts") / width))
    return own.groupBy("user_id", "period").applyInPandasWithState(step, "user_id bigint, event_id bigint", "used int", "append", GroupStateTimeout.EventTimeTimeout)
