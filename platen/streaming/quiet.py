"""The quiet window as a stream: per user, an event is told if the last told one lies far enough back."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.state import QUIET_MINUTES

TOLD = "user_id long, told_at timestamp"


def throttled(events: DataFrame, minutes: int = QUIET_MINUTES) -> DataFrame:
    """user_id, told_at of a stream (user_id, ts) in the order of arrival; within a batch by time.

    The state is the time last told. An event older than that is passed over: feed arrival times, or
    events within a watermark that have been put in order.
    """

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        times = sorted(t.value // 1000 for p in parts for t in p["ts"] if not pd.isna(t))
        told = []
        for t in times:
            if last is None or t - last >= minutes * 60_000_000:
                told.append(t)
                last = t
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({"user_id": [key[0]] * len(told), "told_at": pd.to_datetime(told, unit="us")})

    known = events.select("user_id", F.col("ts").cast("timestamp").alias("ts")).filter("user_id is not null")
    return known.groupBy("user_id").applyInPandasWithState(fold, TOLD, "last long", "append", GroupStateTimeout.NoTimeout)


def counts(events: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """start, event_type, n of a stream with a watermark, for windows that can no longer change."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
