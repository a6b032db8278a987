"""State over time, in batch: quiet windows, sessions, retention under a cap, runs and islands."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Minutes of a quiet window and of a held upload, and bytes of all that are held; days and bytes that designs are kept.
QUIET_MINUTES, HOLD_MINUTES, HOLD_BYTES, KEEP_DAYS, KEEP_BYTES = 30, 30, 3 << 29, 30, 2 << 30


def _in_order(df: DataFrame, key: str, order: list[str], start: Callable[[], Callable[[list], list[bool]]]) -> DataFrame:
    """The rows that a fold over each key's rows keeps.

    Rows are dealt by key, sorted, and stream through the fold, so a task holds a batch and the fold's state
    however many rows a key has; a fold is a sequence, so a key's rows are one task's work. start() makes a
    key's fold, which tells of each of some rows whether it is kept.
    """
    columns = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, own, begun = start(), None, False
        for batch in batches:
            keys, rows = batch.column(columns.index(key)).to_pylist(), list(zip(*[batch.column(columns.index(c)).to_pylist() for c in order], strict=True))
            keep, at = [], 0
            while at < len(keys):
                if not begun or keys[at] != own:
                    fold, own, begun = start(), keys[at], True
                to = at
                while to < len(keys) and keys[to] == own:
                    to += 1
                keep += fold(rows[at:to])
                at = to
            yield batch.filter(pa.array(keep, pa.bool_()))

    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, df.schema)


def throttled(df: DataFrame, key: str, at: str, minutes: int = QUIET_MINUTES) -> DataFrame:
    """key and the times that are told: the first, then the first at least so long after the last told one."""
    quiet = minutes * 60_000_000

    def start() -> Callable[[list], list[bool]]:
        last: int | None = None

        def fold(rows: list) -> list[bool]:
            nonlocal last
            out = []
            for (t,) in rows:
                told = last is None or t - last >= quiet
                last = t if told else last
                out.append(told)
            return out

        return fold

    rows = df.select(key, F.unix_micros(F.col(at).cast("timestamp")).alias("micros")).filter(F.col("micros").isNotNull())
    return _in_order(rows, key, ["micros"], start).select(key, F.timestamp_micros("micros").alias("told_at"))


def evicted(df: DataFrame, key: str, at: str, size: str, ident: str, minutes: int = HOLD_MINUTES, cap: int = HOLD_BYTES) -> DataFrame:
    """key, ident of the uploads that are still held after the last one came, each key a store of its own.

    An upload is held so long after it came. When one comes, those past their time go, then the ones that end
    first until it fits under the cap; it is held even if it is larger than that. The state is what is held.
    """
    columns = [key, "micros", size, ident]
    rows = df.select(key, F.unix_micros(F.col(at).cast("timestamp")).alias("micros"), size, ident).filter(F.col("micros").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total, own, begun = deque(), 0, None, False

        def ended() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([own] * len(held), schema[0]), pa.array([h[2] for h in held], schema[1])], [key, ident])

        schema = None
        for batch in batches:
            schema = schema or (batch.schema.field(0).type, batch.schema.field(3).type)
            for k, t, n, i in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                if begun and k != own:
                    yield ended()
                    held, total = deque(), 0
                own, begun = k, True
                while held and (held[0][0] + minutes * 60_000_000 < t or total + n > cap):
                    total -= held.popleft()[1]
                held.append((t, n, i))
                total += n
        if begun:
            yield ended()

    return rows.select(*columns).repartition(key).sortWithinPartitions(key, "micros", ident).mapInArrow(run, StructType([df.schema[key], df.schema[ident]]))


def recalled(designs: DataFrame, asked: DataFrame, now: Column, days: int = KEEP_DAYS) -> DataFrame:
    """asked (token) with filename, or null: designs (token, at, filename) that are kept and no older than the days; a token of other characters names none."""
    good = designs.filter(F.col("token").rlike("^[A-Za-z0-9_-]{16,64}$") & (F.col("at") >= now - F.make_dt_interval(F.lit(days)))).select("token", "filename")
    return asked.join(good, "token", "left")


def sessions(df: DataFrame, key: str, at: str, minutes: int = HOLD_MINUTES) -> DataFrame:
    """key, started, ended (the last event), events: every access restarts the clock, and a pause of exactly the time still holds."""
    held = df.filter(F.col(at).isNotNull()).withColumn("at", F.col(at).cast("timestamp"))
    by = held.groupBy(key, F.session_window("at", f"{minutes} minutes"))
    return by.agg(F.min("at").alias("started"), F.max("at").alias("ended"), F.count(F.lit(1)).alias("events")).select(key, "started", "ended", "events")


def kept(df: DataFrame, at: str, size: str, now: Column, days: int = KEEP_DAYS, cap: int = KEEP_BYTES, tie: str | None = None) -> DataFrame:
    """The rows that retention keeps: no older than the days, and newest first within the cap, where dropped ones count too.

    The running total is one of days, and within each day one of rows, so only a total per day meets in a task.
    """
    day = F.to_date(at)
    dated = df.withColumn("kept_day", day)
    per = dated.groupBy("kept_day").agg(F.sum(size).alias("day_size"))
    newer = F.coalesce(F.sum("day_size").over(Window.orderBy(F.desc("kept_day")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.select("kept_day", newer.alias("newer"))
    order = [F.desc(at), *([F.col(tie)] if tie else [])]
    running = F.sum(size).over(Window.partitionBy("kept_day").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    out = dated.join(per, "kept_day")
    return out.withColumn("total", running + F.col("newer")).filter((F.col(at) >= now - F.make_dt_interval(F.lit(days))) & (F.col("total") <= cap)).drop("kept_day", "newer")


def islands(df: DataFrame, keys: list[str], at: str) -> DataFrame:
    """keys, first, last, n of each run of neighbouring whole numbers."""
    distinct = df.select(*keys, F.col(at).cast("long").alias("at")).distinct()
    run = F.col("at") - F.row_number().over(Window.partitionBy(*keys).orderBy("at"))
    return distinct.withColumn("run", run).groupBy(*keys, "run").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count(F.lit(1)).alias("n")).drop("run")


def first_run(df: DataFrame, keys: list[str], at: str, flag: str, n: int) -> DataFrame:
    """keys and where the first run of n neighbouring rows with the flag begins; null without one."""
    w = Window.partitionBy(*keys).orderBy(at).rowsBetween(-(n - 1), 0)
    full = (F.sum(F.col(flag).cast("int")).over(w) == n) & (F.count(F.lit(1)).over(w) == n)
    return df.withColumn("begin", F.when(full, F.first(at).over(w))).groupBy(*keys).agg(F.min("begin").alias("begin"))


def merged_tiles(tiles: DataFrame, key: str = "page") -> DataFrame:
    """key, x0, y0, x1, y1: runs of tiles (key, x, y) within a row, and equal runs of rows below each other, as boxes."""
    rows = islands(tiles, [key, "y"], "x").withColumnRenamed("first", "x0").withColumnRenamed("last", "x1")
    stacked = islands(rows, [key, "x0", "x1"], "y")
    return stacked.select(key, "x0", F.col("first").alias("y0"), "x1", F.col("last").alias("y1"))
