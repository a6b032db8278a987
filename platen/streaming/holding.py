"""Uploads held for a while, as a stream: events may come out of order, within the watermark.

Events wait in the state until the watermark has passed them; a timer then takes those that are due, by their time,
so the answers are those of the batch fold, however the events came. A second kind of state holds the uploads. Needs
the RocksDB state store.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import holding
from ..operators.state import HOLD_BYTES, HOLD_MINUTES

#: The setting that a session needs, and its value.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

_WAITING = "micros long, kind string, token string, size long, owner string, caller string"
_HELD = "ends long, turn long, size long, owner string"


class Held(StatefulProcessor):
    """A store's state: what is held, and the events that wait."""

    def __init__(self, minutes: int, cap: int, key: str):
        self.minutes, self.cap, self.key = minutes, cap, key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _WAITING)
        self.held = handle.getMapState("held", "token string", _HELD)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        due = set()
        for part in rows:
            own = [tuple(None if pd.isna(x) else x for x in r) for r in part[["micros", "kind", "token", "size", "owner", "caller"]].itertuples(index=False)]
            own = [(int(r[0]), r[1], r[2], None if r[3] is None else int(r[3]), *r[4:]) for r in own]
            if own:
                self.waiting.appendList(own)
            due |= {-(-r[0] // 1000) for r in own}
        for at in due:
            self.handle.registerTimer(at)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        due = sorted((r for r in waiting if r[0] <= now), key=_order)
        if not due:
            yield pd.DataFrame()
            return
        rest = [r for r in waiting if r[0] > now]
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        store, before = holding.Hold(self.minutes, self.cap), {}
        for (token,), value in self.held.iterator():
            before[token] = tuple(value)
            store.keep(token, *before[token])
        out = [(key[0], at, kind, token, store.take(at, kind, token, size, owner, caller)) for at, kind, token, size, owner, caller in due]
        for token in before.keys() - store.held.keys():
            self.held.removeKey((token,))
        for token, value in store.held.items():
            if before.get(token) != value:
                self.held.updateValue((token,), value)
        yield pd.DataFrame(out, columns=[self.key, "micros", "kind", "token", "given"])

    def close(self) -> None:
        pass


def _order(r: tuple) -> tuple:
    """The order of ``holding.ORDER``, with nulls first."""
    return (r[0], r[1] == "get", r[2], *((x is not None, x if x is not None else 0) for x in r[3:4]), *((x is not None, x or "") for x in r[4:]))


def answers(events: DataFrame, key: str, late: str = "10 minutes", minutes: int = HOLD_MINUTES, cap: int = HOLD_BYTES) -> DataFrame:
    """key, micros, kind, token, given of a stream of events (key, and ``holding.EVENTS``): the answers of the batch fold, once the watermark has passed an event.

    Events that come later than the watermark allows are passed over. A store without a key is none.
    """
    kind = events.schema[key].dataType.simpleString()
    timed = events.withColumn("at", F.col("at").cast("timestamp")).filter(F.col(key).isNotNull()).withWatermark("at", late)
    micros = F.unix_micros("at").alias("micros")
    known = timed.select(key, "at", micros, "kind", "token", F.col("size").cast("long").alias("size"), "owner", "caller").filter("micros IS NOT NULL AND token IS NOT NULL AND kind IN ('put', 'get')")
    return known.groupBy(key).transformWithStateInPandas(Held(minutes, cap, key), f"{key} {kind}, {holding.ANSWERS}", "append", "eventTime")
