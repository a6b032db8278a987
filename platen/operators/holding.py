"""Uploads held for a while: put, got back, and given up, in batch. ``streaming.holding`` does the same as a stream.

A store holds an upload until its time is over. When one is put, those past their time go, then those that end first
until it fits under the cap; it is held even if it is larger than that. Getting one back restarts its clock, and
gives it to its owner only, or to anyone if it has none. A store is a sequence, so its rows are one task's work;
what a task holds is what the store does.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .state import HOLD_BYTES, HOLD_MINUTES

#: What is asked of a store: put or get, of a token; size and owner go with put, caller with get.
EVENTS = "at timestamp, kind string, token string, size long, owner string, caller string"
#: What comes of it. put: always held. get: whether the caller has it back.
ANSWERS = "micros long, kind string, token string, given boolean"


class Hold:
    """What one store holds. Times are microseconds."""

    def __init__(self, minutes: int = HOLD_MINUTES, cap: int = HOLD_BYTES):
        self.minutes, self.cap = minutes * 60_000_000, cap
        self.held: dict[str, tuple[int, int, int, str | None]] = {}  # ends, turn, size, owner
        self.ends: list[tuple[int, int, str]] = []  # a heap, in which what has changed since is passed over
        self.total = self.turn = 0

    def keep(self, token: str, ends: int, turn: int, size: int, owner: str | None) -> None:
        self.held[token] = (ends, turn, size, owner)
        heapq.heappush(self.ends, (ends, turn, token))
        self.total += size
        self.turn = max(self.turn, turn + 1)

    def _first(self) -> tuple[int, int, str]:
        while self.held.get(self.ends[0][2], (0, 0))[:2] != self.ends[0][:2]:
            heapq.heappop(self.ends)
        return self.ends[0]

    def drop(self, token: str) -> None:
        if token in self.held:
            self.total -= self.held.pop(token)[2]

    def put(self, at: int, token: str, size: int, owner: str | None) -> None:
        self.drop(token)
        while self.held and (self._first()[0] < at or self.total + size > self.cap):
            self.drop(self._first()[2])
        self.keep(token, at + self.minutes, self.turn, size, owner)

    def get(self, at: int, token: str, caller: str | None) -> bool:
        found = self.held.get(token)
        if found is None or found[0] < at:
            self.drop(token)
            return False
        self.drop(token)
        self.keep(token, at + self.minutes, *found[1:])
        return not found[3] or found[3] == caller

    def take(self, at: int, kind: str, token: str, size: int | None, owner: str | None, caller: str | None) -> bool:
        """One event; whether it is given what it asks for."""
        if kind == "put":
            self.put(at, token, size or 0, owner)
            return True
        return self.get(at, token, caller)


def _known(events: DataFrame, key: str) -> DataFrame:
    """Events with a time and a token, of the two kinds, in the columns that folds read."""
    micros = F.unix_micros(F.col("at").cast("timestamp")).alias("micros")
    return events.select(key, micros, "kind", "token", F.col("size").cast("long").alias("size"), "owner", "caller").filter("micros IS NOT NULL AND token IS NOT NULL AND kind IN ('put', 'get')")


#: How events of one moment follow each other: what is put can be got back at once.
ORDER = ["micros", "put_first", "token", "size", "owner", "caller"]


def _folded(events: DataFrame, key: str, minutes: int, cap: int, last: bool) -> DataFrame:
    rows = _known(events, key).withColumn("put_first", (F.col("kind") == "get").cast("int"))
    kind = events.schema[key].dataType.simpleString()
    shape = f"{key} {kind}, token string, ends long" if last else f"{key} {kind}, {ANSWERS}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, own, begun, keys = Hold(minutes, cap), None, False, None
        left = lambda: pa.RecordBatch.from_arrays([pa.array([own] * len(store.held), keys), pa.array(list(store.held), pa.string()), pa.array([h[0] for h in store.held.values()], pa.int64())], [key, "token", "ends"])
        for batch in batches:
            keys = batch.schema.field(0).type
            given = []
            for k, at, what, token, size, owner, caller, _ in zip(*(batch.column(c).to_pylist() for c in range(8)), strict=True):
                if begun and k != own:
                    if last:
                        yield left()
                    store = Hold(minutes, cap)
                own, begun = k, True
                given.append(store.take(at, what, token, size, owner, caller))
            if not last:
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(4)), pa.array(given, pa.bool_())], [key, "micros", "kind", "token", "given"])
        if last and begun:
            yield left()

    return rows.repartition(key).sortWithinPartitions(key, *ORDER).mapInArrow(run, shape)


def answers(events: DataFrame, key: str, minutes: int = HOLD_MINUTES, cap: int = HOLD_BYTES) -> DataFrame:
    """key, micros, kind, token, given: what comes of each event (key, and EVENTS) by its time, each key a store of its own.

    Events of one moment: put first, then by token, size, owner and caller. A token that is put again takes the old one's
    place. Events without a time or a token, or of another kind, are none; a put without a size has none.
    """
    return _folded(events, key, minutes, cap, False)


def still_held(events: DataFrame, key: str, minutes: int = HOLD_MINUTES, cap: int = HOLD_BYTES) -> DataFrame:
    """key, token, ends (microseconds): what each store holds after its last event (see ``answers``)."""
    return _folded(events, key, minutes, cap, True)
