"""Keyed state on a stream that ends: the state of a step lives in the state store, late events go where they belong, and what has been
idle for long is sent out once more and forgotten."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

#: The store that timers and typed state need.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Steps(StatefulProcessor):
    """Of each key, the last value that isn't null of each column, by ``order``; a value that comes late fills only what is older.

    Each batch sends the state of the keys that it touched. ``idle`` milliseconds of event time after a key's last event its state is sent
    with ``ended`` and removed.
    """

    def __init__(self, keys: list[str], order: str, values: list[str], at: str, idle: int, fields: list[tuple[str, str]]):
        self.keys, self.order, self.values, self.at, self.idle, self.fields = keys, order, values, at, idle, fields

    def init(self, handle) -> None:
        self.handle = handle
        # the value of each column and the order of the event that gave it
        columns = [f"{c} {kind}" for v, kind in self.fields for c, kind in ((v, kind), (f"{v}_order", "bigint"))]
        self.state = handle.getValueState("state", ", ".join([*columns, "until bigint"]))

    def _row(self, key, held: dict, ended: bool) -> Row:
        return Row(**dict(zip(self.keys, key)), **{v: held[v] for v in self.values}, ended=ended)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        names = [c for v in self.values for c in (v, f"{v}_order")] + ["until"]
        held = dict(zip(names, self.state.get())) if self.state.exists() else dict.fromkeys(names)
        until = held["until"] or 0
        for r in rows:
            for v in self.values:
                if r[v] is not None and (held[f"{v}_order"] is None or r[self.order] >= held[f"{v}_order"]):
                    held[v], held[f"{v}_order"] = r[v], int(r[self.order])
            until = max(until, int(r[self.at].timestamp() * 1000) + self.idle)
        if until != held["until"]:
            if held["until"]:
                self.handle.deleteTimer(held["until"])
            self.handle.registerTimer(until)
            held["until"] = until
        self.state.update(tuple(held[n] for n in names))
        yield self._row(key, held, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if not self.state.exists():
            return
        names = [c for v in self.values for c in (v, f"{v}_order")] + ["until"]
        held = dict(zip(names, self.state.get()))
        self.state.clear()
        yield self._row(key, held, True)

    def close(self) -> None:
        pass


def steps_of(events: DataFrame, keys: list[str], order: str, values: list[str], at: str, late: str = "10 minutes", idle: str = "1 hour") -> DataFrame:
    """The state of each key of a stream, in update mode: ``keys, values, ended``.

    ``order`` (a whole number) says which of two events is later, ``at`` is their time. Events more than ``late`` behind are dropped;
    the state of a key ends ``idle`` after its last event. The session's state store must be ``PROVIDER``.
    """
    kinds = {f.name: f.dataType for f in events.schema}
    out = T.StructType([T.StructField(c, kinds[c]) for c in (*keys, *values)] + [T.StructField("ended", T.BooleanType())])
    ms = int(events.sparkSession.range(1).select(F.unix_millis(F.lit("1970-01-01 00:00:00+00:00").cast("timestamp") + F.expr(f"interval {idle}"))).first()[0])
    processor = Steps(keys, order, values, at, ms, [(v, kinds[v].simpleString()) for v in values])
    return events.withWatermark(at, late).groupBy(*keys).transformWithState(processor, out, "Update", "EventTime")
