"""Upsert change feed (T5, S8): the newest row per key kept in state, every change emitted with the row before and after.

The newest row is the one greatest in (time, id), whatever the order of arrival: older rows than the state change nothing
and emit nothing. A key's rows of a micro-batch are read in slices and compared one by one, so that memory holds one row a
key, and the feed has at most one change per key and micro-batch. Keys are kept for ever, or, with
``idle_seconds``, until the watermark has passed their row by that much; a key that comes back then starts anew.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from incidentry.functions import epoch_micros
from incidentry.functions.timefmt import ISO_MICROS
from incidentry.session import pickle_by_value
from incidentry.streaming.sources import event_time, use_rocksdb

pickle_by_value(__name__)


class LatestRow(StatefulProcessor):
    """State of a key: (time, id, row as JSON) of its newest row."""

    def __init__(self, key: str, idle_seconds: int | None):
        self.key, self.idle = key, idle_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "event_us long, tie string, row string")

    def handleInputRows(self, key, rows, timerValues):
        before = tuple(self.newest.get()) if self.newest.exists() else None
        best = before
        for pdf in rows:
            for row in zip(pdf["event_us"].tolist(), pdf["tie"], pdf["row"], strict=True):
                if best is None or row[:2] > best[:2]:
                    best = row
        if best is before:
            return
        self.newest.update(best)
        if self.idle is not None:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(best[0] // 1000 + self.idle * 1000)
        yield pd.DataFrame({self.key: [key[0]], "before": [before and before[2]], "after": [best[2]]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.newest.clear()
        yield from ()

    def close(self) -> None:
        pass


def stream_changes(rows: DataFrame, key: str, time: str, tie: str, idle_seconds: int | None = None,
                   delay: str = "0 seconds") -> DataFrame:
    """(key, before, after): a change per key and micro-batch, rows as JSON of the other columns, ``before`` null for a new
    key. Equal times are decided by ``tie``, a number or text, as it sorts. Rows without a key or a time are left out."""
    use_rocksdb(rows.sparkSession)
    rest = F.to_json(F.struct(*[F.col(c) for c in rows.columns if c != key]),
                     {"timestampFormat": ISO_MICROS, "timestampNTZFormat": ISO_MICROS})
    number = dict(rows.dtypes)[tie] != "string"
    # numbers as texts of one width, so that they compare as numbers do
    text = F.lpad((F.col(tie).cast("decimal(38,0)") + F.lit("10000000000000000000").cast("decimal(38,0)")).cast("string"),
                  20, "0") if number else F.col(tie)
    slim = rows.where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(
        key, epoch_micros(time).alias("event_us"), F.coalesce(text, F.lit("")).alias("tie"), rest.alias("row"),
        event_time(time).alias("ets"))
    if idle_seconds is not None:
        slim = slim.withWatermark("ets", delay)
    kind = dict(rows.dtypes)[key]
    return slim.groupBy(key).transformWithStateInPandas(
        LatestRow(key, idle_seconds), f"`{key}` {kind}, before string, after string", "Append",
        "None" if idle_seconds is None else "EventTime")
