"""Side output of late rows (W3, X6): what a watermark would drop is kept, with the reason.

Spark drops rows behind the watermark silently. :class:`LateRouter` sees every row (no watermark stands before it): per
stream shard it keeps the newest event time of the micro-batches before the current one, less the delay, and marks a row late
if it is older. Rows on time go on to the watermarked operators, late ones to the quarantine of ``sources.stores``; no
row is lost: on time + late = input.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from incidentry.functions import epoch_micros
from incidentry.session import pickle_by_value
from incidentry.streaming.sources import use_rocksdb

pickle_by_value(__name__)

LATE = "late"


class LateRouter(StatefulProcessor):
    """Adds ``late`` (boolean) and ``bar_us`` (the limit a row is held against; null before there is one)."""

    def __init__(self, delay_us: int):
        self.delay_us = delay_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", "us long")

    def handleInputRows(self, key, rows, timerValues):
        known = self.newest.get()[0] if self.newest.exists() else None
        bar, newest = None if known is None else known - self.delay_us, known
        for pdf in rows:
            us = pdf["event_us"]
            if us.notna().any():
                high = int(us.max())
                newest = high if newest is None else max(newest, high)
            late = pd.Series(False, index=pdf.index) if bar is None else us.isna() | (us < bar)
            yield pdf.assign(late=late.astype(bool), bar_us=pd.array([bar] * len(pdf), dtype="Int64"))
        if newest is not None and newest != known:
            self.newest.update((newest,))

    def close(self) -> None:
        pass


def route_late(stream: DataFrame, time: str, delay_seconds: int, shards: int = 1, shard: str | None = None) -> DataFrame:
    """``stream`` with ``late`` and ``bar_us``. The limit moves between micro-batches, as a watermark does: it is the newest
    time of all earlier micro-batches of the shard less ``delay_seconds``. Rows are dealt to ``shards`` by ``shard``
    (a column; its values should be spread over all times): each shard has a limit of its own, never behind by more
    than its share of the rows lags."""
    use_rocksdb(stream.sparkSession)
    number = F.lit(0) if shard is None else F.pmod(F.xxhash64(shard), F.lit(shards)).cast("int")
    rows = stream.withColumn("event_us", epoch_micros(time)).withColumn("shard_no", number)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    routed = rows.groupBy("shard_no").transformWithStateInPandas(
        LateRouter(delay_seconds * 1_000_000), f"{schema}, late boolean, bar_us long", "Append", "None")
    return routed.drop("event_us", "shard_no")


def split_late(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows on time, late rows with ``reject_reason``) of a micro-batch of :func:`route_late`."""
    on_time = batch.where(~F.col("late")).drop("late", "bar_us")
    late = batch.where("late").drop("late").withColumn("reject_reason", F.lit(LATE))
    return on_time, late
