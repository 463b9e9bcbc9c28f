"""Many readers of one history (X3, S11): each asks for the days before a time of its own; only needed days are read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Requested days up to which the requests are broadcast (about 100 bytes each).
BROADCAST_DAYS = 100_000


def requested_rows(history: DataFrame, requests: DataFrame, ts_col: str = "timestamp",
                   day_col: str = "date") -> DataFrame:
    """The rows of ``history`` (partitioned by ``day_col``) in [as_of - days, as_of) of each of ``requests`` (consumer,
    as_of, days), with the consumer.

    Requests become one row per consumer and day and are joined on the day, so that dynamic partition pruning leaves
    the days that nobody asked for unread. They are broadcast up to a counted number of days; beyond it the join
    shuffles. Requests with null or non-positive days give nothing; a request made twice is answered once.
    """
    as_of = F.col("as_of").cast(history.schema[ts_col].dataType)
    asked = requests.select("consumer", as_of.alias("_end"), F.col("days").alias("_days")).distinct().where(
        F.col("_days") > 0).withColumn("_start", F.col("_end") - F.make_dt_interval(days=F.col("_days")))
    per_day = asked.select("consumer", "_start", "_end", "_days", F.explode(
        F.sequence(F.to_date("_start"), F.to_date("_end"))).alias(day_col))
    wanted = asked.agg(F.sum(F.col("_days") + 1)).first()[0] or 0
    if wanted <= BROADCAST_DAYS:
        per_day = F.broadcast(per_day)
    inside = (F.col(ts_col) >= F.col("_start")) & (F.col(ts_col) < F.col("_end"))
    return history.join(per_day, day_col).where(inside).drop("_start", "_end", "_days")
