"""Incident rules: instant / accumulated (T2), brute force (T3, see bruteforce.py), incident rows (P10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from incidentry.constants import ACCUMULATED_PREFIX, ACCUMULATION_THRESHOLD, INSTANT_PREFIX, SEVERITY_HIGH, STATUS_OPEN
from incidentry.operators.scan import segmented_running_sum


DEFAULT_THRESHOLD = ACCUMULATION_THRESHOLD


def _is_high(severity: Column) -> Column:
    return F.coalesce(severity == F.lit(SEVERITY_HIGH), F.lit(False))


def instant_and_accumulated(events: DataFrame, key: str = "log_id", threshold: int = DEFAULT_THRESHOLD,
                            order: tuple[str, ...] = ("timestamp", "id")) -> DataFrame:
    """T2. Per key in arrival order every event counts; a ``high`` event raises an *instant* incident; any other event
    raises an *accumulated* incident once the key's count (this event included) reaches ``threshold`` — on that event
    and every later one.

    Plan: a positional running count per key (``operators.scan``: one shuffle into ranges of equal row count, no join),
    so events may share an id or a log id. ``order`` should be total; rows equal in it count in either order."""
    high = _is_high(F.col("severity"))
    marked = segmented_running_sum(events, key, list(order), F.lit(1), "_position")
    fires = high | (F.col("_position") >= threshold)
    # one pass over the events: high → instant, any other event from the threshold-th of its key on → accumulated
    fired = marked.where(fires)
    rule = F.when(high, F.lit("instant")).otherwise(F.lit("accumulated"))
    summary = F.when(high, F.concat(F.lit(INSTANT_PREFIX), F.col("description"))) \
        .otherwise(F.concat(F.lit(ACCUMULATED_PREFIX), F.coalesce(F.col(key).cast("string"), F.lit("None"))))
    return fired.select(
        F.md5(F.concat(F.lit("incident:"), rule, F.lit(":"), F.col("id"))).alias("id"),
        F.col("timestamp"),
        F.array(F.col("id")).alias("events"),
        F.lit(STATUS_OPEN).alias("status"),
        summary.alias("summary"),
        F.lit(None).cast("string").alias("owner"),
        rule.alias("rule"),
        F.col("id").alias("event_id"),
        F.col(key).cast("string").alias("key"),
    )
