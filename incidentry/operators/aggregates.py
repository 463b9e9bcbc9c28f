"""Error counts: tumbling window per source (A1), running count per source (T1), run counters (A5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from incidentry.operators.filters import error_message
from incidentry.operators.scan import segmented_running_sum
from incidentry.constants import TUMBLING_WINDOW
from incidentry.functions import parse_event_time


def tumbling_error_counts(logs: DataFrame, window: str = TUMBLING_WINDOW, ts_col: str = "timestamp",
                          source_col: str = "source", message_col: str = "message") -> DataFrame:
    """Errors per source per tumbling event-time window; only non-empty windows are emitted.

    A partial (map-side) aggregate: a hot source never gathers its rows in one task. The same function serves batch
    and stream (the stream adds a watermark first, see streaming.aggregates)."""
    if isinstance(logs.schema[ts_col].dataType, StringType):  # JSON / topic input: P6, unparsable → epoch
        logs = logs.withColumn(ts_col, parse_event_time(ts_col))
    errors = logs.where(error_message(F.col(message_col)))
    return errors.groupBy(F.window(ts_col, window).alias("window"), F.col(source_col).alias("source")) \
        .agg(F.count(F.lit(1)).alias("error_count")) \
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                "source", "error_count")


def running_error_counts(logs: DataFrame, ts_col: str = "timestamp", id_col: str = "id",
                         source_col: str = "source", message_col: str = "message",
                         ranges: int | None = None) -> DataFrame:
    """One row per log with the count of error messages of its source so far (the log itself included).

    Non-error logs are emitted too, with the count unchanged (0 before the first error). Computed with the ordered
    scan, so a hot source is spread over many tasks."""
    flagged = logs.select(F.col(id_col).alias("id"), F.col(ts_col).alias("timestamp"),
                          F.col(source_col).alias("source"), F.col(message_col).alias("message"))
    return segmented_running_sum(flagged, "source", ["timestamp", "id"],
                                 error_message(F.col("message")).cast("int"), "error_count",
                                 ranges=ranges)


def events_per_key(events: DataFrame, key: str = "log_id") -> DataFrame:
    """A2: number of events per key (all severities), a partial aggregate."""
    return events.groupBy(key).agg(F.count(F.lit(1)).alias("n_events"))


def observed(df: DataFrame, name: str, **conditions):
    """A5 without an extra pass: attach an ``Observation`` that counts rows (and ``conditions``) while ``df`` is
    consumed by its real sink; read ``obs.get`` after the action."""
    from pyspark.sql import Observation
    obs = Observation(name)
    exprs = [F.count(F.lit(1)).alias("total")] + [F.count_if(c).alias(k) for k, c in conditions.items()]
    return df.observe(obs, *exprs), obs


def run_counters(df: DataFrame, **conditions) -> DataFrame:
    """A5: one pass of conditional counts, e.g. ``run_counters(tagged, matched=<Column>)`` → total, matched."""
    aggs = [F.count(F.lit(1)).alias("total")]
    aggs += [F.count_if(c).alias(name) for name, c in conditions.items()]
    return df.agg(*aggs)
