"""Event creation (P5) and claim-check resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incidentry.functions import det_id
from incidentry.constants import DESCRIPTION_PREFIX, ERROR_TAG, EVENT_TYPE, SEVERITY_HIGH, SEVERITY_MEDIUM



def create_events(tagged: DataFrame, carry: list[str] | tuple = ()) -> DataFrame:
    """P5: one event per tagged log. Severity is ``high`` when the log has the ``error`` tag, else ``medium``.

    Ids are md5('event:' || log id) and the event time is the log time (D1, D2), so reruns give the same rows.
    ``carry`` names log columns to keep next to the event (e.g. a correlation key)."""
    severity = F.when(F.coalesce(F.array_contains("tags", ERROR_TAG), F.lit(False)), F.lit(SEVERITY_HIGH)) \
        .otherwise(F.lit(SEVERITY_MEDIUM))
    meta = F.col("metadata") if "metadata" in tagged.columns else F.lit(None).cast("map<string,string>")
    return tagged.select(
        det_id("event", "id").alias("id"),
        F.col("timestamp"),
        F.col("id").alias("log_id"),
        F.lit(EVENT_TYPE).alias("type"),
        severity.alias("severity"),
        F.concat(F.lit(DESCRIPTION_PREFIX), F.col("message")).alias("description"),
        meta.alias("metadata"),
        *[F.col(c) for c in carry],
    )


def resolve_claim_checks(messages: DataFrame, stored: DataFrame):
    """Claim-check messages joined to the stored tagged logs on ``s3_key``.

    Returns (resolved, missing). ``stored`` must have an ``s3_key`` column (see sources.stores). The join is an
    equi-join on a unique key, so it partitions evenly; Spark picks broadcast only when the stored side is small."""
    resolved = messages.select("s3_key").join(stored, "s3_key", "inner")
    missing = messages.join(stored.select("s3_key"), "s3_key", "left_anti") \
        .withColumn("reject_reason", F.lit("unknown s3_key"))
    return resolved, missing
