"""Receive-side projections: normalise (P1), validate / quarantine (P2, X6), typed JSON parse (P3), claim check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from incidentry.functions import det_id, iso_format, lower_strip, strip_ws
from incidentry.schemas import LOG_SUBMISSION
from incidentry.constants import CLAIM_CHECK_PREFIX, CLAIM_CHECK_SUFFIX, RECEIVER_METADATA, UNKNOWN_SOURCE



def _has(df: DataFrame, name: str) -> bool:
    return name in df.columns


def _timestamp_of(df: DataFrame, fallback: Column) -> Column:
    if not _has(df, "timestamp"):
        return fallback
    c = F.col("timestamp")
    if isinstance(df.schema["timestamp"].dataType, StringType):
        c = F.try_to_timestamp(c)
    return F.coalesce(c, fallback)


def normalize_logs(raw: DataFrame) -> DataFrame:
    """Source defaults to 'unknown', stripped and lower-cased; message defaults to '' and is stripped; missing ids
    are derived from the record (D1); a missing timestamp takes the arrival time (``received_at`` when present, else the
    query's current time); metadata gains ``received_by`` / ``normalized`` (overwriting earlier values). Other columns
    pass through."""
    received = F.col("received_at") if _has(raw, "received_at") else F.current_timestamp().cast("timestamp_ntz")
    source = F.col("source") if _has(raw, "source") else F.lit(None).cast("string")
    message = F.col("message") if _has(raw, "message") else F.lit(None).cast("string")
    meta = F.col("metadata") if _has(raw, "metadata") else F.lit(None).cast("map<string,string>")
    meta = F.coalesce(meta, F.create_map().cast("map<string,string>"))
    kept = F.map_filter(meta, lambda k, v: ~k.isin(*RECEIVER_METADATA))
    added = F.create_map(*[F.lit(x) for kv in RECEIVER_METADATA.items() for x in kv])
    natural = F.to_json(F.struct(F.col("timestamp").cast("string").alias("t") if _has(raw, "timestamp")
                                 else F.lit(None).alias("t"), source.alias("s"), message.alias("m")))
    log_id = F.coalesce(F.col("id").cast("string"), det_id("log", natural)) if _has(raw, "id") else det_id("log", natural)
    ts = _timestamp_of(raw, received)
    out = raw.withColumns({
        "id": log_id,
        "timestamp": ts,
        "source": lower_strip(F.coalesce(source, F.lit(UNKNOWN_SOURCE))),
        "message": strip_ws(F.coalesce(message, F.lit(""))),
        "metadata": F.map_concat(kept, added),
        "received_at": received,
    })
    front = ["id", "timestamp", "source", "message", "metadata"]
    return out.select(*front, *[c for c in out.columns if c not in front])


def validate_submissions(subs: DataFrame):
    """A submission needs a ``source`` and a ``message`` (blank text is text) and, when given, a parsable timestamp.

    Returns (valid, rejected); rejected rows carry ``reject_reason`` and are never dropped silently (X6)."""
    src = F.col("source")
    msg = F.col("message")
    ts_bad = F.lit(False)
    if _has(subs, "timestamp") and isinstance(subs.schema["timestamp"].dataType, StringType):
        ts_bad = F.col("timestamp").isNotNull() & F.try_to_timestamp(F.col("timestamp")).isNull()
    reason = (F.when(src.isNull(), F.lit("missing source"))
              .when(msg.isNull(), F.lit("missing message"))
              .when(ts_bad, F.lit("bad timestamp")))
    marked = subs.withColumn("reject_reason", reason)
    valid = marked.where(F.col("reject_reason").isNull()).drop("reject_reason")
    rejected = marked.where(F.col("reject_reason").isNotNull())
    return valid, rejected


def parse_json_logs(lines: DataFrame, value_col: str = "value", schema=LOG_SUBMISSION):
    """Typed parse of JSON text; returns (parsed, corrupt) where corrupt rows keep the original text."""
    with_corrupt = StructType(list(schema.fields) + [StructField("corrupt_record", StringType())])
    opts = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt_record"}
    parsed = lines.withColumn("_rec", F.from_json(F.col(value_col), with_corrupt, opts))
    ok = F.col("_rec").isNotNull() & F.col(value_col).isNotNull() & F.col("_rec.corrupt_record").isNull()
    good = parsed.where(ok).select(*[c for c in lines.columns if c != value_col],
                                   *[F.col(f"_rec.{f.name}") for f in schema.fields])
    bad = parsed.where(~ok).drop("_rec").withColumn("reject_reason", F.lit("malformed json"))
    return good, bad


def claim_check(tagged: DataFrame) -> DataFrame:
    """The message published after storing a tagged log."""
    return tagged.select(
        F.concat(F.lit(CLAIM_CHECK_PREFIX), F.col("id"), F.lit(CLAIM_CHECK_SUFFIX)).alias("s3_key"),
        F.col("id").alias("log_id"),
        iso_format("timestamp").alias("timestamp"),
        F.col("tags"),
    )
