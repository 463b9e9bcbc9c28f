"""Stores: tagged-log objects (S4, S5), event / incident store (S8), event history.

Writes are partitioned folders, never one file per row. "Same id overwrites" is kept as append + latest-by-key on
read (T5): a rerun of a batch replaces only its own ``batch_id`` partition (dynamic partition overwrite), and no job
reads and overwrites the same path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, LongType, StructField, StructType, TimestampType

from incidentry.functions.timefmt import ISO_MICROS
from incidentry.operators.upsert import latest_per_key
from incidentry.schemas import TAGGED_LOG

_JSON_TS = {"timestampFormat": ISO_MICROS, "timestampNTZFormat": ISO_MICROS}


def _dated(df: DataFrame) -> DataFrame:
    return df.withColumn("date", F.to_date("timestamp"))


def write_tagged_logs(tagged: DataFrame, path: str, batch_id: int, fmt: str = "json") -> None:
    """Tagged logs as JSON (ISO microsecond timestamps, P9) under date=/batch_id=; duplicates of an id inside
    the batch collapse to the last one first."""
    latest = latest_per_key(tagged, "id", ["timestamp"])
    (_dated(latest).withColumn("batch_id", F.lit(int(batch_id)).cast("bigint"))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").options(**_JSON_TS)
     .partitionBy("date", "batch_id").format(fmt).save(path))


def read_tagged_logs(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Stored tagged logs, latest copy per id (batch ids are numbers: 10 comes after 9), with the claim-check key ``s3_key``."""
    # a new StructType: StructType.add would modify the shared schema in place
    schema = StructType(TAGGED_LOG.fields + [StructField("received_at", TimestampType()),
                                             StructField("date", DateType()), StructField("batch_id", LongType())])
    df = spark.read.schema(schema).options(**_JSON_TS).format(fmt).load(path)
    latest = latest_per_key(df.drop("date"), "id", ["batch_id", "timestamp"])
    return latest.withColumn("s3_key", F.concat(F.lit("logs/"), F.col("id"), F.lit(".json")))


def append_batch(df: DataFrame, path: str, batch_id: str | int) -> None:
    """S8 write side: one ``batch_id`` partition per batch; rerunning the batch replaces just that partition."""
    (df.withColumn("batch_id", F.lit(str(batch_id)))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("batch_id").parquet(path))


def latest_view(spark: SparkSession, path: str, key: str = "id", order: tuple = ("batch_id", "timestamp")) -> DataFrame:
    """S8 read side: the upsert outcome — the newest row per key."""
    return latest_per_key(spark.read.parquet(path), key, list(order))


def append_history(events: DataFrame, path: str) -> None:
    """Every event kept, partitioned by day (a time-range read prunes partitions, X3)."""
    _dated(events).write.mode("append").partitionBy("date").parquet(path)


def write_quarantine(rejected: DataFrame, path: str, batch_id: str | int | None = None) -> None:
    """Rejected records (``reject_reason`` set by P2 / P3 / J2 / F8) kept apart, by reason and day. With a
    ``batch_id`` (streams) a retried micro-batch replaces its own output."""
    dated = rejected.withColumn("date", F.to_date("timestamp")) if "timestamp" in rejected.columns \
        else rejected.withColumn("date", F.current_date())
    if batch_id is None:
        dated.write.mode("append").partitionBy("reject_reason", "date").parquet(path)
    else:
        (dated.withColumn("batch_id", F.lit(str(batch_id))).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id", "reject_reason", "date").parquet(path))
