"""Streaming sources and sinks.

Kafka (S2/S3) needs the spark-sql-kafka connector on the cluster classpath; the functions only declare the stream.
File streams (JSON or parquet folders) stand in for the queue in tests, with ``maxFilesPerTrigger`` as the poll size
(O2) and the checkpoint replacing message deletion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from incidentry.functions import epoch_micros, to_json_iso
from incidentry.schemas import LOG_SUBMISSION

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """State processors need the RocksDB state store; set it only when the session uses the default one."""
    cur = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    if not cur or "HDFSBackedStateStoreProvider" in cur:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def file_stream(spark: SparkSession, path: str, schema, fmt: str = "json", max_files_per_trigger: int | None = None,
                glob: str | None = None) -> DataFrame:
    """A folder of JSON (or parquet) files as a stream."""
    r = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.load(path)


def events_stream(spark: SparkSession, sf_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """The driver's ``events`` table replayed as a file stream (a file stream needs a folder, hence the glob)."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return file_stream(spark, sf_dir, schema, "parquet", max_files_per_trigger, glob="events.parquet")


def kafka_stream(spark: SparkSession, bootstrap: str, topic: str, schema=LOG_SUBMISSION,
                 starting_offsets: str = "earliest", max_offsets_per_trigger: int | None = None) -> DataFrame:
    """JSON values of a topic, parsed permissively (P3); ``_corrupt`` marks values that did not parse."""
    r = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", bootstrap)
         .option("subscribe", topic).option("startingOffsets", starting_offsets))
    if max_offsets_per_trigger:
        r = r.option("maxOffsetsPerTrigger", str(max_offsets_per_trigger))
    raw = r.load().select(F.col("value").cast("string").alias("value"), "timestamp", "partition", "offset")
    return parse_values(raw, schema)


def parse_values(raw: DataFrame, schema=LOG_SUBMISSION) -> DataFrame:
    """The column code of :func:`kafka_stream`, on a stream or a batch of (value, timestamp): the fields of ``schema``,
    ``_corrupt`` (null or unparsable value), ``_value`` and ``_ingest_ts``."""
    marked = StructType([*schema.fields, StructField("_bad", StringType())])
    parsed = raw.withColumn("_rec", F.from_json("value", marked, {"mode": "PERMISSIVE",
                                                                  "columnNameOfCorruptRecord": "_bad"}))
    corrupt = F.col("value").isNull() | F.col("_rec").isNull() | F.col("_rec._bad").isNotNull()
    return parsed.select(*[F.col("_rec")[f.name].alias(f.name) for f in schema.fields], corrupt.alias("_corrupt"),
                         F.col("value").alias("_value"), F.col("timestamp").alias("_ingest_ts"))


def kafka_sink(df: DataFrame, bootstrap: str, topic: str, checkpoint: str, key: str = "id"):
    """S3: publish rows as JSON values with ISO microsecond timestamps."""
    out = df.select(F.col(key).cast("string").alias("key"),
                    to_json_iso(F.struct(*[F.col(c) for c in df.columns])).alias("value"))
    return (out.writeStream.format("kafka").option("kafka.bootstrap.servers", bootstrap).option("topic", topic)
            .option("checkpointLocation", checkpoint).start())


def event_time(c: Column | str) -> Column:
    """NTZ wall time → TIMESTAMP (the type watermarks require), independent of the session zone."""
    return F.timestamp_micros(epoch_micros(c))


def wall_time(c: Column | str) -> Column:
    """TIMESTAMP → NTZ wall time (inverse of ``event_time``), independent of the session zone."""
    c = F.col(c) if isinstance(c, str) else c
    return F.timestamp_add("MICROSECOND", F.unix_micros(c), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
