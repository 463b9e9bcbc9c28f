"""For the tests: the receive → ETL filter → model match chain as three streaming queries joined by topics (W7, S2/S3, P4,
J2, S8). Logs are resolved against a keyed store in buckets; claim checks that it does not hold go to quarantine.

Each stage is its own query with its own checkpoint, like the reference's three consumers. A topic is a folder of
JSON files, one sub-folder per producing micro-batch (``batch_id=N``), written with overwrite so that a retried
micro-batch replaces its own output; consumers read the folder as a file stream. On a cluster with the Kafka
connector, ``streaming.sources.kafka_sink`` / ``kafka_stream`` take the place of the folders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from incidentry.functions import epoch_micros
from incidentry.functions.timefmt import ISO_MICROS
from incidentry.operators.events import create_events
from incidentry.operators.filters import etl_filter, model_match
from incidentry.operators.normalize import claim_check, normalize_logs, validate_submissions
from incidentry.operators.tagging import tag_logs
from incidentry.schemas import CLAIM_CHECK
from incidentry.session import scratch_path
from incidentry.sources import keyed_store, stores

STORE = {"key": "s3_key", "order": ("timestamp",), "buckets": 4}
_JSON_TS = {"timestampFormat": ISO_MICROS, "timestampNTZFormat": ISO_MICROS}


def publish(batch: DataFrame, topic: str, batch_id: int) -> None:
    """S3 on a folder topic: the batch's messages as JSON under ``batch_id=N`` (idempotent on retry)."""
    batch.write.mode("overwrite").options(**_JSON_TS).json(f"{topic}/batch_id={batch_id}")


def subscribe(spark: SparkSession, topic: str, schema, max_files_per_trigger: int | None = None) -> DataFrame:
    """S2 on a folder topic."""
    with_batch = StructType(list(schema.fields) + [StructField("batch_id", LongType())])  # never .add(): it mutates
    r = spark.readStream.schema(with_batch).options(**_JSON_TS)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return r.json(topic).drop("batch_id")


def _start(df: DataFrame, fn, checkpoint: str, available_now: bool):
    w = df.writeStream.option("checkpointLocation", checkpoint).foreachBatch(fn)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="5 seconds")
    return w.start()


def start_receiver(raw: DataFrame, store: str, topic: str, rules=None, checkpoint: str | None = None,
                   available_now: bool = True, quarantine: str | None = None):
    """Stage 1: validate submissions (P2; rejects go to ``quarantine``, X6), normalise and tag the valid ones, store
    the tagged logs (S4), publish claim checks (P4)."""
    def run(batch: DataFrame, batch_id: int) -> None:
        valid, rejected = validate_submissions(batch)
        if quarantine:
            stores.write_quarantine(rejected, quarantine, batch_id)
        tagged = tag_logs(normalize_logs(valid), rules)
        stored = tagged.withColumn("s3_key", F.concat(F.lit("logs/"), F.col("id"), F.lit(".json")))
        keyed_store.write_batch(stored, store, batch_id, **STORE)
        publish(claim_check(tagged), topic, batch_id)

    return _start(raw, run, checkpoint or scratch_path(raw.sparkSession, "ckpt-receiver"), available_now)


def start_etl_filter(spark: SparkSession, store: str, topic_in: str, topic_out: str, allowed_tags=None,
                     checkpoint: str | None = None, available_now: bool = True, quarantine: str | None = None):
    """Stage 2: resolve each claim check against the store (J2), keep allowed tags (F2), republish the key."""
    def run(batch: DataFrame, batch_id: int) -> None:
        resolved, missing = keyed_store.resolve(batch, store, **STORE)
        if quarantine:
            stores.write_quarantine(missing, quarantine, batch_id)
        passed = etl_filter(resolved, allowed_tags)
        publish(passed.select("s3_key", F.col("id").alias("log_id"), "tags"), topic_out, batch_id)

    return _start(subscribe(spark, topic_in, CLAIM_CHECK), run,
                  checkpoint or scratch_path(spark, "ckpt-etl"), available_now)


def start_matcher(spark: SparkSession, store: str, topic_in: str, events_path: str, event_tags=None,
                  checkpoint: str | None = None, available_now: bool = True, quarantine: str | None = None):
    """Stage 3: resolve again, match (F3), create events (P5) and upsert them into the event store."""
    schema = StructType([f for f in CLAIM_CHECK.fields if f.name != "timestamp"])

    def run(batch: DataFrame, batch_id: int) -> None:
        resolved, missing = keyed_store.resolve(batch.select("s3_key"), store, **STORE)
        if quarantine:
            stores.write_quarantine(missing, quarantine, batch_id)
        events = create_events(model_match(resolved, event_tags))
        stores.append_batch(events, events_path, batch_id)

    return _start(subscribe(spark, topic_in, schema), run,
                  checkpoint or scratch_path(spark, "ckpt-match"), available_now)


def replay_table(spark: SparkSession, df: DataFrame, ts_col: str, pieces: int) -> str:
    """Write a batch table as ``pieces`` files in time order (for replay tests of the stream paths)."""
    path = scratch_path(spark, "replay")
    bounds = df.select(F.min(epoch_micros(ts_col)).alias("lo"), F.max(epoch_micros(ts_col)).alias("hi")).first()
    lo, hi = int(bounds["lo"]), int(bounds["hi"]) + 1
    step = -(-(hi - lo) // pieces)
    for i in range(pieces):
        part = df.where((epoch_micros(ts_col) >= lo + i * step) & (epoch_micros(ts_col) < lo + (i + 1) * step))
        part.coalesce(1).write.mode("append").parquet(path)
    return path
