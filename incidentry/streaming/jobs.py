"""Streaming jobs (W1-W7): the batch operators on streaming DataFrames, plus the keyed state processors.

Stateless steps (normalise, tag, filter, match, create events) are the very same functions as in batch. Results
are written per micro-batch through ``foreachBatch`` into a ``batch_id``-partitioned table (a rerun of a micro-batch
replaces its own partition), and readers take the latest row per key, so update-mode outputs and restarts are safe.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from incidentry.functions import det_id, epoch_micros, parse_event_time
from incidentry.operators.aggregates import tumbling_error_counts
from incidentry.operators.bruteforce import OWNER, RULE, SUMMARY_MIDDLE, SUMMARY_PREFIX
from incidentry.operators.filters import error_message
from incidentry.operators.incidents import ACCUMULATED_PREFIX, INSTANT_PREFIX
from incidentry.operators.upsert import latest_per_key
from incidentry.session import scratch_path
from incidentry.streaming.ordered import CLOSING_TIME, closing_row, in_event_time_order, watermarked
from incidentry.streaming.processors import BruteForce, EventCounter, LoginCounter, RunningErrorCount
from incidentry.streaming.sources import event_time, use_rocksdb, wall_time


def run_to_table(df: DataFrame, path: str, output_mode: str = "append", checkpoint: str | None = None,
                 available_now: bool = True, query_name: str | None = None):
    """Run a stream into a parquet table, one ``batch_id`` partition per micro-batch; returns the query."""
    spark = df.sparkSession
    checkpoint = checkpoint or scratch_path(spark, "stream-checkpoint")

    def write(batch: DataFrame, batch_id: int) -> None:
        (batch.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch_id").parquet(path))

    w = df.writeStream.outputMode(output_mode).option("checkpointLocation", checkpoint).foreachBatch(write)
    if query_name:
        w = w.queryName(query_name)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="5 seconds")
    return w.start()


def run_and_read(df: DataFrame, output_mode: str = "append", latest_key: list[str] | None = None) -> DataFrame:
    """Drive a stream to the end of its input and return what it wrote (latest row per key for update mode)."""
    spark = df.sparkSession
    path = scratch_path(spark, "stream-output")
    q = run_to_table(df, path, output_mode)
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    try:
        out = spark.read.parquet(path)
    except AnalysisException:  # the stream wrote nothing
        return spark.createDataFrame([], df.schema)
    if latest_key:
        out = latest_per_key(out, latest_key, ["batch_id"])
    return out.drop("batch_id")


def stream_error_counts(logs: DataFrame, window: str = "5 seconds", delay: str = "0 seconds") -> DataFrame:
    """A1 + W1-W3: tumbling error counts with an event-time watermark; rows later than the watermark are dropped
    (Spark moves the watermark between micro-batches). Window bounds come back as wall-clock NTZ."""
    if isinstance(logs.schema["timestamp"].dataType, StringType):  # JSON / topic input: P6, unparsable → epoch
        timed = logs.withColumn("timestamp", parse_event_time("timestamp"))
    else:
        timed = logs.withColumn("timestamp", event_time("timestamp"))
    timed = timed.withWatermark("timestamp", delay)
    out = tumbling_error_counts(timed, window)
    return out.withColumn("window_start", wall_time("window_start")).withColumn("window_end", wall_time("window_end"))


def stream_running_error_counts(logs: DataFrame, reorder: str | None = None) -> DataFrame:
    """T1 on a stream (W4), in arrival order or, with ``reorder`` (a delay, e.g. "10 minutes"), in event-time order."""
    use_rocksdb(logs.sparkSession)
    schema = "id string, timestamp timestamp_ntz, source string, error_count long"
    error = error_message(F.col("message")).alias("error")  # the state holds this, not the texts
    if reorder is None:
        return logs.select("id", "timestamp", "source", error).groupBy("source").transformWithStateInPandas(
            RunningErrorCount(), schema, "Append", "None")
    rows = watermarked(logs.select("id", "source", error, epoch_micros("timestamp").alias("event_us"),
                                   event_time("timestamp").alias("ets")), "ets", reorder)
    counted = in_event_time_order(rows, "source", RunningErrorCount("event_us", in_order=True), ["event_us", "id"],
                                  "id string, event_us long, source string, error_count long")
    return counted.select("id", from_micros("event_us").alias("timestamp"), "source", "error_count")


def from_micros(us: str):
    """Microseconds since the epoch as a wall-clock TIMESTAMP_NTZ."""
    return F.timestamp_add("MICROSECOND", F.col(us), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def stream_incidents(events: DataFrame, key: str = "log_id", threshold: int = 3, idle_seconds: int | None = None,
                     delay: str = "0 seconds", reorder: str | None = None) -> DataFrame:
    """T2 on a stream: the same incident rows as ``instant_and_accumulated``, in arrival order or, with ``reorder`` (a
    delay), in event-time order. ``idle_seconds`` bounds the state: a key quiet for that long (event time, behind a
    ``delay`` watermark) starts counting again from zero; the timer fires when the watermark passes it, i.e. between
    micro-batches."""
    use_rocksdb(events.sparkSession)
    ev = events.select("id", "timestamp", "severity", "description", F.col(key).alias("_key"),
                       epoch_micros("timestamp").alias("event_us"), event_time("timestamp").alias("ets"))
    if reorder is not None:
        waiting = watermarked(ev, "ets", reorder).drop("timestamp").withColumnRenamed("_key", "key")
        fired = in_event_time_order(waiting, "key",
                                    EventCounter(threshold, idle_seconds, "event_us", in_order=True), ["event_us", "id"],
                                    "id string, event_us long, description string, key string, rule string")
        fired = fired.withColumn("timestamp", from_micros("event_us"))
    else:
        if idle_seconds is not None:
            ev = ev.withWatermark("ets", delay)
        fired = ev.groupBy("_key").transformWithStateInPandas(
            EventCounter(threshold, idle_seconds),
            "id string, timestamp timestamp_ntz, description string, key string, rule string",
            "Append", "None" if idle_seconds is None else "EventTime")
    summary = F.when(F.col("rule") == "instant", F.concat(F.lit(INSTANT_PREFIX), F.col("description"))) \
        .otherwise(F.concat(F.lit(ACCUMULATED_PREFIX), F.coalesce(F.col("key"), F.lit("None"))))
    return fired.select(
        F.md5(F.concat(F.lit("incident:"), F.col("rule"), F.lit(":"), F.col("id"))).alias("id"),
        "timestamp", F.array("id").alias("events"), F.lit("open").alias("status"), summary.alias("summary"),
        F.lit(None).cast("string").alias("owner"), "rule", F.col("id").alias("event_id"), "key")


def stream_brute_force(events: DataFrame, window_seconds: int = 60, threshold: int = 10,
                       delay: str = "0 seconds", time_mode: str = "event", reorder: str | None = None) -> DataFrame:
    """T3 on a stream (W5). ``time_mode="event"`` (default; a timer clears the buffer of an idle key) or ``"processing"``
    (ages against the wall clock, as the reference). Rows are taken as they arrive or, with ``reorder`` (a delay), in
    event-time order: then the result is that of the batch rule for any arrival within the delay."""
    use_rocksdb(events.sparkSession)
    ev = events.where(F.col("type") == "login_failed").select(
        F.col("id").cast("string").alias("id"), event_time("timestamp").alias("ts"),
        epoch_micros("timestamp").alias("event_us"), F.col("metadata")["ip"].alias("key"))
    schema = "trigger_id string, trigger_us long, ids array<string>, key string"
    if reorder is not None:
        ev = ev.withWatermark("ts", reorder)
        # reads the time as well, so that it stays behind the watermark, which a closing row (without a key) must reach
        ev = ev.where(F.when(F.col("ts") < F.lit(CLOSING_TIME).cast("timestamp"), F.col("key").isNotNull())
                      .otherwise(F.lit(False)))
        fired = in_event_time_order(ev, "key", BruteForce(window_seconds, threshold), ["event_us", "id"], schema)
    else:
        ev = ev.where(F.col("key").isNotNull())
        if time_mode == "event":
            ev = ev.withWatermark("ts", delay)
        fired = ev.groupBy("key").transformWithStateInPandas(
            BruteForce(window_seconds, threshold, time_mode), schema, "Append",
            "EventTime" if time_mode == "event" else "None")
    return fired.select(
        det_id(f"incident:{RULE}", "trigger_id").alias("id"),
        from_micros("trigger_us").alias("timestamp"),
        F.col("ids").alias("events"), F.lit("open").alias("status"),
        F.concat(F.lit(SUMMARY_PREFIX), F.size("ids").cast("string"), F.lit(SUMMARY_MIDDLE), F.col("key"))
        .alias("summary"),
        F.lit(OWNER).alias("owner"), F.lit(RULE).alias("rule"), F.col("trigger_id").alias("event_id"), "key")


def stream_login_counts(attempts: DataFrame, users: DataFrame, ttl_seconds: int | None = 3600,
                        delay: str = "0 seconds", reorder: str | None = None) -> DataFrame:
    """T4 on a stream (W6): stream-static join with the users table (J3), then the keyed counter, in arrival order or,
    with ``reorder`` (a delay), in event-time order."""
    use_rocksdb(attempts.sparkSession)
    # never null, so that the join puts no filter below the watermark
    name = F.coalesce("username", F.lit("")).alias("username")
    names = users.where("username IS NOT NULL").select(name).distinct().withColumn("known", F.lit(True))
    timed = attempts.select(name, event_time("ts").alias("ets"), "attempt_id", "password_ok",
                            epoch_micros("ts").alias("event_us"))
    if reorder is not None:  # the watermark stands before the join, so that a closing row without a user moves it
        timed = watermarked(timed, "ets", reorder)
    elif ttl_seconds is not None:
        timed = timed.withWatermark("ets", delay)
    marked = timed.join(names, "username", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    known, schema = marked.where("known").drop("known"), "attempt_id long, attempts long"
    if reorder is not None:
        return in_event_time_order(known, "username", LoginCounter(ttl_seconds), ["event_us", "attempt_id"], schema)
    return known.groupBy("username").transformWithStateInPandas(
        LoginCounter(ttl_seconds), schema, "Append", "None" if ttl_seconds is None else "EventTime")


def stream_incident_chain(raw_logs: DataFrame, rules=None, etl_tags=None, event_tags=None, key: str = "log_id",
                    threshold: int = 3, carry: tuple = (), reorder: str | None = None) -> DataFrame:
    """The receive → ETL filter → model match → incident chain as one streaming plan. The stateless steps are
    the batch functions; only the incident rule keeps state (``reorder``: see ``stream_incidents``)."""
    from incidentry.plans.batch_jobs import filtered_events
    events = filtered_events(raw_logs, rules, etl_tags, event_tags, carry=carry)
    return stream_incidents(events, key=key, threshold=threshold, reorder=reorder)


def dedupe_exact(stream: DataFrame, key: str = "id", ts_col: str = "timestamp", delay: str = "10 minutes") -> DataFrame:
    """T5 on a stream for exact duplicates: the first copy of an id within the watermark delay is kept. (Keeping the
    latest copy of changing rows is the job of the batch_id-partitioned sink + latest-by-key read.)"""
    return stream.withColumn("_et", event_time(ts_col)).withWatermark("_et", delay) \
        .dropDuplicatesWithinWatermark([key]).drop("_et")


def console(df: DataFrame, output_mode: str = "append"):
    """Print a stream (debugging only)."""
    return df.writeStream.outputMode(output_mode).format("console").option("truncate", "false").start()


#: Rows of a file of a replay, so that a micro-batch is read by several tasks.
REPLAYED_ROWS = 500_000


def replayed(df: DataFrame, order: list[str], files: int) -> DataFrame:
    """``df`` as a stream of ``files`` micro-batches: its rows written in ranges of consecutive ``order`` values by one job
    of as many tasks as the session shuffles with (``files`` at least), behind them a closing row (``streaming.ordered``).
    ``order[0]`` is the event time. For history that shall run through the streaming jobs; files may arrive in any order,
    so give the jobs a ``reorder`` delay."""
    spark = df.sparkSession
    path = scratch_path(spark, "replayed")
    ranges = max(files, int(spark.conf.get("spark.sql.shuffle.partitions")))
    df.repartitionByRange(ranges, *order).write.option("maxRecordsPerFile", REPLAYED_ROWS).parquet(path)
    written = len(spark.read.schema(df.schema).parquet(path).inputFiles())
    closing_row(df, order[0]).coalesce(1).write.mode("append").parquet(path)
    at_a_time = max(1, -(-written // files))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", str(at_a_time)).parquet(path)
