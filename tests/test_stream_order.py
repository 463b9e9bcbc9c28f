"""Event-time order in state and the side output of late rows, on replays of several micro-batches."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL, rows
from incidentry.operators.aggregates import running_error_counts
from incidentry.operators.bruteforce import brute_force_incidents
from incidentry.operators.normalize import normalize_logs
from incidentry.session import scratch_path
from incidentry.sources.driver_views import log_view
from incidentry.sources.tables import read_table
from incidentry.streaming import jobs
from incidentry.streaming.late import route_late, split_late
from incidentry.streaming.ordered import closing_row


def shuffled_replay(df, time, files):
    """Files that each hold rows of all times, a closing row behind them."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, "shuffled")
    df.repartition(files, F.xxhash64(*df.columns)).write.parquet(path)
    closing_row(df, time).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", "1").parquet(path)


def test_running_count_of_a_shuffled_replay_equals_batch(spark):
    logs = normalize_logs(log_view(spark, SF_SMALL)).select("id", "timestamp", "source", "message")
    got = jobs.run_and_read(jobs.stream_running_error_counts(shuffled_replay(logs, "timestamp", 3), reorder="3650 days"))
    want = running_error_counts(logs).select(*got.columns)
    assert rows(got) == rows(want)


def test_brute_force_of_a_shuffled_replay_equals_batch(spark):
    ev = read_table(spark, SF_SMALL, "events").where("event_type = 'error'").select(
        F.concat(F.lit("evt-"), F.col("event_id").cast("string")).alias("id"), F.col("ts").alias("timestamp"),
        F.col("user_id").cast("string").alias("ip"))
    def shaped(df):
        return df.withColumn("type", F.lit("login_failed")).withColumn("metadata", F.create_map(F.lit("ip"), "ip"))
    got = jobs.run_and_read(jobs.stream_brute_force(shaped(shuffled_replay(ev, "timestamp", 3)), 86400, 3,
                                                    reorder="3650 days"))
    want, _ = brute_force_incidents(shaped(ev), 86400, 3)
    assert rows(got, "event_id", "events") == rows(want, "event_id", "events") != []


@pytest.mark.parametrize("delay_s,late", [(0, ["c", "n"]), (5, ["n"])])
def test_late_rows_are_kept_apart(spark, delay_s, late):
    """On time + late = input; the limit is the newest time of the micro-batches before."""
    path = scratch_path(spark, "late")
    schema = "id STRING, s INT"
    for part in ([("a", 100), ("b", 90)], [("c", 98), ("d", 120), ("n", None)]):
        (spark.createDataFrame(part, schema).select("id", F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts"))
         .coalesce(1).write.mode("append").parquet(path))
    stream = spark.readStream.schema("id STRING, ts TIMESTAMP_NTZ").option("maxFilesPerTrigger", "1").parquet(path)
    on_time, gone = split_late(jobs.run_and_read(route_late(stream, "ts", delay_s)))
    assert sorted(r.id for r in gone.collect()) == late
    assert {r.reject_reason for r in gone.collect()} == {"late"}
    assert sorted([r.id for r in on_time.collect()] + late) == ["a", "b", "c", "d", "n"]
