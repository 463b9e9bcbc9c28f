"""A key holding a third of all rows: the ordered operators must stay exact when that key spans many ranges."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF_MID, rows
from incidentry.operators.bruteforce import brute_force_incidents
from incidentry.operators.incidents import instant_and_accumulated
from incidentry.operators.logins import login_attempt_counts
from incidentry.operators.scan import segmented_running_sum, with_range
from incidentry.sources.tables import read_table
from test_bruteforce import direct_fold

HOUR = 3_600_000_000


def hot_events(spark):
    """events with user_id replaced by 'hot' on every third row."""
    ev = read_table(spark, SF_MID, "events")
    return ev.withColumn("k", F.when(F.col("event_id") % 3 == 0, F.lit("hot"))
                         .otherwise(F.col("user_id").cast("string")))


@pytest.mark.parametrize("ranges", [6, 40])
def test_hot_key_running_sum_with_resets(spark, ranges):
    ev = hot_events(spark)
    got = segmented_running_sum(ev, "k", ["ts", "event_id"], (F.col("event_type") == "error").cast("int"), "o",
                                reset=F.col("event_type") == "signup", gap_micros=2 * HOUR, ranges=ranges)
    w = Window.partitionBy("k").orderBy("ts", "event_id")
    b = ev.withColumn("p", F.lag("ts").over(w)).withColumn(
        "r", ((F.col("event_type") == "signup") | (F.col("p").isNotNull() & (
            F.timestamp_diff("SECOND", F.col("p"), F.col("ts")) >= 7200))).cast("int"))
    b = b.withColumn("seg", F.sum("r").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    b = b.withColumn("o", F.sum((F.col("event_type") == "error").cast("int")).over(
        Window.partitionBy("k", "seg").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0))
        .cast("bigint"))
    assert rows(got, "event_id", "o") == rows(b, "event_id", "o")


def test_hot_key_brute_force(spark):
    ev = hot_events(spark).where(F.col("event_type") == "error").select(
        F.concat(F.lit("evt-"), F.col("event_id").cast("string")).alias("id"), F.col("ts").alias("timestamp"),
        F.lit("login_failed").alias("type"), F.create_map(F.lit("ip"), F.col("k")).alias("metadata"))
    src = ev.select("id", "timestamp", F.col("metadata")["ip"].alias("key")).collect()
    for window_s, k, bucket, group in [(6 * 3600, 3, 8, 4), (6 * 3600, 3, 64, 2), (12 * 3600, 5, 4096, 4096)]:
        inc, _ = brute_force_incidents(ev, window_s, k, bucket=bucket, group=group, ranges=16)
        got = sorted((r["key"], r["event_id"], tuple(r["events"])) for r in inc.collect())
        want = direct_fold(src, window_s, k)
        assert got == want and any(g[0] == "hot" for g in got)


def test_hot_key_accumulated(spark):
    ev = hot_events(spark).select(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("id"),
                                  F.col("ts").alias("timestamp"), "k",
                                  F.when(F.col("event_type") == "error", "high").otherwise("medium").alias("severity"),
                                  F.lit("d").alias("description"))
    got = instant_and_accumulated(ev, key="k", threshold=5)
    w = Window.partitionBy("k").orderBy("timestamp", "id")
    b = ev.withColumn("rn", F.row_number().over(w)).where((F.col("severity") == "high") | (F.col("rn") >= 5))
    assert rows(got, "event_id") == rows(b.select(F.col("id").alias("event_id")))


def test_hot_user_logins(spark):
    ev = hot_events(spark).where(F.col("event_type").isin("error", "signup"))
    att = ev.select(F.col("k").alias("username"), "ts", (F.col("event_type") == "signup").alias("password_ok"),
                    F.col("event_id").alias("attempt_id"))
    users = att.select("username").distinct()
    a = rows(login_attempt_counts(att, users, 3600, ranges=40), "attempt_id", "attempts")
    b = rows(login_attempt_counts(att, users, 3600, ranges=1), "attempt_id", "attempts")
    assert a == b


@pytest.mark.parametrize("shape", ["hot", "burst", "epoch"])
def test_ranges_have_equal_row_counts(spark, shape):
    """A third of the rows under one key, all of them in one microsecond, or one row at the epoch among later ones: no
    range has over twice the median rows, and the running sum is that of a plain window."""
    ev = hot_events(spark).select("k", "ts", "event_id", "event_type")
    if shape == "burst":
        ev = ev.withColumn("ts", F.when(F.col("k") == "hot", F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"))
                           .otherwise(F.col("ts")))
    if shape == "epoch":
        ev = ev.withColumn("ts", F.when(F.col("event_id") == 3, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
                           .otherwise(F.col("ts")))
    counts = sorted(r[1] for r in with_range(ev, ["k", "ts", "event_id"], 16).groupBy("_p").count().collect())
    assert len(counts) == 16 and counts[-1] <= 2 * counts[8], counts
    for reset in (None, F.col("event_type") == "signup"):
        value = (F.col("event_type") == "error").cast("int")
        got = segmented_running_sum(ev, "k", ["ts", "event_id"], value, "o", reset=reset, ranges=16)
        want = segmented_running_sum(ev, "k", ["ts", "event_id"], value, "o", reset=reset, ranges=1)
        assert rows(got, "event_id", "o") == rows(want, "event_id", "o")


def test_no_job_runs_while_a_scan_is_built(spark):
    ev = hot_events(spark)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", "no job expected")
    try:
        segmented_running_sum(ev, "k", ["ts", "event_id"], F.lit(1), "o", gap_micros=HOUR, ranges=16)
        assert not tracker.getJobIdsForGroup("building")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
