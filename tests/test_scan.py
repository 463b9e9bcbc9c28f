"""The ordered scan must equal a plain per-key window whatever the number of ranges."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF_MID, rows
from incidentry.operators.aggregates import running_error_counts
from incidentry.operators.logins import login_attempt_counts
from incidentry.operators.normalize import normalize_logs
from incidentry.operators.scan import segmented_running_sum
from incidentry.sources.driver_views import log_view, login_attempts_view, users_view

@pytest.mark.parametrize("ranges", [1, 2, 7, 64])
def test_running_error_count_any_ranges(spark, ranges):
    logs = normalize_logs(log_view(spark, SF_MID))
    got = running_error_counts(logs, ranges=ranges).select("id", "error_count")
    w = Window.partitionBy("source").orderBy("timestamp", "id").rowsBetween(Window.unboundedPreceding, 0)
    want = logs.select("id", F.sum(F.contains(F.lower("message"), F.lit("error")).cast("int")).over(w)
                       .cast("bigint").alias("error_count"))
    assert rows(got) == rows(want)


def _brute_logins(attempts, users, ttl):
    known = attempts.join(users.distinct().withColumn("k", F.lit(True)), "username", "left") \
        .withColumn("known", F.coalesce("k", F.lit(False))).drop("k")
    w = Window.partitionBy("username").orderBy("ts", "attempt_id")
    k = known.where("known").withColumn("pts", F.lag("ts").over(w))
    gap = F.lit(False) if ttl is None else (F.col("pts").isNotNull() & (
        F.timestamp_diff("SECOND", F.col("pts"), F.col("ts")) >= ttl))
    k = k.withColumn("rst", (F.col("password_ok") | gap).cast("int"))
    k = k.withColumn("seg", F.sum("rst").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    w2 = Window.partitionBy("username", "seg").orderBy("ts", "attempt_id").rowsBetween(Window.unboundedPreceding, 0)
    k = k.withColumn("attempts", F.when(F.col("password_ok"), 0).otherwise(
        F.sum((~F.col("password_ok")).cast("int")).over(w2)).cast("bigint"))
    return k.select("attempt_id", "attempts").unionByName(
        known.where(~F.col("known")).select("attempt_id", F.lit(0).cast("bigint").alias("attempts")))


@pytest.mark.parametrize("ttl", [3600, 172800, None])
@pytest.mark.parametrize("ranges", [1, 5, 48])
def test_login_counter_any_ranges(spark, ttl, ranges):
    att, users = login_attempts_view(spark, SF_MID), users_view(spark, SF_MID)
    got = login_attempt_counts(att, users, ttl_seconds=ttl, ranges=ranges).select("attempt_id", "attempts")
    assert rows(got) == rows(_brute_logins(att, users, ttl))


def test_reset_and_gap_edges(spark):
    # key a: 1,1,(reset)0.. ; gap exactly equal to the limit restarts; null key is its own key
    data = [("a", 0, 1, False), ("a", 10, 1, False), ("a", 20, 0, True), ("a", 25, 1, False),
            ("a", 35, 1, False), ("a", 45, 1, False), (None, 1, 1, False), (None, 2, 1, False)]
    df = spark.createDataFrame(data, "k STRING, s INT, v INT, r BOOLEAN") \
        .withColumn("ts", F.timestamp_seconds("s").cast("timestamp_ntz")).withColumn("id", F.col("s"))
    for ranges in (1, 2, 3, 8, 20):
        out = segmented_running_sum(df, "k", ["ts", "id"], F.col("v"), "o", reset=F.col("r"),
                                    gap_micros=10_000_000, ranges=ranges)
        got = {(r["k"], r["s"]): r["o"] for r in out.collect()}
        assert got[("a", 0)] == 1 and got[("a", 10)] == 1  # gap of exactly 10 s restarts
        assert got[("a", 20)] == 0 and got[("a", 25)] == 1
        assert got[("a", 35)] == 1 and got[("a", 45)] == 1
        assert got[(None, 1)] == 1 and got[(None, 2)] == 2
