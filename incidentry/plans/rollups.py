"""Mergeable rollups (X4, A1): per source and day, counts and sketches that later reports merge instead of reading logs.

Latencies go into a KLL quantile sketch, users into an HLL distinct sketch, both by Spark's own aggregates (partial before
the shuffle). A report over any set of days merges the stored sketches: its work grows with sources x days, not with logs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size of the quantile sketches; an HLL sketch has 2 ** 12 slots.
KLL_K, HLL_LOG2_SLOTS = 400, 12


def rank_error(k: int = KLL_K) -> float:
    """Single-sided rank error of a KLL sketch at 99 % confidence (the published fit of the sketch library)."""
    return 2.296 / k ** 0.9723


def daily_rollup(logs: DataFrame, user_col: str = "user_id") -> DataFrame:
    """(source, day, n, errors, latency_n, latency_sum_s, latency_max_s, latency_sketch, users_sketch) per source and day of
    ``timestamp``. Latency is received_at - timestamp in whole seconds; rows without one count in ``n`` alone."""
    latency = F.timestamp_diff("SECOND", F.col("timestamp"), F.col("received_at"))
    error = F.contains(F.lower(F.coalesce("message", F.lit(""))), F.lit("error"))
    return logs.withColumn("_latency", latency).groupBy("source", F.to_date("timestamp").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(error).alias("errors"), F.count("_latency").alias("latency_n"),
        F.sum("_latency").alias("latency_sum_s"), F.max("_latency").alias("latency_max_s"),
        F.kll_sketch_agg_bigint("_latency", F.lit(KLL_K)).alias("latency_sketch"),
        F.hll_sketch_agg(F.col(user_col), F.lit(HLL_LOG2_SLOTS)).alias("users_sketch"))


def write_rollup(rollup: DataFrame, path: str, batch_id: str | int) -> None:
    """Append a batch's rollup; a rerun of the batch replaces it. Days may repeat over batches: reports merge them."""
    (rollup.withColumn("batch_id", F.lit(str(batch_id))).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id", "day").parquet(path))


def merged_rollup(rollups: DataFrame, *keys: str) -> DataFrame:
    """Rollups merged to coarser ``keys`` (``source``, ``day``, or both), again mergeable."""
    return rollups.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("errors").alias("errors"), F.sum("latency_n").alias("latency_n"),
        F.sum("latency_sum_s").alias("latency_sum_s"), F.max("latency_max_s").alias("latency_max_s"),
        F.kll_merge_agg_bigint("latency_sketch").alias("latency_sketch"),
        F.hll_union_agg("users_sketch").alias("users_sketch"))


def latency_report(rollups: DataFrame, key: str = "source") -> DataFrame:
    """X4 from rollups: count, errors, mean, maximum, p50 and p95 with their bounds (the quantiles one rank error below and
    above, between which the exact value lies with 99 % confidence) and distinct users."""
    def quantile(p: float) -> Column:
        return F.when(F.col("latency_n") > 0, F.kll_sketch_get_quantile_bigint(
            "latency_sketch", F.lit(min(1.0, max(0.0, p)))))

    bounds = [(name, p + side * rank_error()) for label, p in (("p50", 0.5), ("p95", 0.95))
              for name, side in ((f"{label}_s", 0), (f"{label}_low_s", -1), (f"{label}_high_s", 1))]
    return merged_rollup(rollups, key).select(
        key, "n", "errors", (F.col("latency_sum_s") / F.col("latency_n")).alias("avg_latency_s"), "latency_max_s",
        *[quantile(p).alias(name) for name, p in bounds], F.hll_sketch_estimate("users_sketch").alias("users"))
