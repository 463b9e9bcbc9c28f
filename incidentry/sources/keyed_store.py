"""A keyed store in hash buckets (S4, S5, S8, J2): batches of rows, pruned lookups, compaction.

Layout under ``path``::

    deltas/batch_id=N/bucket=B   the rows of batch N, one folder a batch: writing it again replaces it
    base/upto=N/bucket=B         the newest row of each key over all batches up to N, written by :func:`compact`
    compactions                  one row (upto) per finished compaction

A reader takes the newest finished base and the batches after it, so a lookup never reads a batch that was merged, and of
the rest only the buckets its keys fall in. A base counts once its row stands in ``compactions``: a compaction that was
lost half way is not seen and can be repeated, and readers may go on meanwhile. Merged batches may be deleted by the
platform's retention. The number of buckets is fixed for a store.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from incidentry.operators.upsert import latest_per_key

BUCKETS = 64
#: Which batch wrote a row; the newest batch wins, then the order columns.
BATCH = "written_by"


def bucket_of(key: str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")


def write_batch(df: DataFrame, path: str, batch_id: int, key: str = "id", order: tuple = ("timestamp",),
                buckets: int = BUCKETS) -> None:
    """Write a batch, the newest row of each key; a rerun of the batch replaces it whole. Batch ids ascend."""
    rows = latest_per_key(df, key, list(order)).withColumn(BATCH, F.lit(int(batch_id)).cast("bigint"))
    _save(rows, f"{path}/deltas/batch_id={int(batch_id)}", key, buckets)


def _save(rows: DataFrame, path: str, key: str, buckets: int) -> None:
    (rows.withColumn("bucket", bucket_of(key, buckets)).repartition("bucket")
     .write.mode("overwrite").partitionBy("bucket").parquet(path))


def compacted_upto(spark: SparkSession, path: str) -> int | None:
    """The last batch of the newest finished compaction."""
    try:
        return spark.read.schema("upto long").parquet(f"{path}/compactions").agg(F.max("upto")).first()[0]
    except AnalysisException:  # never compacted
        return None


def stored_rows(spark: SparkSession, path: str) -> DataFrame:
    """Every stored copy that can still be the newest of its key, with ``bucket`` as a partition column."""
    upto = compacted_upto(spark, path)
    deltas = spark.read.parquet(f"{path}/deltas")
    if upto is None:
        return deltas.drop("batch_id")
    base = spark.read.parquet(f"{path}/base/upto={upto}")
    return base.unionByName(deltas.where(F.col("batch_id") > upto).drop("batch_id"))


def read_latest(spark: SparkSession, path: str, key: str = "id", order: tuple = ("timestamp",)) -> DataFrame:
    """The newest row of every key."""
    return latest_per_key(stored_rows(spark, path).drop("bucket"), key, [BATCH, *order]).drop(BATCH)


def lookup(keys: DataFrame, path: str, key: str = "id", order: tuple = ("timestamp",),
           buckets: int = BUCKETS) -> DataFrame:
    """The newest row of each of ``keys`` (a DataFrame with the column ``key``). Only the buckets that the keys fall in are
    read; their numbers, at most ``buckets``, come to the driver. Keys that are null or not stored give no row."""
    wanted = keys.select(key).where(F.col(key).isNotNull()).distinct()
    numbers = [r.bucket for r in wanted.select(bucket_of(key, buckets).alias("bucket")).distinct().collect()]
    rows = stored_rows(keys.sparkSession, path).where(F.col("bucket").isin(numbers)).drop("bucket")
    return latest_per_key(rows.join(wanted, key, "left_semi"), key, [BATCH, *order]).drop(BATCH)


def resolve(messages: DataFrame, path: str, key: str = "id", order: tuple = ("timestamp",),
            buckets: int = BUCKETS) -> tuple[DataFrame, DataFrame]:
    """J2 against the store: (resolved rows, messages whose key is not stored, with ``reject_reason``)."""
    found = lookup(messages, path, key, order, buckets)
    missing = messages.join(found.select(key), key, "left_anti").withColumn(
        "reject_reason", F.concat(F.lit("unknown "), F.lit(key)))
    return messages.select(key).join(found, key), missing


def compact(spark: SparkSession, path: str, upto: int, key: str = "id", order: tuple = ("timestamp",),
            buckets: int = BUCKETS) -> None:
    """Merge the batches up to ``upto`` (and the base before) into a base with one row a key."""
    done = compacted_upto(spark, path)
    if done is not None and done >= upto:
        return
    parts = [spark.read.parquet(f"{path}/deltas").where(
        (F.col("batch_id") <= upto) & (F.col("batch_id") > (-1 if done is None else done))).drop("batch_id")]
    if done is not None:
        parts.append(spark.read.parquet(f"{path}/base/upto={done}"))
    merged = latest_per_key(reduce(DataFrame.unionByName, parts).drop("bucket"), key, [BATCH, *order])
    _save(merged, f"{path}/base/upto={int(upto)}", key, buckets)
    spark.range(1).select(F.lit(int(upto)).cast("bigint").alias("upto")).write.mode("append").parquet(
        f"{path}/compactions")
