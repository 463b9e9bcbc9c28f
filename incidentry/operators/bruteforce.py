"""Brute-force detector.

Rule, per key (the ``ip`` of the event metadata), over ``login_failed`` events in arrival order (ts, id): drop buffered
events whose age is ``window`` or more, append the event, and when the buffer holds ``threshold`` events raise one
incident with all of them and empty the buffer.

The emptying makes this a fold along the whole history of a key. Written with positions it needs no row-by-row fold:

* an event is a *candidate* if its (threshold-1)-th predecessor lies within the window (a ``lag``);
* the events that fire are the greedy choice of candidates at least ``threshold`` positions apart, for after a fire the
  buffer holds only events behind it.

Positions come from the ordered scan (hot keys spread by row count) and are cut into buckets of ``bucket`` positions, each
with the ``threshold - 1`` events before it. What a bucket hands on is the first position that may fire again, one of
``threshold`` offsets; so a bucket is a table of ``threshold`` exits, tables compose, and a bucket without candidates
hands on 0. Buckets compose to groups of ``GROUP_BUCKETS``, groups are chained per key, and the entries go down the
same way: the longest list in one row is a key's groups (one per ``bucket * GROUP_BUCKETS`` events). Everything is
DataFrame functions; no chunk of a key's history lies in one task, however dense its events are.

Events without a key are not folded together (the reference would put them all under one ``None`` key); they are
returned separately for quarantine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from incidentry.functions import det_id, epoch_micros
from incidentry.operators.scan import segmented_running_sum
from incidentry.constants import (BRUTE_FORCE_OWNER, BRUTE_FORCE_SUMMARY_MIDDLE, BRUTE_FORCE_SUMMARY_PREFIX,
                                  BRUTE_FORCE_THRESHOLD, BRUTE_FORCE_WINDOW_SECONDS, FAILED_LOGIN_TYPE,
                                  STATUS_OPEN)

DEFAULT_WINDOW_SECONDS = BRUTE_FORCE_WINDOW_SECONDS
DEFAULT_THRESHOLD = BRUTE_FORCE_THRESHOLD
SUMMARY_PREFIX = BRUTE_FORCE_SUMMARY_PREFIX
SUMMARY_MIDDLE = BRUTE_FORCE_SUMMARY_MIDDLE
OWNER = BRUTE_FORCE_OWNER
RULE = "brute_force"  # our rule label (not a reference value)

#: Positions of a bucket, and buckets of a group.
BUCKET_POSITIONS, GROUP_BUCKETS = 4096, 4096


def brute_force_incidents(events: DataFrame, window_seconds: int = DEFAULT_WINDOW_SECONDS,
                          threshold: int = DEFAULT_THRESHOLD, event_type: str | None = FAILED_LOGIN_TYPE,
                          key: Column | None = None, bucket: int = BUCKET_POSITIONS, group: int = GROUP_BUCKETS,
                          ranges: int | None = None):
    """T3 → (incidents, quarantined events: without a key or without a time).

    ``events``: id, timestamp, type, metadata (the key defaults to metadata['ip']). Incidents carry all buffered
    event ids in arrival order, owner ``auto-assigned`` and the summary of the reference. ``bucket`` (at least the
    threshold), ``group`` and ``ranges`` say how the history is cut; they do not change the result."""
    k = int(threshold)
    bucket = max(int(bucket), k)
    key = key if key is not None else F.col("metadata")["ip"]
    ev = events if event_type is None else events.where(F.col("type") == event_type)
    ev = ev.select(F.col("id").cast("string").alias("id"), F.col("timestamp"), key.cast("string").alias("key"))
    lacking = F.col("key").isNull() | F.col("timestamp").isNull()
    quarantine = ev.where(lacking)
    placed = segmented_running_sum(ev.where(~lacking), "key", ["timestamp", "id"], F.lit(1), "_n", ranges=ranges)
    placed = placed.select("key", "timestamp", "id", (F.col("_n") - 1).alias("pos"))

    fires = greedy_fires(candidates(placed, k, int(window_seconds) * 1_000_000, bucket), k, bucket, group)
    # the fire's events are the `threshold` positions that end at it
    members = fires.select("key", F.col("pos").alias("fire"),
                           F.explode(F.sequence(F.col("pos") - (k - 1), F.col("pos"))).alias("pos"))
    inc = (placed.join(members, ["key", "pos"]).groupBy("key", "fire")
           .agg(F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("m"), F.max("timestamp").alias("timestamp"))
           .withColumn("ids", F.col("m.id")).withColumn("trigger_id", F.element_at("ids", -1)))
    summary = F.concat(F.lit(SUMMARY_PREFIX), F.size("ids").cast("string"), F.lit(SUMMARY_MIDDLE), F.col("key"))
    incidents = inc.select(
        det_id(f"incident:{RULE}", "trigger_id").alias("id"),
        "timestamp",
        F.col("ids").alias("events"),
        F.lit(STATUS_OPEN).alias("status"),
        summary.alias("summary"),
        F.lit(OWNER).alias("owner"),
        F.lit(RULE).alias("rule"),
        F.col("trigger_id").alias("event_id"),
        "key",
    )
    return incidents, quarantine


def candidates(placed: DataFrame, threshold: int, window_us: int, bucket: int) -> DataFrame:
    """(key, bucket, offsets): the sorted offsets within each bucket of positions of the events whose
    (threshold-1)-th predecessor is less than ``window_us`` older; buckets without any are left out."""
    own = F.floor(F.col("pos") / F.lit(bucket)).cast("bigint")
    halo = F.pmod(F.col("pos"), F.lit(bucket)) >= F.lit(bucket - (threshold - 1))
    rows = placed.select("key", "pos", epoch_micros("timestamp").alias("us"),
                         F.explode(F.when(halo, F.array(own, own + 1)).otherwise(F.array(own))).alias("bucket"))
    by = Window.partitionBy("key", "bucket").orderBy("pos")
    oldest = F.lag("us", threshold - 1).over(by) if threshold > 1 else F.col("us")
    rows = rows.withColumn("oldest", oldest).where(
        (own == F.col("bucket")) & ((F.col("us") - F.col("oldest")) < F.lit(window_us)))
    return rows.groupBy("key", "bucket").agg(
        F.array_sort(F.collect_list(F.pmod(F.col("pos"), F.lit(bucket)).cast("int"))).alias("offsets"))


def greedy_fires(cands: DataFrame, threshold: int, bucket: int, group: int) -> DataFrame:
    """(key, pos) of the greedy choice of candidates at least ``threshold`` positions apart."""
    entries_of_all = F.sequence(F.lit(0), F.lit(threshold - 1))

    def leave(free: Column, at: Column) -> Column:
        return F.when(at >= free, at + F.lit(threshold)).otherwise(free)

    # exit of a bucket for each entry: the first offset of the next bucket that may fire
    tables = cands.select(
        "key", F.floor(F.col("bucket") / F.lit(group)).cast("bigint").alias("grp"), "bucket",
        F.transform(entries_of_all, lambda e: F.aggregate(
            "offsets", e, leave, lambda free: F.greatest(free - F.lit(bucket), F.lit(0)))).alias("exits"))
    groups = tables.groupBy("key", "grp").agg(F.array_sort(F.collect_list(F.struct("bucket", "exits"))).alias("tables"))

    def through(at: str, end: Column | None):
        """Fold step and finish over a sorted list of (number, exits): after a hole the entry is 0."""
        def step(acc: Column, x: Column) -> Column:
            entry = F.when(x[at] == acc["next"], acc["free"]).otherwise(F.lit(0))
            return F.struct((x[at] + 1).alias("next"), F.get(x["exits"], entry).alias("free"))
        return step, lambda acc: F.when(acc["next"] == end, acc["free"]).otherwise(F.lit(0))

    step, finish = through("bucket", (F.col("grp") + 1) * F.lit(group))
    start = F.col("grp") * F.lit(group)
    group_tables = groups.select("key", "grp", F.transform(entries_of_all, lambda e: F.aggregate(
        "tables", F.struct(start.alias("next"), e.alias("free")), step, finish)).alias("exits"))
    chains = group_tables.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("grp", "exits"))).alias("list"))

    def entered(items: str, at: str, first: Column, free: Column) -> Column:
        """The entry of each item of a sorted list, as (number, entry) structs."""
        none = F.array().cast(f"array<struct<{at}:bigint,entry:int>>")

        def walk(acc: Column, x: Column) -> Column:
            entry = F.when(x[at] == acc["next"], acc["free"]).otherwise(F.lit(0))
            told = F.array(F.struct(x[at].alias(at), entry.alias("entry")))
            return F.struct((x[at] + 1).alias("next"), F.get(x["exits"], entry).alias("free"),
                            F.concat(acc["told"], told).alias("told"))
        return F.aggregate(items, F.struct(first.alias("next"), free.alias("free"), none.alias("told")), walk,
                           lambda acc: acc["told"])

    by_group = chains.select("key", F.inline(entered("list", "grp", F.lit(0).cast("bigint"), F.lit(0))))
    by_bucket = groups.join(by_group, ["key", "grp"]).select(
        "key", F.inline(entered("tables", "bucket", start, F.col("entry"))))
    found = cands.join(by_bucket, ["key", "bucket"])
    none = F.array().cast("array<int>")

    def fire(acc: Column, at: Column) -> Column:
        fires = at >= acc["free"]
        return F.struct(F.when(fires, at + F.lit(threshold)).otherwise(acc["free"]).alias("free"),
                        F.when(fires, F.concat(acc["fired"], F.array(at))).otherwise(acc["fired"]).alias("fired"))

    fired = F.aggregate("offsets", F.struct(F.col("entry").alias("free"), none.alias("fired")), fire,
                        lambda acc: acc["fired"])
    return found.select("key", "bucket", F.explode(fired).alias("at")).select(
        "key", (F.col("bucket") * F.lit(bucket) + F.col("at")).alias("pos"))
