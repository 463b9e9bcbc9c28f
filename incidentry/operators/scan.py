"""Ordered per-key scans that do not gather a key into one task.

A running aggregate over ``Window.partitionBy(key).orderBy(ts)`` sorts each key inside a single task; with one key
holding a third of the rows that task would hold a third of the data. Here the rows, in (key, order) order, are cut into
ranges of about equal *row count*, so neither a hot key, nor a burst of one key within a microsecond, nor a row at the
epoch among later ones makes a range large:

1. bounds: the quantiles of a uniform sample of (key, order) values, the ``SAMPLE_PER_RANGE * ranges`` of the smallest
   hashes (a distributed top-k), as one array;
2. rows: each row finds its range by bisection on the bounds and is shuffled once, straight to the partition of that
   number; a window over (range, key) gives the local running value without moving rows again;
3. carry: a key goes on from one range into the next only if it is the key of the bound between them, so the state
   that crosses ranges is one composable entry per (range, such key) — sum, whether it resets, sum after the last
   reset, first and last time; at most two entries a range. A window per key over those entries gives what flows into
   each range, as one array with an entry per range;
4. a row adds its range's carry if its key is the one that was cut there and nothing has reset since.

Bounds and carry are scalar subqueries of the one plan: no job runs while the DataFrame is built, nothing is
checkpointed, and no join touches the rows. The ``order`` columns should be total; equal rows share a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from incidentry.functions import epoch_micros

#: Sampled rows per range: a range's size is then within a few tens of percent of the mean.
SAMPLE_PER_RANGE = 64


def range_bounds(df: DataFrame, columns: list[str], ranges: int) -> DataFrame:
    """One row, one column ``bounds``: ``ranges - 1`` ascending structs of ``columns`` that cut ``df`` into ranges of
    about equal row count (an empty array for an empty table)."""
    sample = df.select(F.struct(*columns).alias("b")).orderBy(F.xxhash64("b"), "b").limit(SAMPLE_PER_RANGE * ranges)
    picked = sample.agg(F.array_sort(F.collect_list("b")).alias("s"))
    cut = F.transform(F.sequence(F.lit(1), F.lit(ranges - 1)),
                      lambda i: F.get("s", F.floor(i * F.size("s") / F.lit(ranges)).cast("int")))
    return picked.select(F.when(F.size("s") > 0, cut).otherwise(F.slice("s", 1, 0)).alias("bounds"))


def with_range(df: DataFrame, columns: list[str], ranges: int, into: str = "_p") -> DataFrame:
    """``df`` with the number of the range (0 to ``ranges - 1``) of each row in ``into``, and whether the row's first
    column is the key cut at its range's lower (``_from``) or upper (``_onto``) bound."""
    if ranges < 2:
        return df.withColumns({into: F.lit(0), "_from": F.lit(False), "_onto": F.lit(False)})
    found = df.withColumns({"_bounds": range_bounds(df, columns, ranges).scalar(), "_x": F.struct(*columns),
                            into: F.lit(0)})
    step = 1 << ((ranges - 1).bit_length() - 1)
    while step:  # bisection, unrolled: each step is a projection of the same stage
        reached = F.get("_bounds", F.col(into) + F.lit(step - 1)) <= F.col("_x")
        found = found.withColumn(into, F.col(into) + F.when(reached, F.lit(step)).otherwise(F.lit(0)))
        step //= 2
    # a value the optimizer must not copy: a filter on these flags would otherwise be pushed below the bisection with all
    # of its steps written out once more in each
    key, settled = F.col(columns[0]), F.spark_partition_id() >= 0

    def cut_at(bound: Column) -> Column:
        return settled & bound.isNotNull() & key.eqNullSafe(bound.getField(columns[0]))

    lower = F.when(F.col(into) > 0, F.get("_bounds", F.col(into) - F.lit(1)))
    found = found.withColumns({"_from": cut_at(lower), "_onto": cut_at(F.get("_bounds", F.col(into)))})
    return found.drop("_bounds", "_x")


def segmented_running_sum(df: DataFrame, key: str, order: list[str], value: Column, out: str,
                          reset: Column | None = None, gap_micros: int | None = None,
                          ranges: int | None = None) -> DataFrame:
    """Running sum of ``value`` per ``key`` in ``order`` (order[0] is the timestamp), restarting at reset rows.

    A row restarts the sum (its own value included) when ``reset`` is true, or — with ``gap_micros`` — when it comes
    ``gap_micros`` or more after the key's previous row. Without resets this is a plain running sum. ``ranges``
    defaults to ``spark.sql.shuffle.partitions``. A null key is a key of its own."""
    if ranges is None:
        ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    resets = reset is not None or gap_micros is not None
    ranged = with_range(df.withColumns({
        "_v": value.cast("bigint"),
        "_r": F.coalesce(reset, F.lit(False)) if reset is not None else F.lit(False),
    }), [key, *order], ranges)

    rows = _local_sums(ranged.repartitionById(ranges, "_p"), key, order, gap_micros)
    local = F.col("_cum") - F.coalesce(F.col("_before"), F.lit(0))
    if ranges < 2:
        return rows.select(*df.columns, local.alias(out))

    # what crosses ranges: one entry per range and cut key, from those keys' rows alone
    edge = ranged.where("_from OR _onto").select(F.col(key).alias("_k"), *[F.col(c).alias(f"_o{i}")
                                                                           for i, c in enumerate(order)],
                                                 "_v", "_r", "_p", "_from")
    names = [f"_o{i}" for i in range(len(order))]
    if resets:
        edge = _local_sums(edge.repartitionById(ranges, "_p"), "_k", names, gap_micros)
        entries = edge.groupBy("_p", "_k", "_from").agg(
            F.sum("_v").alias("_total"), F.max("_R").alias("_any"),
            F.max_by(F.col("_cum") - F.coalesce(F.col("_before"), F.lit(0)), F.struct(*names)).alias("_end"),
            F.min(epoch_micros("_o0")).alias("_first"), F.max(epoch_micros("_o0")).alias("_last"))
    else:
        entries = edge.groupBy("_p", "_k", "_from").agg(F.sum("_v").alias("_total"))
    carry = _carry(entries, resets, gap_micros)
    rows = rows.withColumn("_in", F.get(carry.scalar(), F.col("_p")))
    flows = F.col("_from") & F.col("_in").isNotNull()
    if resets:
        flows = flows & (F.col("_nres") == 0) & ~F.coalesce(F.col("_in._gap"), F.lit(False))
    return rows.select(*df.columns, (local + F.when(flows, F.coalesce(F.col("_in._carry"), F.lit(0)))
                                     .otherwise(F.lit(0))).alias(out))


def _local_sums(rows: DataFrame, key: str, order: list[str], gap_micros: int | None) -> DataFrame:
    """Per (range, key) in order: running sum ``_cum``, restarts so far ``_nres``, whether the row restarts ``_R`` and
    the running sum just before the latest restart ``_before`` (null while there was none)."""
    by = Window.partitionBy("_p", key).orderBy(*order)
    so_far = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    restarts = F.col("_r")
    if gap_micros is not None:
        us, before = epoch_micros(order[0]), F.lag(epoch_micros(order[0])).over(by)
        restarts = restarts | (before.isNotNull() & ((us - before) >= F.lit(gap_micros)))
    rows = rows.withColumns({"_R": restarts, "_cum": F.sum("_v").over(so_far)})
    return rows.withColumns({
        "_nres": F.sum(F.col("_R").cast("int")).over(so_far),
        "_before": F.last(F.when(F.col("_R"), F.col("_cum") - F.col("_v")), ignorenulls=True).over(so_far)})


def _carry(entries: DataFrame, resets: bool, gap_micros: int | None) -> DataFrame:
    """One row, one column: an array with, per range, what flows into it (``_carry``, and ``_gap``: the time before it
    ends it), or null; ranges behind the last entry are left out. ``entries`` are at most two a range."""
    by_key = Window.partitionBy("_k").orderBy("_p")
    before = by_key.rowsBetween(Window.unboundedPreceding, -1)
    entries = entries.withColumn("_sum", F.coalesce(F.sum("_total").over(before), F.lit(0)))
    if not resets:
        state = entries.withColumns({"_carry": F.col("_sum"), "_gap": F.lit(False)})
    else:
        gap = F.lit(False)
        if gap_micros is not None:
            last = F.lag("_last").over(by_key)
            gap = last.isNotNull() & ((F.col("_first") - last) >= F.lit(gap_micros))
        entries = entries.withColumn("_gap", gap)
        # sum at a range's end, less all sums up to there: what a later range adds its earlier sums to
        ended = F.when(F.col("_any") | F.col("_gap"), F.col("_end") - F.col("_sum") - F.col("_total"))
        state = entries.withColumn("_ended", ended)
        since = F.last("_ended", ignorenulls=True).over(before)
        state = state.withColumn("_carry", F.col("_sum") + F.coalesce(since, F.lit(0)))
    found = state.where("_from").agg(F.array_sort(F.collect_list(
        F.struct("_p", F.struct("_carry", "_gap").alias("_in")))).alias("s"))
    # nulls for the ranges between two entries, so that an entry stands at its range's number
    return found.select(F.flatten(F.transform("s", lambda x, i: F.concat(
        F.array_repeat(F.lit(None).cast("struct<_carry:bigint,_gap:boolean>"),
                       x["_p"] - F.coalesce(F.get("s", i - 1)["_p"], F.lit(-1)) - 1),
        F.array(x["_in"])))).alias("carry"))
