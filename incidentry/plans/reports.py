"""Reports over logs, events and incidents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from incidentry.operators.filters import tags_overlap
from incidentry.sources.rules import DEFAULT_ETL_TAGS, DEFAULT_EVENT_TAGS


def route_of(tags: Column) -> Column:
    """Route of a tagged log = its first tag (rule order), ``untagged`` when none."""
    return F.coalesce(F.get(tags, 0), F.lit("untagged"))


def fan_out_counts(tagged: DataFrame) -> DataFrame:
    return tagged.groupBy(route_of(F.col("tags")).alias("route")).agg(F.count(F.lit(1)).alias("n"))


def fan_out_write(tagged: DataFrame, path: str, fmt: str = "parquet") -> None:
    """X1 sink: one folder per route (and per day), never one file per row."""
    (tagged.withColumn("route", route_of(F.col("tags")))
     .withColumn("date", F.to_date("timestamp"))
     .write.mode("append").partitionBy("route", "date").format(fmt).save(path))


def fan_in(*feeds: DataFrame) -> DataFrame:
    """Several feeds into one frame; columns missing in a feed become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), feeds)


def time_range(df: DataFrame, as_of, days: int, ts_col: str = "timestamp") -> DataFrame:
    """Rows in [as_of - days, as_of). On a table partitioned by date the bound prunes partitions."""
    end = F.lit(as_of).cast(df.schema[ts_col].dataType)
    return df.where((F.col(ts_col) >= end - F.make_dt_interval(days=F.lit(days))) & (F.col(ts_col) < end))


def latency_by_source(logs: DataFrame, exact: bool = False) -> DataFrame:
    """Processing latency = received_at - timestamp, in whole seconds, per source.

    ``exact`` uses Spark's exact percentile, whose buffer is a map of distinct values (bounded for second-grained
    latencies); otherwise percentile_approx."""
    lat = F.timestamp_diff("SECOND", F.col("timestamp"), F.col("received_at"))
    pct = (lambda c, p: F.percentile(c, p)) if exact else (lambda c, p: F.percentile_approx(c, p).cast("double"))
    return logs.withColumn("_lat", lat).groupBy("source").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("_lat").alias("avg_latency_s"),
        F.max("_lat").alias("max_latency_s"),
        pct(F.col("_lat"), 0.5).alias("p50_latency_s"),
        pct(F.col("_lat"), 0.95).alias("p95_latency_s"),
    )


def oldest_unprocessed_age(received: DataFrame, processed: DataFrame, as_of, key: str = "id",
                           ts_col: str = "timestamp") -> DataFrame:
    """Per source, how many received records have no processed counterpart yet and the age (seconds at
    ``as_of``) of the oldest of them. The anti-join is on the unique record id."""
    end = F.lit(as_of).cast(received.schema[ts_col].dataType)
    waiting = received.join(processed.select(key), key, "left_anti")
    return waiting.groupBy("source").agg(
        F.count(F.lit(1)).alias("unprocessed"),
        F.max(F.timestamp_diff("SECOND", F.col(ts_col), end)).alias("oldest_age_s"))


def stage_funnel(received: DataFrame, valid: DataFrame, tagged: DataFrame, incidents: DataFrame,
                 etl_tags=None, event_tags=None) -> DataFrame:
    """One row per stage (received, valid, tagged, passed, matched, incidents), each stage one pass."""
    etl = DEFAULT_ETL_TAGS if etl_tags is None else etl_tags
    ev = DEFAULT_EVENT_TAGS if event_tags is None else event_tags
    passed = tags_overlap(F.col("tags"), etl)
    t = tagged.agg(F.count_if(F.size("tags") > 0).alias("tagged"),
                   F.count_if(passed).alias("passed"),
                   F.count_if(passed & tags_overlap(F.col("tags"), ev)).alias("matched"))
    t = t.select(F.explode(F.array(*[F.struct(F.lit(c).alias("stage"), F.col(c).alias("n"))
                                     for c in ("tagged", "passed", "matched")])).alias("s")).select("s.*")
    parts = [received.agg(F.count(F.lit(1)).alias("n")).select(F.lit("received").alias("stage"), "n"),
             valid.agg(F.count(F.lit(1)).alias("n")).select(F.lit("valid").alias("stage"), "n"),
             t,
             incidents.agg(F.count(F.lit(1)).alias("n")).select(F.lit("incidents").alias("stage"), "n")]
    return reduce(DataFrame.unionByName, parts)


def funnel_in_one_pass(logs: DataFrame, stages: dict[str, Column], event: Column, high: Column, key: str,
                       order: list[str], threshold: int = 3, salts: int = 256) -> DataFrame:
    """X5 / A5 from one scan: one row (stage, n) for each of ``stages`` (conditions on a row) and for ``incidents``, the
    number of rows that ``instant_and_accumulated`` would raise for the rows where ``event`` holds.

    Of a key's events every ``high`` one raises an incident, and of the others all but those among its first
    ``threshold - 1`` in ``order``. So only a key's first events are needed beside the counts: each of ``salts`` parts of
    a key keeps its own first ones (at most ``threshold - 1``), and the key's are the first of these. A hot key is spread
    over ``salts`` tasks, and what meets in one row is at most ``salts * (threshold - 1)`` small structs.

    Edge cases: null conditions count as false; null keys are one key; rows that are not events raise nothing; an empty
    table gives every stage with 0."""
    def flag(condition):
        return F.coalesce(condition, F.lit(False))
    at = F.struct(*[F.col(c) for c in order])
    rows = logs.select(F.col(key).alias("k"), F.pmod(F.xxhash64(at), F.lit(salts)).alias("salt"), at.alias("at"),
                       flag(event).alias("event"), flag(high).alias("high"),
                       *[flag(c).alias(f"s_{name}") for name, c in stages.items()])
    first = Window.partitionBy("k", "salt").orderBy(F.col("event").desc(), "at")
    counts = {f"s_{name}": F.count_if(F.col(f"s_{name}")) for name in stages} | {"events": F.count_if("event")}
    early = F.collect_list(F.when(F.col("event") & (F.col("place") < threshold), F.struct("at", "high")))
    parts = rows.withColumn("place", F.row_number().over(first)).groupBy("k", "salt").agg(
        *[c.alias(n) for n, c in counts.items()], early.alias("early"))
    keys = parts.groupBy("k").agg(*[F.sum(n).alias(n) for n in counts],
                                  F.slice(F.array_sort(F.flatten(F.collect_list("early"))), 1, threshold - 1).alias("early"))
    quiet = F.size(F.filter("early", lambda e: ~e["high"]))
    sums = keys.agg(*[F.coalesce(F.sum(f"s_{name}"), F.lit(0)).alias(name) for name in stages],
                    F.coalesce(F.sum(F.col("events") - quiet), F.lit(0)).alias("incidents"))
    return sums.select(F.inline(F.array(*[F.struct(F.lit(n).alias("stage"), F.col(n).alias("n"))
                                          for n in [*stages, "incidents"]])))


def open_incidents(incidents: DataFrame) -> DataFrame:
    """Open incidents counted by rule and day."""
    return incidents.where(F.col("status") == "open") \
        .groupBy("rule", F.to_date("timestamp").alias("day")).agg(F.count(F.lit(1)).alias("n"))


def stream_backlog(queries: list[StreamingQuery]) -> list[dict]:
    """Per source of each running stream, the offsets it has processed against the latest available.

    Reads the queries' progress objects (no service is contacted); returns small dicts the caller can turn into a
    DataFrame."""
    out = []
    for q in queries:
        prog = q.lastProgress or {}
        for src in prog.get("sources", []):
            out.append({"query": q.name, "source": src.get("description"), "end_offset": str(src.get("endOffset")),
                        "latest_offset": str(src.get("latestOffset")),
                        "input_rows": src.get("numInputRows")})
    return out


def watermark_report(query: StreamingQuery) -> list[dict]:
    """Per micro-batch, the input rows, the event-time watermark in force and the late-row counter of the stateful
    operators (Spark fills that counter for some operators only; windowed aggregations filter late rows before it,
    so compare the output with the input to measure what a window aggregation dropped)."""
    out = []
    for prog in query.recentProgress or []:
        ops = prog.stateOperators or []
        out.append({"batch_id": prog.batchId, "input_rows": prog.numInputRows,
                    "watermark": (prog.eventTime or {}).get("watermark"),
                    "dropped_by_operator": sum(int(o.numRowsDroppedByWatermark or 0) for o in ops)})
    return out
