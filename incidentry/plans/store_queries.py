"""Registered queries of the rules at scale, the keyed store, the rollups and the history reads (see ``plans.registry``)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from incidentry.functions import iso_format, parse_event_time, to_json_iso
from incidentry.operators import products as prod
from incidentry.operators.normalize import normalize_logs, parse_json_logs
from incidentry.operators.tagging import tag_logs
from incidentry.plans import rollups
from incidentry.plans.history import requested_rows
from incidentry.plans.registry import _PRODUCTS_SQL, register
from incidentry.session import scratch_path
from incidentry.sources import keyed_store, stores
from incidentry.sources.driver_views import LOG_VIEW_SQL, log_view, logs_from_events, products_view, submissions_view
from incidentry.sources.tables import read_table
from incidentry.streaming import backlog, jobs
from incidentry.streaming.changes import stream_changes


def benchmark_rules(spark, sf_dir):
    """A rules table of some hundred keywords: one rule per benchmark item, its words of six letters and more."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{6,})"), F.lit(1))
    return read_table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("rule_order"), F.concat(F.lit("item-"), F.col("item_id")).alias("tag"),
        words.alias("keywords"))


@register("tag_documents_many_rules", """WITH words AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z]{6,}')) AS word FROM benchmark),
hits AS (SELECT DISTINCT doc_id, item_id FROM documents JOIN words ON contains(lower(text), word))
SELECT d.doc_id, COALESCE(t.tags, '') AS tags FROM documents d LEFT JOIN (
    SELECT doc_id, string_agg('item-' || item_id, ',' ORDER BY item_id) AS tags FROM hits GROUP BY doc_id) t
ON d.doc_id = t.doc_id""")
def q_tag_documents_many_rules(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return tag_logs(docs, benchmark_rules(spark, sf_dir), text_col="text").select(
        "doc_id", F.array_join("tags", ",").alias("tags"))


@register("keyed_store_lookup", """WITH asked AS (
    SELECT user_id FROM events WHERE event_type = 'signup' GROUP BY user_id HAVING count(*) >= 12)
SELECT user_id, event_id, ts, event_type FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
    FROM events WHERE user_id IN (SELECT user_id FROM asked)) WHERE rn = 1""")
def q_keyed_store_lookup(spark, sf_dir):
    """The events go into a store by user as four batches in time order, two of them compacted; then the
    users of many signups are looked up."""
    ev = read_table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    path, order, buckets = scratch_path(spark, "keyed-store"), ("ts", "event_id"), 8
    ends = ["2024-01-08", "2024-01-15", "2024-01-22", "9999-01-01"]
    for i, (start, end) in enumerate(zip(["0001-01-01", *ends], ends, strict=False)):
        batch = ev.where((F.col("ts") >= F.lit(start).cast("timestamp_ntz")) &
                         (F.col("ts") < F.lit(end).cast("timestamp_ntz")))
        keyed_store.write_batch(batch, path, i, "user_id", order, buckets)
    keyed_store.compact(spark, path, 1, "user_id", order, buckets)
    asked = ev.where("event_type = 'signup'").groupBy("user_id").count().where("count >= 12")
    return keyed_store.lookup(asked, path, "user_id", order, buckets).select("user_id", "event_id", "ts", "event_type")


@register("latency_rollup_by_source", f"""WITH lat AS (
    SELECT lower(trim(source)) AS source, CASE WHEN event_id % 50 = 0 THEN '' ELSE lower(message) END AS message, user_id,
           event_id % 7 AS l FROM ({LOG_VIEW_SQL}))
SELECT source, count(*) AS n, count(*) FILTER (contains(message, 'error')) AS errors, avg(l) AS avg_latency_s,
       max(l) AS latency_max_s, quantile_disc(l, 0.5) AS p50_s, quantile_disc(l, 0.5) AS p50_low_s,
       quantile_disc(l, 0.5) AS p50_high_s, quantile_disc(l, 0.95) AS p95_s, quantile_disc(l, 0.95) AS p95_low_s,
       quantile_disc(l, 0.95) AS p95_high_s, count(DISTINCT user_id) AS users FROM lat GROUP BY source""")
def q_latency_rollup_by_source(spark, sf_dir):
    """X4 from stored daily rollups, written in two batches. Latencies are whole seconds, so their quantiles one rank error
    apart are equal."""
    daily = rollups.daily_rollup(normalize_logs(submissions_view(spark, sf_dir)))
    path = scratch_path(spark, "rollup")
    rollups.write_rollup(daily.where("day < '2024-01-16'"), path, 0)
    rollups.write_rollup(daily.where("day >= '2024-01-16'"), path, 1)
    return rollups.latency_report(spark.read.parquet(path))


@register("history_by_request", """WITH asked AS (
    SELECT n_name AS consumer, TIMESTAMP '2024-01-05 00:00:00' + to_days(CAST(n_nationkey AS INTEGER)) AS as_of,
           n_nationkey % 4 AS days FROM nation)
SELECT consumer, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts
FROM events JOIN asked ON ts < as_of AND ts >= as_of - to_days(CAST(days AS INTEGER)) WHERE days > 0 GROUP BY consumer""")
def q_history_by_request(spark, sf_dir):
    """Every nation asks the day-partitioned history of events for some days before a time of its own."""
    path = scratch_path(spark, "history")
    stores.append_history(read_table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("timestamp")), path)
    start = F.lit("2024-01-05 00:00:00").cast("timestamp_ntz")
    key = F.col("n_nationkey").cast("int")
    asked = read_table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("consumer"), (start + F.make_dt_interval(days=key)).alias("as_of"), (key % 4).alias("days"))
    return requested_rows(spark.read.parquet(path), asked).groupBy("consumer").agg(
        F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"))


@register("stream_latest_per_user", """SELECT user_id, event_id, ts, event_type FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def q_stream_latest_per_user(spark, sf_dir):
    """T5 / S8 as a stream: the change feed of events by user over several micro-batches; a user's last change is the state."""
    ev = jobs.replayed(read_table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type"),
                       ["ts", "event_id"], 4).where("event_id IS NOT NULL")
    feed = jobs.run_and_read(stream_changes(ev, "user_id", "ts", "event_id"), latest_key=["user_id"])
    rows = feed.select("user_id", F.from_json("after", "event_id long, ts timestamp_ntz, event_type string").alias("a"))
    return rows.select("user_id", "a.event_id", "a.ts", "a.event_type")


#: The waves of a replay: events up to each day, the last one open.
WAVES = ["2024-01-08", "2024-01-15", "2024-01-22", "9999-01-01"]


@register("stream_backlog", """WITH waves AS (SELECT unnest([0, 1, 2, 3]) AS trigger),
e AS (SELECT CASE WHEN ts < '2024-01-08' THEN 0 WHEN ts < '2024-01-15' THEN 1 WHEN ts < '2024-01-22' THEN 2 ELSE 3 END AS wave
      FROM events)
SELECT CAST(trigger AS BIGINT) AS trigger, 'logOffset' AS partition, CAST(trigger AS BIGINT) AS end_offset,
       CAST(3 - trigger AS BIGINT) AS lag, CASE WHEN trigger > 0 THEN CAST(1 AS BIGINT) END AS drained,
       count(wave) FILTER (wave = trigger) AS input_rows, count(wave) FILTER (wave > trigger) AS rows_waiting
FROM waves LEFT JOIN e ON true GROUP BY trigger""")
def q_stream_backlog(spark, sf_dir):
    """The events arrive as four files and are tagged one file a trigger; the listener's table gives the lag."""
    ev = read_table(spark, sf_dir, "events")
    feed, out, table = (scratch_path(spark, kind) for kind in ("waves", "tagged", "progress"))
    for start, end in zip(["0001-01-01", *WAVES], WAVES, strict=False):
        ev.where((F.col("ts") >= F.lit(start).cast("timestamp_ntz")) &
                 (F.col("ts") < F.lit(end).cast("timestamp_ntz"))).coalesce(1).write.mode("append").parquet(feed)
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", "1").parquet(feed)
    tagged = tag_logs(normalize_logs(logs_from_events(stream))).select("id", "tags")
    listener = backlog.ProgressTable(spark, table)
    spark.streams.addListener(listener)
    try:
        query = jobs.run_to_table(tagged, out, query_name="tagging")
        query.awaitTermination()
        if not listener.wait_for(query):
            raise TimeoutError("the progress of the stream was not written")
    finally:
        spark.streams.removeListener(listener)
    found = backlog.backlog(backlog.offsets(backlog.read_progress(spark, table)))
    later = Window.partitionBy("query_id", "source", "partition").orderBy("trigger").rowsBetween(
        1, Window.unboundedFollowing)
    return found.select("trigger", "partition", "end_offset", "lag", "drained", "input_rows",
                        F.coalesce(F.sum("input_rows").over(later), F.lit(0)).alias("rows_waiting"))


@register("json_logs", f"""SELECT event_id, CASE WHEN event_id % 50 <> 0 THEN id END AS id,
       CASE WHEN event_id % 50 = 0 THEN NULL WHEN event_id % 7 = 0 THEN TIMESTAMP '1970-01-01 00:00:00' ELSE timestamp END
       AS event_time, CASE WHEN event_id % 50 <> 0 THEN source END AS source,
       CASE WHEN event_id % 50 <> 0 THEN message END AS message,
       CASE WHEN event_id % 50 <> 0 THEN CAST(user_id AS VARCHAR) END AS ip,
       CASE WHEN event_id % 50 = 0 THEN 'malformed json' END AS reject_reason
FROM ({LOG_VIEW_SQL})""")
def q_json_logs(spark, sf_dir):
    """Logs as JSON text and back; every 50th text is cut off, the time of every 7th is no time."""
    logs = log_view(spark, sf_dir)
    time = F.when(F.col("event_id") % 7 == 0, F.lit("some day")).otherwise(iso_format("timestamp"))
    text = to_json_iso(F.struct("id", time.alias("timestamp"), "source", "message", "metadata"))
    lines = logs.select("event_id", F.when(F.col("event_id") % 50 == 0, F.left(text, F.length(text) - 5))
                        .otherwise(text).alias("value"))
    good, bad = parse_json_logs(lines)
    kept = good.select("event_id", "id", parse_event_time("timestamp").cast("timestamp_ntz").alias("event_time"), "source",
                       "message", F.col("metadata")["ip"].alias("ip"), F.lit(None).cast("string").alias("reject_reason"))
    return kept.unionByName(bad.select("event_id", "reject_reason"), allowMissingColumns=True)


@register("seed_products_if_empty", f"""WITH {_PRODUCTS_SQL},
seed AS (SELECT * FROM (VALUES ('p1', 'Keyboard', 49.99), ('p2', 'Monitor', 199.00), ('p3', 'Mouse', 24.50)) t(id, name, price))
SELECT 'filled' AS table_name, id, name, CAST(price AS DOUBLE) AS price FROM products
UNION ALL SELECT 'empty', id, name, CAST(price AS DOUBLE) FROM seed""")
def q_seed_products_if_empty(spark, sf_dir):
    """A4: the seeds go into a table without rows only."""
    filled = products_view(spark, sf_dir)
    tables = {"filled": filled, "empty": filled.where("price < 0")}
    seeded = [prod.seed_products(t, prod.seed_rows(spark), only_if_empty=True)
              .select(F.lit(name).alias("table_name"), "id", "name", F.col("price").cast("double").alias("price"))
              for name, t in tables.items()]
    return seeded[0].unionByName(seeded[1])
