"""Multi-pattern tagging, keyed store, rollups, history reads and the change feed."""

import random

from pyspark.sql import functions as F

from conftest import SF_MID, SF_SMALL, rows
from incidentry.operators.multimatch import tags_by_automaton
from incidentry.operators.tagging import tag_logs, tags_by_rules
from incidentry.plans import rollups
from incidentry.plans.history import requested_rows
from incidentry.session import scratch_path
from incidentry.sources import keyed_store, stores
from incidentry.sources.tables import read_table
from incidentry.streaming import jobs
from incidentry.streaming.changes import stream_changes


def test_automaton_gives_the_tags_of_single_tests(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("abAB é\nİß") for _ in range(rng.randint(0, 40))) for _ in range(300)] + [None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, message string")
    rules = [(f"t{i}", ["".join(rng.choice("abAé İß") for _ in range(rng.randint(1, 4))) for _ in range(3)])
             for i in range(60)] + [("t1", ["AB"]), ("none", []), ("any", [""])]
    assert rows(df.select("id", tags_by_automaton(F.col("message"), rules).alias("tags"))) == rows(
        df.select("id", tags_by_rules(F.col("message"), rules).alias("tags")))
    for few in ([], [("none", [])], [("any", [""])]):
        assert rows(df.select("id", tags_by_automaton(F.col("message"), few).alias("tags"))) == rows(
            df.select("id", tags_by_rules(F.col("message"), few).alias("tags")))


def test_many_rules_take_the_automaton(spark):
    docs = read_table(spark, SF_SMALL, "documents").select("doc_id", "text")
    rules = [(f"r{i}", [f"needle{i}", "the" if i == 7 else f"pin{i}"]) for i in range(5000)]
    tagged = tag_logs(docs, rules, text_col="text")
    assert "ArrowEvalPython" in tagged._jdf.queryExecution().toString()
    want = docs.where(F.contains(F.lower("text"), F.lit("the"))).count()
    assert tagged.where(F.array_contains("tags", "r7")).count() == want > 0
    assert tagged.where(F.size("tags") > 1).count() == 0


def _batches(spark, path, order=("ts",)):
    for i in range(4):
        df = spark.range(200).where(f"id % 4 >= {i}").select(
            F.col("id").cast("string").alias("id"), F.lit(i).alias("ts"), F.lit(f"v{i}").alias("v"))
        keyed_store.write_batch(df, path, i, order=order, buckets=8)


def test_keyed_store_lookup_compaction_and_rerun(spark):
    path = scratch_path(spark, "store-test")
    _batches(spark, path)
    order = ("ts",)
    want = sorted((str(i), i % 4, f"v{i % 4}") for i in range(200))
    assert rows(keyed_store.read_latest(spark, path, order=order), "id", "ts", "v") == want
    keys = spark.createDataFrame([("5",), ("5",), ("7",), (None,), ("nowhere",)], "id string")
    for upto in (None, 1, 2):
        if upto is not None:
            keyed_store.compact(spark, path, upto, order=order, buckets=8)
            assert keyed_store.compacted_upto(spark, path) == upto
        got = keyed_store.lookup(keys, path, order=order, buckets=8)
        assert rows(got, "id", "v") == [("5", "v1"), ("7", "v3")]
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "bucket#" in plan.split("PartitionFilters:")[1][:200]
        resolved, missing = keyed_store.resolve(keys, path, order=order, buckets=8)
        assert sorted(r.id for r in resolved.collect()) == ["5", "5", "7"]
        assert sorted(str(r.id) for r in missing.collect()) == ["None", "nowhere"]
        assert rows(keyed_store.read_latest(spark, path, order=order), "id", "ts", "v") == want
    copies = keyed_store.stored_rows(spark, path).count()
    assert copies == 200 + 50  # one copy a key in the base, and the batch after it
    _batches(spark, path)  # a rerun of every batch changes nothing
    assert keyed_store.stored_rows(spark, path).count() == copies
    assert rows(keyed_store.read_latest(spark, path, order=order), "id", "ts", "v") == want
    # a rerun with fewer rows leaves none of the batch's earlier ones
    keyed_store.write_batch(spark.createDataFrame([("3", 3, "again")], "id string, ts int, v string"), path, 3,
                            order=order, buckets=8)
    got = {r.id: r.v for r in keyed_store.read_latest(spark, path, order=order).collect()}
    assert got["3"] == "again" and got["7"] == "v2" and len(got) == 200


def test_rollups_merge_within_their_bounds(spark):
    logs = spark.range(60000).select(
        F.concat(F.lit("s"), F.col("id") % 2).alias("source"), F.lit("an ERROR").alias("message"),
        F.timestamp_add("HOUR", (F.col("id") % 240).cast("int"), F.lit("2024-01-01").cast("timestamp_ntz")).alias("timestamp"),
        (F.pmod(F.xxhash64("id"), 5000)).alias("user_id"), (F.pmod(F.xxhash64("id", F.lit(1)), 100000)).alias("lat"))
    logs = logs.withColumn("received_at", F.timestamp_add("SECOND", F.col("lat").cast("int"), F.col("timestamp")))
    path = scratch_path(spark, "rollup-test")
    daily = rollups.daily_rollup(logs)
    for attempt in range(2):  # the second is a rerun
        rollups.write_rollup(daily.where("source = 's0'"), path, 0)
        rollups.write_rollup(daily.where("source = 's1'"), path, 1)
    stored = spark.read.parquet(path)
    assert stored.count() == 20
    exact = {r.source: r for r in logs.groupBy("source").agg(
        F.percentile("lat", F.array(F.lit(0.5), F.lit(0.95))).alias("p"), F.avg("lat").alias("avg"),
        F.countDistinct("user_id").alias("users")).collect()}
    for r in rollups.latency_report(stored).collect():
        e = exact[r.source]
        assert r.n == r.errors == 30000 and abs(r.avg_latency_s - e.avg) < 1e-6
        assert r.p50_low_s <= e.p[0] <= r.p50_high_s and r.p95_low_s <= e.p[1] <= r.p95_high_s
        assert r.p50_high_s - r.p50_low_s < 3000 and abs(r.users - e.users) < 0.1 * e.users
    empty = rollups.daily_rollup(logs.where("source = 's0'").withColumn("received_at", F.lit(None).cast("timestamp_ntz")))
    (row,) = rollups.latency_report(empty).collect()
    assert row.n == 30000 and row.p50_s is None and row.avg_latency_s is None


def test_history_reads_only_requested_days(spark):
    path = scratch_path(spark, "history-test")
    ev = read_table(spark, SF_MID, "events").select("event_id", F.col("ts").alias("timestamp"))
    stores.append_history(ev, path)
    asked = spark.createDataFrame([("a", "2024-01-05 12:00:00", 2), ("a", "2024-01-05 12:00:00", 2),
                                   ("b", "2024-01-06 00:00:00", 1), ("c", "2024-01-09 00:00:00", 0),
                                   ("d", None, 3)], "consumer string, as_of string, days int")
    got = requested_rows(spark.read.parquet(path), asked)
    want = []
    for r in ev.collect():
        t = str(r.timestamp)
        if "2024-01-03 12:00:00" <= t < "2024-01-05 12:00:00":
            want.append(("a", r.event_id))
        if "2024-01-05" <= t < "2024-01-06":
            want.append(("b", r.event_id))
    assert rows(got, "consumer", "event_id") == sorted(want)
    assert "dynamicpruning" in got._jdf.queryExecution().executedPlan().toString()


def test_change_feed_out_of_order(spark):
    rng = random.Random(2)
    data = [(f"k{rng.randint(0, 9)}", i, f"2024-01-{rng.randint(1, 28):02d} 00:00:00") for i in range(200)]
    rng.shuffle(data)
    path = scratch_path(spark, "feed")
    schema = "key string, n long, at timestamp_ntz"
    for i in range(0, 200, 50):
        spark.createDataFrame(data[i:i + 50] + [(None, 1, "2024-02-01 00:00:00")], "key string, n long, at string").select(
            "key", "n", F.col("at").cast("timestamp_ntz").alias("at")).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").parquet(path)
    out = scratch_path(spark, "feed-out")
    jobs.run_to_table(stream_changes(stream, "key", "at", "n"), out).awaitTermination()
    chains = {}
    for r in spark.read.parquet(out).orderBy("batch_id").collect():
        assert r.before == chains.get(r.key)  # each change continues the one before
        chains[r.key] = r.after
    want = {}
    for key, n, at in data:
        want[key] = max(want.get(key, ("", -1)), (at, n))
    got = spark.createDataFrame(list(chains.items()), "key string, after string").select(
        "key", F.from_json("after", "n long, at timestamp_ntz").alias("a")).select("key", "a.*")
    assert {r.key: (str(r["at"]), r.n) for r in got.collect()} == want
