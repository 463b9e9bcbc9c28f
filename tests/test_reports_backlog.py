"""The one-pass funnel, damaged rules tables, the backlog table, and incidents of a shuffled stream."""

import datetime as dt
import json
import os
import random

from pyspark.sql import functions as F

from conftest import SF_SMALL, rows
from incidentry.operators.events import create_events
from incidentry.operators.incidents import instant_and_accumulated
from incidentry.operators.normalize import normalize_logs
from incidentry.operators.tagging import tag_logs
from incidentry.plans import reports
from incidentry.plans.registry import QUERIES
from incidentry.session import scratch_path
from incidentry.sources.driver_views import log_view
from incidentry.sources.rules import DEFAULT_TAG_RULES, read_rules_table, tag_rules_from_table
from incidentry.streaming import backlog, jobs
from test_stream_order import shuffled_replay

FLAGS = "key string, at int, id int, event boolean, high boolean, valid boolean"


def funnel(spark, data, threshold, salts):
    out = reports.funnel_in_one_pass(spark.createDataFrame(data, FLAGS), {"all": F.lit(True), "valid": F.col("valid")},
                                     F.col("event"), F.col("high"), "key", ["at", "id"], threshold, salts)
    return {r["stage"]: r["n"] for r in out.collect()}


def plain_funnel(data, threshold):
    seen, incidents = {}, 0
    for key, at, ident, event, high, _ in sorted(data, key=lambda r: (r[1], r[2])):
        if event:
            seen[key] = seen.get(key, 0) + 1
            incidents += bool(high) or seen[key] >= threshold
    return {"all": len(data), "valid": sum(bool(r[5]) for r in data), "incidents": incidents}


def test_funnel_in_one_pass_equals_a_plain_count(spark):
    rnd = random.Random(5)
    data = [(rnd.choice(["hot", "hot", "a", "b", None]), rnd.randrange(40), i, rnd.choice([True, True, False, None]),
             rnd.choice([True, False, False, None]), rnd.choice([True, False, None])) for i in range(600)]
    for threshold in (1, 2, 3, 10):
        for salts in (1, 7):
            assert funnel(spark, data, threshold, salts) == plain_funnel(data, threshold)


def test_funnel_of_an_empty_table(spark):
    assert funnel(spark, [], 3, 4) == {"all": 0, "valid": 0, "incidents": 0}


def test_the_registered_funnel_scans_once(spark):
    plan = QUERIES["stage_funnel"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_damaged_rules_give_the_defaults(spark):
    rules = spark.createDataFrame([(i, f"tag{i}", "word") for i in range(1000)], "rule_order int, tag string, keywords string")
    path = scratch_path(spark, "damaged-rules")
    rules.coalesce(1).write.option("compression", "none").parquet(path)
    assert len(tag_rules_from_table(read_rules_table(spark, path))) == 1000
    name = next(f for f in os.listdir(path) if f.endswith(".parquet"))
    with open(os.path.join(path, name), "r+b") as f:  # the footer stays readable, the first column's pages do not
        f.seek(4)
        f.write(b"\xff" * 200)
    os.unlink(os.path.join(path, f".{name}.crc"))
    assert read_rules_table(spark, path) is None
    assert tag_rules_from_table(read_rules_table(spark, path)) == DEFAULT_TAG_RULES
    name = os.path.join(path, name)
    with open(name, "r+b") as f:  # now the footer as well
        f.seek(-200, os.SEEK_END)
        f.write(b"\xff" * 200)
    assert read_rules_table(spark, path) is None


def report(trigger, at, sources):
    return json.dumps({"name": "q", "timestamp": at, "batchDuration": 2000, "numInputRows": 5, "sources": sources})


def test_offsets_and_backlog_by_partition(spark):
    def topic(start, end, latest):
        def text(o):
            return None if o is None else json.dumps({"logs": {"0": o[0], "1": o[1]}})
        return {"description": "topics", "startOffset": text(start), "endOffset": text(end), "latestOffset": text(latest),
                "numInputRows": 5}
    files = {"description": "files", "startOffset": None, "endOffset": json.dumps({"logOffset": 0}), "numInputRows": 1}
    plain = {"description": "rate", "startOffset": "4", "endOffset": "9", "latestOffset": "9", "numInputRows": 5}
    data = [("a", "r1", 0, report(0, "2024-01-01T00:00:01.000Z", [topic(None, (10, 4), (30, 4)), files, plain])),
            ("a", "r1", 1, report(1, "2024-01-01T00:00:02.000Z", [topic((10, 4), (11, 4), (30, 9))])),
            ("a", "r2", 1, report(1, "2024-01-01T00:01:04.000Z", [topic((10, 4), (20, 4), (30, 9))])),
            ("b", "r3", 0, report(0, "2024-01-01T00:00:01.000Z", []))]
    found = backlog.backlog(backlog.offsets(spark.createDataFrame(data, backlog.PROGRESS))).cache()
    got = rows(found.where("topic = 'logs'"), "trigger", "partition", "lag", "drained", "drain_rate", "seconds_left")
    assert got == [(0, "0", 20, None, None, None), (0, "1", 0, None, None, 0.0),
                   (1, "0", 10, 10, 5.0, 2.0), (1, "1", 5, 0, 0.0, None)]
    assert found.where("query_id = 'b'").isEmpty()
    rest = found.where("topic IS NULL").orderBy("source").collect()
    assert [(r["partition"], r["end_offset"], r["lag"], r["drained"]) for r in rest] == [("logOffset", 0, 0, None),
                                                                                       (None, 9, 0, 5)]
    spans = backlog.backlog_by_window(found.where("topic = 'logs'")).orderBy("window_start").collect()
    assert [(r["triggers"], r["drained"], r["drain_rate"], r["lag"]) for r in spans] == [(1, None, None, 20), (1, 10, 5.0, 15)]


def test_progress_of_no_stream(spark):
    empty = spark.createDataFrame([], backlog.PROGRESS)
    assert backlog.backlog(backlog.offsets(empty)).isEmpty()


def test_incidents_of_a_shuffled_replay_equal_batch(spark):
    logs = tag_logs(normalize_logs(log_view(spark, SF_SMALL)))
    events = create_events(logs, carry=["source"]).select("id", "timestamp", "severity", "description", "source")
    got = jobs.run_and_read(jobs.stream_incidents(shuffled_replay(events, "timestamp", 3), "source", reorder="3650 days"))
    want = instant_and_accumulated(events, "source")
    names = ["id", "timestamp", "summary", "rule", "event_id", "key"]
    assert rows(got, *names) == rows(want, *names)
    assert got.agg(F.max("timestamp")).first()[0] < dt.datetime(2100, 1, 1)
