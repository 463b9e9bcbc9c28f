"""Unit tests on tiny frames: the rules one by one and the edge cases of FIXTURES C."""

import datetime as dt

from pyspark.sql import functions as F

from incidentry.operators.events import create_events
from incidentry.operators.filters import etl_filter, etl_split, model_match
from incidentry.operators.incidents import instant_and_accumulated
from incidentry.operators.normalize import claim_check, normalize_logs, parse_json_logs, validate_submissions
from incidentry.operators.tagging import tag_logs, tags_expr
from incidentry.plans.batch_jobs import error_etl, logs_to_incidents
from incidentry.sources.rules import event_tags_from_table, tag_rules_from_table

T0 = dt.datetime(2024, 1, 1, 0, 0, 0)
RAW = "id STRING, timestamp TIMESTAMP_NTZ, source STRING, message STRING"


def raw(spark, rows):
    return spark.createDataFrame(rows, RAW)


def tags_of(df):
    return {r["id"]: list(r["tags"]) for r in df.collect()}


def test_tagger_default_rules(spark):
    df = raw(spark, [("a", T0, "s", "an Error in shard 7"), ("b", T0, "s", "Warning, volume nearly full"),
                     ("c", T0, "s", "heartbeat"), ("d", T0, "s", "misinformation desk"), ("e", T0, "s", None)])
    got = tags_of(tag_logs(df))
    assert got == {"a": ["error"], "b": ["warning"], "c": [], "d": ["info"], "e": []}  # 'info' inside a word


def test_tagger_rules_from_table(spark):
    rules = spark.createDataFrame([("urgent", ["P0", "BLACKOUT"])], "tag STRING, keywords ARRAY<STRING>")
    got = tags_of(tag_logs(raw(spark, [("k", T0, "s", "blackout in region 3"), ("l", T0, "s", "calm")]), rules))
    assert got == {"k": ["urgent"], "l": []}


def test_rule_normalisation_edges(spark):
    rules = spark.createDataFrame([
        (1, " Critical ", "request failed, ,FAILED ", None),
        (2, "error", None, ["ERROR", "Exception"]),
        (3, "", "anything", None),
        (4, "WARNING", None, [" ", ""]),
        (5, "checkout", " , ", None),
        (6, "critical", "slow checkout", None),
    ], "rule_order INT, tag STRING, keywords_text STRING, keywords ARRAY<STRING>")
    got = tag_rules_from_table(rules)
    # a repeated tag keeps its first position and takes the later keywords; blank-only list keeps a dead rule
    assert got == [("critical", ["slow checkout"]), ("error", ["ERROR", "Exception"]), ("warning", [])]
    empty = spark.createDataFrame([], "rule_order INT, tag STRING, keywords STRING")
    assert tag_rules_from_table(empty)[0][0] == "error"  # no usable rule → defaults
    # a dead rule still suppresses the defaults: 'WARNING' messages get no tag
    df = raw(spark, [("1", T0, "s", "WARNING slow checkout")])
    assert tags_of(tag_logs(df, rules)) == {"1": ["critical"]}


def test_matcher_rules(spark):
    rules = spark.createDataFrame([("Critical", "CRIT"), ("alert", "ALERT"), (" ", "x"), ("none", " , ")],
                                  "tag STRING, keywords STRING")
    assert event_tags_from_table(rules) == ["alert", "critical"]  # no scan order given: by tag
    assert event_tags_from_table(None) == ["error", "critical"]


def test_rules_as_literals_equal_compiled(spark):
    df = raw(spark, [(str(i), T0, "s", m) for i, m in enumerate(
        ["shard ERROR", "a", "Ab", "warn me", "nothing", "xx Exception", "", None, "INFO ab", 'quote " \\N', "ÄRGER"])])
    rules = [("error", ["ERROR", "Exception"]), ("short", ["a", "AB"]), ("Dead", []), ("warning", ["WARN"]),
             ("info", ["INFO"]), ("odd", ['" \\N', "ärger"])]
    table = spark.createDataFrame([(i, t, k) for i, (t, k) in enumerate(rules) if k],
                                  "rule_order INT, tag STRING, keywords ARRAY<STRING>")
    compiled = tags_of(df.select("id", tags_expr(F.col("message"), rules).alias("tags")))
    assert tags_of(tag_logs(df, rules)) == tags_of(tag_logs(df, table)) == compiled
    assert compiled["8"] == ["short", "info"] and compiled["9"] == ["odd"] and "odd" in compiled["10"]


def test_thousands_of_rules_in_batch_and_stream(spark, tmp_path):
    rules = spark.range(5000).select(F.col("id").alias("rule_order"), F.format_string("t%04d", "id").alias("tag"),
                                     F.array(F.format_string("<k%d>", "id"), F.lit(" ")).alias("keywords"))
    df = raw(spark, [("1", T0, "s", "x <K4999> y <k0>"), ("2", T0, "s", "<k5000>"), ("3", T0, "s", None)])
    want = {"1": ["t0000", "t4999"], "2": [], "3": []}
    tagged = tag_logs(df, rules)
    assert tags_of(tagged) == want
    assert "from_json" not in tagged._jdf.queryExecution().optimizedPlan().toString()  # folded into literals
    df.write.parquet(str(tmp_path / "in"))
    out = tag_logs(spark.readStream.schema(RAW).parquet(str(tmp_path / "in")), rules)
    out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(
        availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    assert tags_of(spark.read.parquet(str(tmp_path / "out"))) == want


def test_filters_defaults_and_empty(spark):
    df = raw(spark, [("e", T0, "s", "ERROR"), ("w", T0, "s", "WARN"), ("i", T0, "s", "INFO"), ("n", T0, "s", "x")])
    tagged = tag_logs(df)
    assert sorted(r["id"] for r in etl_filter(tagged).collect()) == ["e", "w"]
    assert etl_filter(tagged, []).count() == 0  # explicit empty allowed list passes nothing
    passed, rejected = etl_split(tagged)
    assert passed.count() == 2 and rejected.count() == 2
    # warning-only logs pass F2 but are dropped by the default matcher (Q9)
    assert sorted(r["id"] for r in model_match(etl_filter(tagged)).collect()) == ["e"]


def test_instant_incident(spark):
    df = raw(spark, [("n-17", T0, "billing", "error while posting invoice 17")])
    inc = logs_to_incidents(df).collect()
    assert len(inc) == 1 and inc[0]["status"] == "open" and inc[0]["rule"] == "instant"
    ev = create_events(tag_logs(normalize_logs(df))).collect()[0]
    assert ev["severity"] == "high" and inc[0]["events"] == [ev["id"]]


def test_accumulated_incident_on_third_and_later(spark):
    ev = spark.createDataFrame(
        [(f"e{i}", T0 + dt.timedelta(seconds=i), "n-18", sev, "queue depth above limit")
         for i, sev in enumerate(["medium", "medium", "medium", "high", "medium"])],
        "id STRING, timestamp TIMESTAMP_NTZ, log_id STRING, severity STRING, description STRING")
    got = sorted((r["event_id"], r["rule"]) for r in instant_and_accumulated(ev).collect())
    # 3rd event fires, the 4th is high (instant, counts but does not accumulate), the 5th fires again
    assert got == [("e2", "accumulated"), ("e3", "instant"), ("e4", "accumulated")]
    three = ev.limit(3)
    assert instant_and_accumulated(three).count() == 1


def test_error_etl_demo(spark):
    df = raw(spark, [("p", T0, "s", "info, nightly copy done"), ("q", T0, "s", "Error in step 4"),
                     ("r", T0, "s", "unhandled EXCEPTION in worker")])
    got = sorted((r["log_id"], r["severity"]) for r in error_etl(df).collect())
    assert got == [("q", "high"), ("r", "high")]


def test_normalise_and_claim_check(spark):
    df = spark.createDataFrame(
        [("1", "2024-01-01T00:00:00", "\tLedger-Job ", " \n error: quota used up  ", {"normalized": "x"}),
         (None, None, None, None, None)],
        "id STRING, timestamp STRING, source STRING, message STRING, metadata MAP<STRING,STRING>")
    out = {r["id"] is not None and r["id"] == "1": r for r in normalize_logs(df).collect()}
    a = out[True]
    assert a["source"] == "ledger-job" and a["message"] == "error: quota used up"
    assert a["metadata"] == {"normalized": "true", "received_by": "log_receiver"}
    b = out[False]
    assert b["source"] == "unknown" and b["message"] == "" and b["id"] is not None
    cc = claim_check(tag_logs(normalize_logs(df.limit(1)))).collect()[0]
    assert cc["s3_key"] == "logs/1.json" and cc["timestamp"] == "2024-01-01T00:00:00" and cc["tags"] == ["error"]


def test_validation_and_quarantine(spark):
    subs = spark.createDataFrame([("a", "src", "msg", None), ("b", " ", "msg", None), ("c", "src", None, None),
                                  ("e", None, "msg", None), ("d", "src", "m", "not a time")],
                                 "id STRING, source STRING, message STRING, timestamp STRING")
    valid, rejected = validate_submissions(subs)
    assert sorted(r["id"] for r in valid.collect()) == ["a", "b"]  # presence is required, blank text is text
    assert {r["id"]: r["reject_reason"] for r in rejected.collect()} == {
        "e": "missing source", "c": "missing message", "d": "bad timestamp"}
    lines = spark.createDataFrame([('{"id": "1", "source": "s", "message": "m"}',), ("{broken",)], "value STRING")
    good, bad = parse_json_logs(lines)
    assert [r["id"] for r in good.collect()] == ["1"] and bad.count() == 1


def test_json_log_files_and_epoch_fallback(spark):
    import os
    import uuid

    from incidentry.session import scratch_path
    from incidentry.sources.logs import read_log_files
    path = scratch_path(spark, "test-json") + "-" + uuid.uuid4().hex
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, "part-0.json"), "w") as fh:
        fh.write('{"id": "1", "timestamp": "2024-01-01T00:00:05", "source": "a", "message": "ERROR x"}\n')
        fh.write('{"id": "2", "timestamp": "yesterday", "source": "a", "message": "ok",'
                 ' "metadata": {"request_id": "req-1"}}\n')
        fh.write('{"id": \n')
    logs, bad = read_log_files(spark, path)
    got = {r["id"]: r for r in logs.collect()}
    assert got["1"]["event_time"] == dt.datetime(2024, 1, 1, 0, 0, 5)
    assert got["2"]["event_time"] == dt.datetime(1970, 1, 1)  # unparsable → epoch (P6)
    assert got["2"]["metadata"] == {"request_id": "req-1"}
    assert bad.count() == 1


def test_observed_counters_and_fan_out(spark):
    import os

    from incidentry.operators.aggregates import observed
    from incidentry.plans.reports import fan_out_write, oldest_unprocessed_age
    from incidentry.session import scratch_path
    df = raw(spark, [("e", T0, "s", "ERROR"), ("w", T0, "s", "WARN"), ("n", T0 + dt.timedelta(hours=1), "t", "x")])
    tagged = tag_logs(df)
    watched, obs = observed(tagged, "funnel", matched=F.arrays_overlap("tags", F.array(F.lit("error"))))
    watched.write.format("noop").mode("overwrite").save()
    assert obs.get == {"total": 3, "matched": 1}
    path = scratch_path(spark, "fanout")
    fan_out_write(tagged, path)
    assert sorted(d for d in os.listdir(path) if d.startswith("route=")) == [
        "route=error", "route=untagged", "route=warning"]
    back = spark.read.parquet(path)
    assert back.where("route = 'error'").count() == 1
    age = oldest_unprocessed_age(df, df.where("id = 'e'"), "2024-01-01 02:00:00").collect()
    assert {r["source"]: (r["unprocessed"], r["oldest_age_s"]) for r in age} == {"s": (1, 7200), "t": (1, 3600)}


def test_rules_table_read_falls_back(spark):
    from incidentry.session import scratch_path
    from incidentry.sources.rules import read_rules_table
    missing = read_rules_table(spark, scratch_path(spark, "no-such-rules"))
    assert missing is None
    df = raw(spark, [("1", T0, "s", "ERROR x")])
    assert tags_of(tag_logs(df, missing)) == {"1": ["error"]}  # None → default rules
    path = scratch_path(spark, "rules")
    spark.createDataFrame([("critical", "ERROR")], "tag STRING, keywords STRING").write.parquet(path)
    assert tags_of(tag_logs(df, read_rules_table(spark, path))) == {"1": ["critical"]}


def test_rules_as_literals_on_conversation_text(spark):
    from conftest import SF_SMALL
    from incidentry.plans.registry import DOC_RULES
    from incidentry.sources.tables import read_table
    conv = read_table(spark, SF_SMALL, "conversations").select("conv_id", "turn", "text")
    rules = list(DOC_RULES) + [("x", ["zq", "a"])]
    both = tag_logs(conv, rules, text_col="text").withColumn("compiled", tags_expr(F.col("text"), rules)).collect()
    assert all(r["tags"] == r["compiled"] for r in both) and any(r["tags"] for r in both)


def test_critical_only_and_equal_timestamps(spark):
    # a critical-only log passes the matcher but not the default ETL filter (Q9)
    rules = [("critical", ["SEV1"]), ("error", ["ERROR"])]
    df = raw(spark, [("c", T0, "s", "SEV1 outage"), ("e", T0, "s", "ERROR x")])
    tagged = tag_logs(df, rules)
    assert sorted(r["id"] for r in model_match(tagged).collect()) == ["c", "e"]
    assert sorted(r["id"] for r in model_match(etl_filter(tagged)).collect()) == ["e"]
    # equal timestamps: arrival order falls back to the id
    ev = spark.createDataFrame([(i, T0, "k", "medium", "d") for i in ["b", "a", "d", "c"]],
                               "id STRING, timestamp TIMESTAMP_NTZ, log_id STRING, severity STRING, description STRING")
    assert sorted(r["event_id"] for r in instant_and_accumulated(ev).collect()) == ["c", "d"]


def test_iso_json_keeps_microseconds(spark):
    import json

    from incidentry.functions import iso_format, to_json_iso
    df = spark.createDataFrame([("1", dt.datetime(2024, 1, 1, 0, 0, 0, 5)), ("2", dt.datetime(2024, 1, 1))],
                               "id STRING, timestamp TIMESTAMP_NTZ")
    got = {r["id"]: (json.loads(r["j"])["timestamp"], r["iso"]) for r in
           df.select("id", to_json_iso(F.struct("id", "timestamp")).alias("j"), iso_format("timestamp").alias("iso"))
           .collect()}
    assert got["1"] == ("2024-01-01T00:00:00.000005", "2024-01-01T00:00:00.000005")
    assert got["2"][1] == "2024-01-01T00:00:00"  # isoformat() omits a zero fraction


def test_many_keywords(spark):
    df = raw(spark, [("1", T0, "s", "alpha beta"), ("2", T0, "s", "gamma"), ("3", T0, "s", "kw7 here")])
    rules = [("greek", ["alpha", "gamma"]), ("many", [f"kw{i}" for i in range(50)])]
    assert tags_of(tag_logs(df, rules)) == {"1": ["greek"], "2": ["greek"], "3": ["many"]}


def test_null_keys_share_one_counter(spark):
    ev = spark.createDataFrame(
        [(f"e{i}", T0 + dt.timedelta(seconds=i), None, "medium", "d") for i in range(4)],
        "id STRING, timestamp TIMESTAMP_NTZ, log_id STRING, severity STRING, description STRING")
    got = sorted((r["event_id"], r["key"], r["summary"]) for r in instant_and_accumulated(ev).collect())
    # like a dict keyed by None in the application, whose summary prints the key as "None"
    assert got == [("e2", None, "Accumulated incident from log None"), ("e3", None, "Accumulated incident from log None")]


def test_brute_force_quarantines_null_times_and_keys(spark):
    from incidentry.operators.bruteforce import brute_force_incidents
    ev = spark.createDataFrame(
        [("a", T0, "k"), ("b", None, "k"), ("c", T0 + dt.timedelta(seconds=1), "k"), ("d", T0, None)],
        "id STRING, timestamp TIMESTAMP_NTZ, ip STRING")
    inc, quarantine = brute_force_incidents(ev, window_seconds=60, threshold=2, event_type=None, key=F.col("ip"))
    assert [r["events"] for r in inc.collect()] == [["a", "c"]]
    assert sorted(r["id"] for r in quarantine.collect()) == ["b", "d"]
