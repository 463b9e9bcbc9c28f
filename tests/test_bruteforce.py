"""The greedy choice of candidates must equal a direct fold of the rule, however the history is cut."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from conftest import SF_MID
from incidentry.operators.bruteforce import brute_force_incidents
from incidentry.plans.registry import failed_login_events


def direct_fold(rows, window_s, k):
    """The rule as written: prune by age (strict <), append, fire at k and clear."""
    by_key = defaultdict(list)
    for r in rows:
        by_key[r["key"]].append((r["timestamp"], r["id"]))
    fired = []
    for key, evs in by_key.items():
        buf = []
        for ts, i in sorted(evs):
            buf = [(t, j) for t, j in buf if (ts - t).total_seconds() < window_s]
            buf.append((ts, i))
            if len(buf) >= k:
                fired.append((key, i, tuple(j for _, j in buf)))
                buf = []
    return sorted(fired)


@pytest.mark.parametrize("window_s,k,bucket,group", [(86400, 3, 3, 2), (86400, 3, 4096, 4096), (43200, 2, 5, 3),
                                                     (172800, 4, 7, 1), (3600 * 30, 3, 16, 4), (86400, 1, 4, 2)])
def test_greedy_choice_matches_direct(spark, window_s, k, bucket, group):
    ev = failed_login_events(spark, SF_MID)
    inc, quarantine = brute_force_incidents(ev, window_seconds=window_s, threshold=k,
                                            bucket=bucket, group=group)
    got = sorted((r["key"], r["event_id"], tuple(r["events"])) for r in inc.collect())
    src = ev.select("id", "timestamp", F.col("metadata")["ip"].alias("key")).collect()
    assert got == direct_fold(src, window_s, k)
    assert quarantine.count() == 0


def test_edges_age_equal_window_and_reset(spark):
    # ip a: 3 events 10 s apart fire at k=3; the buffer then starts empty; an event exactly `window` old is dropped
    rows = [("e1", 0, "a"), ("e2", 10, "a"), ("e3", 20, "a"), ("e4", 25, "a"), ("e5", 30, "a"),
            ("e6", 90, "a"), ("e7", 95, "a"), ("x1", 0, None)]
    df = spark.createDataFrame(rows, "id STRING, s INT, ip STRING") \
        .select("id", F.timestamp_seconds("s").cast("timestamp_ntz").alias("timestamp"),
                F.lit("login_failed").alias("type"), F.create_map(F.lit("ip"), F.col("ip")).alias("metadata"))
    inc, quarantine = brute_force_incidents(df, window_seconds=60, threshold=3)
    got = sorted(tuple(r["events"]) for r in inc.collect())
    # e4,e5 buffered after the first fire; e6 at 90 s: e4 (age 65) and e5 (age 60, equal to window) dropped
    assert got == [("e1", "e2", "e3")]
    assert [r["id"] for r in quarantine.collect()] == ["x1"]
    # with a 66 s window e4 (age 65) is still buffered when e6 arrives, so e4, e5, e6 fire
    inc2, _ = brute_force_incidents(df, window_seconds=66, threshold=3)
    assert sorted(tuple(r["events"]) for r in inc2.collect()) == [("e1", "e2", "e3"), ("e4", "e5", "e6")]
    s = inc.collect()[0]
    assert s["summary"] == "Brute Force Attack: 3 failed logins from a" and s["owner"] == "auto-assigned"


def test_dense_history_over_many_buckets_and_groups(spark):
    """One key whose events are all candidates, with holes now and then: entries cross buckets and groups."""
    rng = random.Random(4)
    at, data = 0, []
    for i in range(3000):
        at += 500 if rng.random() < 0.01 else rng.randint(0, 9)
        data.append((f"e{i:05d}", at, rng.choice(["a", "a", "a", "b"])))
    df = spark.createDataFrame(data, "id STRING, s INT, ip STRING").select(
        "id", F.timestamp_seconds("s").cast("timestamp_ntz").alias("timestamp"),
        F.lit("login_failed").alias("type"), F.create_map(F.lit("ip"), F.col("ip")).alias("metadata"))
    src = df.select("id", "timestamp", F.col("metadata")["ip"].alias("key")).collect()
    for k, bucket, group in [(10, 10, 2), (10, 32, 8), (3, 100, 3), (7, 4096, 4096)]:
        inc, _ = brute_force_incidents(df, 60, k, bucket=bucket, group=group, ranges=5)
        got = sorted((r["key"], r["event_id"], tuple(r["events"])) for r in inc.collect())
        assert got == direct_fold(src, 60, k)


def test_no_python_stage(spark, capsys):
    ev = failed_login_events(spark, SF_MID)
    brute_force_incidents(ev, 86400, 3)[0].explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Pandas" not in plan and "InArrow" not in plan
