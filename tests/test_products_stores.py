"""Products (X9, J4, J5, P11, P12), logins (T4 edges) and the stores."""

import datetime as dt
import decimal

from pyspark.sql import functions as F

from incidentry.operators import products as prod
from incidentry.operators.logins import login_attempt_counts
from incidentry.operators.normalize import normalize_logs
from incidentry.operators.tagging import tag_logs
from incidentry.session import scratch_path
from incidentry.sources import stores

T0 = dt.datetime(2024, 1, 1)
D = decimal.Decimal


def products(spark):
    return spark.createDataFrame([("p1", "Keyboard", D("49.99"), T0), ("p2", "Monitor", D("199.00"), T0),
                                  ("p3", "Mouse", D("24.50"), T0)],
                                 "id STRING, name STRING, price DECIMAL(12,2), updated_at TIMESTAMP_NTZ")


def test_price_updates(spark):
    upd = spark.createDataFrame([("p1", 59.99, T0 + dt.timedelta(1)), ("p2", -5.0, T0 + dt.timedelta(1)),
                                 ("p9", 1.0, T0 + dt.timedelta(1)), ("p3", 10.0, T0 + dt.timedelta(1)),
                                 ("p3", 49.995, T0 + dt.timedelta(2))], "id STRING, price DOUBLE, ts TIMESTAMP_NTZ")
    merged, rejected = prod.apply_price_updates(products(spark), upd)
    got = {r["id"]: r["price"] for r in merged.collect()}
    assert got == {"p1": D("59.99"), "p2": D("199.00"), "p3": D("50.00")}  # half-up rounding, latest wins
    assert sorted((r["id"], r["reject_reason"]) for r in rejected.collect()) == [
        ("p2", "negative price"), ("p9", "unknown id")]
    view = prod.list_products(merged).collect()
    assert [r["id"] for r in view] == ["p1", "p2", "p3"] and view[0]["updated_at"] == "2024-01-02T00:00:00"


def test_seed_products(spark):
    empty = products(spark).limit(0)
    assert prod.seed_products(empty, prod.seed_rows(spark)).count() == 3
    assert prod.seed_products(products(spark), prod.seed_rows(spark)).count() == 3
    assert prod.seed_products(products(spark).where("id <> 'p2'"), prod.seed_rows(spark), only_if_empty=True) \
        .count() == 2
    found = prod.get_products(products(spark), spark.createDataFrame([("p1",), ("zz",)], "id STRING")).collect()
    assert {r["id"]: r["found"] for r in found} == {"p1": True, "zz": False}


def test_login_edges(spark):
    rows = [("alice", 0, False, 1), ("alice", 10, False, 2), ("alice", 20, True, 3), ("alice", 30, False, 4),
            ("alice", 3629, False, 5), ("alice", 7229, False, 6), ("mallory", 40, False, 7)]
    att = spark.createDataFrame(rows, "username STRING, s INT, password_ok BOOLEAN, attempt_id LONG") \
        .withColumn("ts", F.timestamp_seconds("s").cast("timestamp_ntz"))
    users = spark.createDataFrame([("alice",)], "username STRING")
    got = {r["attempt_id"]: (r["attempts"], r["message"]) for r in login_attempt_counts(att, users, 3600).collect()}
    assert got[1] == (1, "Wrong password. Attempt #1") and got[2] == (2, "Wrong password. Attempt #2")
    assert got[3] == (0, "Login successful") and got[4][0] == 1
    assert got[5][0] == 2  # 3599 s after the previous failure: still counting
    assert got[6][0] == 1  # exactly 3600 s later: the counter has lapsed
    assert got[7] == (0, "Unknown username")
    no_ttl = {r["attempt_id"]: r["attempts"] for r in login_attempt_counts(att, users, None).collect()}
    assert no_ttl[6] == 3


def test_tagged_log_store_roundtrip(spark):
    logs = spark.createDataFrame([("1", T0, "s", "ERROR x"), ("1", T0 + dt.timedelta(seconds=1), "s", "INFO y"),
                                  ("2", T0 + dt.timedelta(microseconds=5), "s", "ok")],
                                 "id STRING, timestamp TIMESTAMP_NTZ, source STRING, message STRING")
    tagged = tag_logs(normalize_logs(logs))
    path = scratch_path(spark, "test-logs")
    stores.write_tagged_logs(tagged, path, batch_id=1)
    stores.write_tagged_logs(tagged, path, batch_id=1)  # rerun of the batch replaces it
    back = {r["id"]: r for r in stores.read_tagged_logs(spark, path).collect()}
    assert set(back) == {"1", "2"} and back["1"]["tags"] == ["info"] and back["1"]["s3_key"] == "logs/1.json"
    assert back["2"]["timestamp"].microsecond == 5

    ev_path = scratch_path(spark, "test-events")
    ev = spark.createDataFrame([("e1", T0, "medium")], "id STRING, timestamp TIMESTAMP_NTZ, severity STRING")
    stores.append_batch(ev, ev_path, 1)
    stores.append_batch(ev.withColumn("severity", F.lit("high")), ev_path, 2)
    assert [r["severity"] for r in stores.latest_view(spark, ev_path).collect()] == ["high"]
    hist = scratch_path(spark, "test-history")
    stores.append_history(ev, hist)
    stores.append_history(ev, hist)
    assert spark.read.parquet(hist).count() == 2


def test_quarantine_writer(spark):
    from incidentry.operators.normalize import validate_submissions
    subs = spark.createDataFrame([("a", "src", "msg", T0), ("b", None, "msg", T0), ("c", "src", None, None)],
                                 "id STRING, source STRING, message STRING, timestamp TIMESTAMP_NTZ")
    _, rejected = validate_submissions(subs)
    path = scratch_path(spark, "quarantine")
    stores.write_quarantine(rejected, path)
    back = spark.read.parquet(path)
    assert sorted((r["id"], r["reject_reason"]) for r in back.collect()) == [
        ("b", "missing source"), ("c", "missing message")]
