"""Rows that share ids: incidents count positions, stores order batches by number, bad topic values are marked."""

import datetime as dt

from incidentry.operators.incidents import instant_and_accumulated
from incidentry.sources import stores
from incidentry.session import scratch_path
from incidentry.streaming.sources import parse_values

T0 = dt.datetime(2024, 3, 1, 8)


def test_events_of_one_log_share_their_id(spark):
    ev = spark.createDataFrame([("same", T0 + dt.timedelta(minutes=i), "log-7", s, "d", i) for i, s in
                                enumerate(["medium", "high", "medium", "medium", "high"])],
                               "id STRING, timestamp TIMESTAMP_NTZ, log_id STRING, severity STRING, description STRING, n INT")
    got = instant_and_accumulated(ev, order=("timestamp", "n")).orderBy("timestamp").collect()
    assert [(r["rule"], r["timestamp"].minute) for r in got] == [("instant", 1), ("accumulated", 2), ("accumulated", 3),
                                                                 ("instant", 4)]


def test_batch_ten_comes_after_nine(spark):
    path = scratch_path(spark, "test-batches")
    schema = ("id STRING, timestamp TIMESTAMP_NTZ, source STRING, message STRING, metadata MAP<STRING,STRING>, "
              "tags ARRAY<STRING>")
    for batch in (9, 10, 11):
        row = ("a" if batch < 11 else "b", T0, "s", f"copy {batch}", None, ["x"])
        stores.write_tagged_logs(spark.createDataFrame([row], schema), path, batch)
    got = {r["id"]: r["message"] for r in stores.read_tagged_logs(spark, path).collect()}
    assert got == {"a": "copy 10", "b": "copy 11"}


def test_bad_topic_values_are_marked(spark):
    df = spark.createDataFrame([('{"id": "1", "source": "s", "message": "m"}',), ("{broken",), (None,)], "value STRING")
    got = parse_values(df.selectExpr("value", "timestamp '2024-01-01' AS timestamp")).collect()
    assert [r["_corrupt"] for r in got] == [False, True, True] and got[0]["message"] == "m"
