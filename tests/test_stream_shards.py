"""Keys in event-time order share shards: state and calls follow the shards, results stay those of each key alone."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import rows
from incidentry.operators.bruteforce import brute_force_incidents
from incidentry.operators.logins import login_attempt_counts
from incidentry.streaming import jobs, ordered

USERS, TRIES = 600, 7


@pytest.fixture(scope="module")
def tries(spark):
    """Seven logins each of 600 users over 20 days, some of them right, one row in 97 without a user."""
    start = dt.datetime(2024, 1, 1)
    made = [(k, start + dt.timedelta(seconds=(k * 7919) % 1_728_000, microseconds=k), k * 31 % USERS, k % 5 == 0)
            for k in range(USERS * TRIES)]
    return spark.createDataFrame([(i, t, None if i % 97 == 0 else f"u{u}", ok) for i, t, u, ok in made],
                                 "attempt_id long, ts timestamp_ntz, username string, password_ok boolean").cache()


def in_pieces(df, files):
    """A stream of files of consecutive times, written one after the other, and a closing row."""
    spark, path = df.sparkSession, jobs.scratch_path(df.sparkSession, "pieces")
    for i in range(files):
        day = F.datediff("ts", F.lit("2024-01-01"))
        df.where((day * files / 20).cast("int") == i).coalesce(1).write.mode("append").parquet(path)
    ordered.closing_row(df, "ts").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", "1").parquet(path)


def run(df):
    """Result and the most rows that the state held: one per waiting list, and one per key with an own entry."""
    path = jobs.scratch_path(df.sparkSession, "shards")
    q = jobs.run_to_table(df, path)
    q.awaitTermination(300)
    assert q.exception() is None
    return (df.sparkSession.read.parquet(path).drop("batch_id"),
            max(op.numRowsTotal for p in q.recentProgress for op in p.stateOperators))


@pytest.mark.parametrize("delay", ["1 second", "3650 days"])
def test_login_counts_by_shards(spark, tries, delay):
    users = tries.select("username").where("username <> 'u3'").distinct()
    stream = in_pieces(tries, 4)
    got, held = run(jobs.stream_login_counts(stream, users, 172800, reorder=delay))
    want = login_attempt_counts(tries, users, 172800).where("known")
    assert rows(got, "attempt_id", "attempts") == rows(want, "attempt_id", "attempts") != []
    assert held <= ordered.SHARDS < USERS or delay == "1 second"  # where rows wait, not the keys' own entries


@pytest.mark.parametrize("delay", ["1 second", "3650 days"])
def test_brute_force_by_shards(spark, tries, delay):
    def failed(df):
        return df.select(F.col("attempt_id").cast("string").alias("id"), F.col("ts").alias("timestamp"),
                         F.lit("login_failed").alias("type"), F.create_map(F.lit("ip"), "username").alias("metadata"))
    stream = in_pieces(tries, 4)
    got, held = run(jobs.stream_brute_force(failed(stream), 11 * 86400, 3, reorder=delay))
    want, _ = brute_force_incidents(failed(tries), 11 * 86400, 3)
    assert rows(got, "event_id", "events", "key") == rows(want, "event_id", "events", "key") != []
    assert held <= ordered.SHARDS < USERS or delay == "1 second"  # where rows wait, not the keys' own entries


def test_idle_keys_of_a_shard_lapse_alone(spark, tries, monkeypatch):
    """Counters with an idle timeout: the same whether a key has a shard of its own or shares one with all others, the
    null key included; without the timeout more incidents."""
    def fired(shards, idle):
        monkeypatch.setattr(ordered, "SHARDS", shards)
        stream = in_pieces(tries.where("attempt_id < 1500"), 6)
        ev = stream.select(F.col("attempt_id").cast("string").alias("id"), F.col("ts").alias("timestamp"),
                           F.lit("low").alias("severity"), F.lit("d").alias("description"), "username")
        return rows(jobs.run_and_read(jobs.stream_incidents(ev, "username", 2, idle_seconds=idle, reorder="1 second")),
                    "event_id", "key")
    alone, together = fired(100_000, 86400), fired(1, 86400)
    assert alone == together != []
    assert len(fired(1, None)) > len(together)
