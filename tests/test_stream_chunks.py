"""Rows travel to their shard and wait there as chunks: state calls follow the chunks, results stay those of the sorted rows."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import rows
from incidentry.operators.aggregates import running_error_counts
from incidentry.streaming import jobs, ordered
from incidentry.streaming.processors import LoginCounter, RunningErrorCount


def test_running_count_of_one_hot_source_by_chunks(spark):
    """All rows of one source: the state is written once per chunk, not once per row."""
    second = (F.col("id") * 7919 % 20_000).cast("int")
    logs = spark.range(0, 20_000, 1, 4).select(
        F.concat(F.lit("l"), F.col("id").cast("string")).alias("id"),
        F.timestamp_add("SECOND", second, F.lit("2024-01-01").cast("timestamp_ntz")).alias("timestamp"),
        F.lit("one").alias("source"), F.when(F.col("id") % 3 == 0, "an Error").when(F.col("id") % 3 == 1, "fine").alias("message"))
    stream = jobs.replayed(logs, ["timestamp", "id"], 3)
    path = jobs.scratch_path(spark, "chunks")
    q = jobs.run_to_table(jobs.stream_running_error_counts(stream, reorder="3650 days"), path)
    q.awaitTermination(300)
    assert q.exception() is None
    got, want = spark.read.parquet(path).drop("batch_id"), running_error_counts(logs)
    assert rows(got, "id", "timestamp", "source", "error_count") == rows(want, "id", "timestamp", "source", "error_count")
    written = sum(op.numRowsUpdated for p in q.recentProgress for op in p.stateOperators)
    assert written < 20_000 / 100
    assert sum(p.numInputRows > 1 for p in q.recentProgress) == 3


def test_replay_without_rows(spark):
    logs = spark.createDataFrame([], "id string, timestamp timestamp_ntz, source string, message string")
    stream = jobs.replayed(logs, ["timestamp", "id"], 3)
    assert jobs.run_and_read(jobs.stream_running_error_counts(stream, reorder="3650 days")).collect() == []


class State:
    """A value, list or map state and the number of its writes."""

    def __init__(self):
        self.kept, self.writes = None, 0

    def exists(self):
        return self.kept is not None

    def get(self):
        return iter(list(self.kept or [])) if isinstance(self.kept, list | None) else self.kept

    def update(self, row):
        self.kept, self.writes = row, self.writes + 1

    def appendList(self, some):
        self.kept, self.writes = [*(self.kept or []), *some], self.writes + 1

    def put(self, some):
        self.kept, self.writes = list(some), self.writes + 1

    def clear(self):
        self.kept = None

    def getValue(self, key):
        return (self.kept or {}).get(key)

    def updateValue(self, key, value):
        self.kept = {**(self.kept or {}), key: value}

    def removeKey(self, key):
        del self.kept[key]

    def iterator(self):
        return iter(list((self.kept or {}).items()))


class Handle:
    def __init__(self):
        self.states, self.timers = {}, set()

    def _state(self, name, *rest):
        return self.states.setdefault(name, State())

    getValueState = getListState = getMapState = _state

    def listTimers(self):
        return sorted(self.timers)

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)


class Watermark:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def one_shard(inner, order, table, batches, delay_ms):
    """What ``inner`` makes of ``batches`` of rows of one shard, the watermark ``delay_ms`` behind the newest row so far."""
    handle, wrapped, out, newest = Handle(), ordered.EventTimeOrdered(inner, "k", "string", order), [], None
    wrapped.init(handle)
    pack = ordered._packer(order[0])
    for some in [*batches, []]:
        mark = Watermark(10 ** 12 if not some else 0 if newest is None else newest // 1000 - delay_ms)
        made = [b.to_pandas() for b in pack(iter(pa.Table.from_pylist(some, table).to_batches(20)))]
        out += wrapped.handleInputRows((0,), iter(made), mark)
        for at in [t for t in handle.listTimers() if t <= mark.ms]:
            out += wrapped.handleExpiredTimer((0,), mark, None)
            handle.deleteTimer(at)
        newest = max([r["us"] for r in some] + ([] if newest is None else [newest]), default=None)
    return [r for pdf in out for r in pdf.to_dict("records")], handle


@pytest.fixture(params=[10 ** 6, 50])
def small_pieces(request, monkeypatch):
    """Chunks of a few rows, taken out of them all at once or in slices."""
    for name, value in (("GATHERED_BYTES", 2_000), ("CHUNK_BYTES", 200), ("SORTED_ROWS", request.param), ("HANDED_ROWS", 7)):
        monkeypatch.setattr(ordered, name, value)


@pytest.mark.parametrize("delay_ms,spread", [(10 ** 9, 4000), (300, 4000), (300, 300)])
def test_slices_of_chunks_give_the_sorted_rows(small_pieces, delay_ms, spread):
    """Rows up to the delay out of order, equal times and null keys among them, across micro-batches of one shard."""
    pick = random.Random(5)
    table = pa.schema([("shard_no", pa.int32()), ("us", pa.int64()), ("id", pa.string()), ("k", pa.string()), ("error", pa.bool_())])
    made = [{"shard_no": 0, "us": 10 ** 6 + i // 3 * 3000, "id": f"r{i}", "k": pick.choice(["a", "b", None]),
             "error": pick.random() < .4} for i in range(1200)]
    late = delay_ms * 1000 if delay_ms < spread else spread * 1000
    arriving = sorted(made, key=lambda r: r["us"] + pick.randrange(late))
    batches = [arriving[i:i + 240] for i in range(0, 1200, 240)]
    got, handle = one_shard(RunningErrorCount("us", in_order=True), ["us", "id"], table, batches, delay_ms)
    want, counts = [], {}
    for r in sorted(made, key=lambda r: (r["us"], r["id"])):
        counts[r["k"]] = counts.get(r["k"], 0) + r["error"]
        want.append((r["id"], r["us"], r["k"], counts[r["k"]]))
    found = [(r["id"], r["us"], None if r["source"] != r["source"] else r["source"], r["error_count"]) for r in got]
    assert sorted(found, key=str) == sorted(want, key=str)
    assert handle.states["waiting"].kept is None
    assert {k[0]: v[1] for k, v in handle.states["held"].kept.items()} == {k: [(n,)] for k, n in counts.items()}


def test_rows_behind_what_was_handed_out_are_dropped(small_pieces):
    """A row that comes after later ones of its shard went on is late; one still in order is not."""
    table = pa.schema([("shard_no", pa.int32()), ("us", pa.int64()), ("id", pa.string()), ("k", pa.string()), ("error", pa.bool_())])

    def row(ms, name):
        return {"shard_no": 0, "us": ms * 1000, "id": name, "k": "a", "error": True}
    batches = [[row(i, f"r{i}") for i in range(1000, 1100)], [row(5000, "new")], [row(1050, "late"), row(4950, "in order")]]
    got, _ = one_shard(RunningErrorCount("us", in_order=True), ["us", "id"], table, batches, 10)
    assert [r["id"] for r in got] == [*(f"r{i}" for i in range(1000, 1100)), "in order", "new"]
    assert [r["error_count"] for r in got] == list(range(1, 103))


def test_folded_keys_keep_their_state_between_slices(small_pieces):
    """Login counters lapse between micro-batches; a success clears them."""
    pick = random.Random(6)
    table = pa.schema([("shard_no", pa.int32()), ("event_us", pa.int64()), ("us", pa.int64()), ("attempt_id", pa.int64()),
                       ("k", pa.string()), ("password_ok", pa.bool_())])
    made = [{"shard_no": 0, "event_us": 10 ** 6 * (1 + i), "us": 10 ** 6 * (1 + i), "attempt_id": i, "k": f"u{i * i % 13}",
             "password_ok": pick.random() < .2} for i in range(600)]
    arriving = sorted(made, key=lambda r: r["us"] + pick.randrange(5 * 10 ** 6))
    batches = [arriving[i:i + 100] for i in range(0, 600, 100)]
    got, handle = one_shard(LoginCounter(20), ["event_us", "attempt_id"], table, batches, 10_000)
    want, known = [], {}
    for r in made:
        n, last = known.get(r["k"], (0, 0))
        n = 0 if r["password_ok"] else (n if r["us"] - last < 20 * 10 ** 6 else 0) + 1
        known[r["k"]] = (n, r["us"])
        want.append((r["attempt_id"], n))
    assert sorted((r["attempt_id"], r["attempts"]) for r in got) == want
    assert not handle.states["held"].kept
