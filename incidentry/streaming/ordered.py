"""Event-time order for keyed stream processors.

Inside a stream the processors of ``streaming.processors`` fold rows as they arrive. :class:`EventTimeOrdered` puts any of
them behind a waiting list in state: rows are appended to it batch by batch as they come, and an event-time timer
hands them, key by key, to the processor in (time, id) order once the watermark has passed them. What comes out is then
that of the batch operator whatever the order of arrival within the watermark's delay and however the input is cut into
micro-batches; what waits is bounded by the delay, not by the micro-batch. Rows behind what their shard has handed out
already are late and dropped, unless ``streaming.late`` has taken them aside before.

Keys are dealt to shards, the stream's grouping key: each call into the state store costs about as much as folding a key's
rows, so a shard's keys share one waiting list and one timer, and an own entry in state is read and written only for the
keys that rows or timers reach.

Rows travel and wait as chunks (compressed Arrow, sorted by time), made by the tasks that read the input: a row by itself costs
Spark and the state store many times what sorting and folding it costs, and would cost it in the one task of its shard.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from incidentry.session import pickle_by_value

pickle_by_value(__name__)

#: Rows handed to the processor at a time.
HANDED_ROWS = 10_000
#: Rows of a shard that are taken out of their chunks at a time, if the chunks' times allow it.
SORTED_ROWS = 500_000
#: Bytes of rows that a task gathers to cut them into chunks, and of a chunk (Spark puts up to 10,000 into one buffer of 2 GB).
GATHERED_BYTES, CHUNK_BYTES = 32 << 20, 128 << 10
#: Shards of a stream's keys: a task holds the ready rows of one shard.
SHARDS = 256
#: A row at this time or later only closes a stream: it moves the watermark past all others and is not processed.
CLOSING_TIME = "9000-01-01 00:00:00"


def _chunks(rows: pa.Table, time: str) -> list[tuple[int, int, bytes]]:
    """``rows``, sorted by ``time``, in pieces: their first and last time, and the rows as bytes."""
    step = max(1, rows.num_rows * CHUNK_BYTES // max(1, rows.nbytes))
    out = []
    for start in range(0, rows.num_rows, step):
        piece = rows.slice(start, step)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, piece.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
            to.write_table(piece)
        out.append((piece[time][0].as_py(), piece[time][-1].as_py(), sink.getvalue().to_pybytes()))
    return out


def _unpacked(chunk: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(chunk)).read_all()


def _sorted(rows: pa.Table, by: list[str]) -> pa.Table:
    """``rows`` in the order of ``by``, nulls last."""
    rows = rows.combine_chunks()
    return rows.take(pc.sort_indices(rows, sort_keys=[(c, "ascending") for c in by]))


def _packer(time: str):
    """Batches of rows with their ``shard_no`` → one row per chunk of a shard's rows."""
    def packed(some: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = _sorted(pa.Table.from_batches(some), ["shard_no", time])
        shards = rows["shard_no"].to_numpy()
        rows, starts = rows.drop_columns("shard_no"), np.flatnonzero(np.diff(shards, prepend=-1))
        made = [(int(shards[a]), *chunk) for a, b in zip(starts, [*starts[1:], len(shards)], strict=True)
                for chunk in _chunks(rows.slice(a, b - a), time)]
        types = (pa.int32(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*made, strict=True), types, strict=True)],
                                          ["shard_no", "first", "last", "chunk"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, size = [], 0
        for batch in batches:
            if batch.num_rows:
                some.append(batch)
                size += batch.nbytes
            if size >= GATHERED_BYTES:
                yield packed(some)
                some, size = [], 0
        if some:
            yield packed(some)
    return pack


class _KeyState:
    """The state of the key at hand as the wrapped processor sees it: a value state (``single``) or a list state."""

    def __init__(self, single: bool):
        self.single, self.rows = single, []

    def exists(self) -> bool:
        return bool(self.rows)

    def get(self):
        return self.rows[0] if self.single else iter(self.rows)

    def update(self, row) -> None:
        self.rows = [tuple(row)]

    def put(self, rows) -> None:
        self.rows = [tuple(r) for r in rows]

    def appendList(self, rows) -> None:
        self.rows = self.rows + [tuple(r) for r in rows]

    def clear(self) -> None:
        self.rows = []


class _InnerHandle:
    """What the wrapped processor sees of its handle: one state, and one timer, of the key at hand."""

    def __init__(self):
        self.state, self.schema, self.timer = None, None, None

    def getValueState(self, name, schema, *rest):
        return self._only(schema, True)

    def getListState(self, name, schema, *rest):
        return self._only(schema, False)

    def _only(self, schema, single):
        if self.state is not None:
            raise ValueError("a processor behind EventTimeOrdered has one state")
        self.state, self.schema = _KeyState(single), schema
        return self.state

    def listTimers(self):
        return [] if self.timer is None else [self.timer]

    def deleteTimer(self, timer):
        self.timer = None

    def registerTimer(self, timer):
        self.timer = timer


class EventTimeOrdered(StatefulProcessor):
    """``inner`` with its rows in event-time order. ``key`` is the column of the inner processor's key (``key_type``: its SQL
    type), ``order`` are the columns to sort by, the first of them microseconds. An inner processor with a ``fold`` (see
    ``streaming.processors``) gets tuples, any other pandas frames."""

    def __init__(self, inner: StatefulProcessor, key: str, key_type: str, order: list[str]):
        self.inner, self.key, self.key_type, self.order = inner, key, key_type, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.view = handle, _InnerHandle()
        self.inner.init(self.view)
        self.waiting = handle.getListState("waiting", "first long, last long, chunk binary")
        # per key: the inner processor's timer and state
        self.held = handle.getMapState("held", f"{self.key} {self.key_type}",
                                       f"timer long, state array<struct<{self.view.schema}>>")
        # no inner timer of the shard is earlier than idle; rows before handed (microseconds) have been handed out
        self.shard = handle.getValueState("shard", "idle long, handed long")

    def handleInputRows(self, key, rows, timerValues):
        handed, first = self._known()[1], None
        for pdf in rows:
            chunks = list(zip(pdf["first"].tolist(), pdf["last"].tolist(), pdf["chunk"], strict=True))
            if handed is not None:
                chunks = [c for chunk in chunks for c in self._from(handed, chunk)]
            if chunks:
                self.waiting.appendList(chunks)
                low = min(c[0] for c in chunks)
                first = low if first is None else min(first, low)
        if first is not None:
            self._wake(first // 1000 + 1)
        yield from ()

    def _known(self) -> tuple:
        return self.shard.get() if self.shard.exists() else (None, None)

    def _from(self, us: int, chunk: tuple) -> list[tuple]:
        """The rows of ``chunk`` at ``us`` or later."""
        if chunk[0] >= us:
            return [chunk]
        if chunk[1] < us:
            return []
        rows = _unpacked(chunk[2])
        return _chunks(rows.filter(pc.greater_equal(rows[self.order[0]], us)), self.order[0])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = timerValues.getCurrentWatermarkInMs()
        chunks = [tuple(c) for c in self.waiting.get()]
        ready = sorted((c for c in chunks if c[0] < passed * 1000), key=lambda c: c[0], reverse=True)
        rest = [c for c in chunks if c[0] >= passed * 1000]
        handing, waited = bool(ready), bool(chunks)
        del chunks
        reached = {}  # per key: whether it has an entry in state, its timer and state by now
        done = self._handed(ready, rest, passed, reached, timerValues)
        yield from self._framed(done) if hasattr(self.inner, "fold") else self._gathered(done)
        if handing and rest:
            self.waiting.put(rest)
        elif waited and not rest:
            self.waiting.clear()
        idle = self._known()[0]
        left = [] if idle is None else [idle]
        if idle is not None and idle <= passed:
            timers = {k[0]: v for k, v in self.held.iterator() if v[0] is not None and k[0] not in reached}
            left = [v[0] for v in timers.values() if v[0] > passed]
            reached |= {k: (True, *v) for k, v in timers.items() if v[0] <= passed}
        lapsed = self._lapsed(reached, left, passed, timerValues, expiredTimerInfo)
        yield from self._framed(lapsed) if hasattr(self.inner, "fold") else self._gathered(lapsed)
        self.shard.update((int(min(left)) if left else None, passed * 1000))
        wakes = [int(t) for t in left] + [c[0] // 1000 + 1 for c in rest]
        if wakes:
            self._wake(min(wakes), passed)

    def _handed(self, ready: list, rest: list, passed: int, reached: dict, timerValues) -> Iterator:
        """What the inner processor makes of the rows of ``ready`` (chunks, the earliest at the end) that the watermark has
        ``passed`` (frames, or tuples if it folds); the others go to ``rest``. No chunk still to come has rows before those
        handed on, so what is out of its chunk at a time is bounded by how many chunks overlap in time."""
        time, some, size, most = self.order[0], [], 0, SORTED_ROWS
        while ready:
            some.append(_unpacked(ready.pop()[2]))
            size += some[-1].num_rows
            if ready and size < most:
                continue
            upto = min(passed * 1000, ready[-1][0]) if ready else passed * 1000
            rows = pa.concat_tables(some)
            before = pc.less(rows[time], upto)
            yield from self._by_key(rows.filter(before), reached, timerValues)
            some = [rows.filter(pc.invert(before))]
            size = some[0].num_rows
            most = max(SORTED_ROWS, 2 * size)
        if size:
            rest += _chunks(_sorted(some[0], [time]), time)

    def _by_key(self, rows: pa.Table, reached: dict, timerValues) -> Iterator:
        """What the inner processor makes of ``rows``, key by key; the keys' timers and states go to ``reached``."""
        if not rows.num_rows:
            return
        coded = rows[self.key].combine_chunks().dictionary_encode()
        keys = [*coded.dictionary.to_pylist(), None]
        numbers = pc.fill_null(coded.indices, len(keys) - 1)
        one = len(pc.unique(numbers)) == 1
        rows = _sorted(rows.append_column("key_no", numbers), [*([] if one else ["key_no"]), *self.order])
        numbers = rows["key_no"].to_numpy()
        starts = np.flatnonzero(np.diff(numbers, prepend=-1)).tolist()
        folds = hasattr(self.inner, "fold")
        if folds:
            given = list(zip(*[rows[c].to_pylist() for c in self.inner.FOLDED], strict=True))
        else:
            given = rows.drop_columns([self.key, "key_no"])
        for a, b in zip(starts, [*starts[1:], len(numbers)], strict=True):
            key = keys[numbers[a]]
            if key not in reached:
                known = self.held.getValue((key,))
                reached[key] = (False, None, None) if known is None else (True, *known)
            had, self.view.timer, state = reached[key]
            self.view.state.put(state or [])
            if folds:
                yield from self.inner.fold((key,), given[a:b])
            else:
                for start in range(a, b, HANDED_ROWS):
                    pdf = given.slice(start, min(HANDED_ROWS, b - start)).to_pandas()
                    yield from self.inner.handleInputRows((key,), iter([pdf]), timerValues)
            reached[key] = (had, self.view.timer, self.view.state.rows)

    def _lapsed(self, reached: dict, left: list, passed: int, timerValues, expiredTimerInfo) -> Iterator:
        """What the inner processor makes of the timers of keys ``reached`` that the watermark has ``passed``; the keys'
        entries are written, and their timers to come added to ``left``."""
        for key, (had, timer, state) in reached.items():
            self.view.timer = timer
            self.view.state.put(state or [])
            if timer is not None and timer <= passed:
                self.view.timer = None
                yield from self.inner.handleExpiredTimer((key,), timerValues, expiredTimerInfo)
            if self.view.timer is not None:
                left.append(self.view.timer)
            if self.view.timer is not None or self.view.state.exists():
                self.held.updateValue((key,), (self.view.timer, self.view.state.rows))
            elif had:
                self.held.removeKey((key,))

    def _framed(self, rows: Iterator[tuple]) -> Iterator[pd.DataFrame]:
        """Tuples of the inner processor's ``OUT`` as frames (of objects, so that no value is changed)."""
        while some := list(islice(rows, HANDED_ROWS)):
            yield pd.DataFrame(some, columns=list(self.inner.OUT), dtype=object)

    @staticmethod
    def _gathered(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The rows of ``parts`` in fewer frames; frames of different types stay apart, so that no value is changed."""
        some, n = [], 0
        for pdf in parts:
            if not len(pdf):
                continue
            if some and (n + len(pdf) > HANDED_ROWS or list(pdf.dtypes) != list(some[0].dtypes)):
                yield pd.concat(some, ignore_index=True)
                some, n = [], 0
            some.append(pdf)
            n += len(pdf)
        if some:
            yield pd.concat(some, ignore_index=True)

    def _wake(self, at: int, passed: int | None = None) -> None:
        """One timer a shard, at the earliest of what it waits for. While a timer is handled, it is still listed and goes
        afterwards: those that the watermark has ``passed`` don't count."""
        known = [t for t in self.handle.listTimers() if passed is None or t > passed]
        if known and min(known) <= at:
            return
        for old in known:
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at)

    def close(self) -> None:
        self.inner.close()


def in_event_time_order(rows: DataFrame, key: str, inner: StatefulProcessor, order: list[str], schema: str,
                        shards: int | None = None) -> DataFrame:
    """``inner``, keyed by ``key``, over watermarked ``rows`` in event-time order. ``order``: the columns to sort by, the
    first of them microseconds; the other columns but the key and the watermark's go to ``inner`` as well."""
    columns = [f.name for f in rows.schema.fields if f.dataType.typeName() != "timestamp"]
    shard = F.pmod(F.xxhash64(key), F.lit(shards or SHARDS)).cast("int").alias("shard_no")
    chunks = rows.select(shard, *columns).mapInArrow(
        _packer(order[0]), "shard_no int, first long, last long, chunk binary")
    return chunks.groupBy("shard_no").transformWithStateInPandas(
        EventTimeOrdered(inner, key, rows.schema[key].dataType.simpleString(), order), schema, "Append", "EventTime")


def watermarked(df: DataFrame, time: str, delay: str) -> DataFrame:
    """``df`` with a watermark ``delay`` behind ``time``; a closing row moves it and goes no further. (The filter reads the
    time column, so it stays behind the watermark.)"""
    return df.withWatermark(time, delay).where(F.col(time) < F.lit(CLOSING_TIME).cast("timestamp"))


def closing_row(df: DataFrame, time: str) -> DataFrame:
    """One row of ``df``'s columns, null but for ``time``: written behind the last data it ends a replay."""
    def value(field) -> Column:
        text = F.lit(CLOSING_TIME) if field.name == time else F.lit(None)
        return text.cast(field.dataType).alias(field.name)
    return df.sparkSession.range(1).select(*[value(f) for f in df.schema.fields])
