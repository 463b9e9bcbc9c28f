"""Keyed state processors for the stream versions of T1-T4 (``transformWithStateInPandas``).

Rows of one key inside a micro-batch are handled in (timestamp, id) order; across micro-batches the order is the
arrival order, as in the reference's consumers. State per key is small and bounded: a counter, or at most
``threshold - 1`` buffered events for the brute-force rule.

The rules whose keys are many with few rows each (T3, T4) fold plain tuples: ``fold(key, rows)`` takes tuples of
``FOLDED``, sorted by the first two, and returns tuples of ``OUT``. A pandas frame a key costs more than its rows.
"""

from __future__ import annotations

import time

import numpy as np
import pandas as pd
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from incidentry.constants import SEVERITY_HIGH
from incidentry.session import pickle_by_value

pickle_by_value(__name__)  # processors are unpickled by Python workers and by Spark's driver-side runner


def _rows(rows, order, in_order=False):
    pdf = pd.concat(list(rows), ignore_index=True)
    return pdf if in_order else pdf.sort_values(list(order), kind="mergesort").reset_index(drop=True)


class RunningErrorCount(StatefulProcessor):
    """Per source, the number of error messages (rows with ``error``) so far; one output row per input row.
    ``in_order``: rows come sorted."""

    def __init__(self, time: str = "timestamp", in_order: bool = False):
        self.time, self.in_order = time, in_order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows, timerValues):
        pdf = _rows(rows, [self.time, "id"], self.in_order)
        start = self.count.get()[0] if self.count.exists() else 0
        cum = start + pdf["error"].astype("int64").cumsum()
        self.count.update((int(cum.iloc[-1]),))
        yield pd.DataFrame({"id": pdf["id"], self.time: pdf[self.time], "source": key[0],
                            "error_count": cum.astype("int64")})

    def close(self) -> None:
        pass


class EventCounter(StatefulProcessor):
    """Count per key; high → instant, otherwise accumulated from the ``threshold``-th event on.

    With ``idle_seconds`` (event-time mode) a key's counter is dropped once the key has had no event for that long, so
    state does not grow with every key ever seen; without it the counter is kept forever, as in the application.
    ``in_order``: rows come sorted."""

    def __init__(self, threshold: int = 3, idle_seconds: int | None = None, time: str = "timestamp",
                 in_order: bool = False):
        self.threshold, self.time, self.in_order = threshold, time, in_order
        self.idle_ms = None if idle_seconds is None else idle_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows, timerValues):
        pdf = _rows(rows, [self.time, "id"], self.in_order)
        start = self.count.get()[0] if self.count.exists() else 0
        n = start + np.arange(1, len(pdf) + 1)
        self.count.update((int(n[-1]),))
        if self.idle_ms is not None:
            for old in self.handle.listTimers():
                self.handle.deleteTimer(old)
            self.handle.registerTimer(int(pdf["event_us"].max()) // 1000 + self.idle_ms)
        high = (pdf["severity"] == SEVERITY_HIGH).to_numpy()
        rule = np.where(high, "instant", np.where(n >= self.threshold, "accumulated", None))
        fired = rule != None  # noqa: E711 (element-wise)
        out = pdf.loc[fired, ["id", self.time, "description"]].copy()
        out["key"] = None if key[0] is None else str(key[0])
        out["rule"] = rule[fired]
        yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.count.clear()
        none = pd.Series([], dtype="datetime64[us]" if self.time == "timestamp" else "int64")
        yield pd.DataFrame({"id": pd.Series([], dtype=object), self.time: none,
                            "description": pd.Series([], dtype=object), "key": pd.Series([], dtype=object),
                            "rule": pd.Series([], dtype=object)})

    def close(self) -> None:
        pass


class BruteForce(StatefulProcessor):
    """Buffer of (ts, id) per key, pruned by age, emptied when it reaches ``threshold``.

    ``time_mode="event"``: an event's age is measured against the newest event (exact on replay); a timer one window
    after the key's last event clears the buffer. ``time_mode="processing"``: ages are measured against the wall
    clock when the rows are handled, as the reference does with ``now()`` (no timers: Spark's processing-time mode
    does not let an ``availableNow`` query finish here, and stale entries are dropped on the key's next event)."""

    FOLDED, OUT = ("event_us", "id"), ("trigger_id", "trigger_us", "ids", "key")

    def __init__(self, window_seconds: int = 60, threshold: int = 10, time_mode: str = "event"):
        self.window_us = window_seconds * 1_000_000
        self.k = threshold
        self.processing = time_mode == "processing"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.buf = handle.getListState("buf", "ts long, id string")

    def handleInputRows(self, key, rows, timerValues):
        pdf = _rows(rows, ["event_us", "id"])
        yield pd.DataFrame(self.fold(key, zip(pdf["event_us"].tolist(), pdf["id"], strict=True)), columns=self.OUT)

    def fold(self, key, rows) -> list[tuple]:
        buf = [(int(t), str(i)) for t, i in self.buf.get()] if self.buf.exists() else []
        fires = []
        now = int(time.time() * 1_000_000) if self.processing else None  # the wall clock, as the reference
        for t, i in rows:
            ref = now if self.processing else t
            buf = [(bt, bi) for bt, bi in buf if ref - bt < self.window_us]
            buf.append((t, str(i)))
            if len(buf) >= self.k:
                fires.append((str(i), t, [bi for _, bi in buf], str(key[0])))
                buf = []
        if buf:
            self.buf.put(buf)
            if not self.processing:
                for old in self.handle.listTimers():
                    self.handle.deleteTimer(old)
                self.handle.registerTimer(buf[-1][0] // 1000 + self.window_us // 1000)
        else:
            self.buf.clear()
        return fires

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.buf.clear()
        yield from ()

    def close(self) -> None:
        pass


class LoginCounter(StatefulProcessor):
    """T4: failures per known user; a success clears; the counter lapses ``ttl`` after the last failure.

    The lapse is checked on event time, and (in event-time mode) a timer at last-attempt + ttl drops the state of
    idle users, as the reference's expiring counter does."""

    FOLDED, OUT = ("event_us", "attempt_id", "password_ok"), ("attempt_id", "attempts")

    def __init__(self, ttl_seconds: int | None = 3600):
        self.ttl_us = None if ttl_seconds is None else ttl_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("attempts", "n long, last_us long")

    def handleInputRows(self, key, rows, timerValues):
        pdf = _rows(rows, ["event_us", "attempt_id"])
        done = self.fold(key, zip(pdf["event_us"].tolist(), pdf["attempt_id"], pdf["password_ok"], strict=True))
        yield pd.DataFrame({"attempt_id": pdf["attempt_id"], "attempts": np.array([n for _, n in done], dtype="int64")})

    def fold(self, key, rows) -> list[tuple]:
        n, last = (self.state.get() if self.state.exists() else (0, None))
        out = []
        for us, attempt_id, ok in rows:
            if ok:
                n, last = 0, us
            else:
                if last is None or n == 0 or (self.ttl_us is not None and us - last >= self.ttl_us):
                    n = 0
                n, last = n + 1, us
            out.append((attempt_id, n))
        if n == 0:
            self.state.clear()
        else:
            self.state.update((int(n), int(last)))
            if self.ttl_us is not None:
                for old in self.handle.listTimers():
                    self.handle.deleteTimer(old)
                self.handle.registerTimer((last + self.ttl_us) // 1000)
        return out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.state.clear()
        yield from ()

    def close(self) -> None:
        pass
