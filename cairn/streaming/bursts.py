"""Debounced bursts of file events with their refresh points, in keyed state with timers.

Events of a root gather in state until none has come for a quiet time; then a timer lets the burst out, one row a path. When a costly refresh is due, at the first burst,
after so many seconds or after so many bursts, is state of the root as well, so a stream that is stopped and started again goes on as if it had not been.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

BURST = "root string, path string, op string, burst long, refresh boolean"


class Bursts(StatefulProcessor):
    """State of a root: pending paths with whether they changed, when the burst ends, bursts so far, the last refresh and the bursts since."""

    def __init__(self, quiet_ms: int, refresh_ms: int, refresh_bursts: int):
        self._quiet, self._refresh, self._bursts = quiet_ms, refresh_ms, refresh_bursts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._pending = handle.getMapState("pending", "path string", "changed boolean")
        self._times = handle.getValueState("times", "ends long, number long, refreshed long, since long")

    def _let_out(self, root: str, ends: int, number: int, refreshed: int, since: int) -> tuple[pd.DataFrame, int, int]:
        """(the rows of the burst that ends then, the last refresh, the bursts since); nothing is pending behind it."""
        due = refreshed < 0 or ends - refreshed >= self._refresh or since + 1 >= self._bursts
        found = sorted((k[0], v[0]) for k, v in self._pending.iterator())
        self._pending.clear()
        rows = pd.DataFrame([(root, p, "changed" if c else "deleted", number, due) for p, c in found], columns=["root", "path", "op", "burst", "refresh"], dtype=object)
        return rows, ends if due else refreshed, 0 if due else since + 1

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ends, number, refreshed, since = self._times.get() if self._times.exists() else (-1, 0, -1, 0)
        timer = ends
        for path, op, at in sorted((r for pdf in rows for r in zip(pdf["path"], pdf["op"], pdf["at"], strict=True)), key=lambda r: (r[2], r[0])):
            if 0 <= ends < at:  # the burst was over before this event
                out, refreshed, since = self._let_out(key[0], ends, number, refreshed, since)
                ends, number = -1, number + 1
                yield out
            if not self._pending.containsKey((path,)) or op == "changed":
                self._pending.updateValue((path,), (op == "changed",))
            ends = max(ends, int(at) + self._quiet)
        if timer != ends:
            if timer >= 0:
                self._handle.deleteTimer(timer + 1)
            self._handle.registerTimer(ends + 1)
        self._times.update((ends, number, refreshed, since))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ends, number, refreshed, since = self._times.get()
        out, refreshed, since = self._let_out(key[0], ends, number, refreshed, since)
        self._times.update((-1, number + 1, refreshed, since))
        yield out

    def close(self) -> None:
        pass


def bursts(events: DataFrame, quiet_ms: int = 500, refresh_seconds: float = 30, refresh_bursts: int = 32, late: str = "0 seconds") -> DataFrame:
    """(root, path, op, burst, refresh) of a stream of events (root, path, op, event_time): a burst ends once `quiet_ms` pass in event time without an event of its root.

    A path both changed and deleted in a burst counts as changed. `refresh` says that a costly refresh is due behind the burst. Events later than the watermark
    are dropped by it. Needs the RocksDB state store.
    """
    rows = events.withWatermark("event_time", late).selectExpr("root", "path", "op", "unix_millis(event_time) AS at", "event_time")
    return rows.groupBy("root").transformWithStateInPandas(Bursts(quiet_ms, int(refresh_seconds * 1000), refresh_bursts), BURST, "Append", "EventTime")
