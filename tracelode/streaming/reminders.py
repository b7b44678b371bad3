"""A reminder after enough work: keyed state with a timer, which no window expresses."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Work items, and milliseconds after the first, that make a reminder due.
MOST_ITEMS, MOST_WAIT = 10, 1_800_000
OUT = "session_id long, fired_ms long, n_items long, why string"


class Reminder(StatefulProcessor):
    """Counts the items of a session; fires at MOST_ITEMS, at a commit, or by a timer MOST_WAIT after the first."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("open", "n long, first_ms long")

    def _fire(self, key, at: int, n: int, why: str) -> pd.DataFrame:
        self.state.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        return pd.DataFrame({"session_id": [key[0]], "fired_ms": [at], "n_items": [n], "why": [why]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            for ms, commit in part.sort_values("ms")[["ms", "is_commit"]].itertuples(index=False):
                n, first = self.state.get() if self.state.exists() else (0, int(ms))
                n += 1
                if commit or n >= MOST_ITEMS:
                    yield self._fire(key, int(ms), n, "commit" if commit else "count")
                    continue
                self.state.update((n, first))
                if n == 1:
                    self.handle.registerTimer(first + MOST_WAIT)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            n, _ = self.state.get()
            yield self._fire(key, expiredTimerInfo.getExpiryTimeInMs(), n, "time")

    def close(self) -> None:
        pass


def reminders(items: DataFrame) -> DataFrame:
    """OUT rows of a stream of (session_id, at, ms, is_commit) with a watermark on ``at``. Needs the RocksDB state store."""
    return items.groupBy("session_id").transformWithStateInPandas(Reminder(), OUT, "append", "eventTime")
