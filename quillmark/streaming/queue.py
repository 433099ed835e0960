"""A queue with memory: pages that wait, that were claimed and given up, and how often each was tried.

Events of pages arrive as a stream; for each page the last state and the number
of attempts are kept. A claim starts a clock: if neither a result nor another
claim comes before it runs out, the page waits again, or fails once it has been
tried often enough. What changes is put out, so other streams can claim anew.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Events: a page was queued, claimed by a reader, read, or could not be read.
EVENTS = ("queued", "claimed", "done", "error")
OUT = "sheet_id string, status string, attempts int, reason string"
MEMORY = "status string, attempts int"


class Attempts(StatefulProcessor):
    """State of one page: pending, processing, done, error or failed, and its attempts."""

    def __init__(self, patience_ms: int, most: int):
        self.patience_ms, self.most = patience_ms, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.memory = handle.getValueState("memory", MEMORY)

    def _now(self) -> tuple[str | None, int]:
        held = self.memory.get() if self.memory.exists() else None
        return (held[0], held[1]) if held else (None, 0)

    def _put(self, key, status: str, attempts: int, reason: str) -> pd.DataFrame:
        self.memory.update((status, attempts))
        return pd.DataFrame({"sheet_id": [key[0]], "status": [status], "attempts": [attempts], "reason": [reason]})

    def _stop(self) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)

    def _again(self, key, attempts: int, reason: str) -> pd.DataFrame:
        return self._put(key, "pending" if attempts < self.most else "failed", attempts, reason)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = sorted((r.seq, r.event) for pdf in rows for r in pdf.itertuples(index=False))
        for _, event in events:
            status, attempts = self._now()
            if status in ("done", "failed"):
                continue
            if event == "queued":
                if status is None or status == "error":
                    yield self._again(key, attempts, event) if status == "error" else self._put(key, "pending", attempts, event)
            elif event == "claimed":
                self._stop()
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience_ms)
                yield self._put(key, "processing", attempts + 1, event)
            elif event == "done":
                self._stop()
                yield self._put(key, "done", max(attempts, 1), event)
            elif event == "error":
                self._stop()
                yield self._again(key, max(attempts, 1), event)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        status, attempts = self._now()
        if status == "processing":
            yield self._again(key, attempts, "stalled")

    def close(self) -> None:
        pass


def attempted(events: DataFrame, patience_seconds: float = 600, most: int = 3) -> DataFrame:
    """(sheet_id, status, attempts, reason): each change of a page from a stream of (sheet_id, seq, event).

    seq orders a page's events that arrive together. A claim is an attempt; a
    page whose claim brings nothing for ``patience_seconds`` waits again
    (reason stalled), or has failed after ``most`` attempts. An error puts it
    back likewise. Unknown events and null ids are left out; events of pages
    that are done or failed change nothing. State grows with the pages.
    """
    known = events.where(F.col("sheet_id").isNotNull() & F.col("event").isin(*EVENTS)).select(F.col("sheet_id").cast("string"), F.col("seq").cast("long"), "event")
    return known.groupBy("sheet_id").transformWithStateInPandas(Attempts(int(patience_seconds * 1000), most), outputStructType=OUT, outputMode="Update", timeMode="ProcessingTime")


def last_states(changes: DataFrame) -> DataFrame:
    """(sheet_id, status, attempts) as the changes that were put out leave them, from (sheet_id, status, attempts, batch)."""
    last = F.max(F.struct("batch", "attempts", F.col("status") != "processing", "status"))
    return changes.groupBy("sheet_id").agg(last.alias("l")).select("sheet_id", "l.status", "l.attempts")
