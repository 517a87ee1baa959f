"""Progress of a long run: a tracker that reports each new percentage once, and one fed by a streaming query."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

METRIC = "tracehound_progress"


class Update(NamedTuple):
    phase: str
    percent: int
    processed_bytes: int
    total_bytes: int
    eta_seconds: int | None
    message: str


class Tracker:
    """Counts bytes and calls back when the whole percentage grows."""

    def __init__(self, phase: str, total: int, callback: Callable[[Update], None], clock: Callable[[], float] = time.monotonic):
        self.phase, self.total, self.callback, self.clock = phase, max(total, 1), callback, clock
        self.begun, self.done, self.percent = clock(), 0, 0

    def add(self, size: int, message: str = "") -> None:
        self.done += size
        now = min(100, 100 * self.done // self.total)
        if now > self.percent:
            self.percent = now
            self._tell(self.done, message)

    def finish(self, message: str = "") -> None:
        self.percent = 100
        self._tell(self.total, message)

    def _tell(self, done: int, message: str) -> None:
        spent = self.clock() - self.begun
        left = max(self.total - done, 0)
        eta = int(left * spent / done + 0.5) if done and spent > 0 else None
        self.callback(Update(self.phase, self.percent, min(done, self.total), self.total, eta, message))


def observed(parts: DataFrame) -> DataFrame:
    """A stream of (content) that tells its listener how many bytes each batch held."""
    return parts.observe(METRIC, F.sum(F.octet_length("content")).alias("bytes"))


class Listener(StreamingQueryListener):
    """Feeds a tracker with the batches of an observed stream; spark.streams.addListener(Listener(tracker))."""

    def __init__(self, tracker: Tracker):
        self.tracker = tracker

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        seen = event.progress.observedMetrics.get(METRIC)
        if seen is not None and seen["bytes"]:
            self.tracker.add(seen["bytes"], f"batch {event.progress.batchId}")

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        if event.exception is None:
            self.tracker.finish()
