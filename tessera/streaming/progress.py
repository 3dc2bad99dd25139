"""Progress and end of streams, from what Spark reports of them."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

METRIC = "tiles"


def counted(stream: DataFrame) -> DataFrame:
    """The stream with its rows counted by Spark as they pass."""
    return stream.observe(METRIC, F.count("*").alias("n"))


class Progress(StreamingQueryListener):
    """Publishes (phase, done, total, unit) of one query: 0 of the total at its start, then after every batch, and once more at its end.

    Batches are told apart by their number, so a batch reported twice counts once.
    """

    def __init__(self, publish: Callable[[str, int, int, str], None], total: int, phase: str = "tiles", unit: str = "tiles", name: str | None = None):
        self.publish, self.total, self.phase, self.unit, self.name = publish, total, phase, unit, name
        self.batches: dict[int, int] = {}
        self.id = self.error = None
        self.ended = False

    @property
    def done(self) -> int:
        return sum(self.batches.values())

    def _tell(self) -> None:
        self.publish(self.phase, self.done, self.total, self.unit)

    def onQueryStarted(self, event) -> None:  # noqa: N802
        if self.id is None and (self.name is None or event.name == self.name):
            self.id = event.id
            self._tell()

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        if p.id == self.id:
            seen = (p.observedMetrics or {}).get(METRIC)
            self.batches[p.batchId] = int(seen["n"]) if seen is not None else max(p.numInputRows, 0)
            self._tell()

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        if event.id == self.id:
            self.error, self.ended = event.exception, True
            self._tell()


def await_end(query: StreamingQuery, every: float = 6.0, on_poll: Callable[[dict], None] | None = None, most: float | None = None) -> str:
    """Polls until the query ends (R10): 'completed', or 'running' where `most` seconds pass before. An error of the query is raised, the first failing tile's."""
    start = time.monotonic()
    while not query.awaitTermination(every if most is None else max(0.1, min(every, most - (time.monotonic() - start)))):
        if on_poll:
            on_poll(query.status)
        if most is not None and time.monotonic() - start >= most:
            return "running"
    return "completed"
