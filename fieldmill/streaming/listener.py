"""Tells what a scoring stream does, step by step."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql.streaming import StreamingQueryListener


class StepListener(StreamingQueryListener):
    """Calls scored(step) for every step when its batch is done, each step once, and failed(message)
    when a stream breaks off. Give it to spark.streams.addListener and its note to score_stream's
    on_step, which tells it a batch's new metrics. Streams that it wasn't told of are left alone."""

    def __init__(self, scored: Callable[[int], None], failed: Callable[[str], None] | None = None):
        self.scored, self.failed = scored, failed or (lambda message: None)
        self.noted: dict[int, list[int]] = {}
        self.told: set[int] = set()

    def note(self, metrics, number: int) -> None:
        """The steps of a batch's new metrics (a bounded table: the steps that one batch has scored)."""
        self.noted[number] = sorted(r.step for r in metrics.select("step").distinct().collect())

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        for step in self.noted.pop(event.progress.batchId, []):
            if step not in self.told:
                self.told.add(step)
                self.scored(step)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            self.failed(event.exception)
