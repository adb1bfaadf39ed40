"""Taps on a pipeline: counters, samples and missing-watermark warnings, without extra passes over the data."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

log = logging.getLogger("tidemark")


def with_counter(df: DataFrame, name: str = "rows") -> tuple[DataFrame, Observation]:
    """``df`` and an observation whose ``get[name]`` is its row count once an action on it has run.

    On a stream the count comes with each batch's progress (``observedMetrics``)."""
    seen = Observation(f"counter_{name}")
    return df.observe(seen if not df.isStreaming else f"counter_{name}", F.count(F.lit(1)).alias(name)), seen


def inspect(df: DataFrame, label: str = "", **metrics: Column) -> tuple[DataFrame, Observation]:
    """Passes rows through and observes ``metrics`` (rows, withdrawals and corrections by default)."""
    if not metrics:
        kinds = {n: F.count_if(F.col("kind") == k) for n, k in (("data", "D"), ("retract", "R"), ("update", "U"))} if "kind" in df.columns else {}
        metrics = {"rows": F.count(F.lit(1)), **kinds}
    seen = Observation(f"inspect_{label}")
    return df.observe(seen if not df.isStreaming else f"inspect_{label}", *[c.alias(n) for n, c in metrics.items()]), seen


def window_instrumented(results: DataFrame, fired_at: Column, win_end: str = "win_end") -> tuple[DataFrame, Observation]:
    """Observes how long after its end each window's result came out (ms): count, mean and maximum."""
    wait = fired_at - F.col(win_end)
    return inspect(results, "window_ms", windows=F.count(F.lit(1)), mean_ms=F.avg(wait), max_ms=F.max(wait))


class WatermarkDiagnostics(StreamingQueryListener):
    """Warns of stateful streams that read rows without a watermark, and of windows whose rows are all late.

    Register with ``spark.streams.addListener``.  ``warn`` gets one message per query and cause."""

    def __init__(self, rows: int = 10_000, warn: Callable[[str], None] = log.warning) -> None:
        self.rows, self.warn, self._seen, self._told = rows, warn, {}, set()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self._seen[str(event.id)] = 0

    def onQueryIdle(self, event) -> None:  # noqa: N802
        return None

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self._seen.pop(str(event.id), None)

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        self.check(str(p.id), p.name or str(p.id), p.numInputRows, dict(p.eventTime or {}), [(s.numRowsTotal, s.numRowsDroppedByWatermark) for s in p.stateOperators])

    def check(self, query: str, name: str, rows: int, event_time: dict, states: list[tuple[int, int]]) -> None:
        self._seen[query] = seen = self._seen.get(query, 0) + rows
        if not states:
            return
        if seen >= self.rows and "watermark" not in event_time:
            self._tell(query, "watermark", f"{name}: {seen} rows went into stateful operators without a watermark; their windows and timers never fire. Declare event time before them")
        if rows >= self.rows and all(dropped >= rows for _, dropped in states):
            self._tell(query, "late", f"{name}: all {rows} rows of a batch came after the watermark; check time units and lateness")

    def _tell(self, query: str, cause: str, message: str) -> None:
        if (query, cause) not in self._told:
            self._told.add((query, cause))
            self.warn(message)
