"""Keyed processes with timers over a changelog (batch form).

Each key's rows are scanned in arrival order with one state; before a row, event timers that are due by the watermark
it meets fire in order of time, and after the last row those due by the last watermark.  Timers that no
watermark reaches do not fire.  Timers belong to the key that sets them.  Processing timers compare with ``now_ms`` after every row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.accumulators import Accumulator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_TIME, PROCESSING_TIME = "event_time", "processing_time"
STATS = ("event_timer_set", "event_timer_fired", "processing_timer_set", "processing_timer_fired", "watermark_seen", "errors")
ERROR = "E"


def telemetry(spark: SparkSession) -> dict[str, Accumulator]:
    """Counters for ``Process.stats``; they count what tasks did, repeated attempts included."""
    return {name: spark.sparkContext.accumulator(0) for name in STATS}


class SingleTimer:
    """At most one event timer: setting it anew moves it."""

    def __init__(self) -> None:
        self.target: int | None = None

    def reschedule(self, ctx: Context, target: int) -> None:
        if self.target == target:
            return
        if self.target is not None:
            ctx.cancel_event_timer(self.target)
        self.target = target
        ctx.set_event_timer(target)

    def consumed(self) -> None:
        self.target = None


class Context:
    """What a callback may do: emit changelog rows, set and cancel timers of its key, forget its state."""

    def __init__(self, count: Callable[[str], None]) -> None:
        self.ts, self.out, self.cleared = 0, [], False
        self.event_timers: set[int] = set()
        self.processing_timers: set[int] = set()
        self._count = count

    def emit(self, value: tuple) -> None:
        self.out.append(("D", self.ts, value, None, None))

    def emit_retract(self, value: tuple) -> None:
        self.out.append(("R", self.ts, value, None, None))

    def emit_update(self, old: tuple, value: tuple) -> None:
        self.out.append(("U", self.ts, value, old, None))

    def emit_event(self, kind: str, ts: int, value: tuple, old: tuple | None = None) -> None:
        if kind not in ("D", "R", "U"):
            raise ValueError("kind is D, R or U")
        self.out.append((kind, ts, value, old, None))

    def clear_state(self) -> None:
        self.cleared = True

    def set_event_timer(self, at: int) -> None:
        self._count("event_timer_set")
        self.event_timers.add(int(at))

    def cancel_event_timer(self, at: int) -> None:
        self.event_timers.discard(int(at))

    def cancel_event_timers(self) -> None:
        self.event_timers.clear()

    def set_processing_timer(self, at: int) -> None:
        self._count("processing_timer_set")
        self.processing_timers.add(int(at))

    def cancel_processing_timer(self, at: int) -> None:
        self.processing_timers.discard(int(at))

    def cancel_processing_timers(self) -> None:
        self.processing_timers.clear()


@dataclass(frozen=True)
class Process:
    """Callbacks: on_event(ctx, key, state, value), on_timer(ctx, key, state, at, kind), and for withdrawals and corrections
    on_retract(ctx, key, state, value) and on_update(ctx, key, state, old, value).  Without them withdrawals are
    passed over and corrections count as their new values.  States are mutable objects made by ``init``.
    With ``on_error`` a callback's exception becomes a row of kind E with its text, and the scan goes on."""

    init: Callable[[], Any]
    on_event: Callable[..., None]
    on_timer: Callable[..., None] | None = None
    on_update: Callable[..., None] | None = None
    on_retract: Callable[..., None] | None = None
    on_error: bool = False
    now_ms: Callable[[], int] | None = None
    stats: dict[str, Accumulator] = field(default_factory=dict)


class _Key:
    def __init__(self, spec: Process, key: tuple) -> None:
        self.spec, self.key, self.state = spec, key if len(key) > 1 else key[0], None
        self.ctx = Context(self.count)

    def count(self, name: str) -> None:
        if name in self.spec.stats:
            self.spec.stats[name].add(1)

    def call(self, f: Callable[..., None], ts: int, *args: Any, guarded: bool = True) -> None:
        self.ctx.ts = ts
        if self.state is None:
            self.state = self.spec.init()
        try:
            f(self.ctx, self.key, self.state, *args)
        except Exception as e:  # noqa: BLE001 - handed on as a row
            if not (self.spec.on_error and guarded):
                raise
            self.count("errors")
            self.ctx.out.append((ERROR, ts, None, None, f"{type(e).__name__}: {e}"))
        if self.ctx.cleared:
            self.state, self.ctx.cleared = None, False

    def advance(self, wm: int) -> None:
        self.count("watermark_seen")
        due = sorted(t for t in self.ctx.event_timers if t <= wm)
        self.ctx.event_timers.difference_update(due)  # timers set while these fire wait for the next watermark
        for t in due:
            self.count("event_timer_fired")
            if self.spec.on_timer:
                self.call(self.spec.on_timer, t, t, EVENT_TIME, guarded=False)

    def row(self, kind: str, ts: int, value: Any, old: Any) -> None:
        if kind == "R":
            if self.spec.on_retract:
                self.call(self.spec.on_retract, ts, value)
        elif kind == "U" and self.spec.on_update:
            self.call(self.spec.on_update, ts, old, value)
        else:
            self.call(self.spec.on_event, ts, value)
        if self.ctx.processing_timers and self.spec.now_ms:
            now = self.spec.now_ms()
            due = sorted(t for t in self.ctx.processing_timers if t <= now)
            self.ctx.processing_timers.difference_update(due)
            for t in due:
                self.count("processing_timer_fired")
                if self.spec.on_timer:
                    self.call(self.spec.on_timer, t, t, PROCESSING_TIME, guarded=False)


def process_keyed(log: DataFrame, keys: Sequence[str], spec: Process, value: str) -> DataFrame:
    """Runs ``spec`` over ``log`` (keys, seq, ts, kind, value, old, and ``wm_before`` for event timers).

    ``value`` is the schema of emitted values, e.g. "level int, at long".  Gives keys, n (order within the key), kind, ts,
    value, old and error.  State is one object a key, carried from one Arrow batch to the next.
    """
    keys = list(keys)
    end = log.agg(F.max("ts").cast("long").alias("_end"))
    wm = F.col("wm_before") if "wm_before" in log.columns else F.lit(None)
    rows = log.join(F.broadcast(end)).select(*keys, "seq", F.col("ts").cast("long").alias("ts"), "kind", "value", "old", wm.cast("long").alias("_wm"), "_end")
    types = dict(log.dtypes)
    schema = ", ".join([*[f"`{k}` {types[k]}" for k in keys], f"n long, kind string, ts long, value struct<{_fields(value)}>, old struct<{_fields(value)}>, error string"])
    names = [part.strip().split()[0] for part in _split(value)]
    flush = "wm_before" in log.columns

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, held, n, last_end = None, None, 0, None
        out: list[tuple] = []

        def drain() -> None:
            nonlocal n
            for kind, ts, v, old, error in held.ctx.out:
                as_row = lambda x: None if x is None else dict(zip(names, x, strict=True))
                out.append((*current, n, kind, ts, as_row(v), as_row(old), error))
                n += 1
            held.ctx.out.clear()

        def close() -> None:
            if held is not None and flush and last_end is not None:
                held.advance(last_end)
                drain()

        for part in parts:
            columns = [part[c].tolist() for c in [*keys, "ts", "kind", "value", "old", "_wm", "_end"]]
            for *key, ts, kind, v, old, met, end_ in zip(*columns, strict=True):
                if held is None or tuple(key) != current:
                    close()
                    current, n = tuple(key), 0
                    held = _Key(spec, current)
                if met == met and met is not None:
                    held.advance(int(met))
                held.row(kind, int(ts), v, old)
                last_end = int(end_)
                drain()
            yield pd.DataFrame(out, columns=[*keys, "n", "kind", "ts", "value", "old", "error"])
            out.clear()
        close()
        if out:
            yield pd.DataFrame(out, columns=[*keys, "n", "kind", "ts", "value", "old", "error"])

    dealt = rows.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, "seq")
    return dealt.mapInPandas(run, schema)


def _split(value: str) -> list[str]:
    """Fields of a schema, cut at commas outside brackets."""
    out, depth = [""], 0
    for c in value:
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def _fields(value: str) -> str:
    return ", ".join(":".join(part.strip().split(None, 1)) for part in _split(value))
