"""Streaming forms of the stateful operators, on transformWithState with event-time timers.

Input streams have key columns and a timestamp ``ts``, with a watermark.  Watermarks move per micro-batch, so
lateness and absence are judged at batch ends; results agree with the batch forms on in-order data.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def _millis(times: pd.Series) -> pd.Series:
    return times.dt.tz_localize(None).astype("datetime64[ms]").astype("int64") if getattr(times.dt, "tz", None) else times.astype("datetime64[ms]").astype("int64")


def process_keyed(df: DataFrame, keys: Sequence[str], processor: StatefulProcessor, schema: str, mode: str = "append", time: str = "EventTime") -> DataFrame:
    """A keyed process function.  One time mode per operator: EventTime or ProcessingTime."""
    return df.groupBy(*keys).transformWithStateInPandas(processor, outputStructType=schema, outputMode=mode, timeMode=time)


class Dedup(StatefulProcessor):
    """Greedy cool-down; state goes when the watermark passes the cool-down."""

    def __init__(self, keys: Sequence[str], cooldown: int) -> None:
        self.keys, self.cooldown = list(keys), cooldown

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else None
        for part in rows:
            part = part.sort_values("seq")
            keep = []
            for i, t in enumerate(_millis(part["ts"])):
                if last is None or t - last > self.cooldown:
                    keep.append(i)
                    last = int(t)
            if keep:
                yield part.iloc[keep]
        if last is not None:
            self.last.update((last,))
            for t in self.handle.listTimers():
                self.handle.deleteTimer(t)
            self.handle.registerTimer(last + self.cooldown + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


class Silence(StatefulProcessor):
    """'silent' at last + within, once per silence; 'resumed' at the event that ends it."""

    def __init__(self, keys: Sequence[str], within: int) -> None:
        self.keys, self.within = list(keys), within

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "last long, silent boolean")

    def _row(self, key, kind: str, ts: int) -> pd.DataFrame:
        return pd.DataFrame([(*key, kind, ts)], columns=[*self.keys, "kind", "ts"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, silent = self.state.get() if self.state.exists() else (None, False)
        for part in rows:
            for t in sorted(_millis(part["ts"]).tolist()):
                if silent:
                    silent = False
                    yield self._row(key, "resumed", t)
                last = t if last is None else max(last, t)
        self.state.update((last, silent))
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        self.handle.registerTimer(last + self.within)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, silent = self.state.get()
        if not silent:
            self.state.update((last, True))
            yield self._row(key, "silent", last + self.within)

    def close(self) -> None:
        pass


class SilenceAge(StatefulProcessor):
    """Age 0 at events, then the age at each tick of event time without one."""

    def __init__(self, keys: Sequence[str], tick: int) -> None:
        self.keys, self.tick = list(keys), tick

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else None
        for part in rows:
            times = sorted(_millis(part["ts"]).tolist())
            last = times[-1] if last is None else max(last, times[-1])
            yield pd.DataFrame([(*key, t, 0) for t in times], columns=[*self.keys, "ts", "age"])
        self.last.update((last,))
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        self.handle.registerTimer(last + self.tick)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        wm, last = timerValues.getCurrentWatermarkInMs(), self.last.get()[0]
        self.handle.registerTimer(wm + self.tick)
        yield pd.DataFrame([(*key, wm, wm - last)], columns=[*self.keys, "ts", "age"])

    def close(self) -> None:
        pass


class LatestValues(StatefulProcessor):
    """Latest-value join of tagged inputs: rows have src, value, kind (D, R, U); one snapshot per change."""

    def __init__(self, keys: Sequence[str], inputs: int) -> None:
        self.keys, self.inputs = list(keys), inputs

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.slots = handle.getMapState("slots", "src int", "value double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            out = []
            for src, value, kind, ts in part.sort_values("seq")[["src", "value", "kind", "ts"]].itertuples(index=False, name=None):
                k = (int(src),)
                if kind in ("D", "U"):
                    self.slots.updateValue(k, (float(value),))
                elif self.slots.containsKey(k) and self.slots.getValue(k)[0] == value:
                    self.slots.removeKey(k)
                else:
                    continue
                now = [self.slots.getValue((i,))[0] if self.slots.containsKey((i,)) else None for i in range(self.inputs)]
                out.append((*key, ts, *now))
            if out:
                yield pd.DataFrame(out, columns=[*self.keys, "ts", *[f"v{i}" for i in range(self.inputs)]])

    def close(self) -> None:
        pass


class AsOf(StatefulProcessor):
    """Left as-of join: tagged rows (src 0 versions, 1 main; value) wait until the watermark passes them."""

    def __init__(self, keys: Sequence[str]) -> None:
        self.keys = list(keys)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.versions = handle.getMapState("versions", "at long", "seq long, value double")
        self.waiting = handle.getMapState("waiting", "at long, seq long", "value double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            part = part.assign(at=_millis(part["ts"]))
            for src, at, seq, value in part[["src", "at", "seq", "value"]].itertuples(index=False, name=None):
                at, seq = int(at), int(seq)
                if src == 0:
                    if not self.versions.containsKey((at,)) or self.versions.getValue((at,))[0] <= seq:
                        self.versions.updateValue((at,), (seq, float(value)))
                else:
                    self.waiting.updateValue((at, seq), (float(value),))
                    self.handle.registerTimer(at + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs() - 1
        held = sorted((at[0], v[1]) for at, v in self.versions.iterator())
        for (at, seq), (value,) in sorted(self.waiting.iterator()):
            if at <= due:
                known = [v for t, v in held if t <= at]
                yield pd.DataFrame([(*key, at, seq, value, known[-1] if known else None)], columns=[*self.keys, "ts", "seq", "value", "version"])
                self.waiting.removeKey((at, seq))
        old = [t for t, _ in held if t <= due]
        for t in old[:-1]:  # the newest of these is still needed
            self.versions.removeKey((t,))

    def close(self) -> None:
        pass


class Alerts(StatefulProcessor):
    """A trigger's state machine per key; debounce runs on event-time timers."""

    def __init__(self, keys: Sequence[str], problem_for: int, recovery_for: int, check: Callable[[float], bool], recovery: Callable[[float], bool]) -> None:
        self.keys, self.waits, self.check, self.recovery = list(keys), (problem_for, recovery_for), check, recovery

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("machine", "state string, since long, last long, value double, alert_ts long, alert_value double")

    def _machine(self):
        from tidemark.operators.trigger import Machine

        m = Machine(*self.waits)
        if self.state.exists():
            m.state, m.since, m.last, m.value, at, v = self.state.get()
            m.alert = None if at is None else (at, v)
        return m

    def _save(self, key, m, made: list[tuple]) -> Iterator[pd.DataFrame]:
        self.state.update((m.state, m.since, m.last, m.value, *(m.alert or (None, None))))
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        if m.due() is not None:
            self.handle.registerTimer(m.due())
        if made:
            yield pd.DataFrame([(*key, *x) for x in made], columns=[*self.keys, "kind", "status", "ts", "value"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        m, made = self._machine(), []
        for part in rows:
            part = part.sort_values("seq")
            for t, v in zip(_millis(part["ts"]).tolist(), part["value"].tolist(), strict=True):
                made += m.on_time(t) + m.on_event(t, v, self.check(v), self.recovery(v))
        yield from self._save(key, m, made)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        m = self._machine()
        yield from self._save(key, m, m.on_time(expiredTimerInfo.getExpiryTimeInMs()))

    def close(self) -> None:
        pass


class Gate(StatefulProcessor):
    """Drops rows of the gated input (src 1) while the controller's last value (src 0: 1 on, 0 off) is on."""

    def __init__(self, keys: Sequence[str]) -> None:
        self.keys = list(keys)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.on = handle.getValueState("on", "on boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        on = bool(self.on.exists() and self.on.get()[0])
        for part in rows:
            part = part.sort_values(["ts", "src", "seq"])
            keep = []
            for i, (src, value) in enumerate(part[["src", "value"]].itertuples(index=False, name=None)):
                if src == 0:
                    on = value == 1
                elif not on:
                    keep.append(i)
            if keep:
                yield part.iloc[keep]
        self.on.update((on,))

    def close(self) -> None:
        pass


class SingleTimer:
    """One moving timer of a key."""

    def __init__(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def target(self) -> int | None:
        return next(iter(self.handle.listTimers()), None)

    def reschedule(self, at: int) -> None:
        self.cancel()
        self.handle.registerTimer(at)

    def cancel(self) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
