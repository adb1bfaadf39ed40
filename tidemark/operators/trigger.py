"""Alert triggers: check and recovery conditions, debounce, and a four-state machine per key.

States: ok, pending_problem, problem, pending_ok.  A problem starts when ``check`` holds for ``problem_for``;
it ends when ``recovery`` holds for ``recovery_for``.  Ending withdraws the alert (R, at the alert's time)
and adds a recovery (D).  Between the two conditions (hysteresis) a problem stays a problem, and a pending
problem is dropped.

Where check and recovery never hold together, the machine has a closed form (``of_stream``, ``combine``): every
row says whether a run of checks, or a recovery after one, has lasted by now, and what changes the status
is kept.  Streams, and conditions that overlap, run the machine itself.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import not_negative, positive
from tidemark.operators.scan import ordered_scan

SEVERITIES = ("not_classified", "information", "warning", "average", "high", "disaster")
Predicate = Callable[[Column], Column]


@dataclass(frozen=True)
class Condition:
    check: Predicate
    recovery: Predicate
    exclusive: bool = True


def _complement(p: Predicate) -> Condition:
    return Condition(p, lambda v: ~p(v))


def greater_than(t: float) -> Condition:
    return _complement(lambda v: v > t)


def less_than(t: float) -> Condition:
    return _complement(lambda v: v < t)


def greater_than_with_hysteresis(problem: float, recovery: float) -> Condition:
    return Condition(lambda v: v > problem, lambda v: v < recovery)


def less_than_with_hysteresis(problem: float, recovery: float) -> Condition:
    return Condition(lambda v: v < problem, lambda v: v > recovery)


def is_some() -> Condition:
    return Condition(lambda v: v.isNotNull(), lambda v: v.isNull())


def is_none() -> Condition:
    return Condition(lambda v: v.isNull(), lambda v: v.isNotNull())


def custom(check: Predicate, recovery: Predicate | None = None) -> Condition:
    return _complement(check) if recovery is None else Condition(check, recovery, exclusive=False)


@dataclass(frozen=True)
class Trigger:
    name: str
    condition: Condition
    severity: str = "not_classified"
    problem_for: int = 0
    recovery_for: int = 0

    def __post_init__(self) -> None:
        if self.severity not in SEVERITIES:
            raise ValueError(f"severity is one of {SEVERITIES}")
        not_negative("problem_for", self.problem_for)
        not_negative("recovery_for", self.recovery_for)


def default_config(name: str, condition: Condition) -> Trigger:
    return Trigger(name, condition, "warning")


class Machine:
    """The state of one key.  ``on_event`` and ``on_time`` return (kind, status, ts, value) tuples."""

    def __init__(self, problem_for: int, recovery_for: int) -> None:
        self.problem_for, self.recovery_for = problem_for, recovery_for
        self.state, self.since, self.last, self.value = "ok", 0, None, None
        self.alert: tuple[int, object] | None = None

    def due(self) -> int | None:
        wait = {"pending_problem": self.problem_for, "pending_ok": self.recovery_for}.get(self.state)
        return None if wait is None else self.since + wait

    def _raise(self, ts: int) -> list[tuple]:
        self.state, self.alert = "problem", (ts, self.value)
        return [("D", "problem", ts, self.value)]

    def _clear(self, ts: int) -> list[tuple]:
        (at, value), self.alert, self.state = self.alert, None, "ok"
        return [("R", "problem", at, value), ("D", "ok", ts, self.value)]

    def on_time(self, wm: int) -> list[tuple]:
        due = self.due()
        if due is None or due > wm:
            return []
        return self._raise(due) if self.state == "pending_problem" else self._clear(due)

    def on_event(self, ts: int, value: object, check: bool, recovery: bool) -> list[tuple]:
        if self.last is not None and ts < self.last:
            return []
        self.last = ts
        if self.state == "ok" and check:
            self.value, self.state, self.since = value, "pending_problem", ts
            return self._raise(ts) if self.problem_for == 0 else []
        if self.state == "pending_problem":
            if not check:
                self.state = "ok"
                return []
            self.value = value
            return self._raise(ts) if ts >= self.since + self.problem_for else []
        if self.state == "problem" and recovery:
            self.value, self.state, self.since = value, "pending_ok", ts
            return self._clear(ts) if self.recovery_for == 0 else []
        if self.state == "pending_ok":
            if check:
                self.state = "problem"
                return []
            if recovery:
                self.value = value
                return self._clear(ts) if ts >= self.since + self.recovery_for else []
        return []


RESULT = "trigger string, severity string, kind string, status string, ts long, value double"


def _machine(df: DataFrame, keys: Sequence[str], ts: str, seq: str, value: str, trigger: Trigger, ttl: int | None) -> DataFrame:
    """The state machine itself, row by row."""
    flag = lambda p: F.coalesce(p(F.col(value)), F.lit(False))
    wm = F.col("wm_before") if "wm_before" in df.columns else F.lit(None).cast("long")
    end = df.agg(F.max(ts).alias("_end"))
    rows = df.join(F.broadcast(end)).select(
        *keys, F.col(ts).alias("_ts"), F.col(seq).alias("_seq"), F.col(value).cast("double").alias("_value"),
        flag(trigger.condition.check).alias("_check"), flag(trigger.condition.recovery).alias("_recovery"), wm.alias("_wm"), "_end",
    )
    label = (trigger.name, trigger.severity)

    def step(machine, part):
        out = []
        for row in part.itertuples(index=False):
            key, (at, _, v, check, recovery, met, end_) = tuple(row[: len(keys)]), row[len(keys) :]
            if machine is None:
                machine = Machine(trigger.problem_for, trigger.recovery_for)
            if met == met and met is not None:
                out += [(*key, *label, *x) for x in machine.on_time(int(met))]
                if ttl is not None and machine.state == "ok" and machine.last is not None and machine.last < met - ttl:
                    machine.last = None
            out += [(*key, *label, *x) for x in machine.on_event(int(at), v, bool(check), bool(recovery))]
            machine.end = int(end_)
        return machine, out

    def finish(key, machine):
        return [(*key, *label, *x) for x in machine.on_time(machine.end)]

    types = dict(df.dtypes)
    return ordered_scan(rows, keys, ["_seq"], step, ", ".join([*[f"`{k}` {types[k]}" for k in keys], RESULT]), finish)


def of_stream(df: DataFrame, keys: Sequence[str], ts: str, seq: str, value: str, trigger: Trigger, ttl: int | None = None) -> DataFrame:
    """Changelog of alerts.  ``df`` has ``wm_before`` when the trigger debounces; the last watermark (the largest
    time) also fires what is due.  Rows older than their key's last are dropped.  ``ttl`` forgets keys that are ok.
    """
    if ttl is not None:
        positive("ttl", ttl)
    if ttl is not None or not trigger.condition.exclusive:
        return _machine(df, keys, ts, seq, value, trigger, ttl)
    return changes(df, keys, ts, seq, value, [trigger]).drop("at")


def spec(trigger: Trigger, value: str) -> Column:
    """What ``candidates`` reads of a trigger: trigger, severity, check, rec, pf, rf."""
    flag = lambda p: F.coalesce(p(F.col(value)), F.lit(False))
    times = F.lit(trigger.problem_for).cast("long").alias("pf"), F.lit(trigger.recovery_for).cast("long").alias("rf")
    return F.struct(F.lit(trigger.name).alias("trigger"), F.lit(trigger.severity).alias("severity"), flag(trigger.condition.check).alias("check"), flag(trigger.condition.recovery).alias("rec"), *times)


def candidates(rows: DataFrame, part: Sequence[str]) -> DataFrame:
    """Adds ``_found``: array of (pos, status, ts, value), the changes of status that a row shows, or null.

    ``rows`` has _ts, _seq, _v, _wm, _end and the fields of ``spec``.  Rows older than their key's last stay, and show
    nothing but what is due at the end, so that other detectors can read the same rows beside this one.
    """
    order = Window.partitionBy(*part).orderBy("_seq")
    before, so_far = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = lambda c, frame: F.last(c, ignorenulls=True).over(frame)
    rows = rows.select("*", F.max("_ts").over(before).alias("_top"), F.lead("_seq").over(order).isNull().alias("_last"))
    rows = rows.withColumn("_on", F.col("_top").isNull() | (F.col("_ts") >= F.col("_top")))
    check, rec = F.col("_on") & F.col("check"), F.col("_on") & F.col("rec") & ~F.col("check")
    mark = F.when(check, 1).when(rec, 2)
    rows = rows.select("*", F.coalesce(last(F.when(F.col("_on"), F.col("check")), before), F.lit(False)).alias("_was"), last(mark, before).alias("_mark"))
    starts, recovers = check & ~F.col("_was"), rec & F.col("_mark").isNotNull()
    # what a new run of checks takes back becomes null with its first row
    first = F.when(starts, F.struct(F.lit(None).cast("long").alias("x"))).when(recovers & (F.col("_mark") == 1), F.struct(F.col("_ts").alias("x")))
    newest = F.when(starts, F.struct(F.lit(None).cast("double").alias("x"))).when(recovers, F.struct(F.col("_v").alias("x")))
    rows = rows.select(
        "*", last(F.when(starts, F.col("_ts")), so_far).alias("_since"), last(F.when(check, F.struct("_v")), before).alias("_held"),
        last(first, so_far)["x"].alias("_rs"), last(newest, so_far)["x"].alias("_rv"), last(first, before)["x"].alias("_prs"), last(newest, before)["x"].alias("_prv"),
    )

    none = F.lit(None).cast("struct<pos:int,status:string,ts:bigint,value:double>")
    event = lambda pos, status, at, v: F.struct(F.lit(pos).alias("pos"), F.lit(status).alias("status"), at.alias("ts"), v.alias("value"))
    due, rdue, prdue = F.col("_since") + F.col("pf"), F.col("_rs") + F.col("rf"), F.col("_prs") + F.col("rf")
    checked, value = F.when(F.col("_on"), F.col("check")).otherwise(F.col("_was")), F.when(check, F.col("_v")).otherwise(F.col("_held._v"))
    found = [
        F.when(F.col("_on") & F.col("_was") & (F.col("_wm") >= due) & (F.col("pf") > 0), event(0, "problem", due, F.col("_held._v"))).when(F.col("_on") & (F.col("_wm") >= prdue) & (F.col("rf") > 0), event(0, "ok", prdue, F.col("_prv"))),
        F.when(check & (F.col("_ts") >= due), event(1, "problem", F.col("_ts"), F.col("_v"))).when(recovers & (F.col("_ts") >= rdue), event(1, "ok", F.col("_ts"), F.col("_v"))),
        F.when(F.col("_last") & checked & (F.col("_end") >= due), event(2, "problem", due, value)).when(F.col("_last") & ~checked & (F.col("_end") >= rdue), event(2, "ok", rdue, F.col("_rv"))),
    ]
    rows = rows.withColumns({f"_x{i}": x.otherwise(none) for i, x in enumerate(found)})
    shows = F.coalesce("_x0", "_x1", "_x2").isNotNull()
    scratch = ["_top", "_last", "_on", "_was", "_mark", "_since", "_held", "_rs", "_rv", "_prs", "_prv", "_x0", "_x1", "_x2"]
    return rows.withColumn("_found", F.when(shows, F.array_compact(F.array("_x0", "_x1", "_x2")))).drop(*scratch)


def changes(df: DataFrame, keys: Sequence[str], ts: str, seq: str, value: str, triggers: Sequence[Trigger], end: DataFrame | None = None) -> DataFrame:
    """All ``triggers`` (of exclusive conditions) in one scan and one shuffle; ``at`` is when a row comes out.
    ``end`` (column ``_end``) is the latest time, read from ``df`` unless given.

    An alert is due ``problem_for`` after the first row of a run of checks, its recovery ``recovery_for`` after the first
    recovery behind the run; a row shows that the time is over by its own time or by the watermark it meets.  Of
    all that are over, those that change the status count.
    """
    wm = F.col("wm_before") if "wm_before" in df.columns else F.lit(None)
    specs = [spec(t, value) for t in triggers]
    rows = df.select(*keys, F.col(ts).cast("long").alias("_ts"), F.col(seq).alias("_seq"), F.col(value).cast("double").alias("_v"), wm.cast("long").alias("_wm"), (F.explode(F.array(*specs)) if len(specs) > 1 else specs[0]).alias("_s"))
    end = df.agg(F.max(ts).cast("long").alias("_end")) if end is None else end
    rows = rows.select(*keys, "_ts", "_seq", "_v", "_wm", "_s.*").join(F.broadcast(end))
    part = [*keys, "trigger"] if len(specs) > 1 else list(keys)
    steps = candidates(rows, part).where("_found IS NOT NULL").select(*keys, "trigger", "severity", "_seq", F.explode("_found").alias("x")).select(*keys, "trigger", "severity", "_seq", "x.*")
    part = [*keys, "trigger"]
    order = Window.partitionBy(*part).orderBy("_seq", "pos")
    kept = steps.withColumn("_before", F.coalesce(F.lag("status").over(order), F.lit("ok"))).where("status <> _before")
    kept = kept.withColumn("_at", F.lag("ts").over(order)).withColumn("_av", F.lag("value").over(order))
    out = lambda kind, status, at, v: F.struct(F.lit(kind).alias("kind"), status.alias("status"), at.alias("ts"), v.alias("value"))
    here = out("D", F.col("status"), F.col("ts"), F.col("value"))
    pieces = F.when(F.col("status") == "ok", F.array(out("R", F.lit("problem"), F.col("_at"), F.col("_av")), here)).otherwise(F.array(here))
    return kept.select(*part, "severity", F.col("ts").alias("at"), F.explode(pieces).alias("y")).select(*part, "severity", "y.*", "at")


def edges(df: DataFrame, keys: Sequence[str], ts: str, seq: str, value: str, trigger: Trigger) -> DataFrame:
    """A trigger without debounce inside the JVM, for rows whose times rise with ``seq``: keys, status, ts, value.

    With hysteresis the state is that of the last row that met either condition.
    """
    if trigger.problem_for or trigger.recovery_for:
        raise ValueError("edges are for triggers without debounce")
    c, v = trigger.condition, F.col(value)
    state = F.when(c.check(v), "problem").when(c.recovery(v), "ok")
    order = Window.partitionBy(*keys).orderBy(seq)
    rows = df.withColumn("_state", state).where("_state IS NOT NULL")
    rows = rows.withColumn("_was", F.coalesce(F.lag("_state").over(order), F.lit("ok"))).where("_state <> _was")
    return rows.select(*keys, F.lit(trigger.name).alias("trigger"), F.col("_state").alias("status"), F.col(ts).alias("ts"), v.alias("value"))


def combine(df: DataFrame, keys: Sequence[str], ts: str, seq: str, value: str, triggers: Sequence[Trigger]) -> DataFrame:
    """All triggers over one input."""
    if not triggers:
        raise ValueError("no triggers")
    if len({t.name for t in triggers}) < len(triggers):
        raise ValueError("triggers need names of their own")
    closed = [t for t in triggers if t.condition.exclusive]
    parts = [changes(df, keys, ts, seq, value, closed).drop("at")] if closed else []
    return reduce(DataFrame.unionByName, parts + [of_stream(df, keys, ts, seq, value, t) for t in triggers if not t.condition.exclusive])
