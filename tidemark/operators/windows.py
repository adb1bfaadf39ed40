"""Time, session, count and global windows over keyed logs.

Logs have key columns, ``ts`` (long ms) and ``seq`` (arrival order).  Windows are half-open [start, end) and
aligned to 0; results carry the exclusive end.  The batch forms flush open windows at the end of input.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions.scalar import not_negative, positive


@dataclass(frozen=True)
class TimeWindow:
    size: int
    step: int

    def __post_init__(self) -> None:
        positive("size", self.size)
        positive("step", self.step)


def tumbling(size: int) -> TimeWindow:
    return TimeWindow(size, size)


def sliding(size: int, step: int) -> TimeWindow:
    """step > size leaves gaps: rows there belong to no window."""
    return TimeWindow(size, step)


def assign(df: DataFrame, ts: str, spec: TimeWindow) -> DataFrame:
    """One row per window that holds the row, with ``win_start`` and ``win_end`` (ms).

    Rows at or after 0 get no window that starts before 0.
    """
    at = F.col(ts)
    newest = at - F.pmod(at, F.lit(spec.step))
    if spec.size == spec.step:
        rows = df.withColumn("win_start", newest.cast("long"))
    else:
        oldest = at - spec.size - F.pmod(at - spec.size, F.lit(spec.step)) + spec.step
        oldest = F.when(at >= 0, F.greatest(oldest, F.lit(0))).otherwise(oldest)
        starts = F.when(oldest <= newest, F.sequence(oldest.cast("long"), newest.cast("long"), F.lit(spec.step).cast("long")))
        rows = df.withColumn("win_start", F.explode(starts))
    return rows.withColumn("win_end", F.col("win_start") + spec.size)


def window_agg(df: DataFrame, keys: Sequence[str], ts: str, spec: TimeWindow, *aggregates: Column) -> DataFrame:
    """Keyed window aggregate.  On a stream ``ts`` is a timestamp with a watermark and step <= size."""
    if df.isStreaming:
        step = None if spec.size == spec.step else f"{spec.step} milliseconds"
        out = df.groupBy(*keys, F.window(ts, f"{spec.size} milliseconds", step).alias("w")).agg(*aggregates)
        return out.withColumns({"win_start": F.unix_millis("w.start"), "win_end": F.unix_millis("w.end")}).drop("w").where("win_start >= 0")
    return assign(df, ts, spec).groupBy(*keys, "win_start", "win_end").agg(*aggregates)


def window_list(df: DataFrame, keys: Sequence[str], ts: str, seq: str, spec: TimeWindow, value: Column, into: str = "items") -> DataFrame:
    """The window's values in arrival order."""
    items = F.array_sort(F.collect_list(F.struct(F.col(seq).alias("seq"), value.alias("v"))))
    return window_agg(df, keys, ts, spec, F.transform(items, lambda x: x["v"]).alias(into))


def split_late(df: DataFrame, ts: str, spec: TimeWindow, latency: int = 0, allowed_lateness: int = 0) -> tuple[DataFrame, DataFrame]:
    """(kept, late) per row and window; ``df`` has ``wm_before``.  Late rows came after their window was evicted."""
    not_negative("latency", latency)
    not_negative("allowed lateness", allowed_lateness)
    return _late_apart(assign(df, ts, spec), latency, allowed_lateness)


def _late_apart(rows: DataFrame, latency: int, allowed_lateness: int) -> tuple[DataFrame, DataFrame]:
    late = F.coalesce(F.col("win_end") + latency + allowed_lateness <= F.col("wm_before"), F.lit(False))
    return rows.where(~late), rows.where(late)


def window_changes(
    df: DataFrame, keys: Sequence[str], ts: str, seq: str, spec: TimeWindow, running: Callable[[WindowSpec], Column], latency: int = 0, allowed_lateness: int = 0, late_policy: str = "drop"
) -> DataFrame:
    """Window results as a changelog: first firing D, then U for each late row within the allowed lateness.

    ``running`` builds the result as an aggregate over a window specification that ends at the current row.
    A window has fired before a row if that row met a watermark past the end that was emitted after the
    window's first row.  Corrections that change nothing are left out.  Rows too late are dropped
    ("drop") or open the window again and fire it anew ("refire": those that met the same watermark together).
    """
    if late_policy not in ("drop", "refire"):
        raise ValueError("late_policy is drop or refire")
    kept, late = split_late(df, ts, spec, latency, allowed_lateness)
    cols = [*keys, "win_start", "win_end"]
    out = _emitted(kept, cols, cols, seq, running, latency)
    return out if late_policy == "drop" else out.unionByName(_emitted(late, cols, [*cols, "wm_before"], seq, running, None))


def _emitted(rows: DataFrame, cols: Sequence[str], part: Sequence[str], seq: str, running: Callable[[WindowSpec], Column], latency: int | None) -> DataFrame:
    """First firing and corrections of each group ``part``; without a latency each group fires once, at its end."""
    order = Window.partitionBy(*part).orderBy(seq)
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first_wm = F.coalesce(F.first("wm_before").over(so_far), F.lit(-(1 << 62)))
    fired = F.lit(False) if latency is None else F.coalesce((F.col("wm_before") >= F.col("win_end") + latency) & (F.col("wm_before") > first_wm), F.lit(False))
    rows = rows.withColumn("_n", F.row_number().over(order)).withColumn("_fired", fired)
    rows = rows.withColumn("_first_fired", F.min(F.when(F.col("_fired"), F.col("_n"))).over(whole)).withColumn("_last", F.count("*").over(whole))
    rows = rows.withColumn("value", running(so_far)).withColumn("old", running(before))
    opens = F.col("_n") == F.coalesce(F.col("_first_fired") - 1, F.col("_last"))
    kind = F.when(F.col("_n") >= F.col("_first_fired"), "U").when(opens, "D")
    out = rows.withColumn("kind", kind).where("kind IS NOT NULL")
    out = out.where(~((F.col("kind") == "U") & F.col("value").eqNullSafe(F.col("old"))))
    return out.select(*cols, F.col(seq).alias("seq"), F.col("win_end").alias("ts"), "kind", "value", F.when(F.col("kind") == "U", F.col("old")).alias("old"))


@dataclass(frozen=True)
class Retractable:
    """An aggregate that takes values out again: sums of ``parts`` of each value, put together by ``finish``; or with
    ``multiset`` an aggregate of the values in the window, in order of arrival.  ``adds`` is a plain aggregate of the
    values that says the same where nothing is taken out; a multiset is then held only by windows where something is."""

    parts: tuple[Callable[[Column], Column], ...]
    finish: Callable[..., Column]
    multiset: bool = False
    adds: Callable[[Column], Column] | None = None

    def signed(self, kind: Column, value: Column, old: Column, takes: Column) -> list[Column]:
        """What a D, R or U row adds to each sum, or the steps (adds, value) it takes on the multiset.  ``takes``:
        whether something is taken out of the row's window."""
        if self.multiset:
            step = lambda adds, v: F.struct(F.lit(adds).alias("adds"), self.parts[0](v).alias("v"))
            steps = F.when(kind == "R", F.array(step(False, value))).when(takes_out(kind, old), F.array(step(False, old), step(True, value))).otherwise(F.array(step(True, value)))
            return [steps] if self.adds is None else [F.when(takes, steps), self.parts[0](value)]
        zero = lambda c: F.coalesce(c, F.lit(0))
        return [F.when(kind == "R", -zero(f(value))).when(takes_out(kind, old), zero(f(value)) - zero(f(old))).otherwise(zero(f(value))) for f in self.parts]

    def over(self, columns: Sequence[str], frame: WindowSpec | None) -> Column:
        """The result over a frame that ends at the current row, or of a group (None)."""
        of = lambda c: c.over(frame) if frame is not None else c
        if not self.multiset:
            return self.finish(*[of(F.sum(c)) for c in columns])
        if frame is not None:
            steps = F.flatten(F.collect_list(columns[0]).over(frame))
        else:
            steps = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.col(columns[0]).alias("steps")))), lambda x: x["steps"]))
        if self.adds is None:
            return self.finish(remaining(steps))
        return F.when(of(F.count(columns[0])) > 0, self.finish(remaining(steps))).otherwise(of(self.adds(F.col(columns[1]))))


def takes_out(kind: Column, old: Column) -> Column:
    """Whether a row takes a value out."""
    return (kind == "R") | ((kind == "U") & old.isNotNull())


def remaining(steps: Column) -> Column:
    """The values left of steps (adds, v) in order; taking out removes the first equal value, if there is one."""
    kept = F.transform(F.slice(steps, 1, 0), lambda x: x["v"])

    def after(held: Column, step: Column) -> Column:
        at = F.array_position(held, step["v"])
        without = F.concat(F.slice(held, F.lit(1), F.greatest(at - 1, F.lit(0)).cast("int")), F.slice(held, (at + 1).cast("int"), F.size(held)))
        return F.when(step["adds"], F.array_append(held, step["v"])).when(at > 0, without).otherwise(held)

    return F.aggregate(steps, kept, after)


def counted() -> Retractable:
    return Retractable((lambda v: F.lit(1),), lambda n: n)


def counted_if(p: Callable[[Column], Column]) -> Retractable:
    return Retractable((lambda v: F.when(p(v), 1).otherwise(0),), lambda n: n)


def summed(f: Callable[[Column], Column]) -> Retractable:
    return Retractable((f,), lambda x: x)


def averaged(f: Callable[[Column], Column]) -> Retractable:
    return Retractable((f, lambda v: F.when(f(v).isNotNull(), 1).otherwise(0)), lambda x, n: F.when(n != 0, x / n))


def listed(f: Callable[[Column], Column]) -> Retractable:
    return Retractable((f,), lambda held: held, multiset=True)


def smallest(f: Callable[[Column], Column]) -> Retractable:
    return Retractable((f,), lambda held: F.array_min(held), multiset=True, adds=F.min)


def middle(f: Callable[[Column], Column]) -> Retractable:
    """The exact median of the values left."""

    def median(held: Column) -> Column:
        ordered, n = F.array_sort(held), F.size(held)
        return F.when(n > 0, (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2)

    return Retractable((f,), median, multiset=True)


def log_rows(log: DataFrame, keys: dict[str, Callable[[Column], Column]], spec: TimeWindow, retracts: bool = True) -> DataFrame:
    """The rows of a changelog by key and window.  A withdrawal from a window that nothing has entered is passed
    over, and a correction that comes first counts as its new value.  Without ``retracts`` withdrawals
    are passed over and corrections count as their new values."""
    rows = log.select(*[f(F.col("value")).alias(n) for n, f in keys.items()], *[c for c in log.columns if c not in keys])
    if not retracts:
        rows = rows.where("kind <> 'R'").withColumn("old", F.lit(None).cast(log.schema["old"].dataType))
        return assign(rows, "ts", spec)
    part = Window.partitionBy(*keys, "win_start", "win_end")
    rows = assign(rows, "ts", spec).withColumn("_begun", F.min(F.when(F.col("kind") != "R", F.col("seq"))).over(part))
    rows = rows.where("kind <> 'R' OR seq > _begun")
    return rows.withColumn("old", F.when(F.col("seq") > F.col("_begun"), F.col("old"))).drop("_begun")


def _with_parts(rows: DataFrame, keys: Sequence[str], aggs: dict[str, Retractable]) -> tuple[DataFrame, dict[str, list[str]]]:
    takes = F.lit(True)
    if any(a.adds for a in aggs.values()):
        part = Window.partitionBy(*keys, "win_start", "win_end")
        rows, takes = rows.withColumn("_takes", F.max(takes_out(F.col("kind"), F.col("old"))).over(part)), F.col("_takes")
    parts = {n: a.signed(F.col("kind"), F.col("value"), F.col("old"), takes) for n, a in aggs.items()}
    names = {n: [f"_{n}_{i}" for i in range(len(cs))] for n, cs in parts.items()}
    made = [c.alias(x) for n, cs in parts.items() for x, c in zip(names[n], cs, strict=True)]
    return rows.select("*", *made), names


def window_log(log: DataFrame, keys: dict[str, Callable[[Column], Column]], spec: TimeWindow, **aggs: Retractable) -> DataFrame:
    """Final window results of a changelog (seq, ts, kind, value, old): one shuffle by key and window."""
    rows, names = _with_parts(log_rows(log, keys, spec), list(keys), aggs)
    return rows.groupBy(*keys, "win_start", "win_end").agg(*[a.over(names[n], None).alias(n) for n, a in aggs.items()])


def window_log_changes(log: DataFrame, keys: dict[str, Callable[[Column], Column]], spec: TimeWindow, latency: int = 0, allowed_lateness: int = 0, **aggs: Retractable) -> DataFrame:
    """Window results of a changelog as a changelog: late values, withdrawals and corrections each correct a
    window that has fired in one step (U).  ``log`` has ``wm_before``; results are structs of ``aggs``."""
    rows, names = _with_parts(log_rows(log, keys, spec), list(keys), aggs)
    running = lambda frame: F.struct(*[a.over(names[n], frame).alias(n) for n, a in aggs.items()])
    kept, _ = _late_apart(rows.drop("kind", "value", "old"), latency, allowed_lateness)
    return _emitted(kept, [*keys, "win_start", "win_end"], [*keys, "win_start", "win_end"], "seq", running, latency)


def session_window(df: DataFrame, keys: Sequence[str], ts: str, gap: int, *aggregates: Column) -> DataFrame:
    """Sessions that a silence of more than ``gap`` ms separates; ``session_end`` is the last row's time."""
    positive("gap", gap)
    at = F.col(ts) if df.isStreaming else F.timestamp_millis(F.col(ts))
    time = F.unix_millis(ts) if df.isStreaming else F.col(ts)
    session = F.session_window(at, f"{gap} milliseconds").alias("_session")
    out = df.groupBy(*keys, session).agg(F.min(time).alias("session_start"), F.max(time).alias("session_end"), *aggregates)
    return out.drop("_session")


@dataclass(frozen=True)
class CountWindow:
    n: int
    step: int | None = None

    def __post_init__(self) -> None:
        positive("n", self.n)
        if self.step is not None:
            positive("step", self.step)


def count_tumbling(n: int) -> CountWindow:
    return CountWindow(n)


def count_sliding(n: int, step: int) -> CountWindow:
    return CountWindow(n, step)


def count_window(df: DataFrame, keys: Sequence[str], seq: str, ts: str, spec: CountWindow, **running: Callable[[WindowSpec], Column]) -> DataFrame:
    """Windows of n rows per key.  Tumbling: whole windows only.  Sliding: the last n rows, first at row
    max(n, step), then every ``step`` rows.  ``ts`` of a result is its last row's."""
    order = Window.partitionBy(*keys).orderBy(seq)
    frame = order.rowsBetween(-(spec.n - 1), Window.currentRow)
    rows = df.withColumn("_n", F.row_number().over(order))
    rows = rows.select(*keys, F.col(seq).alias("seq"), F.col(ts).alias("ts"), "_n", *[f(frame).alias(c) for c, f in running.items()])
    at = max(spec.n, spec.step or spec.n)
    return rows.where((F.col("_n") >= at) & ((F.col("_n") - at) % (spec.step or spec.n) == 0)).withColumnRenamed("_n", "rn")


def trigger_count(df: DataFrame, keys: Sequence[str], seq: str, n: int, *aggregates: Column) -> DataFrame:
    """Global windows fired and purged every n rows; the rest fires at the end of input."""
    positive("n", n)
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(seq))
    return df.withColumn("fire", F.floor((rn - 1) / n).cast("long")).groupBy(*keys, "fire").agg(*aggregates)


def trigger_on_value(df: DataFrame, keys: Sequence[str], seq: str, fires: Column, **running: Callable[[WindowSpec], Column]) -> DataFrame:
    """Accumulating global windows: a result of all rows so far whenever a row fires, and at the end of input
    if rows came after the last firing."""
    order = Window.partitionBy(*keys).orderBy(seq)
    frame = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hit = F.coalesce(fires, F.lit(False))
    rows = df.withColumn("_fires", hit).withColumn("_end", F.lead(seq).over(order).isNull())
    rows = rows.select(*keys, F.col(seq).alias("seq"), "_fires", "_end", *[f(frame).alias(c) for c, f in running.items()])
    return rows.where("_fires OR _end").withColumnRenamed("_fires", "fired").drop("_end")


def global_window(df: DataFrame, keys: Sequence[str], seq: str, values: Sequence[str], trigger: Callable[[int, dict], str], schema: str) -> DataFrame:
    """Any trigger: ``trigger(rows in buffer, last row)`` is continue, fire or purge.  Emits (key..., fire, values as
    lists).  Rows are scanned in order per key; the buffer is what the trigger lets grow."""
    from tidemark.operators.scan import ordered_scan

    def step(state, rows):
        buffer, fire, dirty = state or ([], 0, False)
        out = []
        key = tuple(rows.iloc[0][list(keys)])
        for row in rows[list(values)].to_dict("records"):
            buffer.append(row)
            dirty = True
            action = trigger(len(buffer), row)
            if action != "continue":
                out.append((*key, fire, *[[r[v] for r in buffer] for v in values]))
                fire, dirty = fire + 1, False
                if action == "purge":
                    buffer = []
        return (buffer, fire, dirty), out

    def finish(key, state):
        buffer, fire, dirty = state
        return [(*key, fire, *[[r[v] for r in buffer] for v in values])] if dirty and buffer else []

    return ordered_scan(df, keys, [seq], step, schema, finish)
