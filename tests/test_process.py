"""Keyed processes, taps, changelog windows and joins, closed-form triggers: against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import joins, observe, process, state, trigger, watermark, windows

LOG = "k string, seq long, ts long, kind string, value struct<k:string,x:int>, old struct<k:string,x:int>"


def _process(spark, rows, spec, schema="n int", latency=0):
    log = watermark.with_wm_before(spark.createDataFrame(rows, LOG), "ts", "seq", latency)
    out = process.process_keyed(log, ["k"], spec, schema).collect()
    return [(r["k"], r["kind"], r["ts"], r["value"] and r["value"][0], r["old"] and r["old"][0], r["error"]) for r in sorted(out, key=lambda r: (r["k"], r["n"]))]


def _row(seq, ts, kind, x, old=None, k="a"):
    return (k, seq, ts, kind, (k, x), None if old is None else (k, old))


def test_process_counts_withdraws_and_corrects(spark):
    def add(ctx, key, held, v):
        held["n"] += v["x"]
        ctx.emit((held["n"],))

    def take(ctx, key, held, v):
        ctx.emit_retract((held["n"],))
        held["n"] -= v["x"]

    def correct(ctx, key, held, old, v):
        before = held["n"]
        held["n"] += v["x"] - old["x"]
        ctx.emit_update((before,), (held["n"],))

    rows = [_row(0, 1, "D", 5), _row(1, 2, "D", 7), _row(2, 3, "R", 5), _row(3, 4, "U", 9, 7), _row(4, 4, "D", 1, k="b")]
    spec = process.Process(lambda: {"n": 0}, add, on_retract=take, on_update=correct)
    assert _process(spark, rows, spec) == [("a", "D", 1, 5, None, None), ("a", "D", 2, 12, None, None), ("a", "R", 3, 12, None, None), ("a", "U", 4, 9, 7, None), ("b", "D", 4, 1, None, None)]
    plain = process.Process(lambda: {"n": 0}, add)  # without them: withdrawals pass, corrections count as new values
    assert [x[3] for x in _process(spark, rows, plain) if x[0] == "a"] == [5, 12, 21]


def test_process_timers_fire_in_order_and_once(spark):
    def on(ctx, key, held, v):
        for t in (ctx.ts + 30, ctx.ts + 10, ctx.ts + 20):
            ctx.set_event_timer(t)
        ctx.set_event_timer(ctx.ts + 10)
        ctx.cancel_event_timer(ctx.ts + 20)

    def fire(ctx, key, held, at, kind):
        assert kind == process.EVENT_TIME
        ctx.emit((at,))
        ctx.clear_state()

    rows = [_row(0, 0, "D", 1), _row(1, 100, "D", 1, k="b"), _row(2, 105, "D", 1)]
    stats = process.telemetry(spark)
    got = _process(spark, rows, process.Process(dict, on, fire, stats=stats))
    assert [(x[0], x[3]) for x in got] == [("a", 10), ("a", 30)]  # 115 and 110 are beyond the last watermark
    assert stats["event_timer_fired"].value == 2 and stats["event_timer_set"].value == 12


def test_process_single_timer_and_errors(spark):
    def on(ctx, key, held, v):
        if v["x"] < 0:
            raise ValueError("bad")
        held["t"].reschedule(ctx, ctx.ts + 50)

    def fire(ctx, key, held, at, kind):
        held["t"].consumed()
        ctx.emit((at,))

    rows = [_row(i, i * 10, "D", 1) for i in range(5)] + [_row(5, 200, "D", -1)]
    spec = process.Process(lambda: {"t": process.SingleTimer()}, on, fire, on_error=True)
    assert [(x[1], x[2], x[5]) for x in _process(spark, rows, spec)] == [("E", 200, "ValueError: bad"), ("D", 90, None)]
    with pytest.raises(Exception, match="bad"):
        _process(spark, rows, process.Process(lambda: {"t": process.SingleTimer()}, on, fire))


def test_process_processing_timers(spark):
    def on(ctx, key, held, v):
        ctx.set_processing_timer(v["x"])

    spec = process.Process(dict, on, lambda ctx, key, held, at, kind: ctx.emit((at,)) if kind == process.PROCESSING_TIME else None, now_ms=lambda: 50)
    assert [x[3] for x in _process(spark, [_row(0, 0, "D", 40), _row(1, 1, "D", 60), _row(2, 2, "D", 45)], spec)] == [40, 45]


@pytest.mark.parametrize("seed", range(2))
def test_closed_form_triggers_are_the_machine(spark, seed):
    r, rows, t = random.Random(seed), [], 0
    for i in range(500):
        t += r.choice([0, 1, 3, 10])
        rows.append((r.choice("abc"), i, t - (r.choice([0, 0, 0, 0, 5, 30]) if seed % 2 else 0), r.choice([5.0, 15.0, 30.0, 90.0, None])))
    df = spark.createDataFrame(rows, "k string, seq long, ts long, v double")
    log = watermark.with_wm_before(df, "ts", "seq", 2)
    specs = [trigger.Trigger(f"t{pf}-{rf}-{i}", c, "high", pf, rf) for pf, rf in ((0, 0), (12, 0), (0, 12), (20, 9)) for i, c in enumerate((trigger.greater_than_with_hysteresis(50, 10), trigger.less_than(20), trigger.is_none()))]
    cols = ["k", "trigger", "severity", "kind", "status", "ts", "value"]
    rows_of = lambda d: sorted(map(str, d.select(*cols).collect()))
    for source in (log, df):
        got = rows_of(trigger.combine(source, ["k"], "ts", "seq", "v", specs))
        want = sorted(x for s in specs for x in rows_of(trigger._machine(source, ["k"], "ts", "seq", "v", s, None)))
        assert got == want


@pytest.mark.parametrize("seed", range(2))
def test_cooldown_over_many_keys_and_batches(spark, seed):
    r, rows, t = random.Random(seed), [], 0
    for i in range(3000):
        t += r.choice([0, 1, 3])
        rows.append((i, r.choice(["a", "b", None, *map(str, range(20))]), r.choice([1, 2]), t - (r.choice([0, 0, 9, 40]) if seed else 0)))
    df = spark.createDataFrame(rows, "seq long, k string, rule int, ts long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = sorted(x["seq"] for x in state.dedup(df, ["k", "rule"], "ts", "seq", 7).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    last, want = {}, []
    for i, k, rule, at in rows:
        if (k, rule) not in last or at - last[k, rule] > 7:
            last[k, rule] = at
            want.append(i)
    assert got == want


def test_update_is_withdrawal_and_addition(spark):
    r = random.Random(3)
    rows, held = [], {}
    for i in range(400):
        k, x, ts = r.choice("ab"), r.randint(0, 9), r.randint(0, 99)
        prior = held.get((k, ts // 10))
        kind = r.choice("DRU") if prior else "D"
        if kind == "D":
            rows.append((k, i, ts, "D", (k, x), None))
            held.setdefault((k, ts // 10), []).append((x, ts))
        else:
            old, at = prior[r.randrange(len(prior))]
            rows.append((k, i, at, kind, (k, old if kind == "R" else x), (k, old) if kind == "U" else None))
    log = spark.createDataFrame(rows, LOG)
    split = [(k, 2 * s + j, ts, *y) for k, s, ts, kind, v, old in rows for j, y in enumerate([("R", old, None), ("D", v, None)] if kind == "U" else [(kind, v, None)])]
    x = lambda v: v["x"]
    aggs = {"n": windows.counted(), "total": windows.summed(x), "all": windows.listed(x), "mid": windows.middle(x), "mean": windows.averaged(x), "odd": windows.counted_if(lambda v: v["x"] % 2 == 1)}
    final = lambda l: sorted(map(str, windows.window_log(l, {"key": lambda v: v["k"]}, windows.tumbling(10), **aggs).collect()))
    assert final(log.drop("k")) == final(spark.createDataFrame(split, LOG).drop("k"))


def test_withdrawals_of_windows_step_by_step(spark):
    rows = [_row(0, 1, "R", 5), _row(1, 1, "D", 5), _row(2, 2, "D", 7), _row(3, 1, "R", 5), _row(4, 2, "U", 8, 7), _row(5, 25, "D", 1), _row(6, 2, "U", 3, 8), _row(7, 2, "R", 3), _row(8, 500, "D", 0), _row(9, 2, "D", 4)]
    log = spark.createDataFrame([(*x[1:], None if i == 0 else max(y[2] for y in rows[:i])) for i, x in enumerate(rows)], LOG.split(", ", 1)[1] + ", wm_before long")
    out = windows.window_log_changes(log, {"k": lambda v: v["k"]}, windows.tumbling(10), allowed_lateness=100, total=windows.summed(lambda v: v["x"]), items=windows.listed(lambda v: v["x"]))
    got = [(r["kind"], r["value"]["total"], r["value"]["items"], r["old"] and r["old"]["total"]) for r in sorted(out.where("win_end = 10").collect(), key=lambda r: r["seq"])]
    assert got == [("D", 8, [8], None), ("U", 3, [3], 8), ("U", 0, [], 3)]  # the last value comes after the window is gone


def test_join_corrections_show_no_gap(spark):
    at = lambda k, i, x: (k, i, x)
    rows = [(0, 0, "D", at("a", 0, 38.0), None), (1, 1, "D", at("a", 1, 5.0), None), (2, 2, "U", at("a", 0, 31.5), at("a", 0, 38.0)), (3, 3, "R", at("a", 0, 99.0), None), (4, 4, "R", at("a", 0, 31.5), None), (5, 5, "R", at("a", 0, 31.5), None),
            (6, 6, "U", at("b", 1, 6.0), at("a", 1, 5.0)), (7, 7, "U", at("b", 0, 7.0), at("b", 1, 6.0))]
    value = "struct<k:string,i:int,x:double>"
    got = joins.keyed_join_log(spark.createDataFrame(rows, f"seq long, ts long, kind string, value {value}, old {value}"), 2, "k", "i", "x").collect()
    assert sorted((r["seq"], r["step"], r["k"], r["v0"], r["v1"]) for r in got) == [
        (0, 0, "a", 38.0, None), (1, 0, "a", 38.0, 5.0), (2, 0, "a", 31.5, 5.0), (4, 0, "a", None, 5.0), (6, 0, "a", None, None), (6, 1, "b", None, 6.0), (7, 1, "b", 7.0, None),
    ]


def test_taps_and_diagnostics(spark):
    rows = spark.createDataFrame([("D", 1), ("R", 2), ("U", 3), ("D", 9)], "kind string, v int")
    counted, seen = observe.with_counter(rows, "n")
    tapped, kinds = observe.inspect(counted, "log")
    timed, waits = observe.window_instrumented(tapped.withColumn("win_end", F.lit(10)), F.lit(25))
    assert timed.count() == 4 and seen.get["n"] == 4 and kinds.get == {"rows": 4, "data": 2, "retract": 1, "update": 1}
    assert waits.get == {"windows": 4, "mean_ms": 15.0, "max_ms": 15}
    said = []
    watch = observe.WatermarkDiagnostics(rows=100, warn=said.append)
    for _ in range(3):
        watch.check("q", "query", 60, {}, [(5, 0)])
    watch.check("p", "plain", 1000, {}, [])
    watch.check("w", "late", 200, {"watermark": "x"}, [(0, 200)])
    assert len(said) == 2 and "without a watermark" in said[0] and "after the watermark" in said[1]
