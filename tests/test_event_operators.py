"""Operator semantics on literal inputs and against plain Python versions."""

import json
import random
import time

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Row
from pyspark.sql import functions as F

from tidemark.functions import scalar
from tidemark.operators import aggs, joins, state, trigger, watermark, windows
from tidemark.operators import changelog as cl
from tidemark.sources import readers, sinks

FEW = settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
streams = st.lists(st.tuples(st.sampled_from("ABC"), st.integers(0, 60), st.integers(0, 9)), min_size=1, max_size=25)


def log(spark, rows):
    return spark.createDataFrame([(k, t, v, i) for i, (k, t, v) in enumerate(rows)], "k string, ts long, v long, seq long")


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


# Time and watermarks


def test_watermark_is_that_before_the_row(spark):
    df = watermark.with_wm_before(log(spark, [("A", 5, 0), ("A", 3, 0), ("A", 9, 0), ("A", 1, 0)]), "ts", "seq", 2)
    assert rows(df, "seq", "wm_before") == [(0, None), (1, 3), (2, 3), (3, 7)]


def test_watermark_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(watermark, "RANGE", 3)
    times = [5, 3, 9, 1, 20, 2, 2, 30, 4, 1]
    df = watermark.with_wm_before(log(spark, [("A", t, 0) for t in times]), "ts", "seq")
    assert [r[1] for r in rows(df, "seq", "wm_before")] == [None, *[max(times[:i]) for i in range(1, 10)]]


def test_union_follows_heads(spark):
    a, b = log(spark, [("A", 1, 0), ("A", 9, 1), ("A", 2, 2)]), log(spark, [("B", 1, 3), ("B", 5, 4)])
    out = watermark.union_ordered([a.withColumnRenamed("seq", "s"), b.withColumnRenamed("seq", "s")], "ts", "s")
    assert [r[1] for r in rows(out, "seq", "v")] == [0, 3, 4, 1, 2]


def test_idle_partition_is_left_out(spark):
    a, b = log(spark, [("A", t, 0) for t in (1, 50, 90, 95)]), log(spark, [("B", t, 1) for t in (2, 3, 4, 5)])
    held = dict(rows(watermark.merge_partitioned([a, b], "ts", "seq"), "seq", "wm_before"))
    freed = dict(rows(watermark.merge_partitioned([a, b], "ts", "seq", idle_ms=40), "seq", "wm_before"))
    assert held[6] == 4 and freed[6] == 90


# Windows


@FEW
@given(st.lists(st.integers(-40, 60), min_size=1, max_size=12), st.integers(1, 12), st.integers(1, 12))
def test_assign(spark, times, size, step):
    out = windows.assign(log(spark, [("A", t, 0) for t in times]), "ts", windows.sliding(size, step))
    want = sorted((i, s, s + size) for i, t in enumerate(times) for s in range(-200 * step, 100 * step, step) if s <= t < s + size and (s >= 0 or t < 0))
    assert rows(out, "seq", "win_start", "win_end") == want


def reference_window(events, size, latency, allowed):
    """An independent simulation: one row at a time, a watermark after each row that advances it."""
    open_, fired, out, late, wm, seen = {}, {}, [], [], None, None
    for i, (k, t, v) in enumerate(events):
        w = (k, t - t % size + size)
        if wm is not None and w[1] + allowed <= wm:
            late.append((i, w[1]))
        else:
            open_.setdefault(w, []).append(v)
            if w in fired:
                out.append((*w, "U", tuple(open_[w])))
        seen = t if seen is None else max(seen, t)
        if wm is None or seen - latency > wm:
            wm = seen - latency
            for x in list(open_):
                if x[1] <= wm and x not in fired:
                    fired[x] = True
                    out.append((*x, "D", tuple(open_[x])))
                if x[1] + allowed <= wm:
                    open_.pop(x), fired.pop(x, None)
    out += [(*x, "D", tuple(open_[x])) for x in open_ if x not in fired]
    return sorted(out), sorted(late)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(streams, st.integers(0, 10), st.integers(0, 20))
def test_window_changes_match_a_simulation(spark, events, latency, allowed):
    df = watermark.with_wm_before(log(spark, events), "ts", "seq", latency)
    out = windows.window_changes(df, ["k"], "ts", "seq", windows.tumbling(10), lambda w: F.collect_list("v").over(w), allowed_lateness=allowed)
    want, late = reference_window(events, 10, latency, allowed)
    assert sorted((r["k"], r["win_end"], r["kind"], tuple(r["value"])) for r in out.collect()) == want
    assert rows(windows.split_late(df, "ts", windows.tumbling(10), 0, allowed)[1], "seq", "win_end") == late


def test_late_refire_opens_the_window_again(spark):
    df = watermark.with_wm_before(log(spark, [("A", 1, 1), ("A", 30, 2), ("A", 2, 3), ("A", 3, 4)]), "ts", "seq")
    out = windows.window_changes(df, ["k"], "ts", "seq", windows.tumbling(10), lambda w: F.sum("v").over(w), late_policy="refire")
    assert rows(out, "win_end", "kind", "value") == [(10, "D", 1), (10, "D", 7), (40, "D", 2)]


@FEW
@given(streams, st.integers(1, 15))
def test_sessions(spark, events, gap):
    out = windows.session_window(log(spark, events), ["k"], "ts", gap, F.count("*").alias("n"))
    want = []
    for k in {e[0] for e in events}:
        times = sorted(t for x, t, _ in events if x == k)
        start = 0
        for i in range(1, len(times) + 1):
            if i == len(times) or times[i] - times[i - 1] > gap:
                want.append((k, times[start], times[i - 1], i - start))
                start = i
    assert rows(out, "k", "session_start", "session_end", "n") == sorted(want)


def test_count_windows(spark):
    df = log(spark, [("A", i, i) for i in range(8)])
    total = {"total": lambda w: F.sum("v").over(w)}
    assert rows(windows.count_window(df, ["k"], "seq", "ts", windows.count_tumbling(3), **total), "rn", "total") == [(3, 3), (6, 12)]
    assert rows(windows.count_window(df, ["k"], "seq", "ts", windows.count_sliding(3, 2), **total), "rn", "total") == [(3, 3), (5, 9), (7, 15)]
    assert rows(windows.count_window(df, ["k"], "seq", "ts", windows.count_sliding(2, 5), **total), "rn", "total") == [(5, 7)]


def test_global_triggers(spark):
    df = log(spark, [("A", i, i) for i in range(5)])
    assert rows(windows.trigger_count(df, ["k"], "seq", 2, F.count("*").alias("n")), "fire", "n") == [(0, 2), (1, 2), (2, 1)]
    out = windows.trigger_on_value(df, ["k"], "seq", F.col("v") == 2, n=lambda w: F.count("*").over(w))
    assert rows(out, "seq", "fired", "n") == [(2, True, 3), (4, False, 5)]
    act = lambda n, row: "purge" if row["v"] % 2 else "continue"
    out = windows.global_window(df, ["k"], "seq", ["v"], act, "k string, fire long, v array<long>")
    assert [list(r["v"]) for r in out.orderBy("fire").collect()] == [[0, 1], [2, 3], [4]]


# Aggregates


def test_aggregates(spark):
    df = log(spark, [("A", 1, 4), ("A", 2, 7), ("A", 3, 4), ("A", 4, 7), ("B", 5, 1)])
    v, seq = F.col("v"), F.col("seq")
    r = aggs.run(
        df, ["k"], n=aggs.count(), best=aggs.arg_max(v, seq, seq), worst=aggs.arg_min(v, seq, seq), top=aggs.top_k_by(3, v, seq, seq), low=aggs.bottom_k_by(2, v, seq, seq), first=aggs.first(v, seq),
        last=aggs.last(v, seq), median=aggs.median(v), items=aggs.to_list(v, seq), big=aggs.count_if(v > 4), twice=aggs.sum_of(v).contramap(lambda c: c * 2).map(lambda c: c + 1),
    ).where("k = 'A'").first()
    assert (r.n, r.best, r.worst, r.top, r.low, r.first, r.last, r.median, r["items"], r.big, r.twice) == (4, 1, 0, [1, 3, 0], [0, 2], 4, 7, 5.5, [4, 7, 4, 7], 2, 45)
    assert aggs.is_retractable(aggs.count(), aggs.median(v)) and not aggs.is_retractable(aggs.count(), aggs.max_of(v))
    g = aggs.group_by(df, [], "k", {"n": aggs.count()}).first()["groups"]
    assert [(x.k, x.n) for x in g] == [("B", 1), ("A", 4)]


def test_nan_wins_min_and_max(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (2.0,)], "x double")
    r = aggs.run(df, low=aggs.min_of(F.col("x")), high=aggs.max_of(F.col("x"))).first()
    assert r.low != r.low and r.high != r.high
    assert aggs.run(df.where("false"), s=aggs.sum_of(F.col("x")), m=aggs.mean(F.col("x"))).first() == (0.0, None)


# Changelog


def changes(spark, rows_):
    return spark.createDataFrame([(i, i, k, v, o) for i, (k, v, o) in enumerate(rows_)], "seq long, ts long, kind string, value long, old long")


def test_filter_rewrites_corrections(spark):
    out = cl.filter_values(changes(spark, [("U", 9, 8), ("U", 9, 1), ("U", 1, 9), ("U", 1, 2), ("D", 9, None), ("R", 1, None)]), lambda v: v > 5)
    assert rows(out, "seq", "kind", "value", "old") == [(0, "U", 9, 8), (1, "D", 9, None), (2, "R", 9, None), (4, "D", 9, None)]


def test_flat_map_stops_at_the_shorter(spark):
    out = cl.flat_map(changes(spark, [("U", 3, 1), ("D", 2, None), ("D", 0, None)]), lambda v: F.when(v > 0, F.sequence(F.lit(1).cast("long"), v)).otherwise(F.array().cast("array<long>")))
    assert rows(out, "seq", "kind", "value", "old") == [(0, "U", 1, 1), (1, "D", 1, None), (1, "D", 2, None)]


@FEW
@given(st.lists(st.tuples(st.sampled_from("DRU"), st.integers(0, 9), st.integers(0, 9)), min_size=1, max_size=15))
def test_update_equals_retract_then_data(spark, made):
    base = changes(spark, [(k, v, o if k == "U" else None) for k, v, o in made])

    def net(df):
        plain = cl.expand_updates(df).groupBy("value").agg(F.sum(F.when(F.col("kind") == "D", 1).otherwise(-1)).alias("n")).where("n <> 0")
        return rows(plain, "value", "n")

    p, f = (lambda v: v > 4), (lambda v: v * 2)
    assert net(cl.filter_values(base, p)) == net(cl.filter_values(cl.expand_updates(base).select("seq", "ts", "kind", "value", F.lit(None).cast("long").alias("old")), p))
    assert net(cl.map_values(base, f)) == [(v * 2, n) for v, n in net(base)]


def test_materialize_and_counts(spark):
    value = "struct<id:long,v:long>"
    made = [("D", 1, 5), ("D", 2, 6), ("U", 1, 7), ("R", 2, 99), ("D", 3, 1)]
    df = spark.createDataFrame([(i, i, k, (a, v), None) for i, (k, a, v) in enumerate(made)], f"seq long, ts long, kind string, value {value}, old {value}")
    assert rows(cl.materialize(df, lambda v: v["id"]), "id", "value.v") == [(1, 7), (3, 1)]
    assert cl.count_data(df) == 4 and cl.fold_data(df, F.sum("v")).first()[0] == 19
    assert cl.drop_noops(changes(spark, [("U", 1, 1), ("U", 1, 2)])).count() == 1


# Joins


def test_temporal_join_takes_the_latest_version(spark):
    v = spark.createDataFrame([("A", 10, 0, "x"), ("A", 20, 1, "y"), ("A", 20, 2, "z"), ("B", 1, 3, "b")], "k string, at long, s long, name string")
    m = spark.createDataFrame([("A", 9, 0), ("A", 10, 1), ("A", 25, 2), ("C", 5, 3)], "k string, ts long, s long")
    out = joins.temporal_join(m, v, ["k"], "ts", "at", "s", ["name"])
    assert rows(out, "s", "name") == [(0, None), (1, "x"), (2, "z"), (3, None)]
    assert rows(joins.as_of(v, ["k"], "at", "s", 20), "k", "name") == [("A", "z"), ("B", "b")]
    assert rows(joins.prune_versions_before(v, ["k"], "at", "s", 15), "k", "at") == [("A", 10), ("A", 20), ("A", 20), ("B", 1)]


def test_keyed_join_and_ttl(spark):
    a = spark.createDataFrame([("A", 0, 0, 1.0), ("A", 2, 50, 2.0)], "k string, seq long, ts long, v double")
    b = spark.createDataFrame([("A", 1, 5, 9.0), ("A", 3, 60, 8.0)], "k string, seq long, ts long, v double")
    assert rows(joins.keyed_join([a, b], ["k"], "seq", "ts", "v"), "seq", "v0", "v1") == [(0, 1.0, None), (1, 1.0, 9.0), (2, 2.0, 9.0), (3, 2.0, 8.0)]
    out = joins.keyed_join([a, b], ["k"], "seq", "ts", "v", ttl=10)
    assert rows(out, "seq", "v0", "v1")[3] == (3, 2.0, 8.0)


def test_tables_enrich_and_suppress(spark):
    t = joins.table_build(log(spark, [("A", 1, 1), ("A", 2, 2), ("B", 3, 3)]), ["k"], "seq")
    assert rows(joins.enrich(log(spark, [("A", 1, 0), ("C", 1, 0)]).select("k"), t.select("k", "v"), ["k"]), "k", "v") == [("A", 2), ("C", None)]
    assert rows(joins.table_build_ttl(log(spark, [("A", 1, 1), ("B", 30, 3)]), ["k"], "seq", "ts", 10), "k") == [("B",)]
    c, s = log(spark, [("A", 5, 1), ("A", 10, 0)]), log(spark, [("A", 4, 0), ("A", 5, 1), ("A", 9, 2), ("A", 10, 3)])
    out = joins.suppress_while(c, s, ["k"], ["k"], "ts", "seq", F.when(F.col("v") == 1, "on").otherwise("off"))
    assert rows(out, "v") == [(0,), (3,)]


# State


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(streams, st.integers(1, 20), st.booleans())
def test_dedup_is_greedy(spark, events, cooldown, in_order):
    events = sorted(events, key=lambda e: e[1]) if in_order else events
    last, want = {}, []
    for i, (k, t, _) in enumerate(events):
        if k not in last or t - last[k] > cooldown:
            last[k] = t
            want.append((i,))
    assert rows(state.dedup(log(spark, events), ["k"], "ts", "seq", cooldown), "seq") == want


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(streams, st.integers(1, 20))
def test_silence_matches_a_simulation(spark, events, within):
    last, silent, out, wm, top = {}, set(), [], None, None
    for k, t, _ in events:
        if k in silent:
            silent.discard(k)
            out.append((k, "resumed", t))
        last[k] = max(last.get(k, t), t)
        top = t if top is None else max(top, t)
        if wm is None or top > wm:
            wm = top
            for x, at in last.items():
                if at + within <= wm and x not in silent:
                    silent.add(x)
                    out.append((x, "silent", at + within))
    df = watermark.with_wm_before(log(spark, events), "ts", "seq")
    assert rows(state.on_silence(df, ["k"], "ts", "seq", within), "k", "kind", "ts") == sorted(out)


def test_silence_age_ticks(spark):
    df = log(spark, [("A", 0, 0), ("A", 100, 0)])
    marks = spark.createDataFrame([(t, 0) for t in (5, 12, 19, 30, 45)], "wm long, after_seq long")
    assert rows(state.silence_age(df, marks, ["k"], "ts", "seq", 10), "ts", "age") == [(0, 0), (12, 12), (30, 30), (45, 45), (100, 0)]


def test_silence_age_jumps_over_marks(spark):
    """Late events and marks that go back, as in the SQL; nothing pairs events with all marks that pass."""
    rng = random.Random(4)
    events = [(rng.choice("ABC"), rng.randrange(300), 0) for _ in range(60)]
    for back in (0, 60):
        marks = [(3 * i - rng.randrange(back + 1), i) for i in range(0, 90, 2)]
        df = log(spark, events).withColumn("ts", F.when(F.col("seq") == 7, None).otherwise(F.col("ts")))
        want = []
        for i, (k, t, _) in enumerate(events):
            until = next((j for j in range(i + 1, 60) if events[j][0] == k), 1 << 62)
            want.append((k, None if i == 7 else t, 0))
            seen = sorted(wm for wm, after in marks if i <= after < until) if i != 7 else []
            due = t + 10
            for wm in seen:
                if wm >= due:
                    want.append((k, wm, wm - t))
                    due = wm + 10
        out = state.silence_age(df, spark.createDataFrame(marks, "wm long, after_seq long"), ["k"], "ts", "seq", 10)
        assert sorted(map(repr, out.toLocalIterator())) == sorted(repr(Row(k=k, ts=t, age=a)) for k, t, a in want)
        assert "Join" not in out._jdf.queryExecution().executedPlan().toString()


def test_fold_process_and_ttl(spark):
    df = log(spark, [("A", 1, 1), ("A", 2, 2), ("B", 50, 5)])
    out = state.fold(df, ["k"], "seq", F.col("v"), F.lit("").cast("string"), lambda acc, x: F.concat(acc, x.cast("string")))
    assert rows(out, "k", "value") == [("A", "12"), ("B", "5")]
    assert rows(state.ttl_state(df, ["k"], "ts", "seq", 10, 55), "k") == [("B",)]


@pytest.mark.parametrize("takes", [False, True])
def test_smallest_of_a_changelog(spark, takes):
    """The same as the least value of the multiset, with and without withdrawals and corrections."""
    rng = random.Random(2)
    made = []
    for i in range(60):
        kind = rng.choice("DDRU") if takes and i % 2 else "D"  # the windows of odd rows: something is taken out
        made.append((i, (i % 2) * 100 + rng.randrange(100), kind, rng.choice([None, *range(9)]), rng.randrange(9) if kind == "U" else None, i - 5))
    df = spark.createDataFrame(made, "seq long, ts long, kind string, x long, o long, wm_before long")
    df = df.select("seq", "ts", "kind", F.struct("x").alias("value"), F.when(F.col("o").isNotNull(), F.struct(F.col("o").alias("x"))).alias("old"), "wm_before")
    x = lambda v: v["x"]
    held = windows.Retractable((x,), F.array_min, multiset=True)
    out = windows.window_log_changes(df, {"k": lambda v: F.lit(1)}, windows.tumbling(100), 0, 1000, least=windows.smallest(x))
    want = windows.window_log_changes(df, {"k": lambda v: F.lit(1)}, windows.tumbling(100), 0, 1000, least=held)
    cols = ["win_end", "seq", "kind", "value.least"]
    assert sorted(map(repr, out.select(*cols).collect())) == sorted(map(repr, want.select(*cols).collect()))
    final = [sorted(map(repr, windows.window_log(df, {"k": lambda v: F.lit(1)}, windows.tumbling(100), least=a).collect())) for a in (windows.smallest(x), held)]
    assert final[0] == final[1] and len(final[0]) == 2


# Triggers


def alerts(spark, events, spec):
    df = watermark.with_wm_before(log(spark, events), "ts", "seq")
    return sorted((r.ts, r.kind, r.status, r.value) for r in trigger.of_stream(df, ["k"], "ts", "seq", "v", spec).collect())


def test_trigger_states(spark):
    spec = trigger.Trigger("t", trigger.greater_than(5), "high")
    assert alerts(spark, [("A", 0, 9), ("A", 1, 8), ("A", 2, 3), ("A", 1, 9)], spec) == [(0, "D", "problem", 9.0), (0, "R", "problem", 9.0), (2, "D", "ok", 3.0)]
    spec = trigger.Trigger("t", trigger.greater_than_with_hysteresis(5, 2))
    assert alerts(spark, [("A", 0, 9), ("A", 1, 4), ("A", 2, 1)], spec) == [(0, "D", "problem", 9.0), (0, "R", "problem", 9.0), (2, "D", "ok", 1.0)]


def test_trigger_debounce(spark):
    spec = trigger.Trigger("t", trigger.greater_than(5), problem_for=10, recovery_for=5)
    events = [("A", 0, 9), ("B", 8, 0), ("A", 9, 7), ("B", 11, 0), ("A", 20, 1), ("B", 30, 0)]
    assert alerts(spark, events, spec) == [(10, "D", "problem", 7.0), (10, "R", "problem", 7.0), (25, "D", "ok", 1.0)]
    assert alerts(spark, [("A", 0, 9), ("A", 5, 1), ("A", 40, 1)], spec) == []


def test_trigger_edges_agree_with_the_machine(spark):
    df = log(spark, [("A", i, v) for i, v in enumerate([1, 9, 9, 2, 8, 1])])
    spec = trigger.default_config("t", trigger.greater_than(5))
    assert rows(trigger.edges(df, ["k"], "ts", "seq", "v", spec), "ts", "status") == [(1, "problem"), (3, "ok"), (4, "problem"), (5, "ok")]
    both = trigger.combine(df, ["k"], "ts", "seq", "v", [spec, trigger.Trigger("u", trigger.less_than(2))])
    assert {r.trigger for r in both.collect()} == {"t", "u"}


# Sources and sinks


def test_decoding_sends_bad_payloads_aside(spark):
    raw = spark.createDataFrame([("t", '{"a": 1}'), ("t", "{bad"), ("t", None)], "topic string, p string")
    good, dead = readers.decode_json(raw, "p", "a long")
    assert [r.a for r in good.collect()] == [1] and dead.count() == 2


def test_versioned_payloads(spark):
    df = spark.range(1).select(F.explode(F.array(readers.encode_versioned(F.lit("new"), 2), readers.encode_versioned(F.lit("old"), 1), readers.encode_versioned(F.lit("?"), 300), F.lit("x").cast("binary"))).alias("b"))
    good, bad = readers.decode_versioned(df, "b", 2, {1: lambda b: F.concat(F.lit("was ").cast("binary"), b)})
    assert sorted(bytes(r.payload) for r in good.collect()) == [b"new", b"was old"]
    assert sorted(r.error for r in bad.collect()) == ["payload too short", "unknown version 300"]


def test_replay_and_upserts(spark, tmp_path):
    df = readers.of_list(spark, [(i,) for i in range(5)], "x long")
    assert readers.read_from(df, 3).count() == 2 and readers.log_length(df) == 5
    with pytest.raises(ValueError):
        readers.read_from(df, 6)
    write = sinks.upsert_files(str(tmp_path / "t"), ["k"], "seq")
    write(log(spark, [("A", 1, 1), ("B", 1, 2)]), 0)
    for _ in range(2):  # a repeated batch changes nothing
        write(log(spark, [("A", 9, 7)]).withColumn("seq", F.lit(10).cast("long")), 1)
    assert rows(sinks.current(spark, str(tmp_path / "t")), "k", "v") == [("A", 7), ("B", 2)]
    done, kept = set(), []
    sink = sinks.transactional(lambda b: b not in done, lambda d, b: kept.append(b), done.add, lambda b: None)
    sink(df, 1), sink(df, 1)
    assert kept == [1]


@pytest.mark.parametrize(
    "call",
    [
        lambda s: windows.tumbling(0), lambda s: windows.sliding(5, 0), lambda s: windows.count_tumbling(0), lambda s: windows.session_window(s, ["k"], "ts", 0), lambda s: state.dedup(s, ["k"], "ts", "seq", 0),
        lambda s: state.on_silence(s, ["k"], "ts", "seq", 5, ttl=5), lambda s: watermark.event_time(s, "ts", -1), lambda s: aggs.top_k_by(0, F.col("v"), F.col("v"), F.col("v")), lambda s: scalar.shard(F.col("k"), 0),
        lambda s: trigger.Trigger("t", trigger.is_some(), "none"), lambda s: trigger.combine(s, ["k"], "ts", "seq", "v", []), lambda s: joins.keyed_join([s], ["k"], "seq", "ts", "v", ttl=0), lambda s: readers.encode_versioned(F.lit("x"), 70_000),
        lambda s: windows.window_changes(s, ["k"], "ts", "seq", windows.tumbling(1), lambda w: F.lit(1), late_policy="x"), lambda s: watermark.merge_partitioned([], "ts", "seq"),
    ],
)
def test_bad_parameters(spark, call):
    with pytest.raises(ValueError):
        call(log(spark, [("A", 1, 1)]))


def test_runtime_helpers():
    from tidemark.streaming import runtime as rt

    assert [rt.delay_for(n) for n in (1, 2, 3, 10)] == [0, 0.1, 0.2, 5.0]
    calls = []
    assert rt.with_retry(lambda: calls.append(1) or 1 / 0, attempts=3, sleep=lambda s: None) is None and len(calls) == 3
    assert rt.Config.of_json(rt.PROD.to_json()) == rt.PROD
    with pytest.raises(ValueError):
        rt.Config("fast").validate()
    m = rt.Metrics()
    m.add("rows", 3), m.set_gauge("state", 2), m.observe("batch", 0.05)
    assert "rows 3" in m.dump() and 'batch_bucket{le="0.1"} 1' in m.dump() and "batch_count 1" in m.dump()
    lines = []
    rt.Log(lines.append, "warn").info("no"), rt.Log(lines.append, "warn").error('a "b"', n=1)
    assert json.loads(lines[0]) == {"level": "error", "msg": 'a "b"', "n": 1} and len(lines) == 1
    h = rt.Health()
    h.set("unhealthy", "disk")
    assert not h.is_live() and json.loads(h.to_json()) == {"status": "unhealthy", "reason": "disk"}
    s, at = rt.Shutdown(), []
    s.register(lambda: at.append(time.time()))
    s.request(), s.request()
    assert s.is_requested() and len(at) == 1


def test_shard_hashes_bytes(spark):
    def expected(key, n):
        h = 5381
        for b in key.encode():
            h = (h * 33 + b) & ((1 << 62) - 1)
        return h % n

    keys = ["", "a", "ab", "sensor-17", "Łódź 東京", "x" * 300]
    rows = spark.createDataFrame([(k,) for k in [*keys, None]], "k string").select("k", scalar.shard(F.col("k"), 1_000_003).alias("s")).collect()
    assert {r["k"]: r["s"] for r in rows} == {None: None} | {k: expected(k, 1_000_003) for k in keys}
    assert expected("", 1_000_003) == 5381 and expected("ab", 1_000_003) == 863193
