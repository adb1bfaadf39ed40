"""Streaming forms agree with the batch forms on in-order data; restarts repeat nothing."""

import os
import time

import pytest
from pyspark.sql import functions as F

from tidemark.functions.scalar import event_millis
from tidemark.operators import state, trigger, watermark, windows
from tidemark.sources import readers, sinks
from tidemark.streaming import processors as p
from tidemark.streaming import runtime as rt

SCHEMA = "k string, seq long, ts timestamp, src int, value double, kind string"
#: key, ms, src, value
BASE = 1_000_000  # rows at or before the first watermark, 0, would be late
EVENTS = [(k, BASE + t, src, v) for k, t, src, v in [("A", 0, 0, 9.0), ("B", 4, 1, 1.0), ("A", 10, 1, 8.0), ("B", 30, 0, 0.0), ("A", 45, 0, 0.0), ("A", 50, 1, 6.0), ("B", 75, 1, 9.0), ("A", 90, 0, 9.0)]]
LATE = 10_000_000


@pytest.fixture
def source(spark, tmp_path):
    """One event a file, and one far later event of another key to move the watermark."""
    folder = tmp_path / "in"
    for i, (k, t, src, v) in enumerate([*EVENTS, ("Z", LATE, 1, 0.0)]):
        row = spark.createDataFrame([(k, i, t, src, v, "D")], "k string, seq long, ts long, src int, value double, kind string")
        row.withColumn("ts", F.timestamp_millis("ts")).select("k", "seq", "ts", "src", "value", "kind").coalesce(1).write.mode("append").parquet(str(folder))
        newest = max((f for f in folder.iterdir() if f.suffix == ".parquet"), key=os.path.getmtime)
        os.utime(newest, (1_000_000 + i, 1_000_000 + i))
    return watermark.event_time(readers.file_stream(spark, str(folder), SCHEMA, files_per_batch=1), "ts", 0)


def _batch(spark):
    return spark.createDataFrame([(k, i, t, src, v) for i, (k, t, src, v) in enumerate(EVENTS)], "k string, seq long, ts long, src int, value double")


def _run(df, tmp_path):
    out = str(tmp_path / "out")
    df.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(out)


def _rows(df, *cols):
    return sorted(tuple(r) for r in df.where("k <> 'Z'").select(*cols).collect())


def test_dedup(spark, source, tmp_path):
    got = _run(p.process_keyed(source, ["k"], p.Dedup(["k"], 20), SCHEMA), tmp_path)
    assert _rows(got, "seq") == _rows(state.dedup(_batch(spark), ["k"], "ts", "seq", 20), "seq")


def test_silence(spark, source, tmp_path):
    got = _run(p.process_keyed(source, ["k"], p.Silence(["k"], 25), "k string, kind string, ts long"), tmp_path)
    extra = spark.createDataFrame([("Z", 99, LATE, 1, 0.0)], "k string, seq long, ts long, src int, value double")
    log = watermark.with_wm_before(_batch(spark).union(extra), "ts", "seq")
    want = _rows(state.on_silence(log, ["k"], "ts", "seq", 25), "k", "kind", "ts")
    assert set(_rows(got, "k", "kind", "ts")) <= set(want) and ("A", "silent", BASE + 115) in _rows(got, "k", "kind", "ts")


def test_triggers(spark, source, tmp_path):
    t = p.Alerts(["k"], 0, 0, lambda v: v > 5, lambda v: v <= 5)
    got = _run(p.process_keyed(source, ["k"], t, "k string, kind string, status string, ts long, value double"), tmp_path)
    spec = trigger.Trigger("t", trigger.greater_than(5))
    assert _rows(got, "k", "kind", "status", "ts", "value") == _rows(trigger.of_stream(_batch(spark), ["k"], "ts", "seq", "value", spec), "k", "kind", "status", "ts", "value")


def test_debounced_trigger_fires_by_timer(spark, source, tmp_path):
    t = p.Alerts(["k"], 30, 0, lambda v: v > 5, lambda v: v <= 5)
    got = _run(p.process_keyed(source, ["k"], t, "k string, kind string, status string, ts long, value double"), tmp_path)
    assert {("A", "D", "problem", BASE + 80), ("B", "D", "problem", BASE + 105)} <= set(_rows(got, "k", "kind", "status", "ts"))


def test_latest_values_and_gate(spark, source, tmp_path):
    got = _run(p.process_keyed(source, ["k"], p.LatestValues(["k"], 2), "k string, ts timestamp, v0 double, v1 double"), tmp_path / "a")
    assert [r[1:] for r in _rows(got.withColumn("ts", event_millis(F.col("ts"))), "k", "ts", "v0", "v1") if r[0] == "B"] == [(BASE + 4, None, 1.0), (BASE + 30, 0.0, 1.0), (BASE + 75, 0.0, 9.0)]
    got = _run(p.process_keyed(source.withColumn("value", F.when(F.col("value") > 5, 1.0).otherwise(0.0)), ["k"], p.Gate(["k"]), SCHEMA), tmp_path / "b")
    assert _rows(got, "k", "seq") == [("A", 5), ("B", 1), ("B", 6)]


def test_as_of(spark, source, tmp_path):
    got = _run(p.process_keyed(source, ["k"], p.AsOf(["k"]), "k string, ts long, seq long, value double, version double"), tmp_path)
    assert _rows(got, "k", "ts", "version") == [("A", BASE + 10, 9.0), ("A", BASE + 50, 0.0), ("B", BASE + 4, None), ("B", BASE + 75, 0.0)]


def test_silence_age(spark, source, tmp_path):
    got = _run(p.process_keyed(source, ["k"], p.SilenceAge(["k"], 1000), "k string, ts long, age long"), tmp_path)
    ages = _rows(got, "k", "ts", "age")
    assert {(k, t, 0) for k, t, _, _ in EVENTS} <= set(ages) and all(a == 0 or a >= 1000 for _, _, a in ages)


def test_windows(spark, source, tmp_path):
    for spec in (windows.tumbling(20), windows.sliding(40, 20)):
        got = _run(windows.window_agg(source, ["k"], "ts", spec, F.count("*").alias("n")), tmp_path / str(spec.size))
        want = windows.window_agg(_batch(spark), ["k"], "ts", spec, F.count("*").alias("n"))
        assert _rows(got, "k", "win_end", "n") == _rows(want, "k", "win_end", "n")


def test_exactly_once_over_a_restart(spark, source, tmp_path):
    out, failed = str(tmp_path / "sink"), []
    write = sinks.per_batch_files(out)

    def flaky(df, batch):
        write(df, batch)
        if batch == 3 and not failed:
            failed.append(batch)
            raise RuntimeError("after the write, before the commit")

    with pytest.raises(Exception):
        rt.run_exactly_once(source, flaky, str(tmp_path / "cp"))
    rt.run_exactly_once(source, flaky, str(tmp_path / "cp"))
    got = spark.read.parquet(out)
    assert failed and sorted(r.seq for r in got.collect()) == list(range(len(EVENTS) + 1))


def test_fan_out_supervision_and_metrics(spark, source, tmp_path):
    seen, metrics = {"a": 0, "b": 0}, rt.Metrics()
    spark.streams.addListener(listener := rt.QueryMetrics(metrics))

    def outlet(name):
        def write(df, batch):
            seen[name] += df.count()

        return write

    for q in rt.fan_out(source, {n: outlet(n) for n in seen}, str(tmp_path / "cp")).values():
        q.awaitTermination()
    assert seen == {"a": len(EVENTS) + 1, "b": len(EVENTS) + 1}
    tries = []

    def start():
        def write(df, batch):
            tries.append(batch)
            if len(tries) < 2:
                raise RuntimeError("once")

        return source.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "s")).trigger(availableNow=True).start()

    assert rt.supervise({"x": (start, rt.Policy("restart", 2, 0.01))}) == {"x": None}
    bad = lambda: source.writeStream.foreachBatch(lambda d, b: 1 / 0).trigger(availableNow=True).start()
    assert "ZeroDivision" in rt.supervise({"y": (bad, rt.Policy("isolate"))})["y"]
    with pytest.raises(RuntimeError):
        rt.supervise({"z": (bad, rt.Policy("crash_all"))})
    for _ in range(50):
        if metrics.counters.get("input_rows"):
            break
        time.sleep(0.1)
    spark.streams.removeListener(listener)
    assert metrics.counters["input_rows"] > 0


def test_run_modes_and_dead_letters(spark, tmp_path):
    got = []
    assert rt.run(spark.range(3), lambda df, b: got.append((df.count(), b)), rt.NOOP) is None and got == [(3, 0)]
    dead = rt.DeadLetters(str(tmp_path / "dlq"))
    dead.send(spark.createDataFrame([("t", "x")], "topic string, payload string"))
    assert dead.count == 1 and spark.read.parquet(str(tmp_path / "dlq")).count() == 1
