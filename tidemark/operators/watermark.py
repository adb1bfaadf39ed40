"""Event time, lateness and ordered unions.

Results of late-data operators depend on arrival order and on the watermark each row meets.  In batch the
arrival order is a long column ``seq`` and the watermark that a row meets is a computed column:
the largest event time before it, minus the latency.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import not_negative

#: Width, in seq, of the ranges in which running maxima are taken; the pass over ranges sees one row each.
RANGE = 1 << 18


def event_time(df: DataFrame, ts: str, lateness_ms: int) -> DataFrame:
    """Streaming: declares the watermark.  Batch: leaves the rows (use ``with_wm_before``)."""
    not_negative("lateness", lateness_ms)
    if not df.isStreaming:
        return df
    if dict(df.dtypes)[ts] != "timestamp":
        df = df.withColumn(ts, F.col(ts).cast("timestamp"))
    return df.withWatermark(ts, f"{lateness_ms} milliseconds")


def running_before(df: DataFrame, value: Column, seq: str, into: str) -> DataFrame:
    """Adds the largest ``value`` over rows before this one by ``seq``, in two parallel passes."""
    return running_before_all(df, {into: value}, seq)


def running_before_all(df: DataFrame, values: dict[str, Column], seq: str) -> DataFrame:
    """``running_before`` of several values in the same passes."""
    rows = df.withColumn("_range", F.floor(F.col(seq) / RANGE)).withColumns({f"_value_{n}": v for n, v in values.items()})
    tops = rows.groupBy("_range").agg(*[F.max(f"_value_{n}").alias(f"_top_{n}") for n in values])
    prior = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("_range", *[F.max(f"_top_{n}").over(prior).alias(f"_prior_{n}") for n in values])
    local = Window.partitionBy("_range").orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    found = {n: F.greatest(f"_prior_{n}", F.max(f"_value_{n}").over(local)) for n in values}
    return rows.join(tops, "_range").withColumns(found).drop("_range", *[f"{p}_{n}" for n in values for p in ("_value", "_prior")])


def with_wm_before(df: DataFrame, ts: str, seq: str, latency_ms: int = 0, into: str = "wm_before") -> DataFrame:
    """Adds the watermark (ms) each row meets: null for the first."""
    not_negative("latency", latency_ms)
    return running_before(df, F.col(ts), seq, into).withColumn(into, F.col(into) - latency_ms)


def idle_advance(df: DataFrame, ts: str, beats: DataFrame, into: str = "is_beat") -> DataFrame:
    """Unions heartbeat rows (``ts`` only) with data, so that silent sources still move event time."""
    return df.withColumn(into, F.lit(False)).unionByName(beats.select(F.col(ts)).withColumn(into, F.lit(True)), allowMissingColumns=True)


def union_ordered(inputs: Sequence[DataFrame], ts: str, seq: str, into: str = "seq", bucket_ms: int | None = None) -> DataFrame:
    """All rows of the inputs with one arrival order ``into``: by running event time, then input, then seq.

    An input that is not sorted keeps its own order, as merging by the heads of the inputs does.  Rows are numbered
    by buckets of time; unless given, their width is such that one holds about ``RANGE`` rows.
    """
    if bucket_ms is None:
        low, high, n = reduce(DataFrame.unionByName, [d.select(F.col(ts).alias("t")) for d in inputs]).agg(F.min("t"), F.max("t"), F.count("t")).first()
        bucket_ms = max(1, (high - low) * RANGE // n) if n else 1
    tagged = [running_before(d, F.col(ts), seq, "_before").withColumn("_head", F.greatest(ts, "_before")).withColumn("src", F.lit(i)) for i, d in enumerate(inputs)]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    both = both.withColumn("_seq", F.col(seq))
    return numbered(both, F.floor(F.col("_head") / bucket_ms), ["_head", "src", "_seq"], into).drop("_before", "_head", "_seq")


def numbered(df: DataFrame, bucket: Column, order: Sequence[str], into: str) -> DataFrame:
    """Row numbers from 0 by ``order``, where ``bucket`` (long) is nondecreasing in it: ranked within buckets,
    then moved by the sizes of the buckets before, so no task sees all rows."""
    rows = df.withColumn("_bucket", bucket)
    sizes = rows.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rank = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order))
    return rows.join(sizes.select("_bucket", before.alias("_base")), "_bucket").withColumn(into, F.col("_base") + rank - 1).drop("_bucket", "_base")


def merge_partitioned(inputs: Sequence[DataFrame], ts: str, seq: str, latency_ms: int = 0, idle_ms: int | None = None) -> DataFrame:
    """Round-robin union of partitions; ``wm_before`` is the least watermark over the partitions.

    A partition that has been idle for ``idle_ms`` of event time (compared with the furthest partition), or
    has no row left, no longer holds the watermark back.
    """
    if not inputs:
        raise ValueError("no inputs")
    not_negative("latency", latency_ms)
    turns = [numbered(d, F.floor(F.col(seq) / RANGE), [seq], "_turn").withColumn("src", F.lit(i)) for i, d in enumerate(inputs)]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), turns)
    rows = numbered(both, F.floor(F.col("_turn") / RANGE), ["_turn", "src"], "seq")
    lasts = {r["src"]: r["_last"] for r in rows.groupBy("src").agg(F.max("seq").alias("_last")).collect()}
    rows = running_before_all(rows, {f"_m{i}": F.when(F.col("src") == i, F.col(ts)) for i in range(len(inputs))}, "seq")
    marks = [(F.col("seq") > lasts.get(i, -1), F.col(f"_m{i}")) for i in range(len(inputs))]
    furthest = F.array_max(F.array(*[m for _, m in marks]))
    held = []
    for ended, m in marks:
        free = ended if idle_ms is None else ended | (furthest - m >= idle_ms)
        held.append(F.when(free, F.lit(1 << 62)).otherwise(F.coalesce(m, F.lit(-(1 << 62)))))
    low = F.array_min(F.array(*held)) if len(held) > 1 else held[0]
    wm = F.when((low == 1 << 62), furthest).when(low == -(1 << 62), None).otherwise(low) - latency_ms
    return rows.withColumn("wm_before", wm).drop("_turn", *[f"_m{i}" for i in range(len(inputs))])
