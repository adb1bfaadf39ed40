"""Composable aggregates: builders of Catalyst aggregate expressions.

An ``Agg`` names its result columns and says whether withdrawals can be taken out again.  ``both`` runs many in
one pass, ``contramap`` changes what is fed in and ``map`` what comes out.  ``seq`` is the arrival order,
which breaks ties: the earliest row wins.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import positive

Project = Callable[[Column], Column]


@dataclass(frozen=True)
class Agg:
    build: Callable[[Project], Column]
    retractable: bool
    feed: Project = staticmethod(lambda c: c)
    post: Project = staticmethod(lambda c: c)

    def column(self) -> Column:
        return self.post(self.build(self.feed))

    def map(self, g: Project) -> Agg:
        return replace(self, post=lambda c, f=self.post: g(f(c)))

    def contramap(self, g: Project) -> Agg:
        return replace(self, feed=lambda c, f=self.feed: f(g(c)))


def both(**aggs: Agg) -> list[Column]:
    """Several aggregates as columns of one pass."""
    return [a.column().alias(n) for n, a in aggs.items()]


def is_retractable(*aggs: Agg) -> bool:
    return all(a.retractable for a in aggs)


def run(df: DataFrame, keys: Sequence[str] = (), **aggs: Agg) -> DataFrame:
    return df.groupBy(*keys).agg(*both(**aggs))


def count() -> Agg:
    return Agg(lambda f: F.count(F.lit(1)), True)


def count_if(p: Column) -> Agg:
    return Agg(lambda f: F.count_if(f(p)), True)


def sum_of(x: Column) -> Agg:
    return Agg(lambda f: F.coalesce(F.sum(f(x)), F.lit(0.0)), True)


def mean(x: Column) -> Agg:
    return Agg(lambda f: F.avg(f(x)), True)


def _nan_first(best: Column, x: Column) -> Column:
    """Not-a-number anywhere gives not-a-number."""
    return F.when(F.max(F.isnan(x.cast("double"))), F.lit(float("nan"))).otherwise(best)


def min_of(x: Column) -> Agg:
    return Agg(lambda f: _nan_first(F.min(f(x)), f(x)), False)


def max_of(x: Column) -> Agg:
    return Agg(lambda f: _nan_first(F.max(f(x)), f(x)), False)


def arg_min(x: Column, row: Column, seq: Column) -> Agg:
    return Agg(lambda f: F.min_by(row, F.struct(f(x), seq)), False)


def arg_max(x: Column, row: Column, seq: Column) -> Agg:
    return Agg(lambda f: F.max_by(row, F.struct(f(x), -seq)), False)


def first(row: Column, seq: Column) -> Agg:
    return Agg(lambda f: F.min_by(f(row), seq), False)


def last(row: Column, seq: Column) -> Agg:
    return Agg(lambda f: F.max_by(f(row), seq), False)


def median(x: Column) -> Agg:
    return Agg(lambda f: F.median(f(x)), True)


def approx_median(x: Column, accuracy: int = 10_000) -> Agg:
    return Agg(lambda f: F.percentile_approx(f(x), 0.5, accuracy), False)


def to_list(row: Column, seq: Column) -> Agg:
    """Rows in arrival order; for groups whose size is bounded by their window."""
    return Agg(lambda f: F.transform(F.array_sort(F.collect_list(F.struct(seq.alias("s"), f(row).alias("r")))), lambda x: x["r"]), True)


def _ranked(k: int, order: Column, row: Column, seq: Column) -> Callable[[Project], Column]:
    positive("k", k)
    return lambda f: F.transform(F.slice(F.array_sort(F.collect_list(F.struct(f(order).alias("o"), seq.alias("s"), row.alias("r")))), 1, k), lambda x: x["r"])


def top_k_by(k: int, by: Column, row: Column, seq: Column) -> Agg:
    """At most k rows, largest first, ties in arrival order.  A group is put together before it is cut: for groups
    whose size their window bounds; ``top_k_list`` cuts first and takes groups of any size."""
    return Agg(_ranked(k, -by, row, seq), False)


def bottom_k_by(k: int, by: Column, row: Column, seq: Column) -> Agg:
    return Agg(_ranked(k, by, row, seq), False)


def top_k(df: DataFrame, keys: Sequence[str], k: int, *order: Column) -> DataFrame:
    """Top k as rows with ``rank``: ranked and cut before the shuffle, in bounded memory for any group size."""
    positive("k", k)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= k)


def top_k_list(df: DataFrame, keys: Sequence[str], k: int, row: Column, *order: Column, into: str = "top") -> DataFrame:
    """``top_k`` as one row per key with a list, in order."""
    best = top_k(df, keys, k, *order).select(*keys, "rank", row.alias("r"))
    return best.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "r"))), lambda x: x["r"]).alias(into))


def group_by(df: DataFrame, keys: Sequence[str], subkey: str, inner: dict[str, Agg], into: str = "groups") -> DataFrame:
    """Per key, the list of (subkey, inner results) by descending subkey; two levels of aggregation."""
    low = df.groupBy(*keys, subkey).agg(*both(**inner))
    item = F.struct(F.col(subkey), *[F.col(c) for c in inner])
    return low.groupBy(*keys).agg(F.sort_array(F.collect_list(item), asc=False).alias(into))
