"""The changelog algebra: values that are added, withdrawn and corrected.

A changelog is a DataFrame of ``seq`` (arrival), ``ts`` (ms), ``kind`` and two structs of one type: ``value`` and
``old``.  Kinds: D adds ``value``, R withdraws it, U replaces ``old`` by ``value`` in one step.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DATA, RETRACT, UPDATE = "D", "R", "U"
Fn = Callable[[Column], Column]


def from_rows(df: DataFrame, ts: str, seq: str, beside: Sequence[str] = ()) -> DataFrame:
    """Plain rows as D events; the whole row but the columns ``beside``, which stay columns, is the value."""
    row = df.drop(*beside)
    value = F.struct(*[F.col(c) for c in row.columns])
    kind = row.schema.simpleString()
    return df.select(F.col(seq).cast("long").alias("seq"), F.col(ts).alias("ts"), F.lit(DATA).alias("kind"), value.alias("value"), F.lit(None).cast(kind).alias("old"), *beside)


def data(value: Column, ts: Column, seq: Column) -> list[Column]:
    return [seq.alias("seq"), ts.alias("ts"), F.lit(DATA).alias("kind"), value.alias("value")]


def retract(value: Column, ts: Column, seq: Column) -> list[Column]:
    return [seq.alias("seq"), ts.alias("ts"), F.lit(RETRACT).alias("kind"), value.alias("value")]


def update(old: Column, new: Column, ts: Column, seq: Column) -> list[Column]:
    return [seq.alias("seq"), ts.alias("ts"), F.lit(UPDATE).alias("kind"), new.alias("value"), old.alias("old")]


def map_values(log: DataFrame, f: Fn) -> DataFrame:
    """f on the value, and on the old value of corrections."""
    return log.select("seq", "ts", "kind", f(F.col("value")).alias("value"), F.when(F.col("kind") == UPDATE, f(F.col("old"))).alias("old"))


def map_with_ts(log: DataFrame, f: Callable[[Column, Column], Column]) -> DataFrame:
    ts = F.col("ts")
    return log.select("seq", "ts", "kind", f(F.col("value"), ts).alias("value"), F.when(F.col("kind") == UPDATE, f(F.col("old"), ts)).alias("old"))


def filter_values(log: DataFrame, p: Fn) -> DataFrame:
    """Keeps what passes.  A correction that starts to pass becomes D, one that stops becomes R of the old."""
    new, old = F.coalesce(p(F.col("value")), F.lit(False)), F.coalesce(p(F.col("old")), F.lit(False))
    is_u = F.col("kind") == UPDATE
    kind = F.when(~is_u, F.when(new, F.col("kind"))).when(old & new, UPDATE).when(new, DATA).when(old, RETRACT)
    value = F.when(is_u & old & ~new, F.col("old")).otherwise(F.col("value"))
    return log.select("seq", "ts", kind.alias("kind"), value.alias("value"), F.when(kind == UPDATE, F.col("old")).alias("old")).where("kind IS NOT NULL")


def flat_map(log: DataFrame, f: Fn) -> DataFrame:
    """f gives an array; a correction pairs old and new results and stops at the shorter."""
    rows = log.withColumn("_new", f(F.col("value"))).withColumn("_old", f(F.col("old")))
    shorter = F.when(F.col("kind") == UPDATE, F.least(F.size("_new"), F.size("_old"))).otherwise(F.size("_new"))
    rows = rows.select("seq", "ts", "kind", "_new", "_old", F.explode(F.when(shorter > 0, F.sequence(F.lit(0), shorter - 1))).alias("_i"))
    return rows.select("seq", "ts", "kind", F.get("_new", "_i").alias("value"), F.when(F.col("kind") == UPDATE, F.get("_old", "_i")).alias("old"))


def values(log: DataFrame) -> DataFrame:
    """Values of D and U in arrival order columns: what a plain sink sees."""
    return log.where(F.col("kind").isin(DATA, UPDATE)).select("seq", "ts", "value.*")


def count_data(log: DataFrame) -> int:
    return log.where(F.col("kind").isin(DATA, UPDATE)).count()


def fold_data(log: DataFrame, *aggregates: Column) -> DataFrame:
    return log.where(F.col("kind").isin(DATA, UPDATE)).select("seq", "ts", "value.*").agg(*aggregates)


def materialize(log: DataFrame, by: Fn) -> DataFrame:
    """The final table: the last event of each id decides; a withdrawal removes the id whatever its value."""
    last = log.groupBy(by(F.col("value")).alias("id")).agg(F.max_by(F.struct("kind", "value", "ts"), "seq").alias("last"))
    return last.where(F.col("last.kind") != RETRACT).select("id", "last.ts", "last.value")


def expand_updates(log: DataFrame) -> DataFrame:
    """Each correction as a withdrawal of the old value and an addition of the new one."""
    withdrawn, added = F.struct(F.lit(RETRACT).alias("kind"), F.col("old").alias("value")), F.struct(F.lit(DATA).alias("kind"), F.col("value"))
    steps = F.when(F.col("kind") == UPDATE, F.array(withdrawn, added)).otherwise(F.array(F.struct("kind", "value")))
    return log.select("seq", "ts", F.posexplode(steps).alias("step", "x")).select("seq", "step", "ts", "x.kind", "x.value")


def drop_noops(log: DataFrame) -> DataFrame:
    """Leaves out corrections that change nothing."""
    return log.where(~((F.col("kind") == UPDATE) & F.col("value").eqNullSafe(F.col("old"))))


# Rows whose expression fails: kept apart, never fatal.


def safe_split(df: DataFrame, **attempts: Column) -> tuple[DataFrame, DataFrame]:
    """(good, failed): ``attempts`` are try_* expressions; a row with a null attempt failed, and names it."""
    tried = df.select("*", *[c.alias(f"_try_{n}") for n, c in attempts.items()])
    names = [F.when(F.col(f"_try_{n}").isNull(), F.lit(n)) for n in attempts]
    error = F.coalesce(*names)
    good = tried.where(error.isNull()).select(*df.columns, *[F.col(f"_try_{n}").alias(n) for n in attempts])
    return good, tried.where(error.isNotNull()).select(*df.columns, error.alias("error"))


def safe_filter(df: DataFrame, attempt: Column) -> tuple[DataFrame, DataFrame]:
    """(passing, failed) of a boolean try_* expression: null is a failure, false is left out."""
    tried = df.withColumn("_ok", attempt)
    return tried.where("_ok").drop("_ok"), tried.where("_ok IS NULL").drop("_ok")


def safe_flat_map(df: DataFrame, attempt: Column, into: str) -> tuple[DataFrame, DataFrame]:
    """(exploded, failed) of an array-valued try_* expression."""
    tried = df.withColumn("_items", attempt)
    return tried.where("_items IS NOT NULL").select(*df.columns, F.explode("_items").alias(into)), tried.where("_items IS NULL").drop("_items")
