"""Lookups, latest-value joins, as-of joins and gated streams."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import positive


def table_build(rows: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """The lookup table of a finite input: the last row of each key."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("_row")).select(*keys, "_row.*")


def table_build_ttl(rows: DataFrame, keys: Sequence[str], seq: str, ts: str, ttl: int) -> DataFrame:
    """As ``table_build``, without keys whose last row is more than ``ttl`` behind the latest event time."""
    positive("ttl", ttl)
    latest = table_build(rows, keys, seq)
    newest = rows.agg(F.max(ts).alias("_newest"))
    return latest.join(F.broadcast(newest)).where(F.col(ts) >= F.col("_newest") - ttl).drop("_newest")


def update_table(base: DataFrame, changes: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """``base`` upserted by a changelog's D and U rows (columns of base, kind, seq); R is passed over."""
    cols = base.columns
    new = changes.where("kind IN ('D', 'U')").select(*cols, F.col(seq).alias("_seq"))
    both = base.withColumn("_seq", F.lit(-(1 << 62))).unionByName(new)
    rest = [c for c in cols if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_seq").alias("_row")).select(*keys, "_row.*").select(*cols)


def enrich(df: DataFrame, lookup: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join: exactly one row per input row, as ``lookup`` has one row per key.

    Whether the lookup is broadcast is decided by its size at run time.
    """
    return df.join(lookup, list(keys), "left")


def keyed_join(inputs: Sequence[DataFrame], keys: Sequence[str], seq: str, ts: str, value: str, ttl: int | None = None, latency: int = 0) -> DataFrame:
    """Latest-value join of N inputs: each row gives the key's latest value of every input (v0, v1, ...).

    ``seq`` orders rows over all inputs.  With ``ttl`` a value older than the watermark its reader meets less
    ttl is gone.
    """
    if ttl is not None:
        positive("ttl", ttl)
    rows = reduce(DataFrame.unionByName, [d.select(*keys, seq, ts, value, F.lit(i).alias("src")) for i, d in enumerate(inputs)])
    if ttl is not None:
        from tidemark.operators.watermark import with_wm_before

        rows = with_wm_before(rows, ts, seq, latency)
    frame = Window.partitionBy(*keys).orderBy(seq).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for i in range(len(inputs)):
        latest = F.last(F.when(F.col("src") == i, F.struct(F.col(value).alias("v"), F.col(ts).alias("t"))), ignorenulls=True).over(frame)
        alive = F.lit(True) if ttl is None else F.coalesce(latest["t"] >= F.col("wm_before") - ttl, F.lit(True))
        rows = rows.withColumn(f"v{i}", F.when(alive, latest["v"]))
    return rows.select(*keys, F.col(seq).alias("seq"), F.col(ts).alias("ts"), "src", *[f"v{i}" for i in range(len(inputs))])


def keyed_join_log(log: DataFrame, n: int, key: str, slot: str, value: str) -> DataFrame:
    """Latest-value join of ``n`` inputs given as one changelog whose values have fields ``key``, ``slot`` (0..n-1: the
    input) and ``value`` (not null).  D sets the slot; R clears it if it still holds that value, else nothing comes
    out; U does both in one step, so readers never see the slot empty in between.  A correction that moves to
    another key clears the one and sets the other."""
    def act(of: str, sets: bool, says: Column) -> Column:
        fields = [F.col(of)[key].alias("key"), F.col(of)[slot].cast("int").alias("slot"), F.col(of)[value].alias("v"), F.lit(sets).alias("sets"), says.alias("says")]
        return F.struct(*fields)

    old, new = F.col("old"), F.col("value")
    moved = ~old[key].eqNullSafe(new[key])
    other = moved | (old[slot] != new[slot])
    set_, yes = act("value", True, F.lit(True)), F.lit(True)
    steps = F.when(F.col("kind") == "R", F.array(act("value", False, yes))).when((F.col("kind") == "U") & old.isNotNull() & other, F.array(act("old", False, moved), set_)).otherwise(F.array(set_))
    rows = log.select("seq", "ts", F.posexplode(steps).alias("step", "x")).select("seq", "ts", "step", "x.*")
    order = Window.partitionBy("key").orderBy("seq", "step")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hits = F.lit(False)
    for i in range(n):
        mine = F.col("slot") == i
        rows = rows.withColumn(f"_g{i}", F.count(F.when(mine & F.col("sets"), 1)).over(so_far)).withColumn(f"_s{i}", F.last(F.when(mine & F.col("sets"), F.struct("v")), ignorenulls=True).over(so_far))
        hit = mine & ~F.col("sets") & F.coalesce(F.col(f"_s{i}.v").eqNullSafe(F.col("v")), F.lit(False)) & F.col(f"_s{i}").isNotNull()
        held = Window.partitionBy("key", f"_g{i}").orderBy("seq", "step")
        rows = rows.withColumn(f"_c{i}", F.count(F.when(hit, 1)).over(held.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        hits = hits | (hit & (F.col(f"_c{i}") == 1))
    out = rows.where(F.col("says") & (F.col("sets") | hits))
    return out.select(F.col("key").alias(key), "seq", "step", "ts", *[F.when(F.col(f"_c{i}") == 0, F.col(f"_s{i}.v")).alias(f"v{i}") for i in range(n)])


def keyed_join_map(inputs: Sequence[DataFrame], keys: Sequence[str], seq: str, ts: str, value: str, keep: Column, *result: Column) -> DataFrame:
    """``keyed_join`` whose snapshots are filtered by ``keep`` and projected to ``result``."""
    return keyed_join(inputs, keys, seq, ts, value).where(keep).select(*keys, "seq", "ts", *result)


def temporal_join(main: DataFrame, versions: DataFrame, keys: Sequence[str], ts: str, valid_from: str, seq: str, columns: Sequence[str]) -> DataFrame:
    """Left as-of join: each main row with the version of its key that was latest at its time.

    Among versions of equal time the later arrival (``seq``) wins.  One shuffle by key: both sides are
    unioned and the last version is carried forward.
    """
    v = versions.select(*keys, F.col(valid_from).alias("_at"), F.lit(0).alias("_side"), F.col(seq).alias("_seq"), F.struct(*columns).alias("_version"))
    m = main.select(*keys, F.col(ts).alias("_at"), F.lit(1).alias("_side"), F.col(seq).alias("_seq"), F.struct(*[c for c in main.columns if c not in keys]).alias("_row"))
    both = v.unionByName(m, allowMissingColumns=True)
    frame = Window.partitionBy(*keys).orderBy("_at", "_side", "_seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last("_version", ignorenulls=True).over(frame)
    return both.withColumn("_last", last).where("_side = 1").select(*keys, "_row.*", *[F.col("_last")[c].alias(c) for c in columns])


def as_of(versions: DataFrame, keys: Sequence[str], valid_from: str, seq: str, at: int) -> DataFrame:
    """The version of each key that was valid at ``at``."""
    rows = versions.where(F.col(valid_from) <= at)
    rest = [c for c in versions.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(valid_from, seq)).alias("_row")).select(*keys, "_row.*")


def prune_versions_before(versions: DataFrame, keys: Sequence[str], valid_from: str, seq: str, at: int) -> DataFrame:
    """Versions still needed for any time from ``at`` on: later ones, and the one valid at ``at``."""
    order = Window.partitionBy(*keys).orderBy(F.desc(valid_from), F.desc(seq))
    old = F.sum((F.col(valid_from) <= at).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return versions.withColumn("_old", old).where("_old <= 1").drop("_old")


def suppress_while(controller: DataFrame, suppressed: DataFrame, keys: Sequence[str], suppressed_keys: Sequence[str], ts: str, seq: str, gate: Column) -> DataFrame:
    """Rows of ``suppressed`` that come while their key's gate is not on.

    ``gate`` over the controller is 'on', 'off' or null (no change).  At equal times the controller comes first.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    c = controller.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col(ts).alias("_at"), F.lit(0).alias("_side"), F.col(seq).alias("_seq"), gate.alias("_gate"))
    s = suppressed.select(*[F.col(k).alias(n) for k, n in zip(suppressed_keys, names, strict=True)], F.col(ts).alias("_at"), F.lit(1).alias("_side"), F.col(seq).alias("_seq"), F.struct(*suppressed.columns).alias("_row"))
    frame = Window.partitionBy(*names).orderBy("_at", "_side", "_seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = c.unionByName(s, allowMissingColumns=True).withColumn("_on", F.last("_gate", ignorenulls=True).over(frame))
    return rows.where("_side = 1 AND NOT coalesce(_on = 'on', false)").select("_row.*")


def co_process(inputs: Sequence[DataFrame], keys: Sequence[str], order: Sequence[str], step, schema: str, finish=None) -> DataFrame:
    """Two or more inputs of different shape with one state per key: rows are tagged ``src`` and scanned in order."""
    from tidemark.operators.scan import ordered_scan

    tagged = [d.withColumn("src", F.lit(i)) for i, d in enumerate(inputs)]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    return ordered_scan(both, keys, [*order, "src"], step, schema, finish)
