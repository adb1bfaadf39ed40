"""Mixing sources to target weights by subset-sum budget fitting.

Each source gets a share of the budget by weight; shares stop at ``cap`` times the source's size and the
excess is shared again by weight.  Within a source every document is taken whole ``base`` times
(the whole part of target/size), and the rest of the target is a subset sum: documents are counted by
exact length, lengths first give counts in proportion to all but half a window of words, and a
bounded-knapsack dynamic programme over the whole remaining budget picks how many more of each length to take.
The window is ``WINDOW`` words or twice the longest document; when no sum meets the target, it grows eightfold
until one does or nothing is fixed before the programme, whose sum is then the nearest there is.  Only above
``MOST`` (in units of the lengths' common divisor) it stops growing and the nearest sum found counts.
Which documents of a length are taken follows a seeded hash.

Sources may be as many as there are rows: they are numbered by ranges, and the level at which shares stop
is found by rounds of one aggregate, of which two numbers reach the driver.  The programme sees counts by
length, one group per source, not documents.  Documents of one length are ranked in 4096 hash ranges, so a source
and length that hold a third of all rows spread over as many tasks.

Null text: size 0, taken 0.  Null source: a source of its own, last.  A source with no words has target
0.  Repeated rows count and are picked each; reruns agree.  A very long document is taken or left whole.
Empty tables give no rows.  Extra columns are kept by ``mix`` and cannot clash with its own.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

#: Weights by order of source, share of all sizes, largest share of a source's size.
WEIGHTS, BUDGET, CAP = (3, 1, 2), 1.5, 2.0
WINDOW, RANGES, SEED = 1 << 16, 4096, 20240229
#: The widest window: a set of sums is a bit for each, and a programme keeps as many sets as halvings of its items.
MOST = 1 << 28


def word_count(text: str = "text"):
    """Number of maximal runs outside space and 0x09-0x0D; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def numbered(sources: DataFrame) -> DataFrame:
    """``sources`` (one row each) with ``at``, their place by code point, null last: ranked within ranges, then moved
    by the sizes of the ranges before."""
    order = [F.asc_nulls_last("source")]
    dealt = written(sources.repartitionByRange(F.col("source").isNull(), *order).withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = dealt.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return dealt.withColumn("rank", rank).join(base, "part").select(*sources.columns, (F.col("base") + F.col("rank") - 1).alias("at"))


def targets(sources: DataFrame, weights: Sequence[int], budget: float, cap: float) -> DataFrame:
    """``sources`` (source, n: words) with ``target``: ``budget`` times all words, shared by weight, none above cap * n
    and the excess shared again.  Weights are whole numbers, so sums are exact in any order."""
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("at") % len(weights) + 1).cast("int"))
    rows = written(numbered(sources).withColumn("weight", weight))
    total = rows.agg(F.sum("n")).first()[0] or 0
    level, closed, open_ = 0.0, -1.0, 0
    while True:  # the level of shares rises as sources stop at their cap
        over = F.col("weight") * F.lit(level) > cap * F.col("n")
        now = rows.agg(F.sum(F.when(over, F.col("n")).otherwise(0)), F.sum(F.when(over, 0).otherwise(F.col("weight")))).first()
        if now[0] == closed and now[1] == open_ or not now[1]:
            break
        closed, open_ = now
        level = (budget * total - cap * closed) / open_
    return rows.select("at", "source", "n", F.least(cap * F.col("n"), F.col("weight") * F.lit(level)).alias("target"))


def nearest_sum(weights: Sequence[int], goal: int, bits: int) -> tuple[int, list[int]]:
    """The sum of some of ``weights``, below ``bits``, that is nearest to ``goal``, and which they are."""
    mask, reach, n = (1 << bits) - 1, 1, 0
    for w in weights:
        if reach >> goal & 1:
            break
        reach |= (reach << w) & mask if w < bits else 0
        n += 1
    low = (reach & ((1 << (goal + 1)) - 1)).bit_length() - 1
    above = reach >> goal
    high = goal + (above & -above).bit_length() - 1 if above else None
    best = high if high is not None and high - goal < goal - low else low
    taken: list[int] = []

    def walk(first: int, last: int, base: int, left: int) -> int:
        """Takes weights of first..last until ``left`` is in ``base``, the sums of those before; keeps few sets at once."""
        if base >> left & 1:
            return left
        if last - first == 1:
            taken.append(first)
            return left - weights[first]
        middle, mid = (first + last) // 2, base
        for w in weights[first:middle]:
            mid |= (mid << w) & mask if w < bits else 0
        return walk(first, middle, base, walk(middle, last, mid, left))

    walk(0, n, 1, best)
    return best, taken


def fit_lengths(lengths: Sequence[int], counts: Sequence[int], want: float) -> list[int]:
    """How many of each length to take, none above its count, for a sum as near ``want`` as is found."""
    total, goal = sum(n * c for n, c in zip(lengths, counts, strict=True)), round(want)
    if want >= total:
        return list(counts)
    if 2 * goal > total:  # what is left out is the smaller sum
        out = fit_lengths(lengths, counts, total - goal)
        return [c - k if n else 0 for n, c, k in zip(lengths, counts, out, strict=True)]
    order = sorted((i for i in range(len(lengths)) if lengths[i] > 0), key=lambda i: -lengths[i])
    if not order:
        return [0] * len(lengths)
    step = math.gcd(*(lengths[i] for i in order))  # all sums are its multiples
    aim, longest = (2 * goal + step) // (2 * step), lengths[order[0]] // step
    best, window = None, max(WINDOW, 2 * longest)
    while True:
        take, left = [0] * len(lengths), aim
        for i in order:
            take[i] = int(counts[i] * (max(0, aim - window // 2) * step / total))
            left -= take[i] * (lengths[i] // step)
        for i in order:  # down to what the programme covers: what is skipped is longer than what is left of it
            more = min(counts[i] - take[i], max(0, left - window // 2) // (lengths[i] // step))
            take[i] += more
            left -= more * (lengths[i] // step)
        bits = left + min(left, longest) + 1
        items = []  # (length, copies together), counts split into powers of two
        for i in reversed(order):
            spare, copies = min(counts[i] - take[i], bits // (lengths[i] // step) + 1), 1
            while spare > 0:
                copies = min(copies, spare)
                items.append((i, copies))
                spare, copies = spare - copies, copies * 2
        found, used = nearest_sum([lengths[i] // step * n for i, n in items], left, bits)
        for k in used:
            take[items[k][0]] += items[k][1]
        off = abs(sum(n * k for n, k in zip(lengths, take, strict=True)) - goal)
        if best is None or off < best[0]:
            best = off, take
        # nearest of all: no multiple is nearer, or the programme covered the whole budget
        if found == left or window // 2 >= aim or 8 * window > MOST:
            return best[1]
        window *= 8


def mix(documents: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", seed: int = SEED) -> DataFrame:
    """key, size, source_size, target, copies and taken (words) of every row of ``documents``."""
    rows = written(documents.select(F.col(key).alias("key"), F.col(source).alias("source"), word_count(text).alias("size")))
    found = targets(rows.groupBy("source").agg(F.sum("size").alias("n")), WEIGHTS, BUDGET, CAP)
    base = F.when(F.col("n") > 0, F.floor(F.col("target") / F.col("n")).cast("int")).otherwise(0)
    plan = written(found.select("at", "source", F.col("n").alias("source_size"), "target", base.alias("base"), F.col("n").alias("n_")).withColumn("rest", F.col("target") - F.col("n_") * F.col("base")).drop("n_"))
    dealt = rows.join(plan, rows["source"].eqNullSafe(plan["source"])).select("key", "size", "at", "source_size", "target", "base", "rest", F.xxhash64(F.lit(seed), "key").alias("order"))
    dealt = dealt.withColumn("range", F.shiftrightunsigned("order", 52).cast("int"))
    ranges = written(dealt.groupBy("at", "size", "range", "rest").agg(F.count("*").alias("n")))
    lengths = ranges.groupBy("at", "rest", "size").agg(F.sum("n").alias("n"))

    def fitted(group: pd.DataFrame) -> pd.DataFrame:
        take = fit_lengths(group["size"].tolist(), group["n"].tolist(), float(group["rest"].iloc[0]))
        return pd.DataFrame({"at": group["at"], "size": group["size"], "extra": take})

    extra = lengths.groupBy("at").applyInPandas(fitted, "at int, size long, extra long")
    before = Window.partitionBy("at", "size").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    prior = ranges.select("at", "size", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("prior"))
    place = ["at", "size", "range"]  # all three, or a large group of one length would meet in one task
    quota = prior.join(extra, ["at", "size"]).select(*place, (F.col("extra") - F.col("prior")).alias("quota")).repartition(*place)
    rank = F.row_number().over(Window.partitionBy(*place).orderBy("order", "key"))
    picked = dealt.repartition(*place).withColumn("rank", rank).join(quota, place)
    copies = F.col("base") + F.when((F.col("rank") <= F.col("quota")) & (F.col("base") < int(CAP)), 1).otherwise(0)
    return picked.select(F.col("key").alias(key), "size", "source_size", "target", copies.cast("long").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def op7_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
