"""Connected components of a table of links, by rounds of contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def connected_components(links: DataFrame) -> DataFrame:
    """id, component (smallest id reachable) for every id in ``links`` (a, b).

    Each round, every vertex points to the least of itself and its neighbours, pointers jump once, and the
    links between different targets go on.  The first round orders vertices by id, which settles stars around
    their smallest member at once.  Later ones order them by a hash that changes every second round: in a
    random order a fixed share of the vertices is expected to go whatever the graph, where in order of ids a
    chain 1-2-3-... would lose two a round; keeping an order for two rounds settles any star.  So rounds grow
    with the logarithm of the vertices.  Each round ends in a table in the shared folder; the driver sees only
    whether links are left.  A hub with many links is aggregated before the shuffle.  Self-links, repeats and
    null ends are ignored.
    """
    ordered = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    left = written(links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(*ordered("a", "b")).distinct())
    maps = []
    while not left.isEmpty():
        salt = (len(maps) + 1) // 2
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(salt)) if salt else F.lit(0).cast("long"), F.col(c).alias("id"))  # noqa: B023, E731
        ends = left.select(F.col("a").alias("id"), F.col("b").alias("other")).union(left.select("b", "a"))
        near = written(ends.groupBy("id").agg(F.min(rank("other")).alias("m")).select("id", F.least(rank("id"), "m")["id"].alias("up")))
        top = near.select(F.col("id").alias("up"), F.col("up").alias("top"))
        up = written(near.join(top, "up").select("id", F.col("top").alias("up")))
        maps.append(up)
        a, b = up.select(F.col("id").alias("a"), F.col("up").alias("ua")), up.select(F.col("id").alias("b"), F.col("up").alias("ub"))
        left = written(left.join(a, "a").join(b, "b").where("ua <> ub").select(*ordered("ua", "ub")).distinct())
    if not maps:
        return links.sparkSession.createDataFrame([], "id long, component long")
    out = maps[-1].withColumnRenamed("up", "component")
    for m in maps[-2::-1]:  # the later, the smaller
        out = m.join(out.toDF("up", "component"), "up", "left").select("id", F.coalesce("component", "up").alias("component"))
    if len(maps) > 1:  # the vertex that stands for a component need not be its smallest
        out = written(out)
        least = out.groupBy("component").agg(F.min("id").alias("least"))
        out = out.join(least, "component").select("id", F.col("least").alias("component"))
    return out
