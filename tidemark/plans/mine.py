"""A synthetic mine: beacons, lamps and their packets, generated on the cluster by formula.

Horizons of beacons on a 50 m grid and lamps on a 25 m grid; each lamp hears the nearest beacons of its horizon
every step.  Flags (dropped packets, low battery and so on) follow a hash of the lamp.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import distance_from_rssi
from tidemark.operators import windows
from tidemark.plans.pipelines import median_location


def beacons(spark: SparkSession, horizons: int = 16, per: int = 64) -> DataFrame:
    side = math.ceil(math.sqrt(per))
    rows = spark.range(horizons * per).select((F.col("id") / per).cast("int").alias("h"), (F.col("id") % per).cast("int").alias("i"))
    return rows.select("h", F.format_string("B%d-%d", "h", "i").alias("beacon"), (F.col("i") % side * 50.0).alias("x"), ((F.col("i") / side).cast("int") * 50.0).alias("y"))


def packets(spark: SparkSession, horizons: int = 16, lamps: int = 256, beacons_per: int = 64, minutes: int = 60, step_s: int = 15, heard: int = 5) -> DataFrame:
    """lamp, seq, ts, voltage, moving, sos, readings: array of (beacon, rssi); late and doubled packets included.

    By a hash of the lamp a tenth stop sending after a third of the time, a twentieth hear no beacon after a sixth, a
    fifth stand still after half, a third have a low battery and one in a hundred presses SOS at a quarter."""
    side, n = math.ceil(math.sqrt(lamps)), minutes * 60 // step_s
    grid = spark.range(horizons * lamps).select((F.col("id") / lamps).cast("int").alias("h"), (F.col("id") % lamps).cast("int").alias("i"), F.col("id").alias("lamp"))
    grid = grid.select("h", "lamp", (F.col("i") % side * 25.0).alias("lx"), ((F.col("i") / side).cast("int") * 25.0).alias("ly"))
    near = grid.join(beacons(spark, horizons, beacons_per), "h").withColumn("d", F.greatest(F.lit(1.0), F.hypot(F.col("x") - F.col("lx"), F.col("y") - F.col("ly"))))
    near = near.withColumn("k", F.row_number().over(Window.partitionBy("lamp").orderBy("d", "beacon"))).where(F.col("k") <= heard)
    near = near.groupBy("lamp").agg(F.sort_array(F.collect_list(F.struct("k", "beacon", "d"))).alias("near"))
    steps = near.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("r", F.pmod(F.xxhash64("lamp", "s"), F.lit(1000)))
    quiet = F.pmod(F.hash("lamp"), F.lit(100)) < 10
    rows = steps.where(~(quiet & (F.col("s") > n // 3)))
    reading = F.transform("near", lambda b: F.struct(b["beacon"].alias("beacon"), (-40.0 - 20.0 * F.log10(b["d"]) + (F.pmod(F.xxhash64("lamp", "s", b["beacon"]), F.lit(600)) - 300) / 100.0).alias("rssi")))
    flag = lambda salt, percent: F.pmod(F.hash("lamp", F.lit(salt)), F.lit(100)) < percent
    reading = F.when(flag(1, 5) & (F.col("s") > n // 6), F.slice(reading, 1, 0)).otherwise(reading)
    volts = F.when(flag(3, 30), 3.3 - 0.05 * F.pmod("lamp", F.lit(3))).otherwise(4.0).alias("voltage")
    moving, sos = ~(flag(2, 20) & (F.col("s") > n // 2)), flag(4, 1) & (F.col("s") == n // 4)
    rows = rows.select("lamp", (F.col("s") * step_s * 1000).cast("long").alias("ts"), volts, moving.alias("moving"), sos.alias("sos"), "r", reading.alias("readings"))
    copies = F.when(F.col("r") < 30, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = rows.withColumn("copy", F.explode(copies))
    late = F.when((F.col("r") >= 970) | (F.col("copy") == 1), 1_500_000).otherwise(0)
    return rows.withColumn("seq", (F.col("ts") + late) * 10_000 + F.col("lamp")).drop("r")


def _median(values, start, end):
    """Median signal of the sorted run of ``values`` from ``start`` (from 1) up to ``end``, exclusive."""
    last = end - start - 1
    at = lambda i: F.get(values, start - 1 + F.floor(i).cast("int"))["rssi"]
    return (at(last / 2) + at((last + 1) / 2)) / 2


def median_rssi(spark: SparkSession, rows: DataFrame, size_ms: int = 60_000, step_ms: int = 5_000) -> DataFrame:
    """Doubles dropped, sliding medians of each beacon's signal, position between the two best.

    A window's content changes only where a packet enters or leaves it, so medians and positions are worked out
    once per change and lamp, and then given to all windows up to the next change.  One shuffle, by lamp.
    Times are not negative, so no window starts before 0.
    """
    if size_ms % step_ms:
        raise ValueError("the size must be a multiple of the step")
    panes = size_ms // step_ms
    once = rows.select("lamp", "ts", "readings").repartition("lamp").dropDuplicates(["lamp", "ts"])
    enter = (F.floor(F.col("ts") / step_ms) + 1).cast("long")
    moves = once.select("lamp", F.explode(F.array(F.struct(enter.alias("c"), F.col("readings").alias("r")), F.struct((enter + panes).alias("c"), F.lit(None).cast(once.schema["readings"].dataType).alias("r")))).alias("m")).select("lamp", "m.c", "m.r")
    by_lamp = Window.partitionBy("lamp").orderBy("c")
    held = F.flatten(F.collect_list("r").over(by_lamp.rangeBetween(-(panes - 1), 0)))
    states = moves.select("lamp", "c", held.alias("held"), F.lead("c").over(by_lamp).alias("next")).where("next > c AND size(held) > 0")
    # sorted by beacon and signal, each beacon's signals are one run, and its median lies in the run's middle
    runs = states.select("lamp", "c", "next", F.array_sort("held").alias("held")).withColumn("of", F.col("held.beacon")).withColumn("names", F.array_distinct("of"))
    runs = runs.withColumn("starts", F.transform("names", lambda b: F.array_position("of", b).cast("int")))
    medians = F.transform("names", lambda b, i: F.struct(_median(F.col("held"), F.get("starts", i), F.coalesce(F.get("starts", i + 1), F.size("held") + 1)).alias("rssi"), b.alias("beacon")))
    top = runs.select("lamp", "c", "next", F.slice(F.sort_array(medians, asc=False), 1, 2).alias("top"))
    place = F.broadcast(beacons(spark).select("beacon", "x", "y").groupBy().agg(F.map_from_entries(F.collect_list(F.struct("beacon", F.struct("x", "y")))).alias("grid")))
    one, two = F.get("top", F.lit(0)), F.get("top", F.lit(1))
    d1, d2 = distance_from_rssi(one["rssi"]), distance_from_rssi(two["rssi"])
    p1, p2 = F.try_element_at("grid", one["beacon"]), F.try_element_at("grid", two["beacon"])
    between = lambda f: F.when(two.isNull(), p1[f]).otherwise(p1[f] + (p2[f] - p1[f]) * (d1 / (d1 + d2)))
    placed = top.join(place).select("lamp", "c", "next", one["beacon"].alias("beacon"), between("x").alias("x"), between("y").alias("y"))
    ends = F.sequence(F.col("c") * step_ms, (F.col("next") - 1) * step_ms, F.lit(step_ms).cast("long"))
    return placed.select("lamp", F.explode(ends).alias("win_end"), "beacon", "x", "y").where(F.col("win_end") >= size_ms)


def median_rssi_plain(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """The same by one row per reading and window."""
    readings = rows.dropDuplicates(["lamp", "ts"]).select("lamp", "ts", F.explode("readings").alias("r")).select("lamp", "ts", "r.beacon", "r.rssi")
    return median_location(readings, beacons(spark), windows.sliding(60_000, 5_000))
