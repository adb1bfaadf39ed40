"""Driver tables as logs: long millisecond times and an arrival order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalar import event_millis


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id (arrival order), user_id, event_type, value, props, ts (ms)."""
    return table(spark, sf_dir, "events").withColumn("ts", event_millis(F.col("ts")))


def shuffled_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same log arriving out of order: every 17th event comes 40 places later (``seq``)."""
    late = F.col("event_id") + F.when(F.col("event_id") % 17 == 0, 40).otherwise(0)
    return events(spark, sf_dir).withColumn("seq", late * 2 + F.when(F.col("event_id") % 17 == 0, 1).otherwise(0))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").withColumn("o_ts", event_millis(F.col("o_orderdate")))


def corrected_log(spark: SparkSession, sf_dir: str, **fields) -> DataFrame:
    """The out-of-order log as a changelog: every 5th event corrects its user's event before, every 7th withdraws it, every
    11th withdraws a value that was never there."""
    from pyspark.sql import Window

    value = F.struct("user_id", F.col("event_type").alias("type"), F.col("value").alias("x"))
    order = Window.partitionBy("user_id").orderBy("seq")
    rows = shuffled_events(spark, sf_dir).withColumn("v", value)
    rows = rows.withColumn("was", F.lag("v").over(order)).withColumn("was_ts", F.lag("ts").over(order))
    kind = F.when(F.col("was").isNull(), "D").when(F.col("event_id") % 5 == 0, "U").when(F.col("event_id") % 7 == 0, "R").when(F.col("event_id") % 11 == 0, "R").otherwise("D")
    stale = F.struct(F.col("was.user_id"), F.col("was.type"), (F.col("was.x") + 1).alias("x"))
    changed = F.when(kind == "R", F.when(F.col("event_id") % 7 == 0, F.col("was")).otherwise(stale)).otherwise(F.col("v"))
    at = F.when(kind == "D", F.col("ts")).otherwise(F.col("was_ts"))
    return rows.select("seq", at.alias("ts"), F.col("ts").alias("arrived"), kind.alias("kind"), changed.alias("value"), F.when(kind == "U", F.col("was")).alias("old"))


#: SQL for the same logs.
EVENTS = "ev AS (SELECT event_id, user_id, event_type, value, props, (epoch_us(ts) // 1000)::BIGINT AS ts FROM events)"
SHUFFLED = EVENTS + """, sh AS (SELECT *, ((event_id + CASE WHEN event_id % 17 = 0 THEN 40 ELSE 0 END) * 2 + CASE WHEN event_id % 17 = 0 THEN 1 ELSE 0 END)::BIGINT AS seq FROM ev)"""
ORDERS = "ord AS (SELECT *, (epoch_us(o_orderdate) // 1000)::BIGINT AS o_ts FROM orders)"
CORRECTED = SHUFFLED + """, lg AS (SELECT *, lag(event_id) OVER o AS was_id, lag(ts) OVER o AS was_ts, lag(value) OVER o AS was_x, lag(event_type) OVER o AS was_type FROM sh WINDOW o AS (PARTITION BY user_id ORDER BY seq)),
kd AS (SELECT *, CASE WHEN was_id IS NULL THEN 'D' WHEN event_id % 5 = 0 THEN 'U' WHEN event_id % 7 = 0 OR event_id % 11 = 0 THEN 'R' ELSE 'D' END AS kind FROM lg),
cl AS (SELECT seq, user_id, kind, ts AS arrived, CASE WHEN kind = 'D' THEN ts ELSE was_ts END AS ts, CASE WHEN kind = 'R' THEN was_type ELSE event_type END AS type,
  CASE WHEN kind <> 'R' THEN value WHEN event_id % 7 = 0 THEN was_x ELSE was_x + 1 END AS x, CASE WHEN kind = 'U' THEN was_x END AS old_x, CASE WHEN kind = 'U' THEN was_type END AS old_type FROM kd)"""
