"""Queries of projections, filters, exception isolation, unions and the changelog algebra."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import scalar
from tidemark.operators import changelog as cl
from tidemark.operators import watermark
from tidemark.plans.base import EVENTS, SHUFFLED, events, shuffled_events, table
from tidemark.sources import readers


def map_currency(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.round(F.col("o_totalprice") * 0.908, 4).alias("price_eur"))


def filter_selection(spark, d):
    return events(spark, d).where("event_type = 'purchase' AND value > 50").select("event_id", "user_id", "value")


def map_ts(spark, d):
    return events(spark, d).select("event_id", (F.col("ts") - F.pmod("ts", F.lit(scalar.hours(1)))).alias("hour_ms"), scalar.clock(F.pmod("ts", F.lit(scalar.minutes(1)))).alias("clock"))


def flat_map_rules(spark, d):
    rules = F.array_compact(F.array(F.when(F.col("value") > 100, F.lit("high")), F.when(F.col("event_type") == "error", F.lit("error")), F.when(F.col("value") < 1, F.lit("low"))))
    return events(spark, d).select("event_id", F.explode(rules).alias("rule"))


def safe_map(spark, d):
    raw = events(spark, d).withColumn("raw", F.when(F.col("event_id") % 10 == 0, F.lit("bad")).otherwise(F.col("value").cast("string")))
    good, failed = cl.safe_split(raw, parsed=F.expr("try_cast(raw AS DOUBLE)"))
    return good.select("event_id", F.lit("ok").alias("status"), F.round("parsed", 4).alias("parsed")).union(failed.select("event_id", "error", F.lit(None).cast("double")))


def safe_filter(spark, d):
    rows = events(spark, d).withColumn("ratio", F.expr("try_divide(value, event_id % 5)"))
    passing, failed = cl.safe_filter(rows, F.col("ratio") > 10)
    return passing.select("event_id", F.lit("pass").alias("status")).union(failed.select("event_id", F.lit("failed").alias("status")))


def decode_dlq(spark, d):
    raw = events(spark, d).select("event_id", F.lit("events").alias("topic"), F.when(F.col("event_id") % 13 == 0, F.lit("{oops")).otherwise(F.col("props")).alias("payload"))
    good, dead = readers.decode_json(raw, "payload", "k long")
    return good.groupBy().agg(F.count("*").alias("n_good"), F.sum("k").alias("sum_k")).join(dead.groupBy().agg(F.count("*").alias("n_dead")))


def versioned_schema(spark, d):
    body = F.col("value").cast("string")
    rows = events(spark, d).select("event_id", F.when(F.col("event_id") % 3 == 0, readers.encode_versioned(body, 1)).when(F.col("event_id") % 3 == 1, readers.encode_versioned(body, 2)).otherwise(F.lit("x").cast("binary")).alias("bytes"))
    good, bad = readers.decode_versioned(rows, "bytes", 2, {1: lambda b: F.concat(F.lit("v1:").cast("binary"), b)})
    return good.select("event_id", F.col("payload").cast("string").startswith("v1:").cast("string").alias("result")).union(bad.select("event_id", "error"))


def union_ordered(spark, d):
    e = events(spark, d)
    parts = [e.where(e["event_type"] == t).select("event_id", "user_id", "ts") for t in ("click", "view")]
    return watermark.union_ordered(parts, "ts", "event_id").select("seq", "event_id", F.col("src").cast("long").alias("src"))


def merge_partitioned(spark, d):
    e = events(spark, d)
    parts = [e.where(F.col("user_id") % 2 == i).select("event_id", "ts") for i in range(2)]
    return watermark.merge_partitioned(parts, "ts", "event_id", scalar.minutes(5)).select("seq", "event_id", "wm_before")


def event_time_lateness(spark, d):
    rows = watermark.with_wm_before(shuffled_events(spark, d), "ts", "seq", scalar.minutes(10))
    return rows.select("event_id", "seq", "wm_before", F.coalesce(F.col("ts") < F.col("wm_before"), F.lit(False)).alias("is_late"))


def _corrections(spark, d):
    """A changelog: errors withdraw the event before them, sign-ups correct it, others add."""
    e = events(spark, d)
    value = F.struct("event_id", "user_id", "value")
    old = F.struct((F.col("event_id") - 1).alias("event_id"), "user_id", (F.col("value") * 2).alias("value"))
    kind = F.when(F.col("event_type") == "error", "R").when(F.col("event_type") == "signup", "U").otherwise("D")
    return e.select(F.col("event_id").alias("seq"), "ts", kind.alias("kind"), value.alias("value"), F.when(kind == "U", old).alias("old"))


def changelog_filter(spark, d):
    out = cl.filter_values(_corrections(spark, d), lambda v: v["value"] > 60)
    return out.select("seq", "kind", F.round("value.value", 4).alias("value"), F.round("old.value", 4).alias("old"))


def changelog_map(spark, d):
    out = cl.map_values(_corrections(spark, d), lambda v: v["value"] + 1)
    return out.select("seq", "kind", F.round("value", 4).alias("value"), F.round("old", 4).alias("old"))


def changelog_flat_map(spark, d):
    twice = lambda v: F.when(v["value"] > 60, F.array(v["value"], v["value"] * 10)).otherwise(F.array(v["value"]))
    out = cl.flat_map(_corrections(spark, d), twice)
    return out.groupBy("seq", "kind").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.sum("old"), 4).alias("total_old"))


def changelog_expand(spark, d):
    return cl.expand_updates(_corrections(spark, d)).select("seq", F.col("step").cast("long").alias("step"), "kind", F.round("value.value", 4).alias("value"))


def materialize_final(spark, d):
    out = cl.materialize(_corrections(spark, d), lambda v: v["user_id"])
    return out.select(F.col("id").alias("user_id"), F.round("value.value", 4).alias("value"))


def count_and_fold(spark, d):
    return cl.fold_data(_corrections(spark, d), F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


def stream_shards(spark, d):
    return events(spark, d).groupBy(scalar.shard(F.col("event_type"), 7).alias("shard")).agg(F.count("*").alias("n"))


CORRECTIONS = EVENTS + """, log AS (SELECT event_id AS seq, user_id, value AS v, CASE WHEN event_type = 'error' THEN 'R' WHEN event_type = 'signup' THEN 'U' ELSE 'D' END AS kind,
  CASE WHEN event_type = 'signup' THEN value * 2 END AS o FROM ev)"""

QUERIES = {
    f.__name__: f
    for f in (
        map_currency, filter_selection, map_ts, flat_map_rules, safe_map, safe_filter, decode_dlq, versioned_schema, union_ordered, merge_partitioned, event_time_lateness,
        changelog_filter, changelog_map, changelog_flat_map, changelog_expand, materialize_final, count_and_fold, stream_shards,
    )
}

SQL = {
    "stream_shards": """SELECT (list_reduce(list_concat([5381::HUGEINT], list_transform(range(1, length(event_type) + 1), lambda i: ascii(substr(event_type, i::INT, 1))::HUGEINT)), lambda a, b: (a * 33 + b) % 4611686018427387904) % 7)::BIGINT AS shard,
count(*) AS n FROM events GROUP BY ALL""",
    "map_currency": "SELECT o_orderkey, round(o_totalprice * 0.908, 4) AS price_eur FROM orders",
    "filter_selection": "SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase' AND value > 50",
    "map_ts": f"WITH {EVENTS} SELECT event_id, ts - ts % 3600000 AS hour_ms, ((ts % 60000) // 1000)::VARCHAR || '.' || lpad(((ts % 60000) % 1000)::VARCHAR, 3, '0') || 's' AS clock FROM ev",
    "flat_map_rules": "SELECT event_id, 'high' AS rule FROM events WHERE value > 100 UNION ALL SELECT event_id, 'error' FROM events WHERE event_type = 'error' UNION ALL SELECT event_id, 'low' FROM events WHERE value < 1",
    "safe_map": "SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'parsed' ELSE 'ok' END AS status, CASE WHEN event_id % 10 = 0 THEN NULL ELSE round(value, 4) END AS parsed FROM events",
    "safe_filter": "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'failed' ELSE 'pass' END AS status FROM events WHERE event_id % 5 = 0 OR value / (event_id % 5) > 10",
    "decode_dlq": "SELECT count(*) FILTER (WHERE event_id % 13 <> 0) AS n_good, (sum(CAST(json_extract(props, '$.k') AS BIGINT)) FILTER (WHERE event_id % 13 <> 0))::BIGINT AS sum_k, count(*) FILTER (WHERE event_id % 13 = 0) AS n_dead FROM events",
    "versioned_schema": "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'false' ELSE 'payload too short' END AS result FROM events",
    "union_ordered": f"WITH {EVENTS} SELECT row_number() OVER (ORDER BY ts, event_type, event_id) - 1 AS seq, event_id, (event_type = 'view')::BIGINT AS src FROM ev WHERE event_type IN ('click', 'view')",
    "merge_partitioned": f"""WITH {EVENTS}, t AS (SELECT event_id, ts, user_id % 2 AS src, row_number() OVER (PARTITION BY user_id % 2 ORDER BY event_id) AS turn FROM ev),
s AS (SELECT *, row_number() OVER (ORDER BY turn, src) - 1 AS seq FROM t),
m AS (SELECT *, max(CASE WHEN src = 0 THEN ts END) OVER w AS m0, max(CASE WHEN src = 1 THEN ts END) OVER w AS m1,
  seq > max(CASE WHEN src = 0 THEN seq END) OVER () AS e0, seq > max(CASE WHEN src = 1 THEN seq END) OVER () AS e1 FROM s WINDOW w AS (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT seq, event_id, CASE WHEN e0 AND e1 THEN greatest(m0, m1) WHEN e0 THEN m1 WHEN e1 THEN m0 WHEN m0 IS NULL OR m1 IS NULL THEN NULL ELSE least(m0, m1) END - 300000 AS wm_before FROM m""",
    "event_time_lateness": f"""WITH {SHUFFLED}, w AS (SELECT event_id, seq, ts, max(ts) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 600000 AS wm_before FROM sh)
SELECT event_id, seq, wm_before, coalesce(ts < wm_before, false) AS is_late FROM w""",
    "changelog_filter": f"""WITH {CORRECTIONS}, k AS (SELECT *, CASE WHEN kind <> 'U' THEN CASE WHEN v > 60 THEN kind END WHEN v > 60 AND o > 60 THEN 'U' WHEN v > 60 THEN 'D' WHEN o > 60 THEN 'R' END AS k2 FROM log)
SELECT seq, k2 AS kind, round(CASE WHEN kind = 'U' AND k2 = 'R' THEN o ELSE v END, 4) AS value, CASE WHEN k2 = 'U' THEN round(o, 4) END AS old FROM k WHERE k2 IS NOT NULL""",
    "changelog_map": f"WITH {CORRECTIONS} SELECT seq, kind, round(v + 1, 4) AS value, round(o + 1, 4) AS old FROM log",
    "changelog_flat_map": f"""WITH {CORRECTIONS}, n AS (SELECT *, CASE WHEN v > 60 THEN 2 ELSE 1 END AS nv, CASE WHEN o > 60 THEN 2 ELSE 1 END AS no_ FROM log),
c AS (SELECT *, CASE WHEN kind = 'U' THEN least(nv, no_) ELSE nv END AS n FROM n)
SELECT seq, kind, n::BIGINT AS n, round(CASE n WHEN 2 THEN v + v * 10 ELSE v END, 4) AS total, round(CASE WHEN kind = 'U' THEN CASE n WHEN 2 THEN o + o * 10 ELSE o END END, 4) AS total_old FROM c""",
    "changelog_expand": f"""WITH {CORRECTIONS} SELECT seq, 0::BIGINT AS step, CASE kind WHEN 'U' THEN 'R' ELSE kind END AS kind, round(CASE kind WHEN 'U' THEN o ELSE v END, 4) AS value FROM log
UNION ALL SELECT seq, 1, 'D', round(v, 4) FROM log WHERE kind = 'U'""",
    "materialize_final": f"WITH {CORRECTIONS}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) AS rn FROM log) SELECT user_id, round(v, 4) AS value FROM r WHERE rn = 1 AND kind <> 'R'",
    "count_and_fold": f"WITH {CORRECTIONS} SELECT count(*) AS n, round(sum(v), 2) AS total FROM log WHERE kind <> 'R'",
}
