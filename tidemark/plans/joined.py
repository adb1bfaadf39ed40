"""Queries of lookups, latest-value joins, as-of joins and gated streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.scalar import hours
from tidemark.operators import joins
from tidemark.plans.base import CORRECTED, EVENTS, ORDERS, corrected_log, events, orders, table


def enrich_left(spark, d):
    lookup = table(spark, d, "customer").where("c_custkey % 3 <> 0").selectExpr("c_custkey AS user_id", "c_mktsegment", "c_nationkey")
    return joins.enrich(events(spark, d), lookup, ["user_id"]).select("event_id", "user_id", "c_mktsegment", "c_nationkey")


def table_build(spark, d):
    return joins.table_build(events(spark, d).select("user_id", "event_id", "event_type", "value"), ["user_id"], "event_id").select("user_id", "event_id", "event_type", "value")


def table_build_ttl(spark, d):
    rows = events(spark, d).select("user_id", "event_id", "ts", "value")
    return joins.table_build_ttl(rows, ["user_id"], "event_id", "ts", hours(12)).select("user_id", "event_id", "value")


def update_table(spark, d):
    base = table(spark, d, "customer").selectExpr("c_custkey AS user_id", "c_acctbal AS balance")
    e = events(spark, d).where("event_type IN ('purchase', 'error')")
    changes = e.select("user_id", F.col("value").alias("balance"), F.when(F.col("event_type") == "error", "R").otherwise("D").alias("kind"), "event_id")
    return joins.update_table(base, changes, ["user_id"], "event_id").select("user_id", "balance")


def _latest(spark, d, **more):
    e = events(spark, d)
    inputs = [e.where(e["event_type"] == t).select("user_id", "event_id", "ts", "value") for t in ("click", "view", "purchase")]
    return joins.keyed_join(inputs, ["user_id"], "event_id", "ts", "value", **more)


def keyed_join_latest(spark, d):
    return _latest(spark, d).select("user_id", "seq", "v0", "v1", "v2")


def keyed_join_ttl(spark, d):
    return _latest(spark, d, ttl=hours(24)).select("user_id", "seq", "v0", "v1", "v2")


def keyed_join_alerts(spark, d):
    e = events(spark, d)
    inputs = [e.where(e["event_type"] == t).select("user_id", "event_id", "ts", "value") for t in ("click", "view", "purchase")]
    keep = F.expr("v0 IS NOT NULL AND v1 IS NOT NULL AND v2 IS NOT NULL")
    total = F.round(F.col("v0") + F.col("v1") + F.col("v2"), 4)
    return joins.keyed_join_map(inputs, ["user_id"], "event_id", "ts", "value", keep & (total > 150), total.alias("total"))


def keyed_join_changes(spark, d):
    """Latest click and view of a log with withdrawals (some of them stale) and corrections that may change the slot."""
    slots = lambda v: F.struct(v["user_id"].alias("user_id"), F.when(v["type"] == "click", 0).when(v["type"] == "view", 1).otherwise(2).alias("slot"), v["x"].alias("x"))
    log = corrected_log(spark, d)
    log = log.select("seq", "ts", "kind", slots(F.col("value")).alias("value"), F.when(F.col("kind") == "U", slots(F.col("old"))).alias("old"))
    return joins.keyed_join_log(log, 3, "user_id", "slot", "x").select("user_id", "seq", "v0", "v1", "v2")


def _versions(spark, d):
    """Orders as versions of their customers, moved to the days of the events."""
    o = orders(spark, d)
    at = F.lit(1_704_067_200_000) + F.pmod(F.col("o_ts"), F.lit(2_500_000)) * 1000
    return o.select(F.col("o_custkey").alias("user_id"), at.alias("valid_from"), F.col("o_orderkey").alias("version"), "o_totalprice")


def temporal_asof(spark, d):
    main = events(spark, d).select("user_id", "event_id", "ts")
    versions = _versions(spark, d).withColumn("event_id", F.col("version"))
    return joins.temporal_join(main, versions, ["user_id"], "ts", "valid_from", "event_id", ["version", "o_totalprice"]).select("event_id", "user_id", "version", "o_totalprice")


def temporal_snapshot(spark, d):
    return joins.as_of(_versions(spark, d), ["user_id"], "valid_from", "version", 1_705_000_000_000).select("user_id", "version")


def temporal_prune(spark, d):
    return joins.prune_versions_before(_versions(spark, d), ["user_id"], "valid_from", "version", 1_705_000_000_000).select("user_id", "version")


def suppress_alerts(spark, d):
    e = events(spark, d)
    controller = e.where("event_type IN ('error', 'signup')")
    gate = F.when(F.col("event_type") == "error", "on").otherwise("off")
    clicks = e.where("event_type = 'click'").select("event_id", "user_id", "ts")
    return joins.suppress_while(controller, clicks, ["user_id"], ["user_id"], "ts", "event_id", gate).select("event_id", "user_id")


def co_process(spark, d):
    """Errors raise a key's level, purchases reset it; each click reports the level it meets."""
    e = events(spark, d).select("user_id", "event_id", "event_type")
    inputs = [e.where(e["event_type"] == t) for t in ("error", "purchase", "click")]

    def step(level, rows):
        level, out = level or 0, []
        for user, event, src in zip(rows["user_id"].tolist(), rows["event_id"].tolist(), rows["src"].tolist(), strict=True):
            if src == 2:
                out.append((user, event, level))
            level = level + 1 if src == 0 else 0 if src == 1 else level
        return level, out

    return joins.co_process(inputs, ["user_id"], ["event_id"], step, "user_id long, event_id long, level long")


QUERIES = {
    f.__name__: f
    for f in (
        keyed_join_changes, enrich_left, table_build, table_build_ttl, update_table, keyed_join_latest, keyed_join_ttl, keyed_join_alerts, temporal_asof, temporal_snapshot, temporal_prune, suppress_alerts, co_process,
    )
}

_LATEST = EVENTS + """, r AS (SELECT *, last_value(CASE WHEN event_type = 'click' THEN value END IGNORE NULLS) OVER w AS v0, last_value(CASE WHEN event_type = 'view' THEN value END IGNORE NULLS) OVER w AS v1,
  last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER w AS v2, last_value(CASE WHEN event_type = 'click' THEN ts END IGNORE NULLS) OVER w AS t0,
  last_value(CASE WHEN event_type = 'view' THEN ts END IGNORE NULLS) OVER w AS t1, last_value(CASE WHEN event_type = 'purchase' THEN ts END IGNORE NULLS) OVER w AS t2,
  max(ts) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS wm
  FROM ev WHERE event_type IN ('click', 'view', 'purchase') WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING))"""
_VERSIONS = ORDERS + """, ver AS (SELECT o_custkey AS user_id, 1704067200000 + (o_ts % 2500000) * 1000 AS valid_from, o_orderkey AS version, o_totalprice FROM ord)"""

SQL = {
    "keyed_join_changes": f"""WITH RECURSIVE {CORRECTED}, a AS (SELECT *, CASE type WHEN 'click' THEN 0 WHEN 'view' THEN 1 ELSE 2 END AS sl, CASE old_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 ELSE 2 END AS old_sl, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS n FROM cl),
g AS (SELECT user_id, 0::BIGINT AS n, 0::BIGINT AS seq, NULL::DOUBLE AS v0, NULL::DOUBLE AS v1, NULL::DOUBLE AS v2, false AS says FROM a WHERE n = 1
  UNION ALL SELECT a.user_id, a.n, a.seq, """ + ", ".join(f"CASE WHEN kind = 'R' THEN CASE WHEN sl = {i} AND v{i} = x THEN NULL ELSE v{i} END WHEN sl = {i} THEN x WHEN kind = 'U' AND old_sl = {i} AND v{i} = old_x THEN NULL ELSE v{i} END" for i in range(3)) + """,
    kind <> 'R' OR coalesce(CASE sl WHEN 0 THEN v0 WHEN 1 THEN v1 ELSE v2 END = x, false) FROM g JOIN a ON a.user_id = g.user_id AND a.n = g.n + 1)
SELECT user_id, seq, v0, v1, v2 FROM g WHERE says""",
    "enrich_left": "SELECT event_id, user_id, c_mktsegment, c_nationkey FROM events LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 <> 0) ON user_id = c_custkey",
    "table_build": "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1",
    "table_build_ttl": f"WITH {EVENTS}, l AS (SELECT *, max(ts) OVER () AS newest FROM ev) SELECT user_id, event_id, value FROM l QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1 AND ts >= newest - 43200000",
    "update_table": """WITH p AS (SELECT user_id, value, event_id FROM events WHERE event_type = 'purchase' UNION ALL SELECT c_custkey, c_acctbal, -1 FROM customer)
SELECT user_id, value AS balance FROM p QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1""",
    "keyed_join_latest": f"WITH {_LATEST} SELECT user_id, event_id AS seq, v0, v1, v2 FROM r",
    "keyed_join_ttl": f"""WITH {_LATEST} SELECT user_id, event_id AS seq, CASE WHEN coalesce(t0 >= wm - 86400000, true) THEN v0 END AS v0, CASE WHEN coalesce(t1 >= wm - 86400000, true) THEN v1 END AS v1,
  CASE WHEN coalesce(t2 >= wm - 86400000, true) THEN v2 END AS v2 FROM r""",
    "keyed_join_alerts": f"WITH {_LATEST} SELECT user_id, event_id AS seq, ts, round(v0 + v1 + v2, 4) AS total FROM r WHERE round(v0 + v1 + v2, 4) > 150",
    "temporal_asof": f"""WITH {EVENTS}, {_VERSIONS}, j AS (SELECT event_id, ev.user_id, version, o_totalprice, row_number() OVER (PARTITION BY event_id ORDER BY valid_from DESC, version DESC) AS rn
  FROM ev LEFT JOIN ver ON ev.user_id = ver.user_id AND valid_from <= ts) SELECT event_id, user_id, version, o_totalprice FROM j WHERE rn = 1""",
    "temporal_snapshot": f"WITH {_VERSIONS} SELECT user_id, version FROM ver WHERE valid_from <= 1705000000000 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY valid_from DESC, version DESC) = 1",
    "temporal_prune": f"""WITH {_VERSIONS}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id, valid_from <= 1705000000000 ORDER BY valid_from DESC, version DESC) AS rn FROM ver)
SELECT user_id, version FROM r WHERE valid_from > 1705000000000 OR rn = 1""",
    "suppress_alerts": f"""WITH {EVENTS}, g AS (SELECT *, last_value(CASE event_type WHEN 'error' THEN 'on' WHEN 'signup' THEN 'off' END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_type = 'click', event_id ROWS UNBOUNDED PRECEDING) AS gate
  FROM ev WHERE event_type IN ('error', 'signup', 'click')) SELECT event_id, user_id FROM g WHERE event_type = 'click' AND coalesce(gate, 'off') <> 'on'""",
    "co_process": f"""WITH {EVENTS}, r AS (SELECT *, count(*) FILTER (WHERE event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY event_id) AS era FROM ev WHERE event_type IN ('error', 'purchase', 'click')),
l AS (SELECT *, count(*) FILTER (WHERE event_type = 'error') OVER (PARTITION BY user_id, era ORDER BY event_id) AS level FROM r) SELECT user_id, event_id, level FROM l WHERE event_type = 'click'""",
}
