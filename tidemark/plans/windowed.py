"""Queries of time, session, count and global windows and of all aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.scalar import hours, minutes
from tidemark.operators import aggs, watermark, windows
from tidemark.plans.base import CORRECTED, EVENTS, SHUFFLED, corrected_log, events, shuffled_events

_SQL_NUMBERS = "count(*) AS n, round(avg(value), 4) AS avg_value, max(value) AS max_value"


def _numbers():
    return F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("avg_value"), F.max("value").alias("max_value")


def _value():
    return F.col("value")


def _id():
    return F.col("event_id")


def tumbling_agg(spark, d):
    return windows.window_agg(events(spark, d), ["user_id"], "ts", windows.tumbling(hours(6)), *_numbers())


def sliding_agg(spark, d):
    return windows.window_agg(events(spark, d), ["user_id"], "ts", windows.sliding(hours(12), hours(3)), *_numbers())


def sliding_gap(spark, d):
    return windows.window_agg(events(spark, d), ["user_id"], "ts", windows.sliding(hours(2), hours(5)), *_numbers())


def window_list(spark, d):
    out = windows.window_list(events(spark, d), ["user_id"], "ts", "event_id", windows.tumbling(hours(24)), F.col("event_type"))
    return out.select("user_id", "win_start", "win_end", F.array_join("items", ",").alias("items"))


def session_agg(spark, d):
    return windows.session_window(events(spark, d), ["user_id"], "ts", hours(4), F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def count_tumbling(spark, d):
    return windows.count_window(events(spark, d), ["user_id"], "event_id", "ts", windows.count_tumbling(5), total=lambda w: F.round(F.sum("value").over(w), 4)).select("user_id", "rn", "seq", "total")


def count_sliding(spark, d):
    return windows.count_window(events(spark, d), ["user_id"], "event_id", "ts", windows.count_sliding(4, 3), total=lambda w: F.round(F.sum("value").over(w), 4)).select("user_id", "rn", "seq", "total")


def global_count_trigger(spark, d):
    return windows.trigger_count(events(spark, d), ["user_id"], "event_id", 7, F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def global_value_trigger(spark, d):
    rows = windows.trigger_on_value(events(spark, d), ["user_id"], "event_id", F.col("event_type") == "purchase", n=lambda w: F.count("*").over(w), total=lambda w: F.round(F.sum("value").over(w), 4))
    return rows.select("user_id", "seq", "fired", "n", "total")


def _by_user(spark, d, **named):
    return aggs.run(events(spark, d), ["user_id"], **named)


def agg_numbers(spark, d):
    r = lambda c: F.round(c, 4)
    return _by_user(
        spark, d, n=aggs.count(), n_click=aggs.count_if(F.col("event_type") == "click"), total=aggs.sum_of(_value()).map(r), mean=aggs.mean(_value()).map(r),
        low=aggs.min_of(_value()), high=aggs.max_of(_value()), doubled=aggs.sum_of(_value()).contramap(lambda c: c * 2).map(r),
    )


def agg_median(spark, d):
    return _by_user(spark, d, median=aggs.median(_value()).map(lambda c: F.round(c, 4)))


def agg_approx_median(spark, d):
    return _by_user(spark, d, median=aggs.approx_median(_value()))


def agg_arg_max(spark, d):
    return _by_user(spark, d, best=aggs.arg_max(_value(), _id(), _id()), worst=aggs.arg_min(_value(), _id(), _id()))


def agg_first_last(spark, d):
    return _by_user(spark, d, first_type=aggs.first(F.col("event_type"), _id()), last_type=aggs.last(F.col("event_type"), _id()))


def agg_top_k(spark, d):
    return aggs.top_k(events(spark, d), ["user_id"], 3, F.desc("value"), F.asc("event_id")).select("user_id", F.col("rank").cast("long").alias("rank"), "event_id", "value")


def agg_bottom_k(spark, d):
    out = _by_user(spark, d, worst=aggs.bottom_k_by(2, _value(), _id(), _id()))
    return out.select("user_id", F.array_join("worst", ",").alias("worst"))


def agg_to_list(spark, d):
    return _by_user(spark, d, ids=aggs.to_list(_id(), _id()).map(lambda c: F.array_join(c, ",")))


def agg_group_by(spark, d):
    out = aggs.group_by(events(spark, d), ["user_id"], "event_type", {"n": aggs.count(), "high": aggs.max_of(_value())})
    return out.select("user_id", F.array_join(F.transform("groups", lambda g: F.concat(g["event_type"], F.lit(":"), g["n"].cast("string"))), ",").alias("groups"))


def _changes(spark, d, policy="drop"):
    log = watermark.with_wm_before(shuffled_events(spark, d), "ts", "seq", minutes(10))
    return windows.window_changes(log, ["user_id"], "ts", "seq", windows.tumbling(hours(6)), lambda w: F.count("*").over(w), allowed_lateness=hours(2), late_policy=policy)


def late_corrections(spark, d):
    return _changes(spark, d).select("user_id", "win_end", "seq", "kind", "value", "old")


def late_refire(spark, d):
    return _changes(spark, d, "refire").groupBy("user_id", "win_end").agg(F.count("*").alias("emissions"), F.sum("value").alias("total"))


def late_rows(spark, d):
    log = watermark.with_wm_before(shuffled_events(spark, d), "ts", "seq", minutes(10))
    return windows.split_late(log, "ts", windows.tumbling(hours(6)), 0, minutes(30))[1].select("event_id", "user_id", "win_end")


def _grouped(by: str) -> str:
    return f"WITH {EVENTS} SELECT user_id, {by} FROM ev GROUP BY user_id"


_CHANGES = SHUFFLED + """,
w AS (SELECT *, ts - ts % 21600000 + 21600000 AS win_end, max(ts) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 600000 AS wm FROM sh),
k AS (SELECT * FROM w WHERE NOT coalesce(win_end + 7200000 <= wm, false)),
n AS (SELECT *, row_number() OVER p AS n, coalesce(first_value(wm) OVER p, -4611686018427387904) AS wm1, count(*) OVER (PARTITION BY user_id, win_end) AS last FROM k WINDOW p AS (PARTITION BY user_id, win_end ORDER BY seq)),
f AS (SELECT *, coalesce(wm >= win_end AND wm > wm1, false) AS fired FROM n),
g AS (SELECT *, min(CASE WHEN fired THEN n END) OVER (PARTITION BY user_id, win_end) AS f1 FROM f),
c AS (SELECT user_id, win_end, seq, CASE WHEN n >= f1 THEN 'U' WHEN n = coalesce(f1 - 1, last) THEN 'D' END AS kind, n AS value, CASE WHEN n >= f1 THEN n - 1 END AS old FROM g)"""

def _retractable():
    x = lambda v: v["x"]
    return {"n": windows.counted(), "big": windows.counted_if(lambda v: v["x"] > 50), "total": windows.summed(x), "mean": windows.averaged(x), "mid": windows.middle(x)}


def window_withdrawn(spark, d):
    """Final daily windows of a log with withdrawals and corrections."""
    out = windows.window_log(corrected_log(spark, d), {"user_id": lambda v: v["user_id"]}, windows.tumbling(hours(24)), **_retractable())
    return out.select("user_id", "win_end", "n", "big", F.round("total", 3).alias("total"), F.round("mean", 7).alias("mean"), F.round("mid", 4).alias("mid"))


def window_corrected(spark, d):
    """The same as a changelog: rows that come after a window fired correct it in one step."""
    log = watermark.with_wm_before(corrected_log(spark, d).withColumnRenamed("ts", "at").withColumnRenamed("arrived", "ts"), "ts", "seq").drop("ts").withColumnRenamed("at", "ts")
    aggs_ = {k: v for k, v in _retractable().items() if k in ("n", "total")}
    out = windows.window_log_changes(log, {"user_id": lambda v: v["user_id"]}, windows.tumbling(hours(24)), allowed_lateness=hours(72), **aggs_)
    return out.select("user_id", "win_end", "seq", "kind", F.col("value.n").alias("n"), F.round("value.total", 3).alias("total"), F.col("old.n").alias("old_n"))


QUERIES = {
    f.__name__: f
    for f in (
        window_withdrawn, window_corrected,
        tumbling_agg, sliding_agg, sliding_gap, window_list, session_agg, count_tumbling, count_sliding, global_count_trigger, global_value_trigger, agg_numbers, agg_median,
        agg_approx_median, agg_arg_max, agg_first_last, agg_top_k, agg_bottom_k, agg_to_list, agg_group_by, late_corrections, late_refire, late_rows,
    )
}


def _slid(size: int, step: int) -> str:
    return f"""WITH {EVENTS}, s AS (SELECT *, unnest(generate_series(greatest(0, ((ts - {size}) // {step} + 1) * {step}), ts // {step} * {step}, {step}))::BIGINT AS win_start FROM ev)
SELECT user_id, win_start, win_start + {size} AS win_end, {_SQL_NUMBERS} FROM s WHERE ts < win_start + {size} GROUP BY user_id, win_start"""


_CHANGED = CORRECTED + """, w AS (SELECT *, ts - ts % 86400000 + 86400000 AS win_end FROM cl),
b AS (SELECT *, min(seq) FILTER (WHERE kind <> 'R') OVER (PARTITION BY user_id, win_end) AS begun FROM w),
c AS (SELECT * REPLACE (CASE WHEN seq > begun THEN old_x END AS old_x) FROM b WHERE kind <> 'R' OR seq > begun)"""
_SIGNED = "CASE WHEN kind = 'R' THEN -{f} WHEN kind = 'U' AND old_x IS NOT NULL THEN {f} - {g} ELSE {f} END"

SQL = {
    "window_withdrawn": f"""WITH {_CHANGED}, st AS (SELECT user_id, win_end, list(CASE WHEN kind = 'R' THEN [(false, x)] WHEN old_x IS NOT NULL THEN [(false, old_x), (true, x)] ELSE [(true, x)] END ORDER BY seq) AS steps,
sum({_SIGNED.format(f="1", g="1")}) AS n, sum({_SIGNED.format(f="(x > 50)::INT", g="(old_x > 50)::INT")}) AS big, sum({_SIGNED.format(f="x", g="old_x")}) AS total FROM c GROUP BY ALL),
fl AS (SELECT user_id, win_end, unnest(flatten(steps)) AS s FROM st),
nu AS (SELECT user_id, win_end, s[2] AS v, s[1] AS adds, row_number() OVER () AS i FROM fl),
h AS (SELECT user_id, win_end, v, greatest(0, max(run) - 0) AS top, last(run ORDER BY i) AS left_ FROM (SELECT *, sum(CASE WHEN adds THEN 1 ELSE -1 END) OVER (PARTITION BY user_id, win_end, v ORDER BY i) AS run FROM nu) GROUP BY ALL),
lo AS (SELECT user_id, win_end, v, min(run) AS low, last(run ORDER BY i) AS fin FROM (SELECT *, sum(CASE WHEN adds THEN 1 ELSE -1 END) OVER (PARTITION BY user_id, win_end, v ORDER BY i) AS run FROM nu) GROUP BY ALL),
kept AS (SELECT user_id, win_end, unnest(list_transform(range(0, (fin - least(low, 0))::BIGINT), lambda k: v)) AS v FROM lo),
m AS (SELECT user_id, win_end, median(v) AS mid FROM kept GROUP BY ALL)
SELECT user_id, win_end, n::BIGINT AS n, big::BIGINT AS big, round(total, 3) AS total, round(CASE WHEN n <> 0 THEN total / n END, 7) AS mean, round(mid, 4) AS mid FROM st LEFT JOIN m USING (user_id, win_end)""",
    "window_corrected": f"""WITH {_CHANGED}, g AS (SELECT seq, max(ts) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS wm FROM sh),
k AS (SELECT c.*, g.wm FROM c JOIN g USING (seq) WHERE NOT coalesce(win_end + 259200000 <= wm, false)),
f AS (SELECT *, row_number() OVER p AS i, coalesce(wm >= win_end AND wm > coalesce(first_value(wm) OVER p, -1), false) AS fired, sum({_SIGNED.format(f="1", g="1")}) OVER p AS n, sum({_SIGNED.format(f="x", g="old_x")}) OVER p AS total FROM k WINDOW p AS (PARTITION BY user_id, win_end ORDER BY seq)),
q AS (SELECT *, min(CASE WHEN fired THEN i END) OVER (PARTITION BY user_id, win_end) AS ff, max(i) OVER (PARTITION BY user_id, win_end) AS fin, lag(n) OVER o AS old_n, lag(total) OVER o AS old_total FROM f WINDOW o AS (PARTITION BY user_id, win_end ORDER BY seq))
SELECT user_id, win_end, seq, CASE WHEN i >= ff THEN 'U' ELSE 'D' END AS kind, n::BIGINT AS n, round(total, 3) AS total, CASE WHEN i >= ff THEN old_n END::BIGINT AS old_n
FROM q WHERE (i >= ff AND (n <> old_n OR total <> old_total)) OR (i = coalesce(ff - 1, fin))""",
    "tumbling_agg": f"WITH {EVENTS} SELECT user_id, ts - ts % 21600000 AS win_start, ts - ts % 21600000 + 21600000 AS win_end, {_SQL_NUMBERS} FROM ev GROUP BY ALL",
    "sliding_agg": _slid(43_200_000, 10_800_000),
    "sliding_gap": f"WITH {EVENTS} SELECT user_id, ts - ts % 18000000 AS win_start, ts - ts % 18000000 + 7200000 AS win_end, {_SQL_NUMBERS} FROM ev WHERE ts % 18000000 < 7200000 GROUP BY ALL",
    "window_list": f"WITH {EVENTS} SELECT user_id, ts - ts % 86400000 AS win_start, ts - ts % 86400000 + 86400000 AS win_end, string_agg(event_type, ',' ORDER BY event_id) AS items FROM ev GROUP BY ALL",
    "session_agg": f"""WITH {EVENTS}, b AS (SELECT *, CASE WHEN ts - lag(ts) OVER w > 14400000 THEN 1 ELSE 0 END AS brk FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM b)
SELECT user_id, min(ts) AS session_start, max(ts) AS session_end, count(*) AS n, round(sum(value), 4) AS total FROM i GROUP BY user_id, island""",
    "count_tumbling": f"""WITH {EVENTS}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM ev)
SELECT user_id, max(n)::INTEGER AS rn, max(event_id) AS seq, round(sum(value), 4) AS total FROM r GROUP BY user_id, (n - 1) // 5 HAVING count(*) = 5""",
    "count_sliding": f"""WITH {EVENTS}, r AS (SELECT *, row_number() OVER w AS n, sum(value) OVER (w ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS s FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, n::INTEGER AS rn, event_id AS seq, round(s, 4) AS total FROM r WHERE n >= 4 AND (n - 4) % 3 = 0""",
    "global_count_trigger": f"""WITH {EVENTS}, r AS (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 7 AS fire FROM ev)
SELECT user_id, fire, count(*) AS n, round(sum(value), 4) AS total FROM r GROUP BY user_id, fire""",
    "global_value_trigger": f"""WITH {EVENTS}, r AS (SELECT *, count(*) OVER w AS n, sum(value) OVER w AS s, event_id = max(event_id) OVER (PARTITION BY user_id) AS fin FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, event_id AS seq, event_type = 'purchase' AS fired, n, round(s, 4) AS total FROM r WHERE event_type = 'purchase' OR fin""",
    "agg_numbers": _grouped("count(*) AS n, count(*) FILTER (WHERE event_type = 'click') AS n_click, round(sum(value), 4) AS total, round(avg(value), 4) AS mean, min(value) AS low, max(value) AS high, round(sum(value * 2), 4) AS doubled"),
    "agg_median": _grouped("round(median(value), 4) AS median"),
    "agg_arg_max": f"""WITH {EVENTS}, r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS hi, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS lo FROM ev)
SELECT user_id, max(CASE WHEN hi = 1 THEN event_id END) AS best, max(CASE WHEN lo = 1 THEN event_id END) AS worst FROM r GROUP BY user_id""",
    "agg_first_last": _grouped("arg_min(event_type, event_id) AS first_type, arg_max(event_type, event_id) AS last_type"),
    "agg_top_k": f"WITH {EVENTS}, r AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM ev) SELECT user_id, rank, event_id, value FROM r WHERE rank <= 3",
    "agg_bottom_k": f"WITH {EVENTS}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS rk FROM ev) SELECT user_id, string_agg(event_id::VARCHAR, ',' ORDER BY rk) AS worst FROM r WHERE rk <= 2 GROUP BY user_id",
    "agg_to_list": _grouped("string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS ids"),
    "agg_group_by": f"WITH {EVENTS}, g AS (SELECT user_id, event_type, count(*) AS n FROM ev GROUP BY ALL) SELECT user_id, string_agg(event_type || ':' || n, ',' ORDER BY event_type DESC) AS groups FROM g GROUP BY user_id",
    "late_corrections": f"WITH {_CHANGES} SELECT user_id, win_end, seq, kind, value, old FROM c WHERE kind IS NOT NULL",
    "late_refire": f"""WITH {_CHANGES}, l AS (SELECT user_id, win_end, count(DISTINCT wm) AS emissions, count(*) AS total FROM w WHERE coalesce(win_end + 7200000 <= wm, false) GROUP BY ALL),
a AS (SELECT user_id, win_end, count(*) AS emissions, sum(value) AS total FROM c WHERE kind IS NOT NULL GROUP BY ALL UNION ALL SELECT * FROM l)
SELECT user_id, win_end, sum(emissions)::BIGINT AS emissions, sum(total)::BIGINT AS total FROM a GROUP BY ALL""",
    "late_rows": f"""WITH {SHUFFLED}, w AS (SELECT *, ts - ts % 21600000 + 21600000 AS win_end, max(ts) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 600000 AS wm FROM sh)
SELECT event_id, user_id, win_end FROM w WHERE win_end + 1800000 <= wm""",
}
