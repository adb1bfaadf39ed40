"""Whole pipelines: fleet alerts, NEXMark queries, signal location, connectivity and gas alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import distance_from_rssi, hours, minutes, relative_change, seconds
from tidemark.operators import changelog, joins, process, state, trigger, watermark, windows
from tidemark.operators.scan import ordered_scan
from tidemark.plans.base import EVENTS, SHUFFLED, events, orders, shuffled_events, table


def fleet_alerts(spark, d):
    """Enrich, aggregate by the hour, apply rules, and hold back repeats of an alert for a day."""
    limits = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), (F.lit(60.0) + F.col("c_nationkey")).alias("limit"))
    rows = joins.enrich(watermark.event_time(events(spark, d), "ts", minutes(5)), limits, ["user_id"])
    hourly = windows.window_agg(rows, ["user_id"], "ts", windows.tumbling(hours(1)), F.max("value").alias("top"), F.min("value").alias("low"), F.first("limit").alias("limit"))
    speed = F.when(F.col("top") > 1.3 * F.col("limit"), "critical").when(F.col("top") > F.col("limit"), "warning")
    fuel = F.when(F.col("low") < 0.5, "critical").when(F.col("low") < 2, "warning")
    rules = F.array(F.struct(F.lit("speed").alias("rule"), speed.alias("severity")), F.struct(F.lit("fuel").alias("rule"), fuel.alias("severity")))
    alerts = hourly.select("user_id", F.col("win_end").alias("ts"), F.explode(rules).alias("a")).select("user_id", "ts", "a.*").where("severity IS NOT NULL")
    return state.dedup(alerts, ["user_id", "rule"], "ts", "ts", hours(24))


# NEXMark on the driver's tables: bids are events (auction = k of props), persons are customers, auctions are orders.


def bids(spark, d) -> DataFrame:
    return events(spark, d).select("event_id", F.get_json_object("props", "$.k").cast("long").alias("auction"), F.col("user_id").alias("bidder"), F.col("value").alias("price"), "ts")


def nexmark_q1(spark, d):
    return bids(spark, d).select("event_id", "auction", "bidder", F.round(F.col("price") * 0.89, 4).alias("price_eur"))


def nexmark_q2(spark, d):
    return bids(spark, d).where(F.col("auction").isin(7, 20, 21, 59, 87)).select("event_id", "auction", "price")


def nexmark_q3(spark, d):
    people = table(spark, d, "customer").where("c_nationkey IN (3, 7, 19)").selectExpr("c_custkey", "c_name", "c_nationkey")
    auctions = orders(spark, d).where("o_orderkey % 10 = 0").selectExpr("o_orderkey", "o_custkey AS c_custkey")
    return auctions.join(people, "c_custkey").select("c_name", "c_nationkey", "o_orderkey")


def nexmark_q5(spark, d):
    """The auctions with most bids in each sliding window."""
    counts = windows.window_agg(bids(spark, d), ["auction"], "ts", windows.sliding(hours(24), hours(12)), F.count("*").alias("n"))
    top = F.max("n").over(Window.partitionBy("win_end"))
    return counts.withColumn("top", top).where("n = top").select("win_end", "auction", "n")


def nexmark_q7(spark, d):
    return windows.window_agg(bids(spark, d), [], "ts", windows.tumbling(hours(1)), F.max("price").alias("price"), F.max_by("bidder", F.struct("price", -F.col("event_id"))).alias("bidder")).select("win_end", "bidder", "price")


def nexmark_q8(spark, d):
    """Who signed up and purchased within one window."""
    e = windows.assign(events(spark, d), "ts", windows.tumbling(hours(12)))
    new = e.where("event_type = 'signup'").select("user_id", "win_end").distinct()
    sold = e.where("event_type = 'purchase'").groupBy("user_id", "win_end").agg(F.count("*").alias("n"))
    return new.join(sold, ["user_id", "win_end"])


def nexmark_q12(spark, d):
    return windows.trigger_count(bids(spark, d), ["bidder"], "event_id", 10, F.count("*").alias("n"), F.max("price").alias("top"))


# Location by signal strength


def median_location(readings: DataFrame, beacons: DataFrame, spec: windows.TimeWindow) -> DataFrame:
    """Where each lamp was per window, from the two beacons with the strongest median signal.

    readings: lamp, beacon, rssi, ts.  beacons: beacon, x, y (one row each).  Medians go before the shuffle's
    second level; the position lies between the two beacons by their distances.
    """
    medians = windows.window_agg(readings, ["lamp", "beacon"], "ts", spec, F.median("rssi").alias("rssi"))
    placed = medians.join(beacons.select("beacon", "x", "y"), "beacon", "left")
    best = F.slice(F.sort_array(F.collect_list(F.struct("rssi", "beacon", "x", "y")), asc=False), 1, 2)
    top = placed.groupBy("lamp", "win_end").agg(best.alias("top"))
    one, two = F.get("top", F.lit(0)), F.get("top", F.lit(1))
    d1, d2 = distance_from_rssi(one["rssi"]), distance_from_rssi(two["rssi"])
    between = lambda a, b: F.when(two.isNull(), a).otherwise(a + (b - a) * (d1 / (d1 + d2)))
    return top.select("lamp", "win_end", one["beacon"].alias("beacon"), between(one["x"], two["x"]).alias("x"), between(one["y"], two["y"]).alias("y"))


def median_rssi(spark, d):
    e = events(spark, d)
    readings = e.select(F.col("user_id").alias("lamp"), F.col("event_type").alias("beacon"), (-40.0 - F.pmod("value", F.lit(60.0))).alias("rssi"), "ts")
    grid = spark.createDataFrame([("click", 0.0, 0.0), ("error", 50.0, 0.0), ("purchase", 0.0, 50.0), ("signup", 50.0, 50.0), ("view", 100.0, 0.0)], "beacon string, x double, y double")
    out = median_location(readings, grid, windows.sliding(hours(24), hours(6)))
    return out.select("lamp", "win_end", "beacon", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


def connectivity_alerts(
    packets: DataFrame, keys: list[str], ts: str, seq: str, *, readings: Column, moving: Column, voltage: Column, sos: Column,
    no_packets: int = minutes(2), no_readings: int = minutes(5), no_motion: int = minutes(2), low: float = 3.5, fine: float = 3.7, hold: int = minutes(2), latency: int = seconds(1),
) -> DataFrame:
    """All alerts on a lamp: keys, alert, kind (D, or R for one withdrawn), ts.

    Three absences (any packet, packets with ``readings``, packets while ``moving``), low ``voltage`` with hysteresis
    once it has held for ``hold``, and each ``sos`` once.  While a lamp has no contact, motion and voltage are not known
    and their alerts are held back; contact comes back with the next packet.
    """
    log = packets.select(*keys, F.col(ts).alias("ts"), F.col(seq).alias("seq"), readings.alias("readings"), moving.alias("moving"), voltage.cast("double").alias("voltage"), sos.alias("sos"))
    end = log.agg(F.max("ts").cast("long").alias("_end"))  # without the watermarks' pass
    battery = trigger.Trigger("low_voltage", trigger.less_than_with_hysteresis(low, fine), "warning", problem_for=hold)
    # every detector reads the same sorted rows of a key: one shuffle by arrival for watermarks, one by key
    rows = watermark.with_wm_before(log, "ts", "seq", latency).withColumn("_s", trigger.spec(battery, "voltage")).join(F.broadcast(end))
    rows = rows.select(*keys, F.col("ts").cast("long").alias("_ts"), F.col("seq").alias("_seq"), F.col("voltage").alias("_v"), F.col("wm_before").cast("long").alias("wm_before"), F.col("wm_before").cast("long").alias("_wm"), "_end", "readings", "moving", "_s.*")
    rows = state.silence_marks(rows, keys, "_ts", "_seq", {"no_packets": (no_packets, None), "no_readings": (no_readings, F.col("readings")), "no_motion": (no_motion, F.col("moving"))})
    rows = trigger.candidates(rows, keys).where("_silences IS NOT NULL OR _found IS NOT NULL")
    mark = lambda name, kind, at, pos: F.struct(name.alias("detector"), kind.alias("says"), at.alias("ts"), pos.alias("pos"))
    none = F.array().cast("array<struct<detector:string,says:string,ts:bigint,pos:int>>")
    quiet = F.transform("_silences", lambda x: mark(x["detector"], x["kind"], x["ts"], F.lit(-1)))
    power = F.transform("_found", lambda x: mark(F.lit("low_voltage"), x["status"], x["ts"], x["pos"]))
    rows = rows.select(*keys, "_seq", F.explode(F.concat(F.coalesce(quiet, none), F.coalesce(power, none))).alias("x")).select(*keys, "_seq", "x.*")
    own = Window.partitionBy(*keys, "detector").orderBy("_seq", "pos")
    rows = rows.select("*", F.coalesce(F.lag("says").over(own), F.lit("ok")).alias("was"))
    volts, silent, contact = F.col("detector") == "low_voltage", F.col("says") == "silent", F.col("detector") == "no_packets"
    rows = rows.where((volts & (F.col("says") != F.col("was"))) | silent | contact).withColumn("was_ts", F.lag("ts").over(own))
    # contact gates the rows beside it by a window over the key
    gate = F.when(contact, F.when(silent, "on").otherwise("off"))
    out = lambda alert, kind, at: F.struct(alert.alias("alert"), F.lit(kind).alias("kind"), at.alias("ts"))
    pieces = F.when(~volts, F.array(out(F.col("detector"), "D", F.col("ts")))).when(F.col("says") == "ok", F.array(out(F.lit("low_voltage"), "R", F.col("was_ts")), out(F.lit("voltage_ok"), "D", F.col("ts")))).otherwise(F.array(out(F.col("detector"), "D", F.col("ts"))))
    shown, held, turn = volts | silent, volts | (F.col("detector") == "no_motion"), F.when(volts, 2).when(silent, 0).otherwise(1)
    so_far = Window.partitionBy(*keys).orderBy("ts", F.col("gate").isNull(), "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.select(*keys, "ts", gate.alias("gate"), turn.alias("turn"), pieces.alias("pieces"), shown.alias("shown"), held.alias("held"))
    known = rows.withColumn("on", F.last("gate", ignorenulls=True).over(so_far)).where("shown AND NOT (held AND coalesce(on = 'on', false))")
    known = known.select(*keys, F.explode("pieces").alias("x")).select(*keys, "x.*")
    urgent = log.where("sos").dropDuplicates([*keys, "ts"]).select(*keys, F.lit("sos").alias("alert"), F.lit("D").alias("kind"), "ts")
    return known.unionByName(urgent)


def connectivity(spark, d):
    e = events(spark, d).select("event_id", "user_id", "event_type", "value", "ts")
    kind = F.col("event_type")
    return connectivity_alerts(
        e, ["user_id"], "ts", "event_id", readings=kind != "error", moving=kind.isin("click", "view", "purchase"), voltage=F.col("value"), sos=kind == "signup",
        no_packets=hours(24), no_readings=hours(36), no_motion=hours(24), low=20.0, fine=40.0, hold=hours(6), latency=minutes(1),
    )


#: Gas levels that warn and that evacuate.
GAS = {"co2": (5000.0, 15000.0), "co": (50.0, 100.0), "h2": (4000.0, 10000.0), "ch4": (5000.0, 10000.0)}


def gas_alerts(readings: DataFrame, refresh: float = 0.2) -> DataFrame:
    """Changelog of gas alerts per lamp and gas: D when a level is reached, U when the level changes or the value
    moved by more than ``refresh``, R when it is normal again.  readings: lamp, gas, value, ts, seq."""

    def step(now, rows):
        out = []
        for lamp, gas, value, ts in rows[["lamp", "gas", "value", "ts"]].itertuples(index=False, name=None):
            warn, evacuate = GAS.get(gas, (float("inf"), float("inf")))
            level = None if value != value or value <= warn else "evacuate" if value > evacuate else "warning"
            if now is None and level:
                out.append((lamp, gas, "D", ts, level, value, None))
                now = (level, value)
            elif now and not level:
                out.append((lamp, gas, "R", ts, now[0], now[1], None))
                now = None
            elif now and (level != now[0] or abs(value - now[1]) > refresh * abs(now[1])):
                out.append((lamp, gas, "U", ts, level, value, now[1]))
                now = (level, value)
        return now, out

    return ordered_scan(readings, ["lamp", "gas"], ["seq"], step, "lamp long, gas string, kind string, ts long, level string, value double, old double")


def gas(spark, d):
    e = events(spark, d)
    readings = e.select(F.col("user_id").alias("lamp"), F.when(F.col("event_type") == "click", "co").otherwise("ch4").alias("gas"), F.when(F.col("event_type") == "click", F.col("value")).otherwise(F.col("value") * 100).alias("value"), "ts", F.col("event_id").alias("seq"))
    return gas_alerts(readings).select("lamp", "gas", "kind", "ts", "level", F.round("value", 4).alias("value"))


def composite_alerts(spark, d):
    """A composite item of two latest values and a debounced trigger on both."""
    e = events(spark, d)
    inputs = [e.where(e["event_type"] == t).select("user_id", "event_id", "ts", "value") for t in ("click", "view")]
    both = joins.keyed_join(inputs, ["user_id"], "event_id", "ts", "value")
    item = both.where("v0 IS NOT NULL AND v1 IS NOT NULL").withColumn("item", F.least("v0", "v1"))
    spec = trigger.Trigger("both_high", trigger.greater_than_with_hysteresis(50.0, 10.0), "high")
    return trigger.edges(item, ["user_id"], "ts", "seq", "item", spec).select("user_id", "status", "ts", F.round("value", 4).alias("value"))


def presence(spark, d):
    """Who is where: sign-ups enter, errors leave, others move; the final map from the changelog."""
    e = events(spark, d)
    kind = F.when(F.col("event_type") == "error", "R").otherwise("D")
    value = F.struct("user_id", F.col("event_type").alias("zone"))
    log = e.select(F.col("event_id").alias("seq"), "ts", kind.alias("kind"), value.alias("value"), F.lit(None).cast("struct<user_id:bigint,zone:string>").alias("old"))
    return changelog.materialize(log, lambda v: v["user_id"]).select(F.col("id").alias("user_id"), "value.zone", "ts")


def relative_moves(spark, d):
    """Values that moved by more than nine tenths since the user's last event."""
    before = F.lag("value").over(Window.partitionBy("user_id").orderBy("event_id"))
    rows = events(spark, d).withColumn("was", before).where("was > 0")
    return rows.where(relative_change(F.col("value"), F.col("was")) > 0.9).select("event_id", "value", "was")


def sensor_average(spark, d):
    """Bad readings out, then the mean per sensor and window."""
    rows = events(spark, d).where(F.abs(F.col("value") - 999.0) > 1e-9)
    return windows.window_agg(rows, ["user_id"], "ts", windows.tumbling(hours(12)), F.round(F.avg("value"), 7).alias("mean"), F.count("*").alias("n"))


def limit_alerts(spark, d):
    """Readings over the limit of their sensor, repeats held back; sensors without a limit give none."""
    limits = table(spark, d, "customer").where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("user_id"), (F.lit(40.0) + F.col("c_nationkey")).alias("limit"))
    over = joins.enrich(events(spark, d).select("user_id", "event_id", "ts", "value"), limits, ["user_id"]).where("value > limit")
    return state.dedup(over, ["user_id"], "ts", "event_id", hours(48)).select("user_id", "event_id", "limit")


def _mine(spark, d):
    """People (sign-ups and views) and gas (clicks) in one order, with the zone of their horizon and the limit in force.

    Limits come from a stream of settings: the last purchase of the user sets it, an error withdraws nothing."""
    e = events(spark, d)
    people, gas_ = e.where("event_type IN ('signup', 'view')"), e.where("event_type = 'click'")
    cols = ["user_id", "event_id", "event_type", "value", "ts"]
    log = watermark.union_ordered([people.select(*cols), gas_.select(*cols)], "ts", "event_id", into="seq")
    changes = e.where("event_type IN ('purchase', 'error')").select("user_id", F.col("value").alias("limit"), F.when(F.col("event_type") == "error", "R").otherwise("D").alias("kind"), "event_id")
    base = table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("user_id"), F.lit(50.0).alias("limit"))
    limits = joins.update_table(base, changes, ["user_id"], "event_id")
    zones = table(spark, d, "customer").join(table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("zone")), "c_nationkey").select(F.col("c_custkey").alias("user_id"), "zone")
    return joins.enrich(joins.enrich(log, zones, ["user_id"]), limits, ["user_id"])


def mine_monitor(spark, d):
    """Four branches of one enriched stream: mean gas over its limit, critical gas at once, sessions of people, batches of readings."""
    log = _mine(spark, d)
    gas_, people = log.where("event_type = 'click'"), log.where("event_type <> 'click'")
    mean = windows.window_agg(gas_, ["user_id"], "ts", windows.tumbling(hours(24)), F.avg("value").alias("mean"), F.max("limit").alias("limit")).where("mean > limit")
    over = state.dedup(mean.select("user_id", "win_end", "mean"), ["user_id"], "win_end", "win_end", hours(72))
    critical = state.dedup(gas_.where("value > 100").select("user_id", "seq", "ts", "zone"), ["user_id"], "ts", "seq", hours(12))
    sessions = windows.session_window(people, ["user_id"], "ts", hours(12), F.count("*").alias("n"))
    batches = windows.trigger_count(gas_, ["user_id"], "seq", 2, F.max("ts").alias("ts"), F.count("*").alias("n"))
    row = lambda df, branch, ts, detail: df.select(F.lit(branch).alias("branch"), "user_id", F.col(ts).alias("ts"), detail.cast("string").alias("detail"))
    parts = [row(over, "mean", "win_end", F.lit("over")), row(critical, "critical", "ts", F.coalesce("zone", F.lit("?"))), row(sessions, "session", "session_end", F.col("n")), row(batches, "batch", "ts", F.col("n"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def depot_metrics(spark, d):
    """Bad rows apart, then per depot and window the mean speed, the least charge and how many are low, corrected by late rows."""
    raw = shuffled_events(spark, d).select("seq", "ts", (F.col("user_id") % 7).alias("depot"), F.when(F.col("event_id") % 19 == 0, "bad").otherwise(F.col("value").cast("string")).alias("charge"), "value")
    good, _ = changelog.safe_split(raw, parsed=F.expr("try_cast(charge AS double)"))
    log = watermark.with_wm_before(good.select("seq", "ts", "depot", "value"), "ts", "seq", minutes(1))
    log = changelog.from_rows(log.select("seq", "ts", "depot", "value", "wm_before"), "ts", "seq", beside=["wm_before"])
    x = lambda v: v["value"]
    out = windows.window_log_changes(
        log, {"depot": lambda v: v["depot"]}, windows.tumbling(hours(6)), allowed_lateness=hours(6), speed=windows.averaged(x), charge=windows.smallest(x), low=windows.counted_if(lambda v: v["value"] < 5)
    )
    return out.select("depot", "win_end", "seq", "kind", F.round("value.speed", 7).alias("speed"), "value.charge", "value.low")


def depot_totals(spark, d):
    """Running totals per depot of the readings that parse (what exactly-once runs keep)."""
    rows = events(spark, d).where("event_id % 19 <> 0").withColumn("depot", F.col("user_id") % 7)
    return rows.groupBy("depot").agg(F.round(F.sum("value"), 3).alias("total"), F.count("*").alias("n"))


def gas_topology(spark, d):
    """Two partitions merged, then an alarm branch and a dashboard branch."""
    e = events(spark, d).select("event_id", "user_id", "value", "ts")
    merged = watermark.merge_partitioned([e.where("user_id % 2 = 0"), e.where("user_id % 2 = 1")], "ts", "event_id")
    alarms = merged.where("value >= 100").select(F.lit("alarm").alias("branch"), "user_id", "ts", F.round("value", 4).alias("value"))
    board = windows.window_agg(merged, ["user_id"], "ts", windows.tumbling(hours(24)), F.round(F.avg("value"), 7).alias("value"))
    return alarms.unionByName(board.select(F.lit("dashboard").alias("branch"), "user_id", F.col("win_end").alias("ts"), "value"))


def lamp_pipelines(spark, d):
    """Three queries over one source: low voltage with a cool-down, lost contact, smoothed distance."""
    e = events(spark, d).select("event_id", "user_id", "value", "ts")
    low = state.dedup(e.where("value < 3.2"), ["user_id"], "ts", "event_id", hours(24)).select(F.lit("voltage").alias("query"), "user_id", "ts", F.round("value", 4).alias("value"))
    lost = state.on_silence(watermark.with_wm_before(e, "ts", "event_id"), ["user_id"], "ts", "event_id", hours(30)).where("kind = 'silent'")
    middle = windows.window_agg(e, ["user_id"], "ts", windows.sliding(hours(24), hours(12)), F.median(-40.0 - F.pmod("value", F.lit(40.0))).alias("rssi"))
    near = middle.select(F.lit("distance").alias("query"), "user_id", F.col("win_end").alias("ts"), F.round(distance_from_rssi(F.col("rssi")), 4).alias("value"))
    return low.unionByName(lost.select(F.lit("contact").alias("query"), "user_id", "ts", F.lit(None).cast("double").alias("value"))).unionByName(near)


def timed_process(spark, d):
    """A keyed process with timers on a changelog: a user's level, closed a day after its last change; withdrawals lower it."""
    value = F.struct("user_id", F.col("value").alias("x"))
    e = watermark.with_wm_before(events(spark, d), "ts", "event_id")
    kind = F.when(F.col("event_type") == "error", "R").otherwise("D")
    log = e.select("user_id", F.col("event_id").alias("seq"), "ts", kind.alias("kind"), value.alias("value"), F.lit(None).cast("struct<user_id:bigint,value:double>").alias("old"), "wm_before")

    def changed(by):
        def on(ctx, key, held, v):
            held["n"] = max(0, held["n"] + by)
            held["timer"].reschedule(ctx, ctx.ts + 86_400_000)

        return on

    def closed(ctx, key, held, at, kind):
        held["timer"].consumed()
        ctx.emit((held["n"],))
        ctx.clear_state()

    spec = process.Process(lambda: {"n": 0, "timer": process.SingleTimer()}, on_event=changed(1), on_retract=changed(-1), on_timer=closed)
    return process.process_keyed(log, ["user_id"], spec, "level int").select("user_id", "ts", F.col("value.level").alias("level"))


QUERIES = {
    f.__name__: f
    for f in (
        sensor_average, limit_alerts, mine_monitor, depot_metrics, depot_totals, gas_topology, lamp_pipelines, timed_process, fleet_alerts, nexmark_q1, nexmark_q2, nexmark_q3, nexmark_q5, nexmark_q7, nexmark_q8, nexmark_q12, median_rssi, connectivity, gas, composite_alerts, presence, relative_moves,
    )
}

_BIDS = EVENTS + ", b AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS auction, user_id AS bidder, value AS price, ts FROM ev)"

from tidemark.plans.stateful import DEBOUNCE  # noqa: E402


def _silent(name: str, has: str, within: int) -> str:
    """SQL: CTEs that end in ``name``: user_id, kind, ts of a silence detector over the log with watermarks ``w``."""
    return f"""{name}_k AS (SELECT user_id, wm, max(ts) OVER p AS last, lead(ts) OVER p AS nts, CASE WHEN lead(event_id) OVER p IS NULL THEN fin ELSE lead(wm) OVER p END AS nwm FROM w WHERE {has} WINDOW p AS (PARTITION BY user_id ORDER BY event_id)),
{name}_s AS (SELECT * FROM {name}_k WHERE nwm >= last + {within} AND (wm IS NULL OR nwm > wm)),
{name} AS (SELECT user_id, 'silent' AS kind, last + {within} AS ts FROM {name}_s UNION ALL SELECT user_id, 'resumed', nts FROM {name}_s WHERE nts IS NOT NULL)"""


def _greedy(rows: str, key: str, order: str, cooldown: int) -> str:
    """SQL: CTEs r and g, of which those with ``keep`` pass a cool-down; ``rows`` has the key, ts and an order."""
    return f"""r AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS n FROM {rows}),
g AS (SELECT {key}, n, ts AS last, true AS keep FROM r WHERE n = 1 UNION ALL SELECT r.{key}, r.n, CASE WHEN r.ts - g.last > {cooldown} THEN r.ts ELSE g.last END, r.ts - g.last > {cooldown} FROM g JOIN r ON r.{key} = g.{key} AND r.n = g.n + 1)"""


SQL = {
    "sensor_average": f"WITH {EVENTS} SELECT user_id, ts - ts % 43200000 AS win_start, ts - ts % 43200000 + 43200000 AS win_end, round(avg(value), 7) AS mean, count(*) AS n FROM ev GROUP BY ALL",
    "limit_alerts": f"""WITH RECURSIVE {EVENTS}, o AS (SELECT user_id, event_id, ts, 40.0::DOUBLE + c_nationkey AS lim FROM ev JOIN customer ON user_id = c_custkey WHERE c_custkey % 4 <> 0 AND value > 40.0::DOUBLE + c_nationkey),
{_greedy("o", "user_id", "event_id", 172800000)} SELECT user_id, event_id, lim AS "limit" FROM r JOIN g USING (user_id, n) WHERE keep""",
    "mine_monitor": f"""WITH RECURSIVE {EVENTS}, lm AS (SELECT user_id, value AS lim FROM (SELECT user_id, value, event_id FROM ev WHERE event_type = 'purchase' UNION ALL SELECT c_custkey, 50.0, -1 FROM customer WHERE c_custkey % 2 = 0) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1),
zn AS (SELECT c_custkey AS user_id, n_name AS zone FROM customer JOIN nation ON c_nationkey = n_nationkey),
ga AS (SELECT * FROM ev LEFT JOIN lm USING (user_id) LEFT JOIN zn USING (user_id) WHERE event_type = 'click'),
mo AS (SELECT user_id, ts - ts % 86400000 + 86400000 AS ts FROM ga GROUP BY ALL HAVING avg(value) > max(lim)),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM mo),
g AS (SELECT user_id, n, ts AS last, true AS keep FROM r WHERE n = 1 UNION ALL SELECT r.user_id, r.n, CASE WHEN r.ts - g.last > 259200000 THEN r.ts ELSE g.last END, r.ts - g.last > 259200000 FROM g JOIN r ON r.user_id = g.user_id AND r.n = g.n + 1),
r2 AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM ga WHERE value > 100),
g2 AS (SELECT user_id, n, ts AS last, true AS keep FROM r2 WHERE n = 1 UNION ALL SELECT r2.user_id, r2.n, CASE WHEN r2.ts - g2.last > 43200000 THEN r2.ts ELSE g2.last END, r2.ts - g2.last > 43200000 FROM g2 JOIN r2 ON r2.user_id = g2.user_id AND r2.n = g2.n + 1),
pe AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > 43200000, true)::INT AS brk FROM ev WHERE event_type IN ('signup', 'view')),
se AS (SELECT user_id, ts, sum(brk) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM pe),
ba AS (SELECT user_id, ts, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 2 AS k FROM ga)
SELECT 'mean' AS branch, user_id, ts, 'over' AS detail FROM r JOIN g USING (user_id, n) WHERE keep UNION ALL SELECT 'critical', user_id, ts, coalesce(zone, '?') FROM r2 JOIN g2 USING (user_id, n) WHERE keep
UNION ALL SELECT 'session', user_id, max(ts), count(*)::VARCHAR FROM se GROUP BY user_id, k UNION ALL SELECT 'batch', user_id, max(ts), count(*)::VARCHAR FROM ba GROUP BY user_id, k""",
    "depot_metrics": f"""WITH {SHUFFLED}, q AS (SELECT seq, ts, user_id % 7 AS depot, value, max(ts) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 60000 AS wm, ts - ts % 21600000 + 21600000 AS win_end FROM sh WHERE event_id % 19 <> 0),
k AS (SELECT * FROM q WHERE NOT coalesce(win_end + 21600000 <= wm, false)),
f AS (SELECT *, row_number() OVER p AS i, coalesce(wm >= win_end AND wm > coalesce(first_value(wm) OVER p, -1), false) AS fired, avg(value) OVER p AS speed, min(value) OVER p AS charge, sum((value < 5)::INT) OVER p AS low FROM k WINDOW p AS (PARTITION BY depot, win_end ORDER BY seq)),
z AS (SELECT *, min(CASE WHEN fired THEN i END) OVER (PARTITION BY depot, win_end) AS ff, max(i) OVER (PARTITION BY depot, win_end) AS fin FROM f)
SELECT depot, win_end, seq, CASE WHEN i >= ff THEN 'U' ELSE 'D' END AS kind, round(speed, 7) AS speed, charge, low::BIGINT AS low FROM z WHERE i >= ff OR i = coalesce(ff - 1, fin)""",
    "depot_totals": f"WITH {EVENTS} SELECT user_id % 7 AS depot, round(sum(value), 3) AS total, count(*) AS n FROM ev WHERE event_id % 19 <> 0 GROUP BY ALL",
    "gas_topology": f"WITH {EVENTS} SELECT 'alarm' AS branch, user_id, ts, round(value, 4) AS value FROM ev WHERE value >= 100 UNION ALL SELECT 'dashboard', user_id, ts - ts % 86400000 + 86400000, round(avg(value), 7) FROM ev GROUP BY ALL",
    "lamp_pipelines": f"""WITH RECURSIVE {EVENTS}, o AS (SELECT * FROM ev WHERE value < 3.2), {_greedy("o", "user_id", "event_id", 86400000)},
w AS (SELECT *, max(ts) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS wm, max(ts) OVER () AS fin FROM ev), {_silent("np", "true", 108000000)},
s AS (SELECT user_id, -40.0::DOUBLE - value % 40.0::DOUBLE AS rssi, unnest([ts - ts % 43200000, ts - ts % 43200000 - 43200000]) AS win FROM ev), m AS (SELECT user_id, win + 86400000 AS ts, median(rssi) AS rssi FROM s GROUP BY ALL)
SELECT 'voltage' AS query, user_id, ts, round(value, 4) AS value FROM r JOIN g USING (user_id, n) WHERE keep UNION ALL SELECT 'contact', user_id, ts, NULL FROM np WHERE kind = 'silent'
UNION ALL SELECT 'distance', user_id, ts, round(power(10.0::DOUBLE, (-rssi - 40.0::DOUBLE) / 20.0::DOUBLE), 4) FROM m""",
    "timed_process": f"""WITH RECURSIVE {EVENTS}, z AS (SELECT user_id, event_id, ts, event_type, max(ts) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS wm, max(ts) OVER () AS fin, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, count(*) OVER (PARTITION BY user_id) AS cnt FROM ev),
g AS (SELECT user_id, 0::BIGINT AS n, 0::BIGINT AS level, NULL::BIGINT AS due, NULL::BIGINT AS out_ts, 0::BIGINT AS out_level FROM z WHERE n = 1
  UNION ALL SELECT z.user_id, z.n, greatest(0, CASE WHEN z.wm >= g.due THEN 0 ELSE g.level END + CASE event_type WHEN 'error' THEN -1 ELSE 1 END), z.ts + 86400000, CASE WHEN z.wm >= g.due THEN g.due END, g.level FROM g JOIN z ON z.user_id = g.user_id AND z.n = g.n + 1)
SELECT user_id, out_ts AS ts, out_level::INT AS level FROM g WHERE out_ts IS NOT NULL UNION ALL SELECT user_id, due, level::INT FROM g JOIN z USING (user_id, n) WHERE n = cnt AND fin >= due""",
    "connectivity": DEBOUNCE.format(events=EVENTS, key="user_id", value="value", latency=60000, check="value < 20", recovery="value > 40", pf=21600000, rf=0)
    + f""", w AS (SELECT *, max(ts) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 60000 AS wm, max(ts) OVER () AS fin FROM ev),
{_silent("np", "true", 86400000)}, {_silent("nr", "event_type <> 'error'", 129600000)}, {_silent("nm", "event_type IN ('click', 'view', 'purchase')", 86400000)},
held AS (SELECT user_id, 'no_motion' AS alert, 'D' AS kind, ts, ts AS at FROM nm WHERE kind = 'silent' UNION ALL SELECT k, CASE x.status WHEN 'ok' THEN 'voltage_ok' ELSE 'low_voltage' END, x.kind, x.ts, x.at FROM d),
gates AS (SELECT user_id, ts AS at, kind FROM np)
SELECT user_id, 'no_packets' AS alert, 'D' AS kind, ts FROM np WHERE kind = 'silent' UNION ALL SELECT user_id, 'no_readings', 'D', ts FROM nr WHERE kind = 'silent'
UNION ALL SELECT DISTINCT user_id, 'sos', 'D', ts FROM ev WHERE event_type = 'signup'
UNION ALL SELECT user_id, alert, kind, ts FROM held h WHERE coalesce((SELECT g.kind FROM gates g WHERE g.user_id = h.user_id AND g.at <= h.at ORDER BY g.at DESC, g.kind ASC LIMIT 1), 'resumed') <> 'silent'""",
    "fleet_alerts": f"""WITH RECURSIVE {EVENTS}, h AS (SELECT user_id, ts - ts % 3600000 + 3600000 AS ts, max(value) AS top, min(value) AS low, min(60.0 + c_nationkey) AS lim FROM ev LEFT JOIN customer ON user_id = c_custkey GROUP BY ALL),
a AS (SELECT user_id, ts, 'speed' AS rule, CASE WHEN top > 1.3::DOUBLE * lim THEN 'critical' WHEN top > lim THEN 'warning' END AS severity FROM h UNION ALL SELECT user_id, ts, 'fuel', CASE WHEN low < 0.5 THEN 'critical' WHEN low < 2 THEN 'warning' END FROM h),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, rule ORDER BY ts) AS n FROM a WHERE severity IS NOT NULL),
g AS (SELECT user_id, rule, n, ts AS last, true AS keep FROM r WHERE n = 1
  UNION ALL SELECT r.user_id, r.rule, r.n, CASE WHEN r.ts - g.last > 86400000 THEN r.ts ELSE g.last END, r.ts - g.last > 86400000 FROM g JOIN r ON r.user_id = g.user_id AND r.rule = g.rule AND r.n = g.n + 1)
SELECT user_id, ts, rule, severity FROM r JOIN g USING (user_id, rule, n) WHERE keep""",
    "nexmark_q1": f"WITH {_BIDS} SELECT event_id, auction, bidder, round(price * 0.89, 4) AS price_eur FROM b",
    "nexmark_q2": f"WITH {_BIDS} SELECT event_id, auction, price FROM b WHERE auction IN (7, 20, 21, 59, 87)",
    "nexmark_q3": "SELECT c_name, c_nationkey, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey IN (3, 7, 19) AND o_orderkey % 10 = 0",
    "nexmark_q5": f"""WITH {_BIDS}, s AS (SELECT *, unnest([ts - ts % 43200000, ts - ts % 43200000 - 43200000]) AS w FROM b), c AS (SELECT w + 86400000 AS win_end, auction, count(*) AS n FROM s WHERE w >= 0 GROUP BY ALL)
SELECT win_end, auction, n FROM c QUALIFY n = max(n) OVER (PARTITION BY win_end)""",
    "nexmark_q7": f"WITH {_BIDS} SELECT ts - ts % 3600000 + 3600000 AS win_end, bidder, price FROM b QUALIFY row_number() OVER (PARTITION BY ts - ts % 3600000 ORDER BY price DESC, event_id) = 1",
    "nexmark_q8": f"""WITH {EVENTS}, w AS (SELECT *, ts - ts % 43200000 + 43200000 AS win_end FROM ev)
SELECT user_id, win_end, count(*) FILTER (WHERE event_type = 'purchase') AS n FROM w GROUP BY ALL HAVING count(*) FILTER (WHERE event_type = 'purchase') > 0 AND count(*) FILTER (WHERE event_type = 'signup') > 0""",
    "nexmark_q12": f"WITH {_BIDS}, r AS (SELECT *, (row_number() OVER (PARTITION BY bidder ORDER BY event_id) - 1) // 10 AS fire FROM b) SELECT bidder, fire, count(*) AS n, max(price) AS top FROM r GROUP BY ALL",
    "median_rssi": f"""WITH {EVENTS}, s AS (SELECT user_id AS lamp, event_type AS beacon, -40.0::DOUBLE - value % 60.0::DOUBLE AS rssi, unnest([ts - ts % 21600000, ts - ts % 21600000 - 21600000, ts - ts % 21600000 - 43200000, ts - ts % 21600000 - 64800000]) AS w FROM ev),
m AS (SELECT lamp, w + 86400000 AS win_end, beacon, median(rssi) AS rssi FROM s GROUP BY ALL), g(beacon, x, y) AS (VALUES ('click', 0.0::DOUBLE, 0.0::DOUBLE), ('error', 50.0, 0.0), ('purchase', 0.0, 50.0), ('signup', 50.0, 50.0), ('view', 100.0, 0.0)),
r AS (SELECT *, row_number() OVER (PARTITION BY lamp, win_end ORDER BY rssi DESC, beacon DESC) AS k, power(10.0::DOUBLE, (-rssi - 40.0::DOUBLE) / 20.0::DOUBLE) AS d FROM m JOIN g USING (beacon))
SELECT a.lamp, a.win_end, a.beacon, round(CASE WHEN b.x IS NULL THEN a.x ELSE a.x + (b.x - a.x) * (a.d / (a.d + b.d)) END, 4) AS x, round(CASE WHEN b.x IS NULL THEN a.y ELSE a.y + (b.y - a.y) * (a.d / (a.d + b.d)) END, 4) AS y
FROM r a LEFT JOIN r b ON a.lamp = b.lamp AND a.win_end = b.win_end AND b.k = 2 WHERE a.k = 1""",
    "gas": f"""WITH RECURSIVE {EVENTS}, q AS (SELECT user_id AS lamp, CASE WHEN event_type = 'click' THEN 'co' ELSE 'ch4' END AS gas, CASE WHEN event_type = 'click' THEN value ELSE value * 100 END AS value, ts, event_id FROM ev),
v AS (SELECT *, CASE gas WHEN 'co' THEN CASE WHEN value > 100 THEN 'evacuate' WHEN value > 50 THEN 'warning' END ELSE CASE WHEN value > 10000 THEN 'evacuate' WHEN value > 5000 THEN 'warning' END END AS lvl, row_number() OVER (PARTITION BY lamp, gas ORDER BY event_id) AS n FROM q),
g AS (SELECT lamp, gas, n, ts, lvl AS now_l, CASE WHEN lvl IS NOT NULL THEN value END AS now_v, CASE WHEN lvl IS NOT NULL THEN 'D' END AS kind, lvl AS out_l, value AS out_v FROM v WHERE n = 1
  UNION ALL SELECT v.lamp, v.gas, v.n, v.ts, CASE WHEN v.lvl IS NULL THEN NULL WHEN g.now_l IS NULL OR v.lvl <> g.now_l OR abs(v.value - g.now_v) > 0.2::DOUBLE * abs(g.now_v) THEN v.lvl ELSE g.now_l END,
    CASE WHEN v.lvl IS NULL THEN NULL WHEN g.now_l IS NULL OR v.lvl <> g.now_l OR abs(v.value - g.now_v) > 0.2::DOUBLE * abs(g.now_v) THEN v.value ELSE g.now_v END,
    CASE WHEN g.now_l IS NULL AND v.lvl IS NOT NULL THEN 'D' WHEN g.now_l IS NOT NULL AND v.lvl IS NULL THEN 'R' WHEN g.now_l IS NOT NULL AND (v.lvl <> g.now_l OR abs(v.value - g.now_v) > 0.2::DOUBLE * abs(g.now_v)) THEN 'U' END,
    CASE WHEN v.lvl IS NULL THEN g.now_l ELSE v.lvl END, CASE WHEN v.lvl IS NULL THEN g.now_v ELSE v.value END FROM g JOIN v ON v.lamp = g.lamp AND v.gas = g.gas AND v.n = g.n + 1)
SELECT lamp, gas, kind, ts, out_l AS level, round(out_v, 4) AS value FROM g WHERE kind IS NOT NULL""",
    "composite_alerts": f"""WITH {EVENTS}, r AS (SELECT user_id, event_id, ts, last_value(CASE WHEN event_type = 'click' THEN value END IGNORE NULLS) OVER w AS v0, last_value(CASE WHEN event_type = 'view' THEN value END IGNORE NULLS) OVER w AS v1
  FROM ev WHERE event_type IN ('click', 'view') WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)),
i AS (SELECT *, least(v0, v1) AS item FROM r WHERE v0 IS NOT NULL AND v1 IS NOT NULL), s AS (SELECT *, CASE WHEN item > 50 THEN 'problem' WHEN item < 10 THEN 'ok' END AS st FROM i),
l AS (SELECT *, coalesce(lag(st) OVER (PARTITION BY user_id ORDER BY event_id), 'ok') AS was FROM s WHERE st IS NOT NULL) SELECT user_id, st AS status, ts, round(item, 4) AS value FROM l WHERE st <> was""",
    "presence": f"WITH {EVENTS}, l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM ev) SELECT user_id, event_type AS zone, ts FROM l WHERE rn = 1 AND event_type <> 'error'",
    "relative_moves": f"WITH {EVENTS}, l AS (SELECT event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS was FROM ev) SELECT event_id, value, was FROM l WHERE was > 0 AND abs(value - was) / abs(was) > 0.9",
}
