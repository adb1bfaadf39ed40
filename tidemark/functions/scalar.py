"""Scalar helpers: durations in milliseconds, shard hashing, formatting and the telemetry formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ms(n: int) -> int:
    return int(n)


def seconds(n: float) -> int:
    return int(n * 1000)


def minutes(n: float) -> int:
    return int(n * 60_000)


def hours(n: float) -> int:
    return int(n * 3_600_000)


def shard(key: Column, shards: int) -> Column:
    """Shard number 0..shards-1 by a times-33 hash of the UTF-8 bytes, kept to 62 bits; null for a null key."""
    if shards <= 0:
        raise ValueError("shards must be positive")
    mask = F.lit((1 << 62) - 1)
    code = F.hex(F.encode(key, "UTF-8"))
    at = F.when(F.length(code) > 0, F.sequence(F.lit(1), F.length(code), F.lit(2))).when(key.isNotNull(), F.array().cast("array<int>"))
    byte = lambda i: F.conv(F.substring(code, i, F.lit(2)), 16, 10).cast("long")
    # 33 h as 32 h + h, each step below 2**63
    times_33 = lambda h: (F.shiftleft(h, 5).bitwiseAND(mask) + h).bitwiseAND(mask)
    return F.aggregate(at, F.lit(5381).cast("long"), lambda h, i: (times_33(h) + byte(i)).bitwiseAND(mask)) % shards


def clock(ts_ms: Column) -> Column:
    """Milliseconds as seconds.milliseconds, e.g. 12.034s."""
    return F.format_string("%d.%03ds", F.floor(ts_ms / 1000).cast("long"), F.pmod(ts_ms, F.lit(1000)).cast("long"))


def distance_from_rssi(rssi: Column) -> Column:
    """Metres from a signal strength in dBm: 10 ** ((-rssi - 40) / 20)."""
    return F.pow(F.lit(10.0), (-rssi - 40.0) / 20.0)


def relative_change(new: Column, old: Column) -> Column:
    return F.when(old == 0, F.when(new == 0, 0.0).otherwise(float("inf"))).otherwise(F.abs(new - old) / F.abs(old))


def event_millis(ts: Column) -> Column:
    """A timestamp column as long milliseconds (session time zone UTC for zoneless timestamps)."""
    return F.unix_millis(ts.cast("timestamp"))


def positive(name: str, value: int) -> int:
    if value is None or value <= 0:
        raise ValueError(f"{name} must be positive")
    return value


def not_negative(name: str, value: int) -> int:
    if value is None or value < 0:
        raise ValueError(f"{name} must not be negative")
    return value
