"""Date coercion, durations and time zones."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

YEAR_1990_MS = 631_152_000_000
FORMATS = ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]XXX", "yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS]", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "yyyy-MM", "yyyy")
UNITS = {"ms": 1_000, "s": 1_000_000, "m": 60_000_000, "h": 3_600_000_000, "d": 86_400_000_000, "w": 604_800_000_000}


def epoch_micros(number: Column) -> Column:
    """Microseconds of an epoch number whose unit follows from its size against the year 1990."""
    n = number.cast("decimal(38,0)")
    ns, us, ms = (n > YEAR_1990_MS * k for k in (1_000_000, 1_000, 1))
    return F.when(ns, n / 1000).when(us, n).when(ms, n * 1000).otherwise(n * 1_000_000).cast("long")


def to_time(c: Column, kind: str) -> Column:
    """A timestamp from text, number or time; null for what can't be read."""
    if kind in ("timestamp", "timestamp_ntz", "date"):
        return c.cast("timestamp")
    if kind != "string":
        return F.timestamp_micros(epoch_micros(c))
    digits = F.timestamp_micros(epoch_micros(F.when(c.rlike(r"^\d{1,19}$"), c).cast("decimal(38,0)")))
    return F.coalesce(digits, F.expr("null").cast("timestamp"), *[F.try_to_timestamp(c, F.lit(f)) for f in FORMATS], c.try_cast("timestamp"))


def duration_micros(text: str) -> int:
    """``90m``, ``1h30m``, ``1d`` ... in microseconds."""
    parts = re.findall(r"(\d+)(ms|[smhdw])", text)
    if not parts or "".join(n + u for n, u in parts) != text:
        raise ValueError(f"not a duration: {text}")
    return sum(int(n) * UNITS[u] for n, u in parts)


def zone(text: str | None) -> str:
    """``+hhmm``, ``+hh:mm`` or a zone's name as Spark takes it."""
    if not text or text.upper() in ("UTC", "Z"):
        return "UTC"
    m = re.fullmatch(r"([+-])(\d{2}):?(\d{2})", text)
    return f"{m[1]}{m[2]}:{m[3]}" if m else text


CALENDAR = {}
for _name, _short in (("minute", "1m"), ("hour", "1h"), ("day", "1d"), ("week", "1w"), ("month", "1M"), ("quarter", "1q"), ("year", "1y")):
    CALENDAR[_name] = CALENDAR[_short] = _name


def calendar_bucket(t: Column, unit: str, tz: str = "UTC") -> Column:
    """Start of the calendar unit that holds a timestamp, as an instant; weeks start on Sunday."""
    if unit not in CALENDAR:
        raise ValueError(f"not a calendar interval: {unit}")
    unit = CALENDAR[unit]
    local = t if tz == "UTC" else F.from_utc_timestamp(t, tz)
    if unit == "week":
        start = F.date_trunc("week", local + F.expr("interval 1 day")) - F.expr("interval 1 day")
    else:
        start = F.date_trunc(unit, local)
    return start if tz == "UTC" else F.to_utc_timestamp(start, tz)


def fixed_bucket(t: Column, micros: int, tz: str = "UTC") -> Column:
    """Start of the fixed-length bucket, counted from the epoch in the zone's wall time."""
    local = t if tz == "UTC" else F.from_utc_timestamp(t, tz)
    start = F.timestamp_micros(F.floor(F.unix_micros(local) / F.lit(micros).cast("double")).cast("long") * micros)
    return start if tz == "UTC" else F.to_utc_timestamp(start, tz)
