"""Time buckets, calendar parts, freshness. All in UTC; the present is an argument."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def floor_to(ts: Column, seconds: int) -> Column:
    """The start of the bucket of so many seconds, counted from the epoch."""
    return F.timestamp_seconds(F.floor(F.unix_micros(ts.cast("timestamp")) / (seconds * 1_000_000)) * seconds)


def calendar(ts: Column) -> dict[str, Column]:
    """hour, weekday (0 = Monday), weekend, business hours (9 to 18 on weekdays)."""
    hour, day = F.hour(ts), F.weekday(ts)
    return {"hour": hour, "weekday": day, "weekend": day >= 5, "business": (hour >= 9) & (hour < 18) & (day < 5)}


def parse_iso(text: Column) -> Column:
    """ISO-8601 text as a timestamp, without zone in UTC; null if it is none."""
    return F.try_to_timestamp(text)


def default_range(now: datetime | None = None, days: int = 7) -> tuple[Column, Column]:
    end = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    return end - F.expr(f"INTERVAL {days} DAYS"), end


def seconds_between(a: Column, b: Column) -> Column:
    return (F.unix_micros(a) - F.unix_micros(b)) / 1e6


def freshness(ts: Column, now: Column) -> Column:
    """1.2 within an hour, 1.1 within a day, 1.0 within a week, 0.95 within thirty days, else 0.9."""
    age = seconds_between(now, ts)
    return F.when(ts.isNull(), 0.9).when(age < 3600, 1.2).when(age < 86400, 1.1).when(age < 7 * 86400, 1.0).when(age < 30 * 86400, 0.95).otherwise(0.9)
