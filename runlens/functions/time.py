"""Local-time bucketing. Buckets are time-zone-free timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the four granularities, their truncation unit and step
GRANULARITIES = {
    "hourly": ("hour", "interval 1 hour"),
    "daily": ("day", "interval 1 day"),
    "weekly": ("week", "interval 7 days"),
    "monthly": ("month", "interval 1 month"),
}


def unit_of(granularity: str) -> str:
    return GRANULARITIES[granularity][0]


def step_of(granularity: str) -> str:
    return GRANULARITIES[granularity][1]


def local_bucket(ts: Column | str, tz: str, granularity: str) -> Column:
    """Start of the local hour, day, ISO week or month that holds ``ts``."""
    col = F.col(ts) if isinstance(ts, str) else ts
    return F.date_trunc(unit_of(granularity), F.from_utc_timestamp(col, tz)).cast("timestamp_ntz")


def seconds_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(1e6)
