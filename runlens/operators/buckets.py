"""Bucket spine and the joins of runs to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.time import local_bucket, step_of, unit_of


def _ts(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast("timestamp")


def _spine_columns(df: DataFrame, start: Column, end: Column, tz: str, granularity: str, now: Column | None) -> DataFrame:
    unit, step = unit_of(granularity), F.expr(step_of(granularity))
    stop = end - F.expr("interval 1 microsecond")
    if now is not None:
        stop = F.least(stop, now)
    local = lambda c: F.date_trunc(unit, F.from_utc_timestamp(c, tz))
    return (
        df.select(F.explode(F.sequence(local(start), local(stop), step)).alias("d"))
        .distinct()
        .select(
            F.col("d").cast("timestamp_ntz").alias("date"),
            F.to_utc_timestamp("d", tz).alias("start_utc"),
            F.to_utc_timestamp(F.col("d") + step, tz).alias("end_utc"),
        )
    )


def bucket_spine(spark: SparkSession, start, end, tz: str = "UTC", granularity: str = "daily", now=None) -> DataFrame:
    """Every bucket touching [start, end), also the empty ones: (date, start_utc, end_utc)."""
    return _spine_columns(
        spark.range(1), _ts(start), _ts(end), tz, granularity, None if now is None else _ts(now)
    )


def spine_per_row(df: DataFrame, start, end, tz: str = "UTC", granularity: str = "daily") -> DataFrame:
    """Repeats every row of a small table for every bucket of [start, end), as column ``date``."""
    unit, step = unit_of(granularity), F.expr(step_of(granularity))
    local = lambda c: F.date_trunc(unit, F.from_utc_timestamp(c, tz))
    stop = _ts(end) - F.expr("interval 1 microsecond")
    return df.withColumn("date", F.explode(F.sequence(local(_ts(start)), local(stop), step))).withColumn("date", F.col("date").cast("timestamp_ntz"))


def spine_of(runs: DataFrame, tz: str = "UTC", granularity: str = "daily") -> DataFrame:
    """The spine that covers the whole of ``runs``."""
    bounds = runs.agg(F.min("created_at").alias("lo"), F.max("created_at").alias("hi")).where("lo is not null")
    return _spine_columns(
        bounds, F.col("lo"), F.col("hi") + F.expr("interval 1 microsecond"), tz, granularity, None
    )


def in_range(runs: DataFrame, start, end, ts: str = "created_at") -> DataFrame:
    return runs.where((F.col(ts) >= _ts(start)) & (F.col(ts) < _ts(end)))


def with_bucket(runs: DataFrame, tz: str, granularity: str, ts: str = "created_at") -> DataFrame:
    return runs.withColumn("date", local_bucket(ts, tz, granularity))


def join_on_bucket(spine: DataFrame, runs: DataFrame, tz: str, granularity: str) -> DataFrame:
    """Equi join of spine and runs on the truncated local time; weekly buckets too."""
    return spine.join(with_bucket(runs, tz, granularity), "date", "left")


def join_on_interval(spine: DataFrame, runs: DataFrame, tz: str, granularity: str, ts: str = "created_at") -> DataFrame:
    """created_at in [start_utc, end_utc), as an equi join on the bucket plus the exact bounds.

    The bucket of a row is the only spine row whose interval can hold it, so the range
    condition is a residual filter and never a nested loop.
    """
    r = runs.withColumn("_b", local_bucket(ts, tz, granularity))
    cond = (spine["date"] == r["_b"]) & (r[ts] >= spine["start_utc"]) & (r[ts] < spine["end_utc"])
    return spine.join(r, cond, "left").drop("_b")
