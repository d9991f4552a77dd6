"""Time-bucketed aggregates. Every series is (date, value, name), one row per bucket at least.

Runs are aggregated per (bucket, name) first, with map-side combine, and the small
result is joined to the spine; no run row ever meets the spine.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.json import get_text
from .buckets import bucket_spine, in_range, spine_per_row, with_bucket
from .skew import exact_percentiles

PERCENTILES = {"p50": 0.50, "p75": 0.75, "p90": 0.90, "p95": 0.95, "p99": 0.99}


@dataclass(frozen=True)
class Range:
    start: str
    end: str
    tz: str = "UTC"
    granularity: str = "daily"


def _spine(runs: DataFrame, r: Range) -> DataFrame:
    return bucket_spine(runs.sparkSession, r.start, r.end, r.tz, r.granularity).select("date")


def _scoped(runs: DataFrame, r: Range) -> DataFrame:
    return with_bucket(in_range(runs, r.start, r.end), r.tz, r.granularity)


def _named(runs: DataFrame, r: Range, name: Column, value: Column, zero: Column) -> DataFrame:
    agg = _scoped(runs, r).groupBy("date", name.alias("name")).agg(value.alias("value"))
    return _spine(runs, r).join(agg, "date", "left").select(
        "date", F.coalesce("value", zero).alias("value"), "name"
    )


def _single(runs: DataFrame, r: Range, label: str, value: Column, zero: Column) -> DataFrame:
    agg = _scoped(runs, r).groupBy("date").agg(value.alias("value"))
    return _spine(runs, r).join(agg, "date", "left").select(
        "date", F.coalesce("value", zero).alias("value"), F.lit(label).alias("name")
    )


def _zero() -> Column:
    return F.lit(0).cast("long")


def _zero_d() -> Column:
    return F.lit(0.0)


def tokens_by_model(runs: DataFrame, r: Range) -> DataFrame:
    total = F.sum((F.col("prompt_tokens") + F.col("completion_tokens")).cast("long"))
    return _named(runs, r, F.col("name"), total, _zero())


def cost_by_model(runs: DataFrame, r: Range) -> DataFrame:
    return _named(runs, r, F.col("name"), F.sum("cost"), _zero_d())


def errors(runs: DataFrame, r: Range) -> DataFrame:
    out = _single(runs, r, "error", F.count("error"), _zero())
    return out.where("value > 0") if r.granularity == "weekly" else out


def _of_new_users(runs: DataFrame, users: DataFrame) -> DataFrame:
    """Runs made within seven days after their user first appeared."""
    u = users.select(F.col("id").alias("external_user_id"), F.col("created_at").alias("_user_since"), F.col("props").alias("_props"))
    age = (F.col("_user_since") <= F.col("created_at")) & (
        F.col("_user_since") >= F.col("created_at") - F.expr("interval 7 days")
    )
    return runs.join(u, "external_user_id").where(age)


def _with_props(runs: DataFrame, users: DataFrame) -> DataFrame:
    u = users.select(F.col("id").alias("external_user_id"), F.col("props").alias("_props"))
    return runs.where("external_user_id is not null").join(u, "external_user_id", "left")


def new_users(runs: DataFrame, users: DataFrame, r: Range) -> DataFrame:
    return _single(_of_new_users(runs, users), r, "Count", F.count_distinct("external_user_id"), _zero())


def new_users_stat(runs: DataFrame, users: DataFrame, r: Range) -> DataFrame:
    return in_range(_of_new_users(runs, users), r.start, r.end).agg(
        F.count_distinct("external_user_id").alias("stat")
    )


def _by_property(runs: DataFrame, r: Range, key: str) -> DataFrame:
    value = F.coalesce(get_text("_props", key), F.lit("Unknown"))
    return _named(runs, r, value, F.count_distinct("external_user_id"), _zero())


def _by_two_properties(runs: DataFrame, r: Range, first: str, second: str) -> DataFrame:
    """Distinct users per (second, first) property pair, long form of the pivot; null second removed."""
    rows = in_range(runs, r.start, r.end).select(
        "external_user_id", get_text("_props", second).alias("second"),
        F.coalesce(get_text("_props", first), F.lit("Unknown")).alias("first"),
    )
    return rows.where("second is not null").groupBy("second", "first").agg(
        F.count_distinct("external_user_id").alias("value")
    )


def pivot_pairs(pairs: DataFrame, firsts: list[str] | None = None) -> DataFrame:
    """Second property down, first property across, missing pairs 0."""
    return pairs.groupBy("second").pivot("first", firsts).agg(F.sum("value")).na.fill(0)


def new_users_by_property(runs: DataFrame, users: DataFrame, r: Range, key: str) -> DataFrame:
    return _by_property(_of_new_users(runs, users), r, key)


def new_users_by_two(runs: DataFrame, users: DataFrame, r: Range, first: str, second: str) -> DataFrame:
    return _by_two_properties(_of_new_users(runs, users), r, first, second)


def active_users(runs: DataFrame, r: Range) -> DataFrame:
    return _single(runs, r, "Count", F.count_distinct("external_user_id"), _zero())


def active_users_stat(runs: DataFrame, r: Range) -> DataFrame:
    return in_range(runs, r.start, r.end).agg(F.count_distinct("external_user_id").alias("stat"))


def active_users_by_property(runs: DataFrame, users: DataFrame, r: Range, key: str) -> DataFrame:
    return _by_property(_with_props(runs, users), r, key)


def active_users_by_two(runs: DataFrame, users: DataFrame, r: Range, first: str, second: str) -> DataFrame:
    return _by_two_properties(_with_props(runs, users), r, first, second)


def average_user_cost(runs: DataFrame, r: Range) -> DataFrame:
    per_user = (
        _scoped(runs.where("external_user_id is not null"), r)
        .groupBy("date", "external_user_id")
        .agg(F.coalesce(F.sum("cost"), F.lit(0.0)).alias("total"))
    )
    agg = per_user.groupBy("date").agg(F.avg("total").alias("value"))
    # a bucket without users averages to zero and zero buckets are dropped: no spine needed
    return agg.where("value != 0").select("date", "value", F.lit("Cost").alias("name"))


def average_user_cost_stat(runs: DataFrame, r: Range) -> DataFrame:
    per_user = (
        in_range(runs, r.start, r.end)
        .where("external_user_id is not null and cost is not null")
        .groupBy("external_user_id")
        .agg(F.sum("cost").alias("total"))
    )
    return per_user.agg(F.avg("total").alias("stat"))


def runs_by_type(runs: DataFrame, r: Range) -> DataFrame:
    return _named(runs, r, F.col("type"), F.count(F.lit(1)), _zero())


def runs_by_tag(runs: DataFrame, r: Range) -> DataFrame:
    tagged = runs.select("created_at", F.explode_outer(F.array_distinct("tags")).alias("tag"))
    return _named(tagged, r, F.col("tag"), F.count("tag"), _zero())


def run_volume(runs: DataFrame, r: Range) -> DataFrame:
    out = _single(runs, r, "Events", F.count(F.lit(1)), _zero())
    if r.granularity == "weekly":
        return out
    any_run = in_range(runs, r.start, r.end).agg(F.count(F.lit(1)) > 0)
    return out.where(any_run.scalar())


def latency_percentiles(runs: DataFrame, r: Range) -> DataFrame:
    points = exact_percentiles(_scoped(runs, r).select("date", "duration_s"), ["date"], "duration_s", list(PERCENTILES.values()))
    label = F.element_at(F.create_map(*[x for n, p in PERCENTILES.items() for x in (F.lit(p), F.lit(n))]), F.col("p"))
    names = F.explode(F.array(*[F.lit(n) for n in PERCENTILES])).alias("name")
    grid = _spine(runs, r).select("date", names)
    return grid.join(points.select("date", label.alias("name"), "value"), ["date", "name"], "left").select(
        "date", F.coalesce("value", F.lit(0.0)).alias("value"), "name"
    )


def latency_stat(runs: DataFrame, r: Range) -> DataFrame:
    return in_range(runs, r.start, r.end).where("type = 'llm'").agg(F.avg("duration_s").alias("stat"))


def active_threads(runs: DataFrame, r: Range) -> DataFrame:
    return _single(runs.where("type = 'thread'"), r, "Threads", F.count(F.lit(1)), _zero())


def _thumb(kind: str) -> Column:
    return F.sum(F.when(get_text("feedback", "thumb") == kind, 1).otherwise(0).cast("long"))


def thumbs(runs: DataFrame, r: Range, kind: str) -> DataFrame:
    return _single(runs, r, "Thumbs Up" if kind == "up" else "Thumbs Down", _thumb(kind), _zero())


def feedback_ratio(runs: DataFrame, r: Range) -> DataFrame:
    ratio = F.try_divide(_thumb("up") - _thumb("down"), _thumb("up") + _thumb("down"))
    return _single(runs, r, "Ratio", ratio, _zero_d())


def custom_events(runs: DataFrame, r: Range, names: list[str] | None = None) -> DataFrame:
    rows = runs.where("type = 'custom-event'")
    if names:
        rows = rows.where(F.col("name").isin(names))
    return _named(rows, r, F.col("name"), F.count(F.lit(1)), _zero())


def daily_usage(runs: DataFrame, keys: list[str], now, days: int = 30) -> DataFrame:
    """Runs per UTC day over the trailing days, per org or project."""
    at = F.lit(now).cast("timestamp")
    recent = runs.where((F.col("created_at") >= at - F.make_dt_interval(F.lit(days))) & (F.col("created_at") < at))
    return recent.groupBy(*keys, F.date_trunc("day", "created_at").cast("timestamp_ntz").alias("date")).agg(
        F.count(F.lit(1)).alias("value")
    )


def _usage_aggs() -> list[Column]:
    return [
        F.coalesce(F.sum(F.col("prompt_tokens").cast("long")), _zero()).alias("prompt_tokens"),
        F.coalesce(F.sum(F.col("completion_tokens").cast("long")), _zero()).alias("completion_tokens"),
        F.coalesce(F.sum("cost"), _zero_d()).alias("cost"),
        F.sum(F.when(F.col("status") == "error", 1).otherwise(0).cast("long")).alias("errors"),
        F.sum(F.when(F.col("status") == "success", 1).otherwise(0).cast("long")).alias("success"),
    ]


def usage_summary(runs: DataFrame, now, days: int, daily: bool = False, min_ms: int = 1000) -> DataFrame:
    at = F.lit(now).cast("timestamp")
    recent = runs.where(F.col("created_at") >= at - F.make_dt_interval(F.lit(days)))
    keys = ["name", "type"]
    if daily:
        recent = recent.where(F.col("duration_s") * 1000 >= min_ms).withColumn(
            "date", F.date_trunc("day", "created_at").cast("timestamp_ntz")
        )
        keys = ["date", *keys]
    return recent.groupBy(*keys).agg(*_usage_aggs())


def usage_per_user(runs: DataFrame) -> DataFrame:
    """Per user, name and type; an agent inside another run is left out."""
    top = runs.where("external_user_id is not null and not (type = 'agent' and parent_run_id is not null)")
    return top.groupBy("external_user_id", "name", "type").agg(*_usage_aggs())


def nonzero_names(series: DataFrame) -> DataFrame:
    return series.where("name is not null").groupBy("name").agg(F.sum(F.abs("value")).alias("_t")).where("_t > 0").select("name")


def zero_filled(series: DataFrame, r: Range) -> DataFrame:
    """Every bucket of the range with every name that has a non-zero value, missing = 0 (long form)."""
    grid = spine_per_row(nonzero_names(series), r.start, r.end, r.tz, r.granularity)
    return grid.join(series, ["date", "name"], "left").select("date", "name", F.coalesce("value", F.lit(0)).alias("value"))


def wide(series: DataFrame, names: list[str]) -> DataFrame:
    """One column per name, as a chart reads it."""
    return series.groupBy("date").pivot("name", names).agg(F.sum("value")).na.fill(0)


def headline(series: DataFrame, method: str) -> DataFrame:
    """The one number above a chart: sum, avg over non-zero points, min or max."""
    fn = {
        "sum": F.sum("value"),
        "avg": F.avg(F.when(F.col("value") != 0, F.col("value"))),
        "min": F.min("value"),
        "max": F.max("value"),
    }[method]
    return series.agg(F.coalesce(fn.cast("double"), _zero_d()).alias("headline"))


def series_totals(series: DataFrame, k: int = 5) -> DataFrame:
    """Sum over dates, largest ``k`` names."""
    return (
        series.where("name is not null").groupBy("name").agg(F.sum("value").alias("value"))
        .orderBy(F.desc("value"), "name").limit(k)
    )
