"""Trailing-window metrics, alert transitions and notification rows.

Sums are taken per (rule key, minute) first; the trailing sum then runs over minutes, of
which a key has few, so a busy project costs no more than a quiet one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.json import get_text
from ..session import cut_lineage
from .skew import sliding_percentiles, with_neighbour

PERCENTILES = {"p50": 0.50, "p75": 0.75, "p90": 0.90, "p95": 0.95, "p99": 0.99}


def per_minute(runs: DataFrame, keys: list[str], ts: str = "created_at") -> DataFrame:
    thumb = get_text("feedback", "thumb")
    flag = lambda c: F.sum(F.when(c, 1).otherwise(0).cast("long"))
    return runs.groupBy(*keys, F.date_trunc("minute", ts).alias("minute")).agg(
        F.count(F.lit(1)).alias("runs"), flag(F.col("error").isNotNull()).alias("errors"), F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"),
        flag(thumb == "up").alias("up"), flag(thumb == "down").alias("down"),
    )


def minute_spine(minutes: DataFrame, keys: list[str], tail_minutes: int) -> DataFrame:
    """Every minute per key from its first to its last run plus the window, so that alerts can also resolve. Days come first,
    then their minutes, so a long history of a key is many rows, not one long list."""
    ends = minutes.groupBy(*keys).agg(F.unix_seconds(F.min("minute")).alias("_lo"), (F.unix_seconds(F.max("minute")) + 60 * tail_minutes).alias("_hi"))
    days = ends.select(*keys, "_lo", "_hi", F.explode(F.sequence(F.floor(F.col("_lo") / 86400), F.floor(F.col("_hi") / 86400))).alias("_day"))
    of_day = F.sequence(F.greatest("_lo", F.col("_day") * 86400), F.least("_hi", F.col("_day") * 86400 + 86340), F.lit(60).cast("long"))
    return days.select(*keys, F.explode(of_day).alias("_s")).select(*keys, F.timestamp_seconds("_s").alias("minute"))


def trailing(runs: DataFrame, keys: list[str], minutes: int, fill: bool = True) -> DataFrame:
    """(keys, window_end, runs, errors, cost, up, down) of the last ``minutes`` before every minute's end."""
    sums = cut_lineage(per_minute(runs, keys))  # read by the spine and by the windows
    base = minute_spine(sums, keys, minutes).join(sums, [*keys, "minute"], "left") if fill else sums
    secs = F.unix_seconds("minute")
    # a day's chunk keeps long histories of one key in separate tasks; each chunk brings the minutes before it
    day = F.floor(secs / 86400)
    spread = base.withColumn("_s", secs).withColumn(
        "_chunk", F.explode(F.sequence(day, F.floor((secs + F.lit(60 * (minutes - 1))) / 86400)))
    )
    w = W.partitionBy(*keys, "_chunk").orderBy("_s").rangeBetween(-60 * (minutes - 1), 0)
    total = lambda c, zero: F.coalesce(F.sum(c).over(w), F.lit(zero)).alias(c)
    out = spread.select(
        *keys, "_chunk", day.alias("_day"), (F.col("minute") + F.expr("interval 1 minute")).alias("window_end"), total("runs", 0), total("errors", 0), total("cost", 0.0), total("up", 0), total("down", 0)
    )
    return out.where("_chunk = _day").drop("_chunk", "_day")


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part * 100.0 / whole).otherwise(F.lit(0.0))


def error_rate(t: DataFrame) -> Column:
    return _share(F.col("errors"), F.col("runs"))


def cost_total(t: DataFrame) -> Column:
    return F.col("cost")


def thumbs_up_share(t: DataFrame, rated_only: bool = False) -> Column:
    """Share of all runs in the window, or of the rated ones."""
    return _share(F.col("up"), (F.col("up") + F.col("down")) if rated_only else F.col("runs"))


METRICS = {"error_rate": error_rate, "cost": cost_total, "feedback": thumbs_up_share}


def metric(runs: DataFrame, keys: list[str], name: str, minutes: int) -> DataFrame:
    t = trailing(runs, keys, minutes)
    return t.select(*keys, "window_end", METRICS[name](t).alias("value"))


def latency(runs: DataFrame, keys: list[str], minutes: int, slide: int = 1, points: list[str] | None = None) -> DataFrame:
    """Percentiles of duration over sliding windows: (keys, window_end, name, value)."""
    names = points or list(PERCENTILES)
    out = sliding_percentiles(runs, keys, "created_at", "duration_s", [PERCENTILES[n] for n in names], minutes, slide)
    label = F.coalesce(*[F.when(F.col("p") == PERCENTILES[n], F.lit(n)) for n in names])
    return out.select(*keys, "window_end", label.alias("name"), "value")


def transitions(values: DataFrame, rules: DataFrame) -> DataFrame:
    """(rule_id, triggered_at, resolved_at, value, status): healthy → triggered above the threshold, back at or below it.

    ``values`` has rule_id, window_end, value. Rows that repeat the state before them are dropped by a
    chunked look-back; what is left alternates, and the next row resolves.
    """
    on = values.join(rules.select("rule_id", "threshold"), "rule_id").withColumn("hot", F.col("value") > F.col("threshold"))
    before = with_neighbour(on, ["rule_id"], ["window_end"], {"was": F.col("hot")}, keep=True)
    edges = before.where(F.col("hot") != F.coalesce("was", F.lit(False))).select("_k", "rule_id", "window_end", "value", "hot")
    paired = with_neighbour(edges, ["rule_id"], ["window_end"], {"resolved_at": F.col("window_end")}, following=True)
    return paired.where("hot").select(
        "rule_id", F.col("window_end").alias("triggered_at"), "resolved_at", "value",
        F.when(F.col("resolved_at").isNull(), "ongoing").otherwise("resolved").alias("status"),
    )


def notifications(history: DataFrame) -> DataFrame:
    """One row per transition for a sink."""
    up = history.select("rule_id", F.col("triggered_at").alias("at"), F.lit("triggered").alias("kind"), "value")
    down = history.where("resolved_at is not null").select("rule_id", F.col("resolved_at").alias("at"), F.lit("resolved").alias("kind"), F.lit(None).cast("double").alias("value"))
    return up.unionByName(down)


def history_report(history: DataFrame, rules: DataFrame) -> DataFrame:
    return history.join(rules, "rule_id").orderBy(F.desc("triggered_at"), "rule_id")
