"""Retention: redact old runs of projects with a window, purge old runs of organisations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: allowed windows of a project, and the free plan's window
PROJECT_WINDOWS = (30, 60, 90, 180, 365)
FREE_DAYS = 30
REDACTED_COLUMNS = ("input", "output", "error", "metadata")


def _cutoff(now, days: Column) -> Column:
    return F.lit(now).cast("timestamp") - F.make_dt_interval(days)


def redact_old(runs: DataFrame, policies: DataFrame, now) -> DataFrame:
    """``policies``: project_id, days. Older runs lose their content and are marked deleted. The policy
    table has one row per project; the rewrite is one pass, best run per date partition."""
    p = policies.where(F.col("days").isin(list(PROJECT_WINDOWS))).select("project_id", F.col("days").alias("_days"))
    joined = runs.join(p, "project_id", "left")
    old = F.coalesce(F.col("created_at") < _cutoff(now, F.col("_days")), F.lit(False))
    for c in REDACTED_COLUMNS:
        joined = joined.withColumn(c, F.when(~old, F.col(c)))
    return joined.withColumn("is_deleted", F.col("is_deleted") | old).drop("_days")


def affected_dates(runs: DataFrame, policies: DataFrame, now) -> DataFrame:
    """The (project_id, date) partitions a purge or redaction has to rewrite."""
    p = policies.select("project_id", F.col("days").alias("_days"))
    old = runs.join(p, "project_id").where(F.col("created_at") < _cutoff(now, F.col("_days")))
    return old.select("project_id", F.to_date("created_at").alias("date")).distinct()


def org_windows(orgs: DataFrame) -> DataFrame:
    """(org_id, days): free organisations keep 30 days, others what their plan says; none = keep."""
    days = F.when(F.col("plan") == "free", F.lit(FREE_DAYS)).otherwise(F.col("retention_days"))
    return orgs.select("org_id", days.alias("days")).where("days is not null")


def purge_old(runs: DataFrame, orgs: DataFrame, now) -> DataFrame:
    """Runs inside their organisation's window."""
    w = org_windows(orgs).withColumnRenamed("days", "_days")
    joined = runs.join(w, "org_id", "left")
    return joined.where(F.col("_days").isNull() | (F.col("created_at") >= _cutoff(now, F.col("_days")))).drop("_days")


def purge_results(results: DataFrame, kept_runs: DataFrame) -> DataFrame:
    """Evaluation results of the runs that stay."""
    return results.join(kept_runs.select(F.col("id").alias("run_id")), "run_id", "left_semi")
