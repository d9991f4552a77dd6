"""Facets and set operations: distinct values for filter menus. ``distinct`` combines map-side, so hot values do not travel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import json as J
from .ordering import latest_cluster_version
from .topk import search_users, topic_array


def _values(df: DataFrame, col: Column) -> DataFrame:
    return df.select(col.alias("value")).where("value is not null").distinct()


def elements(df: DataFrame, key: str, field_ddl: str) -> DataFrame:
    """All elements of the input and output arrays of a result: (key, side, element)."""
    side = lambda f: df.select(key, F.lit(f).alias("side"), F.explode(J.path_array("result", f, field_ddl)).alias("element"))
    return side("input").unionByName(side("output"))


def retention_windows(projects: DataFrame, free_days: int = 30) -> DataFrame:
    """(org_id, days): the plan's own window, or the free one."""
    paid = projects.where("plan != 'free' and retention_days is not null").select("org_id", F.col("retention_days").alias("days"))
    free = projects.where("plan = 'free'").select("org_id", F.lit(free_days).alias("days"))
    return paid.unionByName(free).distinct()


def feedback_kinds(runs: DataFrame) -> DataFrame:
    """Distinct (project, key, value) of feedback; a comment counts as present, not by its text."""
    pairs = runs.where("feedback is not null").select("project_id", F.explode(J.as_map("feedback")).alias("key", "value"))
    return pairs.select("project_id", "key", F.when(F.col("key") == "comment", F.lit("")).otherwise(F.col("value")).alias("value")).distinct()


def models(runs: DataFrame) -> DataFrame:
    return _values(runs.where("type = 'llm' and name != ''"), F.col("name"))


def tags(runs: DataFrame) -> DataFrame:
    return _values(runs, F.explode("tags"))


def topics(results: DataFrame) -> DataFrame:
    return _values(results.where("type = 'topics'"), F.explode(F.concat(topic_array("input"), topic_array("output"))))


INTENT = "struct<intents:array<struct<label:string>>>"


def raw_intents(results: DataFrame) -> DataFrame:
    """One row per detected intent label: (run_id, label)."""
    found = elements(results.where("type = 'intent'"), "run_id", INTENT)
    labels = found.select("run_id", F.explode("element.intents").alias("i")).select("run_id", F.trim("i.label").alias("label"))
    return labels.where("label != ''")


def intents(results: DataFrame, versions: DataFrame | None = None, clusters: DataFrame | None = None, max_intents: int = 10) -> DataFrame:
    """Canonical labels of the latest taxonomy, ``other`` for the tail; raw labels when there is none."""
    if clusters is None or versions is None:
        return _values(raw_intents(results), F.col("label"))
    latest = latest_cluster_version(versions).select(F.col("id").alias("version_id"))
    known = clusters.join(latest, "version_id", "left_semi")
    tail = (F.col("sort_order") > max_intents) | (F.lower("label") == "other")
    return _values(known, F.when(tail, F.lit("other")).otherwise(F.col("label")))


def metadata_keys(runs: DataFrame) -> DataFrame:
    """Distinct (project_id, type, key)."""
    keys = runs.where("metadata is not null").select("project_id", "type", F.explode(F.json_object_keys("metadata")).alias("key"))
    return keys.distinct()


def metadata_key_facet(cache: DataFrame, project: str) -> DataFrame:
    return _values(cache.where(F.col("project_id") == project), F.col("key"))


def find_users(users: DataFrame, text: str) -> DataFrame:
    return search_users(users, text)


def user_property_keys(users: DataFrame) -> DataFrame:
    return _values(users, F.explode(F.json_object_keys("props")))


def user_property_values(users: DataFrame, key: str) -> DataFrame:
    return users.select(J.get_text("props", key).alias("value")).distinct().orderBy(F.asc_nulls_last("value"))


def templates(versions: DataFrame) -> DataFrame:
    return _values(versions, F.col("template_id"))


def custom_events(runs: DataFrame) -> DataFrame:
    return _values(runs.where("type = 'custom-event'"), F.col("name"))
