"""Grouped aggregates and top lists. Ties are broken by name, so results are stable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import json as J
from .skew import ordered_parts
from .trees import attributed_to_agents


def _sums() -> list[Column]:
    p, c = F.col("prompt_tokens").cast("long"), F.col("completion_tokens").cast("long")
    return [
        F.coalesce(F.sum(p), F.lit(0).cast("long")).alias("prompt_tokens"),
        F.coalesce(F.sum(c), F.lit(0).cast("long")).alias("completion_tokens"),
        F.coalesce(F.sum(p + c), F.lit(0).cast("long")).alias("total_tokens"),
        F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"),
    ]


def top_models(runs: DataFrame, k: int = 5) -> DataFrame:
    named = runs.where("type = 'llm' and coalesce(name, '') != ''")
    return named.groupBy("name").agg(*_sums()).orderBy(F.desc("total_tokens"), F.desc("cost"), "name").limit(k)


def top_models_of_org(runs: DataFrame, k: int = 20) -> DataFrame:
    """Per model over an org: sums, and the project that uses it most."""
    per = runs.where("type = 'llm' and coalesce(name, '') != ''").groupBy("project_id", "name").agg(*_sums())
    # the leading project by tokens, then cost, then name, as one aggregate instead of a window sort
    leader = F.max_by("project_id", F.struct("total_tokens", "cost", F.transform(F.split("project_id", ""), lambda ch: -F.ascii(ch)))).alias("project_name")
    sums = [F.sum(c).alias(c) for c in ("prompt_tokens", "completion_tokens", "total_tokens", "cost")]
    return per.groupBy("name").agg(*sums, leader).orderBy(F.desc("total_tokens"), F.desc("cost"), "name").limit(k)


def ranked_projects(runs: DataFrame) -> DataFrame:
    """Rank of every project within a model; the window runs over (project, model) sums, not runs."""
    per = runs.where("type = 'llm' and coalesce(name, '') != ''").groupBy("project_id", "name").agg(*_sums())
    order = W.partitionBy("name").orderBy(F.desc("total_tokens"), F.desc("cost"), "project_id")
    return per.withColumn("rank", F.row_number().over(order))


def top_templates(runs: DataFrame, versions: DataFrame, k: int = 5) -> DataFrame:
    v = versions.select(F.col("id").alias("template_version_id"), "template_id")
    # sums per version first, so the join sees one row per version
    per = runs.groupBy("template_version_id").agg(*_sums(), F.count(F.lit(1)).alias("usage"))
    cols = ("usage", "prompt_tokens", "completion_tokens", "total_tokens", "cost")
    return (
        per.join(v, "template_version_id").groupBy("template_id").agg(*[F.sum(c).alias(c) for c in cols])
        .orderBy(F.desc("usage"), "template_id").limit(k)
    )


def top_agents(runs: DataFrame, k: int = 5) -> DataFrame:
    """Cost and tokens of whole subtrees, by the name of the agent on top."""
    return attributed_to_agents(runs).groupBy(F.col("agent_name").alias("name")).agg(*_sums()).orderBy(F.desc("cost"), "name").limit(k)


def top_languages(results: DataFrame, k: int = 5) -> DataFrame:
    """Distinct runs per language over input and output."""
    lang = results.where("type = 'language'")
    ddl = "struct<isoCode:string>"
    both = F.concat(F.coalesce(J.path_array("result", "input", ddl), F.array().cast(f"array<{ddl}>")), F.coalesce(J.path_array("result", "output", ddl), F.array().cast(f"array<{ddl}>")))
    seen = lang.select("run_id", F.explode(F.array_distinct(F.transform(both, lambda e: e["isoCode"]))).alias("language")).where("language is not null")
    return seen.groupBy("language").agg(F.count_distinct("run_id").alias("runs")).orderBy(F.desc("runs"), "language").limit(k)


def topic_array(field: str) -> Column:
    ddl = "array<struct<topic:string>>"
    found = F.coalesce(J.path_array("result", field, ddl), F.array().cast(f"array<{ddl}>"))
    return F.transform(F.flatten(F.filter(found, lambda x: x.isNotNull())), lambda e: e["topic"])


def top_topics(results: DataFrame, k: int | None = None) -> DataFrame:
    topics = results.where("type = 'topics'").select("run_id", F.explode(F.array_distinct(F.concat(topic_array("input"), topic_array("output")))).alias("topic"))
    out = topics.where("topic is not null").groupBy("topic").agg(F.count(F.lit(1)).alias("runs")).orderBy(F.desc("runs"), "topic")
    return out.limit(k) if k else out


# fixed values: property keys searched by the user list
USER_SEARCH_KEYS = ("email", "name", "firstName", "lastName", "orgName", "orgId")


def search_users(users: DataFrame, text: str) -> DataFrame:
    pattern = f"%{text}%"
    hit = F.col("external_id").ilike(pattern)
    for key in USER_SEARCH_KEYS:
        hit = hit | F.coalesce(J.get_text("props", key).ilike(pattern), F.lit(False))
    return users.where(hit)


def user_list(users: DataFrame, runs: DataFrame, search: str | None = None, sort: str = "cost", ascending: bool = False, page: int = 0, size: int | None = None) -> DataFrame:
    """Users with the cost of the given runs, sorted and paged."""
    cost = runs.groupBy(F.col("external_user_id").alias("id")).agg(F.sum("cost").alias("cost"))
    base = search_users(users, search) if search else users
    out = base.join(cost, "id", "left")
    order = F.asc_nulls_last(sort) if ascending else F.desc_nulls_last(sort)
    out = out.orderBy(order, "id")
    return out.offset(page * size).limit(size) if size else out


def hourly_metering(runs: DataFrame, now) -> DataFrame:
    at = F.lit(now).cast("timestamp")
    last = runs.where((F.col("created_at") >= at - F.expr("interval 1 hour")) & (F.col("created_at") < at))
    return last.groupBy("org_id").agg(F.count(F.lit(1)).alias("runs"))


def metering_windows(runs: DataFrame) -> DataFrame:
    """Runs per org in every hour; also runs on a stream."""
    return runs.groupBy("org_id", F.window("created_at", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("runs")).select(
        "org_id", F.col("w.start").alias("hour"), "runs"
    )


def usage_flags(runs: DataFrame, orgs: DataFrame, now, limit: int = 10_000, days: int = 30) -> DataFrame:
    """(org_id, limited, changed): free orgs above the limit, and whether their flag flips."""
    at = F.lit(now).cast("timestamp")
    recent = runs.where((F.col("created_at") >= at - F.make_dt_interval(F.lit(days))) & (F.col("created_at") < at))
    used = recent.groupBy("org_id").agg(F.count(F.lit(1)).alias("n"))
    over = F.coalesce(F.col("n") > limit, F.lit(False)) & (F.col("plan") == "free")
    return orgs.join(used, "org_id", "left").select("org_id", over.alias("limited"), (over != F.col("limited")).alias("changed"))


def item_counts(parents: DataFrame, items: DataFrame, key: str) -> DataFrame:
    return parents.join(items.groupBy(key).agg(F.count(F.lit(1)).alias("items")), key, "left").na.fill(0, ["items"])


def templates_with_versions(versions: DataFrame) -> DataFrame:
    """Versions per template, oldest first, in parts (``skew.ordered_parts``)."""
    item = F.struct("id", "is_draft", "published_at")
    return ordered_parts(versions.where("id is not null"), ["template_id"], item, ["id"], "versions")
