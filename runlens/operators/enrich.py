"""Joins that enrich runs. Each function adds one piece, so a query pays only for what it reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import json as J
from .buckets import in_range
from .skew import beside_parts, ordered_parts
from .trees import ancestors_first


def with_users(runs: DataFrame, users: DataFrame) -> DataFrame:
    u = users.select(F.col("id").alias("external_user_id"), F.col("external_id").alias("user_external_id"), F.col("props").alias("user_props"))
    return runs.join(u, "external_user_id", "left")


def with_templates(runs: DataFrame, versions: DataFrame) -> DataFrame:
    v = versions.select(F.col("id").alias("template_version_id"), "template_id")
    return runs.join(v, "template_version_id", "left")


def with_parent_chat(runs: DataFrame, every_run: DataFrame | None = None) -> DataFrame:
    """parent_chat_id: the parent when it is a chat."""
    chats = (every_run if every_run is not None else runs).where("type = 'chat'").select(
        F.col("id").alias("parent_run_id"), F.col("id").alias("parent_chat_id")
    )
    return runs.join(chats, "parent_run_id", "left")


def result_parts(results: DataFrame, items: int | None = None) -> DataFrame:
    """(id, part, results_size, results): (type, evaluator_id, result) in that order, in parts of a bounded length."""
    long = results.withColumnRenamed("run_id", "id")
    return ordered_parts(long, ["id"], F.struct("type", "evaluator_id", "result"), ["type", "evaluator_id"], "results", items)


def score_parts(scores: DataFrame, items: int | None = None) -> DataFrame:
    """(id, part, scores_size, scores): (label, value, comment) by label, in parts; (run, label) is unique."""
    long = scores.withColumnRenamed("run_id", "id")
    return ordered_parts(long, ["id"], F.struct("label", "value", "comment"), ["label"], "scores", items)


def with_results(runs: DataFrame, results: DataFrame) -> DataFrame:
    """Runs with their results; a run with more than a part's items has a row per part."""
    return beside_parts(runs, ["id"], result_parts(results))


def with_scores(runs: DataFrame, scores: DataFrame) -> DataFrame:
    """Runs with their scores; as ``with_results``."""
    return beside_parts(runs, ["id"], score_parts(scores))


def parent_feedback(runs: DataFrame) -> DataFrame:
    """(id, parent_feedback): feedback of the nearest chat ancestor."""
    chats = (F.col("type") == "chat") & F.col("feedback").isNotNull()
    return ancestors_first(runs, chats, F.col("feedback"), "parent_feedback")


def with_parent_feedback(runs: DataFrame) -> DataFrame:
    return runs.join(parent_feedback(runs), "id", "left")


def child_feedbacks(runs: DataFrame) -> DataFrame:
    """Long form: one row per chat child with feedback (parent_id, child_id, created_at, feedback)."""
    return runs.where("type = 'chat' and parent_run_id is not null and feedback is not null").select(
        F.col("parent_run_id").alias("parent_id"), F.col("id").alias("child_id"), "created_at", "feedback"
    )


def child_feedback_parts(runs: DataFrame, items: int | None = None) -> DataFrame:
    """(id, part, child_feedbacks_size, child_feedbacks): feedbacks of a run's chat children in time order, in parts."""
    long = child_feedbacks(runs).withColumnRenamed("parent_id", "id")
    return ordered_parts(long, ["id"], F.col("feedback"), ["created_at", "child_id"], "child_feedbacks", items)


def with_child_feedbacks(runs: DataFrame, items: int | None = None) -> DataFrame:
    """Runs with ``child_feedback_parts``; a run with more than a part's items has a row per part."""
    return beside_parts(runs, ["id"], child_feedback_parts(runs, items))


def message_stats(messages: DataFrame) -> DataFrame:
    """(thread_id, messages_count, first_message) from a message log."""
    return messages.groupBy("thread_id").agg(
        F.count(F.lit(1)).alias("messages_count"), F.min_by("content", F.struct("timestamp", "id")).alias("first_message")
    )


def thread_stats(runs: DataFrame) -> DataFrame:
    """(thread_id, messages_count, first_message) over the input and output messages of a thread's chat runs."""
    from ..functions.messages import parse

    chats = runs.where("type = 'chat' and parent_run_id is not null")
    side = lambda name, n: chats.select(F.col("parent_run_id").alias("thread_id"), "created_at", "id", F.lit(n).alias("side"), F.posexplode(parse(name)).alias("pos", "m"))
    said = side("input", 0).unionByName(side("output", 1))
    return said.groupBy("thread_id").agg(F.count(F.lit(1)).alias("messages_count"), F.min_by("m.content", F.struct("created_at", "id", "side", "pos")).alias("first_message"))


def enriched(
    runs: DataFrame,
    start=None,
    end=None,
    project: str | None = None,
    users: DataFrame | None = None,
    versions: DataFrame | None = None,
    results: DataFrame | None = None,
    scores: DataFrame | None = None,
    include: tuple[str, ...] = (),
) -> DataFrame:
    """The enriched run view: live runs of a project in [start, end) plus only the pieces named.

    ``include`` may hold users, templates, parent_chat, results, scores, parent_feedback, child_feedbacks. Lists come in
    parts: a run whose lists need several has a row for each, numbered by ``part``.
    """
    r = runs.where(~F.coalesce(F.col("is_deleted"), F.lit(False)))
    if project is not None:
        r = r.where(F.col("project_id") == project)
    scope = in_range(r, start, end) if start is not None else r
    out = scope
    if "users" in include:
        out = with_users(out, users)
    if "templates" in include:
        out = with_templates(out, versions)
    if "parent_chat" in include:
        out = with_parent_chat(out, r)
    if "parent_feedback" in include:
        out = out.join(parent_feedback(r), "id", "left")
    lists = {"results": lambda: result_parts(results), "scores": lambda: score_parts(scores), "child_feedbacks": lambda: child_feedback_parts(r)}
    wanted = [make() for name, make in lists.items() if name in include]
    return beside_parts(out, ["id"], *wanted) if wanted else out


def keep_matching(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right.select(*keys).distinct(), keys, "left_semi")


def drop_matching(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right.select(*keys), keys, "left_anti")


def unscored(runs: DataFrame, results: DataFrame, evaluator_id: str, toxicity: DataFrame | None = None) -> DataFrame:
    """Runs an evaluator has not scored yet; a toxicity evaluator also skips runs with a toxicity row."""
    done = results.where(F.col("evaluator_id") == evaluator_id).select(F.col("run_id").alias("id"))
    out = runs.join(done, "id", "left_anti")
    if toxicity is not None:
        out = out.join(toxicity.select(F.col("run_id").alias("id")), "id", "left_anti")
    return out


def second_dimension_users(users: DataFrame, key: str) -> DataFrame:
    """Every distinct value of a property left-joined to the users that carry it, one row per user."""
    value = J.get_text("props", key)
    values = users.select(value.alias("sd")).where("sd is not null").distinct()
    holders = users.select(value.alias("sd"), F.col("id").alias("user_id")).dropDuplicates(["user_id"])
    return values.join(holders, "sd", "left")


def evaluation_grid(prompts: DataFrame, variations: DataFrame, providers: DataFrame, block: int = 1000) -> DataFrame:
    """prompt × its variations × provider. Providers are dealt into blocks; every pair asks each block, so no
    provider list passes the driver."""
    blocks = max(1, -(-providers.count() // block))
    dealt = providers.withColumn("_block", F.pmod(F.xxhash64(*providers.columns), F.lit(blocks)))
    pairs = prompts.join(variations, "prompt_id").withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    return pairs.join(dealt, "_block").drop("_block")


def run_detail(runs: DataFrame, results: DataFrame, scores: DataFrame) -> DataFrame:
    """Results and scores per run, each put in parts before the join, so there is no fan-out."""
    return beside_parts(runs, ["id"], result_parts(results), score_parts(scores))
