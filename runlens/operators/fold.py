"""Events → runs, users, feedback and scores in one pass of partial aggregates.

Every fold is an order-based aggregate (min_by / max_by over the sequence key), so the
input order of events does not matter, partial results combine before the shuffle, and a
run with very many events costs no more memory than one with two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import json as J
from ..sources.events import sequence_key
from .skew import ordered_lists
from .trees import fold_up

FOLDED = ("start", "end", "error", "update", "feedback")


def _first(value: Column, when: Column, seq: Column) -> Column:
    return F.min_by(value, F.when(when, seq))


def _last(value: Column, when: Column, seq: Column) -> Column:
    return F.max_by(value, F.when(when, seq))


def feedback_values(events: DataFrame, stored: DataFrame | None = None, arrival: Column | None = None) -> DataFrame:
    """Long form (run_id, k, v): the latest value of every feedback key of a run, v as JSON text."""
    rows = events.where("event = 'feedback'").select(
        "run_id", sequence_key("ts", arrival).alias("seq"), F.explode(J.as_variant_map(J.merge(F.col("feedback"), F.col("extra")))).alias("k", "v")
    ).select("run_id", "seq", "k", F.to_json("v").alias("v"))
    if stored is not None:
        old = stored.where("feedback is not null").select(
            F.col("id").alias("run_id"), F.lit(None).cast(rows.schema["seq"].dataType).alias("seq"), F.explode(J.as_variant_map("feedback")).alias("k", "v")
        ).select("run_id", "seq", "k", F.to_json("v").alias("v"))
        rows = rows.unionByName(old)
    return rows.groupBy("run_id", "k").agg(F.max(F.struct("seq", "v")).alias("m")).select("run_id", "k", "m.v")


def fold_feedback(events: DataFrame, stored: DataFrame | None = None, arrival: Column | None = None) -> DataFrame:
    """(run_id, feedback): shallow merge in time order, later keys win.

    Only the distinct keys of a run meet, never its events; ``feedback_values`` has them as rows.
    """
    quoted = F.to_json(F.array("k"))
    item = F.concat(F.substring(quoted, F.lit(2), F.length(quoted) - 2), F.lit(":"), F.coalesce("v", F.lit("null")))
    lists = ordered_lists(feedback_values(events, stored, arrival), ["run_id"], item, F.col("k"), "items")
    return lists.select("run_id", F.concat(F.lit("{"), F.array_join("items", ","), F.lit("}")).alias("feedback"))


def fold_runs(events: DataFrame, arrival: Column | None = None) -> DataFrame:
    """One row per started run. A second start is ignored, an end without a start is dropped."""
    seq = sequence_key("ts", arrival)
    ev = F.col("event")
    begin = F.struct(
        "project_id", "type", "name", "parent_run_id", "user_id", "input", "params", "metadata", "tags", "template_version_id", "runtime",
        F.col("ts").alias("created_at"),
    )
    finish = F.struct(ev.alias("event"), F.col("ts").alias("ended_at"), "output", "error", "metadata", "tokens_usage", "name")
    ended = ev.isin("end", "error")
    agg = events.where(ev.isin("start", "end", "error", "update")).groupBy("run_id").agg(
        _first(begin, ev == "start", seq).alias("s"),
        _last(finish, ended, seq).alias("e"),
        F.max(F.when(ended, seq)).alias("e_seq"),
        _last(F.col("output"), ended & F.col("output").isNotNull(), seq).alias("output"),
        _last(F.col("error"), (ev == "error"), seq).alias("error"),
        _last(F.col("input"), ended & F.col("input").isNotNull(), seq).alias("late_input"),
        _last(F.col("metadata"), (ev == "end") & F.col("metadata").isNotNull(), seq).alias("end_meta"),
        _last(F.col("metadata"), (ev == "update"), seq).alias("new_meta"),
        F.max(F.when(ev == "update", seq)).alias("u_seq"),
    )
    replaced = F.coalesce(F.col("new_meta"), F.col("s.metadata"))
    after_end = F.col("u_seq").isNotNull() & (F.col("e_seq").isNull() | (F.col("u_seq") > F.col("e_seq")))
    return agg.where("s is not null").select(
        F.col("run_id").alias("id"), "s.project_id", "s.type", "s.name",
        F.when(F.col("e").isNull(), "started").when(F.col("e.event") == "error", "error").otherwise("success").alias("status"),
        "s.created_at", "e.ended_at", "s.parent_run_id", "s.user_id",
        F.coalesce("late_input", "s.input").alias("input"), "output", "error", "s.params",
        F.when(after_end, F.col("new_meta")).when(F.col("end_meta").isNull(), replaced).otherwise(J.merge(replaced, F.col("end_meta"))).alias("metadata"),
        "s.tags", F.col("e.tokens_usage.prompt").alias("prompt_tokens"), F.col("e.tokens_usage.completion").alias("completion_tokens"),
        F.col("e.tokens_usage.prompt_cached").alias("cached_prompt_tokens"), "s.template_version_id", "s.runtime",
    )


def with_feedback(runs: DataFrame, feedback: DataFrame) -> DataFrame:
    return runs.join(feedback.withColumnRenamed("run_id", "id"), "id", "left")


def without_missing_parents(runs: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """A parent that is not known becomes null. Known ids are unique, so the join adds no rows."""
    known = runs.select(F.col("id").alias("_p"))
    if stored is not None:
        known = known.unionByName(stored.select(F.col("id").alias("_p"))).distinct()
    return runs.join(known, F.col("parent_run_id") == F.col("_p"), "left").withColumn("parent_run_id", F.col("_p")).drop("_p")


def duplicate_starts(events: DataFrame) -> DataFrame:
    """(run_id, extra): how many starts of a run are rejected."""
    return events.where("event = 'start'").groupBy("run_id").agg((F.count(F.lit(1)) - 1).alias("extra")).where("extra > 0")


def fold_users(events: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Users seen on events other than end and error, merged with the stored ones by one aggregate."""
    seen = events.where("event not in ('end', 'error') and user_id is not null").select(
        "project_id", F.col("user_id").alias("external_id"), F.col("ts").alias("created_at"), F.col("ts").alias("last_seen"), F.col("user_props").alias("props")
    )
    if stored is not None:
        seen = seen.unionByName(stored.select("project_id", "external_id", "created_at", "last_seen", "props"))
    out = seen.groupBy("project_id", "external_id").agg(
        F.min("created_at").alias("created_at"), F.max("last_seen").alias("last_seen"),
        F.max_by("props", F.when(F.col("props").isNotNull(), F.col("last_seen"))).alias("props"),
    )
    return out.select(F.xxhash64("project_id", "external_id").alias("id"), "*")


def cascade_users(runs: DataFrame) -> DataFrame:
    """A run takes its parent's user when the parent has one, all the way down from the root."""
    top = fold_up(runs.select("id", "parent_run_id", "user_id"), F.col("user_id"), "_user", far=True)
    return runs.drop("user_id").join(top, "id", "left").withColumnRenamed("_user", "user_id")


def update_metadata(events: DataFrame) -> DataFrame:
    """(run_id, metadata): the last llm update."""
    return events.where("event = 'update' and type = 'llm'").groupBy("run_id").agg(F.max_by("metadata", sequence_key("ts")).alias("metadata"))


def fold_scores(scores: DataFrame) -> DataFrame:
    """One row per (run_id, label), last value wins."""
    return scores.groupBy("run_id", "label").agg(F.max_by(F.struct("value", "comment"), "ts").alias("v")).select("run_id", "label", "v.value", "v.comment")


def custom_event_runs(events: DataFrame) -> DataFrame:
    """Custom events as runs that begin and end at once, below their thread."""
    rows = events.where("(event = 'custom-event' or type = 'custom-event') and parent_run_id is not null")
    return rows.select(
        F.col("run_id").alias("id"), "project_id", F.lit("custom-event").alias("type"), "name", F.lit("success").alias("status"),
        F.col("ts").alias("created_at"), F.col("ts").alias("ended_at"), "parent_run_id", "user_id", "metadata",
    )


def log_rows(events: DataFrame) -> DataFrame:
    return events.where("type = 'log'").select("run_id", "level", "message", "extra", "ts")
