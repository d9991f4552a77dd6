"""Run formatting: messages with the enrichments that belong to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import json as J
from ..functions import messages as M

# fixed values: evaluator types whose results are arrays with one item per message
PER_MESSAGE = ("language", "pii", "topics", "sentiment", "intent")


def _result(kind: str) -> Column:
    """The result text of one evaluator type; a run has one result per evaluator."""
    return F.max(F.when(F.col("type") == kind, F.col("result"))).alias(f"_{kind}")


def _zip(messages: Column, field: str) -> Column:
    """Position by position: the i-th item of each result beside the i-th message."""
    items = {k: J.path_array(f"_{k}", field) for k in PER_MESSAGE}
    at = lambda arr, i: F.get(arr, i)
    return F.transform(
        messages,
        lambda m, i: F.struct(m["role"].alias("role"), m["content"].alias("content"), *[at(items[k], i).alias(k) for k in PER_MESSAGE]),
    )


def formatted(runs: DataFrame, results: DataFrame, toxicity: DataFrame | None = None, users: DataFrame | None = None) -> DataFrame:
    """Runs with input_messages and output_messages carrying language, pii, topics, sentiment and intent."""
    per_run = results.groupBy(F.col("run_id").alias("id")).agg(*[_result(k) for k in PER_MESSAGE])
    out = runs.join(per_run, "id", "left")
    for field in ("input", "output"):
        out = out.withColumn(f"{field}_messages", _zip(M.parse(field), field))
    out = out.drop(*[f"_{k}" for k in PER_MESSAGE])
    if {"prompt_tokens", "completion_tokens"} <= set(runs.columns):
        total = F.col("prompt_tokens") + F.col("completion_tokens")
        out = out.withColumn("tokens", F.struct(F.col("prompt_tokens").alias("prompt"), F.col("completion_tokens").alias("completion"), total.alias("total")))
    if toxicity is not None:
        flags = toxicity.select(F.col("run_id").alias("id"), F.struct("toxic_input", "toxic_output").alias("toxicity"))
        out = out.join(flags, "id", "left")
    if users is not None:
        who = users.select(F.col("id").alias("external_user_id"), F.struct("external_id", "last_seen", "props").alias("user"))
        out = out.join(who, "external_user_id", "left")
    return out
