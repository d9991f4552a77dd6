"""Datasets: items, immutable versions, resolving, sweeps, outcomes and summaries."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.messages import valid_messages
from ..functions.templates import render
from .infer import RETRIES, OnBatches, infer_rows
from .ordering import item_numbers
from .topk import item_counts

ITEM_COLUMNS = ("input", "ground_truth", "output")


def new_id(*parts: Column) -> Column:
    """Deterministic id, so a recomputed task writes the same row."""
    return F.regexp_replace(F.sha2(F.concat_ws("|", *parts), 256), "^(.{8})(.{4})(.{4})(.{4})(.{12}).*$", "$1-$2-$3-$4-$5")


def next_versions(datasets: DataFrame, versions: DataFrame) -> DataFrame:
    """(dataset_id, version_number): one more than the latest, 1 for a new dataset."""
    last = versions.groupBy("dataset_id").agg(F.max("version_number").alias("_last"))
    return datasets.select("dataset_id").join(last, "dataset_id", "left").select("dataset_id", (F.coalesce("_last", F.lit(0)) + 1).alias("version_number"))


def snapshot(items: DataFrame, versions: DataFrame) -> DataFrame:
    """Rows of the next version of every dataset in ``items``: numbered copies with their source id.

    Append them partitioned by (dataset_id, version_number); nothing already written changes.
    """
    target = next_versions(items.select("dataset_id").distinct(), versions)
    numbered = item_numbers(items)
    out = numbered.join(target, "dataset_id")
    return out.select(
        new_id(F.col("dataset_id"), F.col("version_number").cast("string"), F.col("id")).alias("id"), "dataset_id", "version_number", "item_index",
        F.col("id").alias("source_item_id"), *[c for c in ITEM_COLUMNS if c in items.columns],
    )


def restore(version_items: DataFrame, version_number: int) -> DataFrame:
    """Items of a version in index order, as the new live items. created_at keeps their order."""
    rows = version_items.where(F.col("version_number") == version_number)
    at = F.timestamp_seconds(F.col("item_index"))
    return rows.select(
        F.col("source_item_id").alias("id"), "dataset_id", at.alias("created_at"), F.lit(version_number).alias("restored_from"), *[c for c in ITEM_COLUMNS if c in rows.columns]
    )


def copy_name(name: Column, taken_numbers: Column) -> Column:
    return F.when(taken_numbers.isNull(), F.concat(name, F.lit(" copy"))).otherwise(F.concat(name, F.lit(" copy ("), (taken_numbers + 1).cast("string"), F.lit(")")))


def duplicate(datasets: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new datasets, new items): every dataset copied under the next free "X copy (n)" name."""
    pattern = r"^(.*) copy(?: \(([0-9]+)\))?$"
    taken = datasets.select(F.regexp_extract("name", pattern, 1).alias("name"), F.coalesce(F.nullif(F.regexp_extract("name", pattern, 2), F.lit("")).cast("int"), F.lit(1)).alias("n"))
    used = taken.where("name != ''").groupBy("name").agg(F.max("n").alias("_n"))
    copies = datasets.join(used, "name", "left").select(
        new_id(F.col("dataset_id"), F.lit("copy")).alias("dataset_id"), copy_name(F.col("name"), F.col("_n")).alias("name"), F.col("dataset_id").alias("source_dataset_id")
    )
    moved = items.withColumnRenamed("dataset_id", "source_dataset_id").join(copies.select("dataset_id", "source_dataset_id"), "source_dataset_id")
    return copies, moved.withColumn("id", new_id(F.col("id"), F.lit("copy"))).drop("source_dataset_id")


def from_runs(runs: DataFrame) -> DataFrame:
    """(run_id, messages): the chat messages of chosen runs as prompts; runs without any are dropped."""
    return runs.select(F.col("id").alias("run_id"), valid_messages("input").alias("messages")).where("messages is not null")


def resolve(prompts: DataFrame, variations: DataFrame) -> DataFrame:
    """prompt × its variations, rendered: (prompt_id, variation_id, input, ideal_output)."""
    return prompts.join(variations, "prompt_id").select(
        "prompt_id", "variation_id", render(F.col("template"), F.col("variables")).alias("input"), "ideal_output"
    )


def _value(items: DataFrame, make: Callable[[DataFrame], Column]) -> Column:
    """The evaluator's value as JSON, or its error where Spark can't resolve it."""
    try:
        value = F.to_json(F.struct(make(items).alias("value")))
        items.select(value)  # resolved here, so one evaluator's mistake is its own
        return value
    except Exception as e:
        return F.lit(json.dumps({"error": str(e).splitlines()[0]}))


def sweep(items: DataFrame, slots: dict[int, tuple[str, Callable[[DataFrame], Column] | OnBatches]], batch: int = 100) -> DataFrame:
    """(item_id, slot, evaluator_id, result): every item under every attached evaluator.

    Evaluators that are Columns share one scan; they must not raise on a row (the ``try_`` functions give null). Those that
    run on batches have a scan each, and a row that fails after its retries has an ``{"error": message}`` result, as has every
    row of an evaluator that can't be resolved; no failure reaches the other results.
    """
    columns = {k: v for k, v in slots.items() if not isinstance(v[1], OnBatches)}
    built = [F.struct(F.lit(slot).alias("slot"), F.lit(evaluator).alias("evaluator_id"), _value(items, make).alias("result")) for slot, (evaluator, make) in columns.items()]
    parts = [items.select(F.col("id").alias("item_id"), "dataset_id", F.explode(F.array(*built)).alias("r")).select("item_id", "dataset_id", "r.*")] if built else []
    for slot, (evaluator, model) in slots.items():
        if slot not in columns:
            own = OnBatches(lambda part, fn=model.fn: [None if r is None else {"value": r} for r in fn(part)], model.columns)
            found = infer_rows(items, ["id", "dataset_id"], own, batch).withColumnRenamed("id", "item_id")
            parts.append(found.select("item_id", "dataset_id", F.lit(slot).alias("slot"), F.lit(evaluator).alias("evaluator_id"), "result"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def labeler_outcome(label: Column, pass_labels: list[str]) -> Column:
    return F.when(label.isNull(), "unknown").when(label.isin(pass_labels), "pass").otherwise("fail")


def scorer_outcome(score: Column, threshold: float | None) -> Column:
    if threshold is None:
        return F.lit("unknown")
    return F.when(score.isNull(), "unknown").when(score >= threshold, "pass").otherwise("fail")


def outcome(kind: Column, label: Column, score: Column, pass_labels: list[str], threshold: float) -> Column:
    return F.when(kind == "model-labeler", labeler_outcome(label, pass_labels)).when(kind == "model-scorer", scorer_outcome(score, threshold)).otherwise("unknown")


def _counts() -> list[Column]:
    is_ = lambda what: F.sum(F.when(F.col("outcome") == what, 1).otherwise(0).cast("long"))
    return [is_("pass").alias("passed"), is_("fail").alias("failed"), is_("unknown").alias("unknown"), F.count("outcome").alias("evaluated")]


def _percent(part: Column, whole: Column) -> Column:
    return F.coalesce(F.round(F.try_divide(part * 100.0, whole), 2), F.lit(0.0))


def run_summary(outcomes: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    """Counts, pass rate and coverage (%, two decimals) per slot. ``totals`` has items per key."""
    out = outcomes.groupBy(*keys).agg(*_counts()).join(totals, [k for k in keys if k in totals.columns], "left")
    decided = F.col("passed") + F.col("failed")
    return out.withColumn("pass_rate", _percent(F.col("passed"), decided)).withColumn("coverage", _percent(F.col("evaluated"), F.col("items")))


def summary_across(summaries: DataFrame) -> DataFrame:
    """Sums over runs by evaluator, or by slot where the evaluator is gone."""
    key = F.coalesce("evaluator_id", F.concat(F.lit("slot-"), F.col("slot").cast("string"))).alias("evaluator")
    sums = [F.sum(c).alias(c) for c in ("passed", "failed", "unknown", "evaluated")]
    out = summaries.groupBy(key).agg(*sums, F.count(F.lit(1)).alias("runs"))
    return out.withColumn("pass_rate", _percent(F.col("passed"), F.col("passed") + F.col("failed")))


def answered(grid: DataFrame, model: OnBatches, batch: int = 100, retries: int = RETRIES) -> DataFrame:
    """The grid with output, duration_s, cost and error. ``model`` gives a dict of the first three for every cell; a cell that
    still fails after its retries has the error alone."""
    said = F.from_json("result", "output string, duration_s double, cost double, error string")
    return infer_rows(grid, grid.columns, model, batch, retries).select(*grid.columns, said.alias("a")).select(*grid.columns, "a.*")


def run_grid(grid: DataFrame, answer: Callable[[DataFrame], DataFrame], checks, check_runner) -> DataFrame:
    """Answers for every cell of the grid, then the checklist: with ``status``; a cell with an ``error`` is not checked, its
    ``passed`` is null."""
    cells = answer(grid)
    if "error" not in cells.columns:
        return check_runner(cells, checks).withColumn("status", F.lit("success"))
    failed = F.col("error").isNotNull()
    done = check_runner(cells, checks)
    return done.withColumn("passed", F.when(~failed, F.col("passed"))).withColumn("status", F.when(failed, "error").otherwise("success"))


def results_matrix(results: DataFrame) -> DataFrame:
    """Passed, failed, mean duration and mean cost per variation and provider."""
    yes = lambda v: F.sum(F.when(F.col("passed") == v, 1).otherwise(0).cast("long"))
    return results.groupBy("variation_id", "provider").agg(
        yes(True).alias("passed"), yes(False).alias("failed"), F.avg("duration_s").alias("mean_duration"), F.avg("cost").alias("mean_cost")
    )


# fixed values: orders of the dataset list
LIST_ORDERS = {
    "newest": ("created_at", False), "oldest": ("created_at", True), "alphabetical": ("name", True), "items": ("items", False), "updated": ("updated_at", False),
}


def dataset_list(datasets: DataFrame, items: DataFrame, search: str | None = None, sort: str = "newest", page: int = 0, size: int = 50) -> DataFrame:
    found = datasets.where(F.col("name").ilike(f"%{search}%")) if search else datasets
    col, up = LIST_ORDERS[sort]
    out = item_counts(found, items, "dataset_id")
    return out.orderBy(F.asc_nulls_last(col) if up else F.desc_nulls_last(col), "dataset_id").offset(page * size).limit(size)
