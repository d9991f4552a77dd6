"""Exports: CSV, JSONL, fine-tuning JSONL and the evaluation matrix; written by the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.messages import valid_messages
from ..operators.datasets import results_matrix
from ..operators.skew import PART_ITEMS
from ..operators.trees import trace_lines

# fixed values: columns a thread export leaves out
THREAD_DROPS = ("input", "feedback", "params", "sibling_run_id", "parent_feedback", "trace_id")


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, for CSV."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema.fields])


def run_lines(runs: DataFrame, kind: str = "llm", messages: DataFrame | None = None, fields: tuple[str, ...] | None = None) -> DataFrame:
    """One JSON text per run. A thread gets its messages. Of a trace, one JSON text with the named fields (all by default) of
    its runs, the children nested: a line of the format is one value, however long; ``trace_lines`` has its runs as rows."""
    d = runs
    if kind == "trace":
        chosen = fields or tuple(c for c in runs.columns if c not in ("id", "parent_run_id"))
        return _joined(trace_lines(runs, chosen)).select("value")
    if kind == "thread":
        d = d.drop(*THREAD_DROPS)
        if messages is not None:
            d = d.join(messages, "id", "left")
    return d.select(F.to_json(F.struct(*d.columns)).alias("value"))


def _joined(lines: DataFrame) -> DataFrame:
    """(root_id, value): the lines of every trace as one text, joined first in parts of a bounded number of lines."""
    text = lambda at, piece: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at, piece))), lambda x: x[piece]), "")
    parts = lines.groupBy("root_id", F.floor(F.col("place") / PART_ITEMS).alias("part")).agg(text("place", "line").alias("piece"))
    return parts.groupBy("root_id").agg(text("part", "piece").alias("value"))


def _clean(m: Column) -> Column:
    """Message with snake_case keys, empty tool calls left out, null content as empty text."""
    calls = F.coalesce(m["tool_calls"], m["toolCalls"])
    return F.struct(
        m["role"].alias("role"), F.coalesce(m["content"], F.lit("")).alias("content"),
        F.when(~calls.isin("[]", ""), calls).alias("tool_calls"), F.coalesce(m["function_call"], m["functionCall"]).alias("function_call"),
    )


def training_lines(runs: DataFrame) -> DataFrame:
    """``{messages: input ++ output}`` for runs whose input and output are valid chat messages."""
    both = runs.select("id", valid_messages("input").alias("i"), valid_messages("output").alias("o")).where("i is not null and o is not null")
    return both.select("id", F.to_json(F.struct(F.transform(F.concat("i", "o"), _clean).alias("messages"))).alias("value"))


def export_runs(runs: DataFrame, path: str, kind: str = "csv", run_type: str = "llm", **related) -> None:
    """kind: csv, jsonl or ojsonl. One file per task; no row passes the driver."""
    if kind == "csv":
        flat(runs).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    elif kind == "jsonl":
        run_lines(runs, run_type, **related).write.mode("overwrite").text(path)
    elif kind == "ojsonl":
        training_lines(runs).select("value").write.mode("overwrite").text(path)
    else:
        raise ValueError(f"unknown export kind {kind}")


def evaluation_matrix(results: DataFrame, providers: list[str] | None = None, most: int = 1_000) -> DataFrame:
    """One row per variation, one pass-count column per provider: those named, or all of them in order. A table has a column
    for each, so more than ``most`` are refused; ``results_matrix`` has them as rows."""
    m = results_matrix(results)
    if providers is None:
        providers = [r[0] for r in m.select("provider").distinct().orderBy("provider").limit(most + 1).collect()]
        if len(providers) > most:
            raise ValueError(f"more than {most} providers: use results_matrix, which has a row for each")
    return m.groupBy("variation_id").pivot("provider", providers).agg(F.first("passed")).na.fill(0)
