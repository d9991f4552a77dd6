"""Similarity evaluators over a run or dataset table: score and pass flag per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import messages as M
from ..functions import similarity as S

# score of each method; the token methods share one overlap struct per row
TOKEN_METHODS = {"cosine": S.cosine_of, "bleu": S.bleu_of, "rouge": S.rouge_of, "gleu": S.gleu_of}
METHODS = (*TOKEN_METHODS, "fuzzy")


def with_reference(runs: DataFrame, references: DataFrame) -> DataFrame:
    """Pair every run with one of all ground-truth texts (ids from 0), by run number."""
    items = max(references.count(), 1)
    refs = references.select(F.col("item_id").alias("_item"), F.col("text").alias("ideal_output"))
    return runs.withColumn("_item", F.col("doc_id") % items).join(refs, "_item").drop("_item")


def with_overlap(df: DataFrame, ref: Column, hyp: Column) -> DataFrame:
    """Adds the overlap struct once, for any number of token scores."""
    return df.withColumn("overlap", S.overlap(ref, hyp))


def score_pair(df: DataFrame, ref: Column, hyp: Column, method: str = "cosine") -> DataFrame:
    if method not in METHODS:
        raise ValueError(f"unknown method {method}")
    if method == "fuzzy":
        return df.withColumn("score", S.fuzzy_ratio(ref, hyp))
    return with_overlap(df, ref, hyp).withColumn("score", TOKEN_METHODS[method](F.col("overlap"))).drop("overlap")


def evaluate(df: DataFrame, ref: Column, hyp: Column, method: str = "cosine", threshold: float | None = None) -> DataFrame:
    """Adds score and passed; threshold is clamped to [0, 1], default 0.5."""
    bound = min(max(0.5 if threshold is None else float(threshold), 0.0), 1.0)
    return score_pair(df, ref, hyp, method).withColumn("passed", F.col("score") >= bound)


def compare_text(text: Column, comparator: str, target: str) -> Column:
    return {
        "equals": lambda: text == target,
        "not_equals": lambda: text != target,
        "contains": lambda: text.contains(target),
        "contains_ignore_case": lambda: F.lower(text).contains(target.lower()),
    }.get(comparator, lambda: F.lit(False))()


def label(text: Column, labels: list[str]) -> Column:
    """struct(matches, primary_label, passed): labels found in the text, ignoring case."""
    wanted = F.array(*[F.lit(x.strip()) for x in labels if x.strip()]).cast("array<string>")
    low = F.lower(F.coalesce(text, F.lit("")))
    found = F.filter(wanted, lambda w: F.contains(low, F.lower(w)))
    return F.struct(found.alias("matches"), F.get(found, F.lit(0)).alias("primary_label"), (F.size(found) > 0).alias("passed"))


def word_score(text: Column, lowest: float = 0.0, highest: float = 10.0) -> Column:
    """struct(score, passed): grows with the number of words, passes from the middle up."""
    top = max(lowest, highest)
    score = F.lit(float(lowest)) + (top - lowest) * F.tanh(F.size(S.tokens(text)) / 100)
    return F.struct(score.alias("score"), (score >= lowest + (top - lowest) / 2).alias("passed"))


def message_text(col: str) -> Column:
    return M.content_text(col)
