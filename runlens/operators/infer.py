"""Model-based enrichment: one batch-inference operator and rule-based defaults.

A default is a Column expression and never leaves the JVM; a user model is a callable on
pandas batches, run by ``mapInPandas`` wherever the rows are.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import messages as M
from ..functions.similarity import tokens
from ..session import cut_lineage
from .filters import Tables, filter_runs
from .skew import numbered, running_sum, with_neighbour

EVALUATORS: dict[str, Callable[[pd.DataFrame], list]] = {}


def register_evaluator(name: str):
    """Add a callable: pandas batch of runs → one result (or None) per row."""

    def put(fn):
        EVALUATORS[name] = fn
        return fn

    return put


class OnBatches(NamedTuple):
    """A model as a function: pandas batch of the named columns → one result per row."""

    fn: Callable[[pd.DataFrame], list]
    columns: list[str]


#: Further tries of a row that fails alone.
RETRIES = 2


def isolated(fn: Callable[[pd.DataFrame], list], part: pd.DataFrame, retries: int = RETRIES) -> list:
    """One result per row of the batch. A batch that fails is halved until the failing rows are alone; those are tried
    ``retries`` times more and then give ``{"error": message}``, so k bad rows of n cost about k log2(n) further calls."""
    failure: Exception | None = None
    for _ in range(1 + retries if len(part) == 1 else 1):
        try:
            found = list(fn(part))
            if len(found) != len(part):
                raise ValueError(f"{len(found)} results for {len(part)} rows")
            return found
        except Exception as e:
            failure = e
    if len(part) == 1:
        return [{"error": str(failure) or type(failure).__name__}]
    half = len(part) // 2
    return isolated(fn, part.iloc[:half], retries) + isolated(fn, part.iloc[half:], retries)


def infer_rows(df: DataFrame, keep: Sequence[str], model: OnBatches, batch: int = 100, retries: int = RETRIES) -> DataFrame:
    """The kept columns and ``result``: the model's answer for every row as JSON text, null where it has none,
    ``{"error": message}`` where it fails. Only the named columns travel to Python."""
    picked = list(dict.fromkeys([*keep, *model.columns]))

    def per_partition(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                results = [None if r is None else json.dumps(r, ensure_ascii=False) for r in isolated(model.fn, part, retries)]
                yield part[list(keep)].assign(result=pd.Series(results, index=part.index, dtype=object))

    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*picked).mapInPandas(per_partition, f"{schema}, result string")


def batch_infer(
    runs: DataFrame, evaluator_id: str, fn: Callable[[pd.DataFrame], list], columns: list[str], batch: int = 100, retries: int = RETRIES
) -> DataFrame:
    """(run_id, evaluator_id, result). None is not stored; a row that fails has an ``{"error": message}`` result."""
    found = infer_rows(runs, ["id"], OnBatches(fn, columns), batch, retries).where("result IS NOT NULL")
    return found.select(F.col("id").cast("string").alias("run_id"), F.lit(evaluator_id).alias("evaluator_id"), "result")


def as_results(runs: DataFrame, evaluator_id: str, result: Column, kind: str | None = None) -> DataFrame:
    """A Column default as result rows; null results are left out."""
    cols = [F.col("id").alias("run_id"), F.lit(evaluator_id).alias("evaluator_id")]
    if kind:
        cols.append(F.lit(kind).alias("type"))
    return runs.select(*cols, result.alias("result")).where("result is not null")


def sides(fn: Callable[[Column], Column]) -> Column:
    """{"input": […], "output": […], "error": […]}: one item per message."""
    each = lambda c: F.transform(M.texts(c), fn).alias(c)
    return F.to_json(F.struct(each("input"), each("output"), F.transform(F.array(F.lit(1)), lambda _: F.lit(None).cast("string")).alias("error")), {"ignoreNullFields": "false"})


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``."""
    return F.transform(F.array(value), body)[0]


def _count_of(text: Column, wanted: list[str]) -> Column:
    """Whole words of a lower-case text among ``wanted``: one regex scan, no word array."""
    return F.regexp_count(text, F.lit(r"(?<!\p{L})(?:" + "|".join(wanted) + r")(?!\p{L})"))


# fixed values: entity patterns
PII_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}",
    "phone": r"[+]?[0-9]{0,2}[ -]?[(]?[0-9]{3}[)]?[ -][0-9]{3}[ -][0-9]{4}",
    "ip": r"\b(?:[0-9]{1,3}[.]){3}[0-9]{1,3}\b",
    "card": r"\b(?:[0-9]{4}[ -]){3}[0-9]{4}\b",
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
}


def detect_pii(text: Column, types: list[str] | None = None, custom: dict[str, str] | None = None, excluded: list[str] | None = None) -> Column:
    """array<struct(type, entity)> over a text."""
    wanted = {k: v for k, v in PII_PATTERNS.items() if types is None or k in types}
    wanted.update(custom or {})

    def of_kind(kind: str, pattern: str) -> Column:
        hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        return F.transform(hits, lambda e: F.struct(F.lit(kind).alias("type"), e.alias("entity")))

    found = F.concat(*[of_kind(k, p) for k, p in wanted.items()])
    return F.filter(found, lambda e: ~e["entity"].isin(excluded)) if excluded else found


def tag_topics(text: Column, topics: list[str]) -> Column:
    """array<struct(topic, score)>: topics whose word occurs, with their share of the words."""
    low = F.lower(text)
    total = F.greatest(F.regexp_count(low, F.lit(r"\S+")), F.lit(1))
    count = lambda t: F.regexp_count(low, F.lit(r"(?<!\S)" + re.escape(t.lower()) + r"(?!\S)"))
    scored = F.array(*[F.struct(F.lit(t).alias("topic"), count(t).alias("n")) for t in topics])
    found = F.filter(scored, lambda s: s["n"] > 0)
    return let(total, lambda all_words: F.transform(found, lambda s: F.struct(s["topic"].alias("topic"), (s["n"] / all_words).alias("score"))))


# fixed values: small sentiment lexicon
POSITIVE = ["good", "great", "love", "excellent", "happy", "thanks", "nice", "best", "perfect", "super", "gut", "bueno", "bon"]
NEGATIVE = ["bad", "terrible", "hate", "awful", "angry", "worst", "wrong", "broken", "poor", "error", "schlecht", "malo", "mauvais"]


def score_sentiment(text: Column) -> Column:
    """struct(label, score): 0.5 when short or undecided, stars out of five otherwise."""
    low = F.lower(text)

    def rate(n: Column) -> Column:
        seen = n["up"] + n["down"]
        stars = F.ceil(F.lit(1) + 4 * n["up"] / seen).cast("double")
        score = F.when((F.length(text) < 10) | (seen == 0), F.lit(0.5)).otherwise(F.round(stars / 5, 2))
        return let(score, lambda x: F.struct(F.when(x >= 0.7, "positive").when(x <= 0.4, "negative").otherwise("neutral").alias("label"), x.alias("score")))

    return let(F.struct(_count_of(low, POSITIVE).alias("up"), _count_of(low, NEGATIVE).alias("down")), rate)


def user_sentiments(input_: Column) -> Column:
    """One item per input message; only user messages get one, others null."""
    return F.transform(
        M.parse(input_), lambda m, i: F.when(m["role"] == "user", F.struct(i.cast("int").alias("index"), score_sentiment(m["content"]).alias("s")))
    )


# Labels of a toxicity model, in the order of its scores.
TOXICITY_LABELS = ("toxicity", "severe_toxicity", "obscene", "identity_attack", "insult", "threat", "sexual_explicit")


class MultiLabelClassifier:
    """One linear model per label over hashed words, trained and applied by Spark ML; an absolute penalty keeps the few telling
    words. Labels may overlap."""

    def __init__(self, labels: Sequence[str] = TOXICITY_LABELS, features: int = 1 << 14):
        self.labels, self.features, self.models = list(labels), features, {}

    def _vectors(self, df: DataFrame, text: str) -> DataFrame:
        from pyspark.ml.feature import HashingTF

        words = df.withColumn("_words", F.coalesce(tokens(F.lower(F.col(text))), F.array().cast("array<string>")))
        return HashingTF(inputCol="_words", outputCol="_vec", numFeatures=self.features, binary=True).transform(words)

    def fit(self, df: DataFrame, text: str) -> MultiLabelClassifier:
        """Trained on the rows of ``df`` whose label column is not null, for each label; one with a single kind of rows always
        gives that kind's share."""
        from pyspark.ml.classification import LogisticRegression

        rows = cut_lineage(self._vectors(df, text).select("_vec", *self.labels))
        for label in self.labels:
            own = rows.where(F.col(label).isNotNull()).select("_vec", F.col(label).cast("double").alias("label"))
            n, share = own.agg(F.count(F.lit(1)), F.avg("label")).first()
            self.models[label] = LogisticRegression(featuresCol="_vec", labelCol="label", regParam=0.005, elasticNetParam=1.0, maxIter=60).fit(own) if n and 0 < share < 1 else float(share or 0)
        return self

    def transform(self, df: DataFrame, text: str, name: str = "scores") -> DataFrame:
        """``df`` with the probability of every label, as a struct."""
        from pyspark.ml.functions import vector_to_array

        out, kept = self._vectors(df, text), [F.col(c) for c in df.columns]
        for i, label in enumerate(self.labels):
            model = self.models[label]
            if isinstance(model, float):
                out = out.withColumn(f"_p{i}", F.lit(model))
            else:
                out = model.setProbabilityCol("_p").setRawPredictionCol("_r").setPredictionCol("_y").transform(out).withColumn(f"_p{i}", vector_to_array("_p")[1]).drop("_p", "_r", "_y")
        return out.select(*kept, F.struct(*[F.col(f"_p{i}").alias(label) for i, label in enumerate(self.labels)]).alias(name))


def toxicity_scores(runs: DataFrame, model: MultiLabelClassifier) -> DataFrame:
    """(run_id, side, index, role, scores): a row for every message of input and output, each scored by its own text."""
    said = lambda side: runs.select(F.col("id").alias("run_id"), F.lit(side).alias("side"), F.posexplode(M.texts(side)).alias("index", "text"))
    both = said("input").unionByName(said("output"))
    return model.transform(both, "text").drop("text")


def toxicity_rows(scores: DataFrame, labels: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """run_toxicity rows: whether a message of a side is toxic, and the labels some message of that side has. A side's
    labels are its messages' highest scores, combined before the shuffle."""
    highest = [F.max(F.when(F.col("side") == side, F.col(f"scores.{label}"))).alias(f"{side}_{label}") for side in ("input", "output") for label in labels]
    by_run = scores.groupBy("run_id").agg(*highest)
    named = lambda side: F.array_compact(F.array(*[F.when(F.col(f"{side}_{label}") >= threshold, F.lit(label)) for label in labels]))
    return by_run.select(
        "run_id", (F.size(named("input")) > 0).alias("toxic_input"), (F.size(named("output")) > 0).alias("toxic_output"), named("input").alias("input_labels"), named("output").alias("output_labels")
    )


def upsert(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace stored rows of the same key."""
    return stored.join(new.select(*keys), keys, "left_anti").unionByName(new)


TRANSCRIPT_CHARS = 12_000


def deduplicated(messages: DataFrame) -> DataFrame:
    """Thread messages without blank texts and without repeats of the message just before; the chunk
    column stays for the scans that follow."""
    clean = messages.withColumn("content", F.trim("content")).where("content != ''")
    seen = with_neighbour(clean, ["thread_id"], ["timestamp", "id"], {"_pr": F.col("role"), "_pc": F.col("content")}, keep=True)
    return seen.where(~(F.col("role").eqNullSafe(F.col("_pr")) & F.col("content").eqNullSafe(F.col("_pc")))).drop("_pr", "_pc")


def transcripts(messages: DataFrame, limit: int = TRANSCRIPT_CHARS) -> DataFrame:
    """(thread_id, transcript): numbered lines, the tail that fits ``limit`` characters, at least one line.

    Lengths are summed by chunked scans; only lines inside the limit are ever collected.
    """
    keys, order = ["thread_id"], ["timestamp", "id"]
    lines = numbered(deduplicated(messages), keys, order, "n", keep=True).withColumn(
        "line", F.concat(F.col("n").cast("string"), F.lit(". "), F.upper("role"), F.lit(": "), "content")
    )
    size = (F.length("line") + 2).cast("long")
    lines = running_sum(lines.select("_k", "thread_id", "timestamp", "id", "n", "line"), keys, order, {"upto": size})
    totals = lines.groupBy("thread_id").agg(F.max("upto").alias("total"), F.max("n").alias("last"))
    tail = lines.join(totals, "thread_id").withColumn("from_end", F.col("total") - F.col("upto") + size)
    kept = tail.where((F.col("total") - 2 <= limit) | (F.col("from_end") <= limit) | (F.col("n") == F.col("last")))
    return kept.groupBy("thread_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n\n").alias("transcript"))


def humanize_label(label: Column) -> Column:
    """Underscores and hyphens become spaces, words get a capital; a label already written in words keeps its case."""
    t = F.trim(label)
    spaced = F.trim(F.regexp_replace(F.regexp_replace(t, "[_-]+", " "), r"\s+", " "))
    worded = ~t.rlike("[_-]") & t.rlike(r"\s")
    return F.when(spaced == "", t).when(worded, spaced).otherwise(F.initcap(spaced))


def normalize_intents(intents: Column) -> Column:
    """Humanised labels, confidence within [0, 1], empty labels dropped."""
    fixed = F.transform(
        intents, lambda i: F.struct(humanize_label(i["label"]).alias("label"), F.least(F.greatest(i["confidence"], F.lit(0.0)), F.lit(1.0)).alias("confidence"))
    )
    return F.filter(fixed, lambda i: i["label"] != "")


def system_led(runs: DataFrame) -> DataFrame:
    """Runs whose first input message is a system message: the ones guideline judges look at."""
    return runs.where(F.get(M.parse("input"), F.lit(0))["role"] == "system")


def answered(runs: DataFrame) -> DataFrame:
    """Runs with both a question and an answer, for reply, tone, assertion and fact judges."""
    return runs.where(F.col("input").isNotNull() & (F.length(F.trim(F.coalesce(M.last_text("output"), F.lit("")))) > 0))


# fixed values: the judge evaluators and who they look at
JUDGES = {
    "llm": answered, "guidelines": system_led, "replies": answered, "assertion": answered, "tone": answered, "factualness": answered, "similarity-ai": answered,
}


def judge(runs: DataFrame, kind: str, fn: Callable[[pd.DataFrame], list], evaluator_id: str | None = None) -> DataFrame:
    """Verdicts {result, reason} of a user-supplied model on the eligible runs."""
    return batch_infer(JUDGES[kind](runs), evaluator_id or kind, fn, ["input", "output"])


def backlog(runs: DataFrame, results: DataFrame, evaluator_id: str, kind: str, logic: list | None = None, tables: Tables | None = None) -> DataFrame:
    """Runs an evaluator has still to score: its filter (default llm; intent looks at threads), minus those scored."""
    base = ["AND", {"id": "type", "params": {"type": "thread" if kind == "intent" else "llm"}}]
    rest = [n for n in (logic or ["AND"])[1:] if not (isinstance(n, dict) and n["id"] == "type" and kind == "intent")]
    has_type = any(isinstance(n, dict) and n["id"] == "type" for n in rest)
    tree = ["AND", *([] if has_type else base[1:]), *rest]
    todo = filter_runs(runs, tree, tables)
    if "is_deleted" in runs.columns:
        todo = todo.where(~F.coalesce(F.col("is_deleted"), F.lit(False)))
    done = results.where(F.col("evaluator_id") == evaluator_id).select(F.col("run_id").alias("id"))
    left = todo.join(done, "id", "left_anti")
    if kind == "toxicity" and tables is not None and tables.toxicity is not None:
        left = left.join(tables.toxicity.select(F.col("run_id").alias("id")), "id", "left_anti")
    return left


#: Runs of one evaluator in one round.
ROUND = 100


def next_round(runs: DataFrame, results: DataFrame, evaluators: Sequence[dict], tables: Tables | None = None, size: int = ROUND) -> DataFrame:
    """Runs with ``evaluator_id``: of every evaluator (id, type, filters) the newest ``size`` of its backlog, ties by id. Each is
    a bounded top list, so no backlog is sorted whole."""
    rounds = None
    for e in evaluators:
        newest = backlog(runs, results, e["id"], e["type"], e.get("filters"), tables).orderBy(F.desc("created_at"), "id").limit(size).withColumn("evaluator_id", F.lit(e["id"]))
        rounds = newest if rounds is None else rounds.unionByName(newest)
    return rounds if rounds is not None else runs.where("false").withColumn("evaluator_id", F.lit(None).cast("string"))
