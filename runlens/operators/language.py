"""Language detection by a character n-gram model, trained on labelled texts.

Multinomial naive Bayes over the trigrams of lower-case letters, with single spaces for everything else. Neighbouring
trigrams share two letters, so the evidence of a text is divided by the gram's length before it is turned into a
probability; that keeps the confidence near the share of right answers (a test holds it there).

Training counts in Spark and brings ``features`` trigrams and their counts to the driver; detection is a pass of Arrow
batches without any shuffle, with the trigram table as a broadcast of that size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters of a gram; shorter texts and less certain answers have no language.
GRAM, MIN_CHARS, MIN_CONFIDENCE = 3, 30, 0.5
#: Grams the model keeps; labelled texts and their first code points that it is trained on.
FEATURES, SAMPLE, CHARS = 5_000, 20_000, 2_000


def letters_only(text: Column) -> Column:
    """Lower-case letters between single spaces, with one on either side."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}]+", " ")), F.lit(" "))


class LanguageModel:
    """``weights``: log probability of each gram (rows, in code order) in each language; ``prior``: of each language."""

    def __init__(self, languages: list[str], grams: list[str], weights: np.ndarray, prior: np.ndarray):
        self.languages, self.prior = languages, prior
        codes = np.array([_gram_code([ord(c) for c in g]) for g in grams], np.uint64)
        order = np.argsort(codes)
        self.codes, self.weights = codes[order], weights[order] if len(grams) else np.zeros((0, len(languages)))

    @classmethod
    def fit(cls, labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "id", features: int = FEATURES, sample: int = SAMPLE, chars: int = CHARS) -> LanguageModel:
        """Trained on at most ``sample`` texts, those with the least md5 of their key, and on their first ``chars`` code points.
        Texts or languages that are null are left out; without any, every answer is null."""
        known = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
        known = known.select(F.col(lang).alias("lang"), F.substring(text, 1, chars).alias("text"), F.md5(F.col(key).cast("string")).alias("_m")).orderBy("_m", "text").limit(sample)
        said = letters_only(F.col("text"))
        grams = known.select("lang", said.alias("said")).where(F.char_length("said") >= GRAM)
        grams = grams.select("lang", F.explode(F.transform(F.sequence(F.lit(1), F.char_length("said") - GRAM + 1), lambda i: F.substr(F.col("said"), i, F.lit(GRAM)))).alias("gram"))
        counts = grams.groupBy("gram", "lang").agg(F.count(F.lit(1)).alias("n"))
        kept = counts.groupBy("gram").agg(F.sum("n").alias("all"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by")).orderBy(F.desc("all"), "gram").limit(features).collect()
        texts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per language
        languages = sorted(texts)
        n = np.array([[r["by"].get(x, 0) for x in languages] for r in kept], float).reshape(len(kept), len(languages))
        weights = np.log((n + 0.5) / (n.sum(axis=0) + 0.5 * len(kept))) if len(kept) else n
        prior = np.log(np.array([texts[x] for x in languages], float) / max(sum(texts.values()), 1))
        return cls(languages, [r["gram"] for r in kept], weights, prior)

    def scores(self, said: list[str]) -> np.ndarray:
        """Log probability of each language for texts that ``letters_only`` made; a row per text."""
        out = np.tile(self.prior, (len(said), 1))
        if not said or not len(self.codes) or not any(said):
            return out
        sizes = np.array([len(s) for s in said])
        points = np.frombuffer("".join(said).encode("utf-32-le"), np.uint32)
        n = len(points) - GRAM + 1
        if n <= 0:
            return out
        code = _gram_code([points[i : i + n] for i in range(GRAM)])
        row = np.repeat(np.arange(len(said)), sizes)
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        hit = (self.codes[at] == code) & (row[:n] == row[GRAM - 1 :])
        for i in range(len(self.languages)):
            out[:, i] += np.bincount(row[:n][hit], weights=self.weights[at[hit], i], minlength=len(said)) / GRAM
        return out

    def detect(self, texts: Column) -> Column:
        """array<struct(isoCode, confidence)>, an item per text of an array: null for short texts and unsure answers."""
        model = self

        @F.arrow_udf("array<struct<isoCode: string, confidence: double>>")
        def judged(column: pa.Array) -> pa.Array:
            off = column.offsets.to_numpy()
            flat = column.values.slice(off[0], off[-1] - off[0]).to_pylist()
            best, sure = np.zeros(len(flat), int), np.zeros(len(flat))
            for first in range(0, len(flat), 500):
                part = flat[first : first + 500]
                if model.languages:
                    s = model.scores([t or "" for t in part])
                    best[first : first + 500] = s.argmax(axis=1)
                    sure[first : first + 500] = 1 / np.exp(s - s.max(axis=1, keepdims=True)).sum(axis=1)
            found = np.array([t is not None for t in flat], bool) & (sure >= MIN_CONFIDENCE)
            iso = pa.array([model.languages[i] if f else None for i, f in zip(best, found, strict=True)], pa.string())
            items = pa.StructArray.from_arrays([iso, pa.array(sure)], ["isoCode", "confidence"], mask=pa.array(~found))
            return pa.ListArray.from_arrays(pa.array((off - off[0]).astype(np.int32)), items, mask=column.is_null() if column.null_count else None)

        return judged(F.transform(texts, lambda t: F.when(F.char_length(t) >= MIN_CHARS, letters_only(t))))


def _gram_code(points) -> np.ndarray:
    """The code points of a gram, 21 bits each: no two grams share a code."""
    code = np.asarray(points[0], np.uint64)
    for p in points[1:]:
        code = code * np.uint64(1 << 21) + np.asarray(p, np.uint64)
    return code


def language_results(runs: DataFrame, model: LanguageModel, evaluator_id: str) -> DataFrame:
    """Evaluation results (run_id, evaluator_id, type, result): an item per message of input and output, errors always null."""
    from ..functions.messages import texts

    sides = F.struct(model.detect(texts("input")).alias("input"), model.detect(texts("output")).alias("output"), F.array(F.lit(None).cast("string")).alias("error"))
    return runs.select(F.col("id").alias("run_id"), F.lit(evaluator_id).alias("evaluator_id"), F.lit("language").alias("type"), F.to_json(sides, {"ignoreNullFields": "false"}).alias("result"))
