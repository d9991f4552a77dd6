"""Toxicity by a classifier chain.

The categories come in a fixed order and the verdict last. Each is a logistic model over word features and the
probabilities of the categories before it; in training those probabilities are out-of-fold, so a later model never
sees an earlier one's opinion on its own training rows. A category's labels are the toxic documents that hold one of
its stems; the verdict's labels are the given ones.

Features say whether a document has a word, or a word that begins so (first 4, 5 and 6 bytes). The ``features`` most
telling ones are chosen by a score test over the sample, in Spark. Models are fitted on the driver on at most
``sample`` labelled documents; scoring reads every text whole.

Nulls: a null text is empty and scores by the intercepts. Without labels of both kinds all scores are the prior (0 without
labels). Repeated documents score alike; a repeated labelled id is one row of the sample. Ties among features are broken by code. Very
long texts are scored whole, in slices. Extra columns stay; one named like the result is refused. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import learning as L

# Stems of the categories before the verdict.
CATEGORIES = (
    ("insult", ("idiot", "moron", "stupid", "clown", "fool", "dumb")),
    ("contempt", ("loser", "pathetic", "worthless", "useless")),
    ("disgust", ("trash", "scum", "disgusting", "filth", "garbage")),
)
VERDICT = "toxic"
_PREFIXES = (4, 5, 6)


def codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature code) of every word and of its prefixes."""
    words = C.Words(data, offsets, C.LETTERS)
    rows, found = [words.row], [words.code]
    for k in _PREFIXES:
        long = np.flatnonzero(words.end - words.start > k)
        at = words.start[long]
        with np.errstate(over="ignore"):
            code = np.full(len(long), np.uint64(k), np.uint64)
            for j in range(k):
                code = code * C._BASE + C._BYTE_CODES[words.data[at + j]]
        rows.append(words.row[long])
        found.append(C.mix(code))
    return np.concatenate(rows), np.concatenate(found)


def present(data: np.ndarray, offsets: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Documents x chosen codes (ascending): 1 where the document has the feature."""
    row, code = codes(data, offsets)
    at = np.minimum(np.searchsorted(chosen, code), max(len(chosen) - 1, 0))
    x = np.zeros((len(offsets) - 1, len(chosen)))
    if len(chosen):
        hit = chosen[at] == code
        x[row[hit], at[hit]] = 1
    return x


class Chain:
    """Chosen features, one weight vector per category in order, the verdict last."""

    def __init__(self, chosen: np.ndarray, weights: list[np.ndarray], names: Sequence[str]):
        self.chosen, self.weights, self.names = chosen, weights, tuple(names)

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Documents x categories."""
        x = present(data, offsets, self.chosen)
        for w in self.weights:
            x = np.column_stack([x, L.sigmoid(x @ w[:-1] + w[-1])])
        return x[:, len(self.chosen) :]


def _fit_or_prior(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    if len(y) and y.min() < y.max():
        return L.logistic(x, y)
    w = np.zeros(x.shape[1] + 1)
    w[-1] = 40 if len(y) and y.min() == 1 else -40
    return w


def fit(x: np.ndarray, y: np.ndarray, fold: np.ndarray, folds: int = 3) -> list[np.ndarray]:
    """Models in order; column i of y is category i, the verdict last."""
    weights = []
    for i in range(y.shape[1]):
        weights.append(_fit_or_prior(x, y[:, i]))
        unseen = np.zeros(len(x))
        for f in range(folds):
            own = fold == f
            w = _fit_or_prior(x[~own], y[~own, i])
            unseen[own] = L.sigmoid(x[own] @ w[:-1] + w[-1])
        x = np.column_stack([x, unseen])
    return weights


def train(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", target: str = "toxic", sample: int = 12_000, features: int = 256, modulus: int | None = None
) -> Chain:
    """Fitted on at most ``sample`` labelled documents; with a modulus, on none with crc32(id) mod modulus = 1."""
    stems = [s for _, words in CATEGORIES for s in words]

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in C.slices(batch.column(1)):
                row, code = codes(data, offsets)
                order = np.lexsort((code, row))
                row, code = row[order], code[order]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (code[1:] != code[:-1])
                row, code = row[new], code[new]
                n = len(offsets) - 1
                lines = [data[offsets[i] : offsets[i + 1]] for i in range(n)]
                low = [C.LOWER[x].tobytes().decode("utf-8", "replace") for x in lines]
                marks = [[s in t for s in stems] for t in low]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, n), batch.column(2).slice(first, n), C.lists(C.signed(code), C.row_counts(row, n)), pa.array(marks, pa.list_(pa.bool_()))],
                    ["id", "y", "codes", "marks"],
                )

    found = C.cut(L.labelled(docs, labels, doc_id, text, target, sample, modulus).mapInArrow(seen, f"id {docs.schema[doc_id].dataType.simpleString()}, y int, codes array<long>, marks array<boolean>"))
    n, bad = found.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    share = (bad + 0.5) / (n + 1)
    tested = (
        found.select("y", F.explode("codes").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("bad")).where("n >= 3")
        .withColumn("z", F.abs(F.col("bad") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share)))
    )
    chosen = np.sort(np.array([r[0] for r in tested.orderBy(F.desc("z"), "code").limit(features).collect()], np.int64).view(np.uint64))
    wanted = F.array(*[F.lit(c) for c in C.signed(chosen).tolist()]).cast("array<long>")
    rows = found.select("id", "y", "marks", F.array_intersect("codes", wanted).alias("codes")).orderBy("id").collect()  # at most `sample` short rows
    x, y = np.zeros((len(rows), len(chosen))), np.zeros((len(rows), len(CATEGORIES) + 1))
    for i, r in enumerate(rows):
        x[i, np.searchsorted(chosen, np.array(r["codes"], np.int64).view(np.uint64))] = 1
        y[i, -1] = r["y"]
        at = 0
        for j, (_, words) in enumerate(CATEGORIES):
            y[i, j] = r["y"] and any(r["marks"][at : at + len(words)])
            at += len(words)
    fold = np.arange(len(rows)) % 3
    return Chain(chosen, fit(x, y, fold), [*[c for c, _ in CATEGORIES], VERDICT])


def toxicity(docs: DataFrame, chain: Chain, text: str = "text", out: str = "toxicity") -> DataFrame:
    """``docs`` with a struct of the probability of each category and the verdict."""
    if out.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"there is a column {out} already")

    @F.arrow_udf("struct<" + ", ".join(f"{c}: double" for c in chain.names) + ">")
    def judged(column: pa.Array) -> pa.Array:
        parts = [chain.score(d, o) for _, d, o in C.slices(column)]
        p = np.concatenate(parts) if parts else np.zeros((0, len(chain.names)))
        return pa.StructArray.from_arrays([pa.array(p[:, i]) for i in range(p.shape[1])], list(chain.names))

    return docs.withColumn(out, judged(F.col(text)))
