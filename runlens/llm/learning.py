"""A bounded labelled sample and a small logistic fit, for the trained operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bytes of text that a labelled sample holds at most, all rows together.
SAMPLE_BYTES = 64_000_000


def held_out(doc_id: Column, modulus: int = 3) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == 1, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, target: str, bound: int, modulus: int | None, most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """Rows (id, text, y) of at most ``bound`` labelled ids, those with the least hash, one row each, of at most ``most_bytes``
    bytes together; with a modulus, none that is held out.

    Of rows that share an id the one with the least text hash is taken, so a repeated id is no larger than another. A repeated
    label counts as 1 only if all of its rows say so; null labels and ids are left out. Ties in the hash of ids: the lesser id.
    """
    known = labels.where(F.col(doc_id).isNotNull() & F.col(target).isNotNull())
    if modulus:
        known = known.where(~held_out(F.col(doc_id), modulus))
    chosen = known.groupBy(F.col(doc_id).alias("id")).agg(F.min(target).cast("int").alias("y")).orderBy(F.xxhash64("id"), "id").limit(bound)
    found = docs.select(F.col(doc_id).alias("own"), F.coalesce(F.col(text), F.lit("")).alias("text")).where(F.octet_length("text") <= most_bytes)
    found = found.join(F.broadcast(chosen), F.col("own") == F.col("id")).groupBy("id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    upto = F.sum(F.octet_length("text")).over(W.orderBy(F.xxhash64("id"), "id").rowsBetween(W.unboundedPreceding, 0))  # over at most `bound` rows
    return found.withColumn("upto", upto).where(F.col("upto") <= most_bytes).select("id", "text", "y")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 8) -> np.ndarray:
    """Weights (the last one is the intercept, not shrunk) by Newton's method with halved steps where needed."""
    x = np.hstack([x, np.ones((len(x), 1))])
    shrink = np.full(x.shape[1], ridge)
    shrink[-1] = 1e-6
    w = np.zeros(x.shape[1])

    def loss(v: np.ndarray) -> float:
        z = x @ v
        return float(np.logaddexp(0, z).sum() - y @ z + 0.5 * (shrink * v * v).sum())

    now = loss(w)
    for _ in range(steps):
        p = sigmoid(x @ w)
        grad = x.T @ (p - y) + shrink * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(shrink + 1e-9), grad)
        size = 1.0
        while size > 1e-3 and (new := loss(w - size * step)) > now:
            size /= 2
        if size <= 1e-3 or now - new < 1e-6 * max(1.0, now):
            break
        w, now = w - size * step, new
    return w
