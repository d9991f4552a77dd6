"""Text and embedding similarity as Columns. Tokens: split on white space, case kept."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda t: t != "")


def _ratio(num: Column, den: Column) -> Column:
    return F.when(den == 0, F.lit(0.0)).otherwise(num / den)


OVERLAP = StructType(
    [StructField(n, LongType()) for n in ("hits", "ref_size", "hyp_size")]
    + [StructField(n, DoubleType()) for n in ("dot", "ref_sq", "hyp_sq")]
)


#: Tokens that are counted at a time, unless one pair has more.
SLICE_TOKENS = 1 << 18


@F.arrow_udf(OVERLAP)
def _overlap(ref: pa.Array, hyp: pa.Array) -> pa.Array:
    """Counts of a batch's pairs, in slices of a bounded number of tokens."""
    sides = [x.fill_null([]) if x.null_count else x for x in (ref, hyp)]
    upto = np.cumsum(sum(np.diff(x.offsets.to_numpy()).astype(np.int64) for x in sides))
    cuts = [0, *(np.flatnonzero(np.diff(upto // SLICE_TOKENS)) + 1).tolist(), len(ref)]
    return pa.concat_arrays([_counts([x.slice(a, b - a) for x in sides]) for a, b in zip(cuts, cuts[1:])])


def _counts(sides: list[pa.Array]) -> pa.Array:
    """Counts of the pairs of a slice at once: terms are numbered over the slice, and (pair, term) counts of both sides are met."""
    term = pa.concat_arrays([x.flatten().cast(pa.string()) for x in sides]).dictionary_encode().indices.to_numpy().astype(np.int64)
    n, terms = len(sides[0]), int(term.max(initial=0)) + 1
    keys, counts, sizes, squares, at = [], [], [], [], 0
    for x in sides:
        length = np.diff(x.offsets.to_numpy())
        row = np.repeat(np.arange(n), length)
        found, count = np.unique(row * terms + term[at : at + len(row)], return_counts=True)
        at += len(row)
        keys.append(found), counts.append(count), sizes.append(length.astype(np.int64))
        squares.append(np.bincount(found // terms, weights=count.astype(float) ** 2, minlength=n))
    shared, i, j = np.intersect1d(*keys, assume_unique=True, return_indices=True)
    row = shared // terms
    hits = np.bincount(row, weights=counts[1][j], minlength=n).astype(np.int64)
    dot = np.bincount(row, weights=(counts[0][i] * counts[1][j]).astype(float), minlength=n)
    return pa.StructArray.from_arrays([pa.array(c) for c in (hits, *sizes, dot, *squares)], [f.name for f in OVERLAP.fields])


def overlap(ref: Column, hyp: Column) -> Column:
    """struct of token counts of a text pair, linear in its length: hits (hypothesis tokens known to
    the reference, with repeats), sizes, and the dot product and squares of the term counts."""
    return _overlap(tokens(ref), tokens(hyp))


def bleu_of(o: Column) -> Column:
    return _ratio(o["hits"], o["hyp_size"])


def rouge_of(o: Column) -> Column:
    return _ratio(o["hits"], o["ref_size"])


def gleu_of(o: Column) -> Column:
    return F.sqrt(bleu_of(o) * rouge_of(o))


def cosine_of(o: Column) -> Column:
    norm = F.sqrt(o["ref_sq"]) * F.sqrt(o["hyp_sq"])
    return _ratio(o["dot"], norm)


def ngrams(words: Column, n: int) -> Column:
    if n == 1:
        return words
    size = F.size(words) - (n - 1)
    spots = F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(F.array().cast("array<int>"))
    return F.transform(spots, lambda i: F.array_join(F.slice(words, i, n), " "))


def rouge_n(hyp: Column, ref: Column, n: int = 1) -> Column:
    """Distinct n-grams in common over the n-grams of the reference."""
    h, r = ngrams(tokens(hyp), n), ngrams(tokens(ref), n)
    return _ratio(F.size(F.array_intersect(h, r)), F.size(r))


def lcs_length(a: list, b: list) -> int:
    """Length of the longest common subsequence, by bit rows over ``b``."""
    places: dict = {}
    for i, w in enumerate(b):
        places[w] = places.get(w, 0) | (1 << i)
    full = (1 << len(b)) - 1
    row = full
    for w in a:
        hit = row & places.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(b) - row.bit_count()


@F.arrow_udf(IntegerType())
def _lcs(a: pa.Array, b: pa.Array) -> pa.Array:
    """One pair of texts at a time is taken out of the batch."""
    return pa.array([lcs_length((x.as_py() or "").split(), (y.as_py() or "").split()) for x, y in zip(a, b)], pa.int32())


def rouge_l(hyp: Column, ref: Column, beta: float = 0.5) -> Column:
    lcs = _lcs(hyp, ref)
    p, r = _ratio(lcs, F.size(tokens(hyp))), _ratio(lcs, F.size(tokens(ref)))
    b2 = beta * beta
    return F.when((p == 0) | (r == 0), F.lit(0.0)).otherwise((1 + b2) * p * r / (r + b2 * p))


def rouge(hyp: Column, ref: Column, kind: str = "n") -> Column:
    return rouge_l(hyp, ref) if kind == "l" else rouge_n(hyp, ref, 2 if kind == "s" else 1)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x
    )


def embedding_cosine(a: Column, b: Column) -> Column:
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm)


def jaccard_percent(a: Column, b: Column) -> Column:
    x, y = F.array_distinct(tokens(a)), F.array_distinct(tokens(b))
    union = F.size(F.array_union(x, y))
    return F.lit(1.0) + 99 * _ratio(F.size(F.array_intersect(x, y)), union)


def fuzzy_ratio(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    both_empty = (F.length(a) == 0) & (F.length(b) == 0)
    one_empty = (F.length(a) == 0) | (F.length(b) == 0)
    return (
        F.when(both_empty, F.lit(1.0)).when(one_empty, F.lit(0.0)).otherwise((longest - F.levenshtein(a, b)) / longest)
    )
