"""Benchmark decontamination by a prefix-filtered set join.

A window is ``window`` consecutive words of a benchmark item (a shorter item is one window) and stands for the set of its
word grams. A document contains a window only if it contains all its grams, so the window's rarest gram over the corpus
is a necessary prefix: it alone is joined. The gram's place in the window fixes where the window would start (positional
bound), the document's word count bounds its end (length bound), and the words themselves decide.

Nulls: a null text has no words; a null item id counts as the id ''. Empty tables: no item, no hit; no document, no row.
Ties in rarity are broken by the gram's code. Repeated documents get a row each; repeated items count once per id.
Very long texts are read whole, in slices of words; a text longer than a slice is a slice of its own. Extra columns go unless kept,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C


def windows(items: DataFrame, item_id: str, text: str, window: int, gram: int) -> DataFrame:
    """Rows (item, words, n, offset, size, code): every gram of every window of every item."""
    schema = "item string, words string, n int, offset int, size int, code long"

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).fill_null("").to_pylist()
            for first, data, offsets in C.slices(batch.column(1)):
                words = C.Words(data, offsets, C.LETTERS)
                codes = {k: dict(zip(*(x.tolist() for x in words.runs(k)), strict=True)) for k in range(1, gram + 1)}
                out: list[tuple] = []
                for r in range(len(offsets) - 1):
                    a, b = int(words.first[r]), int(words.first[r + 1])
                    said = words.text(a, b)
                    n = min(window, b - a)
                    size = min(gram, n)
                    for s in range(b - a - n + 1) if n else ():
                        joined = " ".join(said[s : s + n])
                        out += [(ids[first + r], joined, n, o, size, codes[size][a + s + o]) for o in range(n - size + 1)]
                cols = list(zip(*out, strict=True)) or [[]] * 6
                kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
                cols[5] = np.array(cols[5], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], schema.replace(",", "").split()[::2])

    return items.select(F.col(item_id).cast("string"), F.col(text)).mapInArrow(split, schema)


def _candidates(words: C.Words, sizes: Sequence[int], bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(size, first word, code) of the grams that the filter lets through."""
    found = []
    for k in sizes:
        at, code = words.runs(k)
        keep = C.may_hold(bits, code)
        found.append((np.full(int(keep.sum()), k), at[keep], code[keep]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int),) * 2 + (np.zeros(0, np.uint64),)


def gram_counts(docs: DataFrame, text: str, sizes: Sequence[int], packed: bytes) -> DataFrame:
    """Rows (code, n): occurrences over all documents of the grams in the filter."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = C.unpacked(packed)
        for batch in batches:
            parts = [_candidates(C.Words(d, o, C.LETTERS), sizes, bits)[2] for _, d, o in C.slices(batch.column(0))]
            if parts:
                code, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(C.signed(code)), pa.array(n.astype(np.int64))], ["code", "n"])

    return docs.select(text).mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def _marked(docs: DataFrame, keep: Sequence[str], text: str, sizes: Sequence[int], packed: bytes, window: int) -> DataFrame:
    """Per document its kept columns, n_words and the candidate grams with the words around them."""
    hit = T.StructType().add("code", "long").add("at", "long").add("from", "long").add("around", "string")
    schema = T.StructType([T.StructField(f"k{i}", docs.schema[c].dataType) for i, c in enumerate(keep)]).add("rid", "long").add("n_words", "long").add("hits", T.ArrayType(hit))
    source = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.monotonically_increasing_id().alias("rid"), F.col(text).alias("text"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = C.unpacked(packed)
        for batch in batches:
            for first, data, offsets in C.slices(batch.column(len(keep) + 1)):
                words = C.Words(data, offsets, C.LETTERS)
                size, at, code = _candidates(words, sizes, bits)
                row = words.row[at]
                order = np.argsort(row, kind="stable")
                size, at, code, row = size[order], at[order], code[order], row[order]
                low = np.maximum(words.first[row], at - (window - size))
                high = np.minimum(words.first[row + 1], at + window)
                flat = pa.StructArray.from_arrays(
                    [
                        pa.array(C.signed(code)), pa.array(at - words.first[row]), pa.array(low - words.first[row]),
                        pa.array([" ".join(words.text(a, b)) for a, b in zip(low.tolist(), high.tolist(), strict=True)], pa.string()),
                    ],
                    ["code", "at", "from", "around"],
                )
                n = len(offsets) - 1
                held = [c.slice(first, n) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*held, pa.array(np.diff(words.first)), C.lists(flat, C.row_counts(row, n))], schema.names)

    return source.mapInArrow(mark, schema)


def contamination(
    docs: DataFrame, items: DataFrame, keep: Sequence[str] = ("doc_id",), text: str = "text", item_id: str = "item_id",
    item_text: str = "text", window: int = 10, gram: int = 5,
) -> DataFrame:
    """One row per document: the kept columns, n_words, n_hit, n_items, items_sha256, contaminated, and ``spans``
    (start and length in words of every occurrence of a window). See the module for nulls, ties and empty tables."""
    grams = C.cut(windows(items, item_id, item_text, window, gram))
    sizes = [r[0] for r in grams.select("size").distinct().collect()]  # at most `gram` of them
    counts = gram_counts(docs, text, sizes, C.code_filter(grams.select("code")))
    each = grams.groupBy("words", "n", "offset", "code").agg(F.lit(1).alias("one")).drop("one")
    # A window with a gram that no document has can't occur: its rarest gram has no count.
    prefix = C.cut(
        each.join(counts.withColumnRenamed("n", "seen"), "code", "left").groupBy("words", "n")
        .agg(F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "code", "offset")).alias("p")).where("p.seen > 0")
        .select(F.col("p.code").alias("code"), F.col("p.offset").alias("offset"), "words", "n")
    )
    marked = C.cut(_marked(docs, keep, text, sizes, C.code_filter(prefix.select("code")), window))
    start = F.col("h.at") - F.col("offset")
    there = F.slice(F.split("h.around", " "), (start - F.col("h.from") + 1).cast("int"), F.col("n"))
    found = (
        marked.select("rid", "n_words", F.explode("hits").alias("h")).withColumn("code", F.col("h.code")).join(prefix, "code")
        .where((start >= 0) & (start + F.col("n") <= F.col("n_words")))
        .where(F.array_join(there, " ") == F.col("words"))
        .groupBy("rid").agg(F.array_sort(F.collect_set(F.struct(start.alias("start"), F.col("n").cast("long").alias("length")))).alias("spans"), F.collect_set("words").alias("said"))
    )
    found = C.cut(found)
    of = grams.select("item", "words").distinct()
    named = (
        found.select("rid", F.explode("said").alias("words")).join(of, "words").select("rid", "item").distinct()
        .groupBy("rid").agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    covered = F.aggregate(
        "spans", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto")),
        lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["start"] + s["length"] - F.greatest(a["upto"], s["start"]))).alias("n"), F.greatest(a["upto"], s["start"] + s["length"]).alias("upto")),
        lambda a: a["n"],
    )
    hits = found.select("rid", covered.alias("n_hit"), "spans").join(named, "rid")
    none = F.array().cast("array<string>")
    got = F.coalesce("items", none)
    return marked.join(hits, "rid", "left").select(
        *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.size(got).cast("long").alias("n_items"), F.sha2(F.array_join(got, ","), 256).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"), "spans",
    )
