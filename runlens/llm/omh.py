"""Document fingerprints by Order MinHash.

A text's k-mers of code points are numbered by occurrence. Each of ``hashes`` functions picks the ``pick`` k-mers with the
least hash values; they are put back into text order and hashed as a tuple. Two texts agree in an entry when they
share those k-mers in the same order, so the share of equal entries follows edit distance rather than mere content.

``with_next`` joins every document with the one after it in descending order of id, without a global sort in one task: ids
are cut into ranges by quantiles, each range is sorted and streamed, and the first row of a range is also sent to the
range before it. Rows with a null id are one range.

Nulls: a null text is empty; its fingerprint is ''. Texts shorter than k are one k-mer. Two empty texts are alike (1), an
empty and another one are not (0). Rows with a null id come last in order; rows of equal id are ordered by the hash of
their text, then the text. A single document is its own next one. Equal minima are ordered by their place. A very long
text is hashed whole. Extra columns go, whatever their names. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

K, PICK, HASHES = 8, 2, 64
_ENTRY = 8  # hex digits of an entry
#: Documents per range of ids; with more than ``MOST_RANGES`` times as many, ranges grow (they are streamed, not held).
RANGE_ROWS, MOST_RANGES = 8_000, 100_000

_DRAW = np.random.default_rng(53).integers(1, 2**64, (2, 256), dtype=np.uint64)


def fingerprint(text: str, k: int = K, pick: int = PICK, hashes: int = HASHES) -> np.ndarray:
    """``hashes`` 32-bit entries; none for the empty text."""
    if not text:
        return np.zeros(0, np.uint32)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    k = min(k, len(points))
    n = len(points) - k + 1
    with np.errstate(over="ignore"):
        code = C.mix(_rolling(points, k))
        bits = np.uint64(max(n - 1, 1).bit_length())
        low = (np.uint64(1) << bits) - np.uint64(1)
        # Sorted with the place in the low bits, equal k-mers stand together in text order.
        order = np.sort((code & ~low) | np.arange(n, dtype=np.uint64))
        place, kind = (order & low).astype(np.int64), order >> bits
        begin = np.zeros(n, np.int64)
        begin[1:] = np.where(kind[1:] != kind[:-1], np.arange(1, n), 0)
        occurrence = np.empty(n, np.uint64)
        occurrence[place] = np.arange(n) - np.maximum.accumulate(begin)
        numbered = C.mix(code + occurrence * _DRAW[0, -1])
        numbered = (numbered >> np.uint64(32)).astype(np.uint32)
        a, b = (_DRAW[0, :hashes] | np.uint64(1)).astype(np.uint32), _DRAW[1, :hashes].astype(np.uint32)
        entry = np.zeros(hashes, np.uint64)
        span = max(1, 65_536 // n)
        for i in range(0, hashes, span):
            h = numbered[None, :] * a[i : i + span, None] + b[i : i + span, None]
            rows = np.arange(len(h))
            least = np.empty((len(h), min(pick, n)), np.int64)
            for p in range(least.shape[1]):
                least[:, p] = h.argmin(axis=1)
                h[rows, least[:, p]] = np.uint32(0xFFFFFFFF)
            least.sort(axis=1)
            e = np.zeros(len(h), np.uint64)
            for p in range(least.shape[1]):
                e = C.mix(e * C._BASE + code[least[:, p]])
            entry[i : i + span] = e
    return (entry >> np.uint64(32)).astype(np.uint32)


def _rolling(points: np.ndarray, k: int) -> np.ndarray:
    """A code for every run of k values, in about log k passes."""
    code, width, power = points, 1, C._BASE
    while 2 * width <= k:
        code = code[:-width] * power + code[width:]
        width, power = 2 * width, power * power
    for j in range(width, k):
        code = code[:-1] * C._BASE + points[j:]
    return code


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return float((a == b).mean())


def text_of(entries: np.ndarray) -> str:
    return entries.astype(">u4").tobytes().hex()


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by the first as many of the next text."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of each text, in hex."""

    @F.arrow_udf("string")
    def made(column: pa.Array) -> pa.Array:
        return pa.array([text_of(fingerprint(t.as_py() or "")) for t in column], pa.string())

    return docs.withColumn(out, made(F.col(text)))


def _in_ranges(docs: DataFrame, doc_id: str, text: str, range_rows: int) -> DataFrame:
    """Rows (range, guest, id, text), every range in one partition and in descending order, its guests last."""
    ids = docs.select(F.col(doc_id).alias("id"))
    n, nulls, least = ids.agg(F.count("id"), F.count_if(F.col("id").isNull()), F.min("id")).first()
    parts = min(max(1, -(-n // range_rows)), MOST_RANGES)
    cuts = ids.agg(F.percentile_approx("id", [i / parts for i in range(1, parts)], 100 * parts)).first()[0] if parts > 1 else []
    cuts = np.array(sorted(set(cuts or []) - {least}), np.int64)

    @F.arrow_udf("int")
    def ranged(column: pa.Array) -> pa.Array:
        """Range 0 has the largest ids, the last one the nulls."""
        found = len(cuts) - np.searchsorted(cuts, column.cast(pa.int64()).fill_null(0).to_numpy(), "right")
        return pa.array(np.where(column.is_null(), len(cuts) + 1, found).astype(np.int32))

    placed = docs.select(F.col(doc_id).alias("id"), F.coalesce(text, F.lit("")).alias("text")).withColumn("range", ranged(F.col("id")))
    # The first ids of the ranges, a row for each range, say which rows are guests of the range before.
    heads = {r["range"]: r["first"] for r in placed.groupBy("range").agg(F.max("id").alias("first")).collect()}
    order = sorted(heads)
    before = {r: order[i - 1] for i, r in enumerate(order)}
    host = docs.sparkSession.createDataFrame([(r, heads[r], before[r]) for r in order] or [(0, None, 0)], f"range int, first {docs.schema[doc_id].dataType.simpleString()}, host int")
    tagged = placed.join(F.broadcast(host), "range").select(
        F.explode(F.when(F.col("id").eqNullSafe(F.col("first")), F.array(F.struct(F.col("range").alias("r"), F.lit(0).alias("guest")), F.struct(F.col("host").alias("r"), F.lit(1).alias("guest"))))
                  .otherwise(F.array(F.struct(F.col("range").alias("r"), F.lit(0).alias("guest"))))).alias("at"), "id", "text",
    ).select("at.r", "at.guest", "id", "text")
    return tagged.repartition(max(len(order), 1), "r").sortWithinPartitions("r", "guest", F.desc_nulls_last("id"), F.xxhash64("text"), "text")


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", range_rows: int = RANGE_ROWS) -> DataFrame:
    """One row per document: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, where the
    edited text ends with the beginning of the next document in descending order of id (the first after the last)."""
    source = _in_ranges(docs, doc_id, text, range_rows)
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # (range, id, text, fingerprint) whose next document is awaited
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for r, guest, i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), (x.as_py() for x in batch.column(3)), strict=True):
                if guest and last is None:
                    continue  # only the first guest follows the range
                own = fingerprint(t)
                if last is not None:
                    changed = edited(last[1], t)
                    theirs = fingerprint(changed)
                    for column, value in zip(out, (last[0].as_py(), len(last[1]), hashlib.sha256(changed.encode()).hexdigest(), text_of(last[2]), text_of(theirs), likeness(last[2], theirs), likeness(last[2], own)), strict=True):
                        column.append(value)
                last = None if guest else (i, t, own)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n == "n_chars" else pa.float64() if n.startswith("near") else pa.string() if n != "id" else ids) for c, n in zip(out, names, strict=True)], names)

    ids = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
    return source.mapInArrow(run, f"id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
