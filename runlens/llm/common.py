"""Shared helpers: reading tables, word splitting and hashing over Arrow batches, tables that cut lineage.

Texts are handled as UTF-8 bytes. Every word rule used here lets all bytes of a multi-byte character through, so
splitting bytes gives the same words as splitting code points. Batches are taken in slices of bounded size.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Bytes of text worked on at once; a longer text is taken alone.
SLICE_BYTES = 2_000_000

#: Size of the filter that tasks hold, whatever the size of what went in; a fuller filter lets more through to the join.
FILTER_BITS = 1 << 25
MOST_FILTER_BITS, FILTER_SLICES = 1 << 28, 64

_ALL = np.arange(256)
#: Lower case for A-Z only.
LOWER = np.where((_ALL >= 0x41) & (_ALL <= 0x5A), _ALL + 32, _ALL).astype(np.uint8)
#: Bytes of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lowering.
LETTERS = ((LOWER >= 0x30) & (LOWER <= 0x39)) | ((LOWER >= 0x61) & (LOWER <= 0x7A)) | (LOWER >= 0x80)
#: Bytes of words [^\x20\x09-\x0D]+.
VISIBLE = ~((_ALL == 0x20) | ((_ALL >= 0x09) & (_ALL <= 0x0D)))

#: The same two rules as patterns, for SQL.
LETTER_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
VISIBLE_WORDS = r"[^\x20\x09-\x0D]+"
UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_BYTE_CODES = np.random.default_rng(20_240_229).integers(1, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lowered(text):
    """Column: A-Z in lower case, all else as it is; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWERED)


def cut(df: DataFrame) -> DataFrame:
    """A table in the shared folder; later reads don't repeat the work, whichever executors are lost."""
    return cut_lineage(df)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive rows with about ``limit`` bytes of text; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(off, off[first] + limit, "right")) - 1)
        yield first, raw[off[first] : off[last]], off[first : last + 1] - off[first]
        first = last


class Words:
    """Words of a slice: byte ``start`` and ``end``, ``row``, 64-bit ``code``; words of a row are consecutive."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray, codes: bool = True, lower: bool = True):
        self.data, self.offsets = LOWER[data] if lower else data, offsets
        inside = kind[data]
        before, after = np.zeros_like(inside), np.zeros_like(inside)
        if len(data):
            before[1:], after[:-1] = inside[:-1], inside[1:]
            edges = offsets[1:-1]
            before[edges[edges < len(data)]] = False
            after[edges[edges > 0] - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.row = np.searchsorted(offsets, self.start, "right") - 1
        #: Words of row r are first[r]:first[r + 1].
        self.first = np.searchsorted(self.row, np.arange(len(offsets)))
        self.code = self._codes(inside) if codes else None

    def _codes(self, inside: np.ndarray) -> np.ndarray:
        n = self.end - self.start
        if not len(n):
            return np.zeros(0, np.uint64)
        at = np.cumsum(n) - n
        place = np.arange(int(n.sum()), dtype=np.int64) - np.repeat(at, n)
        with np.errstate(over="ignore"):
            powers = np.full(int(n.max()), _BASE, np.uint64)
            powers[0] = 1
            powers = np.cumprod(powers, dtype=np.uint64)
            sums = np.add.reduceat(_BYTE_CODES[self.data[inside]] * powers[place], at)
            return mix(sums + n.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def runs(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of first word, code) of every run of k words within a row."""
        n = len(self.start) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            code = np.full(n, np.uint64(k), np.uint64)
            for j in range(k):
                code = mix(code * _BASE + self.code[j : j + n])
        at = np.flatnonzero(self.row[:n] == self.row[k - 1 :])
        return at, code[at]

    def text(self, a: int, b: int) -> list[str]:
        return [self.data[self.start[i] : self.end[i]].tobytes().decode() for i in range(a, b)]


def row_counts(rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, minlength=n).astype(np.int64)


def lists(values: pa.Array | np.ndarray, sizes: Sequence[int] | np.ndarray) -> pa.Array:
    """A list column from flat values and the length of each list."""
    ends = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), values if isinstance(values, pa.Array) else pa.array(values))


def code_filter(codes: DataFrame, bits: int = FILTER_BITS) -> bytes:
    """A Bloom filter with two probes over a column of 64-bit codes, packed. It has about 16 bits a code, a power of two, and at
    most ``bits`` and ``MOST_FILTER_BITS`` whatever the data; a fuller one lets more through to the join that follows.

    Every task marks its own codes; what it marked travels in slices, which are merged side by side."""
    codes = cut(codes)
    bits = min(bits, MOST_FILTER_BITS, max(1 << 16, 1 << (16 * codes.count()).bit_length()))
    width = max(bits // 8 // FILTER_SLICES, 1)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(bits, bool)
        for batch in batches:
            for probe in _probes(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), bits):
                found[probe] = True
        packed = np.packbits(found).reshape(-1, width)
        some = np.flatnonzero(packed.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([zlib.compress(packed[i].tobytes(), 1) for i in some], pa.binary())], ["slice", "bits"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merged: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(zlib.decompress(part), np.uint8)
                merged[i] = merged[i] | part if i in merged else part
        yield pa.RecordBatch.from_arrays([pa.array(list(merged), pa.int64()), pa.array([zlib.compress(x.tobytes(), 1) for x in merged.values()], pa.binary())], ["slice", "bits"])

    cores = codes.sparkSession.sparkContext.defaultParallelism
    marked = codes.coalesce(max(cores, 8)).mapInArrow(mark, "slice long, bits binary")
    total = np.zeros((bits // 8 // width, width), np.uint8)
    # At most FILTER_SLICES rows, in one job; an iterator would start a job for each partition.
    for i, part in marked.repartition("slice").mapInArrow(merge, "slice long, bits binary").collect():
        total[i] = np.frombuffer(zlib.decompress(part), np.uint8)
    return zlib.compress(total.tobytes(), 1)


@functools.lru_cache(maxsize=2)
def unpacked(packed: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(packed), np.uint8)).astype(bool)


def may_hold(bits: np.ndarray, code: np.ndarray) -> np.ndarray:
    keep = np.ones(len(code), bool)
    for probe in _probes(code, len(bits)):
        keep &= bits[probe]
    return keep


def _probes(code: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(bits - 1)
    return code & mask, (code >> np.uint64(32)) & mask
