"""Exact token counts under a byte-level pair-merge vocabulary, without merging what needs no merging.

1. Proof. Every string of the vocabulary is encoded alone, once, by the library. Those that give one token are whole. The
   split before the merges gives a whole string back as one piece (else it had given more tokens), and merges never look
   outside a piece; so wherever a text's piece equals a whole string it counts one token.
2. Pieces. A batch's texts are split by array operations over code points: classes of letters, numbers, white space and
   others, a single space that goes with what follows, and the six contractions. A code point on whose class two Unicode
   tables disagree, or that is not assigned, sends its text whole to the library.
3. Merges. A batch's distinct pieces are compared with the whole strings; only the rest is merged by the library, once per
   distinct piece, and remembered by the worker up to ``REMEMBERED`` short pieces.

There is no shuffle: a text is counted where it is read. The vocabulary reaches the tasks as a broadcast of its file, whose
size doesn't depend on the data. Strings of added tokens inside a text are one token each, as the library's default has it.

Nulls: a null text is empty and has no token. Very long texts are worked on in pieces of about 2 MB, cut before a space or line
break that follows a visible ASCII character; a text without such a place is one piece. Rows are independent: ties do not arise
and repeated rows get a row each. Extra columns go unless kept; a kept column named like a result is refused. Empty tables give
no rows.
"""

from __future__ import annotations

import functools
import json
import os
import re
import unicodedata
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import common as C

#: Pieces a worker remembers at once, and the longest one, in characters.
REMEMBERED, SHORT = 400_000, 64
#: Classes of code points.
SPACE, LETTER, NUMBER, OTHER, UNSURE = range(5)
RESULTS = ("n_bytes", "n_pieces", "n_whole", "n_tokens")


@functools.lru_cache(maxsize=1)
def classes() -> bytes:
    """The class of every code point, compressed."""
    found = np.full(0x110000, OTHER, np.uint8)
    points = [p for p in range(0x110000) if not 0xD800 <= p < 0xE000]
    kinds = np.array([unicodedata.category(chr(p)) for p in points])
    points = np.array(points)
    first = kinds.astype("U1")
    found[points[first == "L"]] = LETTER
    found[points[first == "N"]] = NUMBER
    text = "".join(map(chr, points))
    found[[ord(c) for c in regex.findall(r"\s", text)]] = SPACE
    again = np.full(0x110000, OTHER, np.uint8)
    for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", SPACE)):
        again[[ord(c) for c in regex.findall(pattern, text)]] = kind
    found[found != again] = UNSURE
    found[points[kinds == "Cn"]] = UNSURE
    return zlib.compress(found.tobytes(), 1)


@functools.lru_cache(maxsize=1)
def _class_table(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), np.uint8)


def _byte_letters() -> dict[str, int]:
    """The printable stand-in of every byte in the vocabulary's strings: itself if printable, else the next free code point."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def vocabulary(file: str) -> tuple[list[str], list[str]]:
    """(strings of the vocabulary, strings of the added tokens) of a tokenizer file; other kinds of tokenizers are refused."""
    model = json.loads(file)
    split = model.get("pre_tokenizer") or {}
    merges = model["model"]
    fits = merges["type"] == "BPE" and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not model.get("normalizer")
    if not fits or merges.get("dropout") or merges.get("continuing_subword_prefix") or merges.get("end_of_word_suffix"):
        raise ValueError("counted are byte-level pair-merge tokenizers without normalizer and prefix space")
    added = model.get("added_tokens") or []
    if any(a["single_word"] or a["lstrip"] or a["rstrip"] or re.search(r"\s", a["content"]) for a in added):
        raise ValueError("added tokens that depend on what stands around them are not supported")
    letters = _byte_letters()
    strings = []
    for name in merges["vocab"]:
        try:
            strings.append(bytes(letters[c] for c in name).decode())
        except (KeyError, UnicodeDecodeError):
            continue  # part of a character: never a piece of its own
    return strings, [a["content"] for a in added]


def whole_strings(file: str) -> list[str]:
    """The strings of the vocabulary that the library encodes, alone, as one token."""
    strings, added = vocabulary(file)
    strings = [s for s in strings if s and not any(a in s for a in added)]
    coder = _library(file)
    return sorted(s for s, e in zip(strings, coder.encode_batch_fast(strings, add_special_tokens=False), strict=True) if len(e.ids) == 1)


@functools.lru_cache(maxsize=2)
def _library(file: str) -> Tokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    coder = Tokenizer.from_str(file)
    coder.no_truncation()
    coder.no_padding()
    return coder


class Counter:
    """Counts of a slice of texts; ``merged`` remembers what the library gave."""

    def __init__(self, file: str, whole: Sequence[str], packed: bytes):
        self.library, self.whole, self.kinds = _library(file), pa.array(whole, pa.string()), _class_table(packed)
        added = sorted(vocabulary(file)[1], key=len, reverse=True)
        self.added = re.compile(b"|".join(re.escape(a.encode()) for a in added)) if added else None
        self.merged: dict[str, int] = {}

    def count(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(pieces, pieces counted as whole, tokens) x texts."""
        n = len(offsets) - 1
        out = np.zeros((3, n), np.int64)
        if n == 1 and len(data) > 2 * C.SLICE_BYTES:
            for a, b in _parts(data):
                out[:, 0] += self._count(data[a:b], np.array([0, b - a]))[:, 0]
            return out
        return self._count(data, offsets)

    def _count(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n, raw = len(offsets) - 1, data.tobytes()
        out = np.zeros((3, n), np.int64)
        if not raw:
            return out
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        points = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
        kind = self.kinds[points]
        begin, row, special = self._segments(raw, offsets)
        at = np.searchsorted(lead, begin)  # first code point of each segment
        first = np.zeros(len(points), bool)
        first[at] = True
        heads = _heads(points, kind, first)
        for k in np.flatnonzero(special):  # an added token is one piece
            heads[at[k] + 1 : at[k + 1] if k + 1 < len(at) else len(points)] = False
        heads = np.flatnonzero(heads)
        segment = np.searchsorted(at, heads, "right") - 1
        ends = np.concatenate([lead[heads], [len(data)]])
        if len(data) >= 1 << 31:
            pieces = pa.LargeStringArray.from_buffers(len(heads), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(raw))
        else:
            pieces = pa.StringArray.from_buffers(len(heads), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(raw))
        found = pieces.dictionary_encode()
        place = found.indices.to_numpy()
        is_whole = pc.is_in(found.dictionary, value_set=self.whole.cast(found.dictionary.type)).to_numpy(zero_copy_only=False)
        used = np.zeros(len(found.dictionary), bool)
        used[place[~special[segment]]] = True
        size = np.ones(len(found.dictionary), np.int64)
        rest = np.flatnonzero(~is_whole & used)
        unsure = np.unique(row[np.searchsorted(at, np.flatnonzero(kind == UNSURE), "right") - 1]) if (kind == UNSURE).any() else np.zeros(0, np.int64)
        size[rest] = self._merge(found.dictionary.take(pa.array(rest)).to_pylist())
        own = row[segment]
        plain = ~special[segment]
        out[0] = np.bincount(own, minlength=n)
        out[1] = np.bincount(own[plain & is_whole[place]], minlength=n)
        tokens = np.where(plain, size[place], 1)
        upto = np.concatenate([[0], np.cumsum(tokens)])
        bounds = np.searchsorted(own, np.arange(n + 1))
        out[2] = upto[bounds[1:]] - upto[bounds[:-1]]
        for r in unsure:
            out[2, r] = len(self.library.encode(raw[offsets[r] : offsets[r + 1]].decode(), add_special_tokens=False).ids)
        return out

    def _segments(self, raw: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first byte, text, whether it is an added token) of the non-empty stretches between and of added tokens."""
        full = np.flatnonzero(np.diff(offsets))
        begin, row, special = list(offsets[full]), list(full), [False] * len(full)
        if self.added is not None and self.added.search(raw):
            begin, row, special = [], [], []
            for r in full:
                at, end = int(offsets[r]), int(offsets[r + 1])
                for m in self.added.finditer(raw, at, end):
                    if m.start() > at:
                        begin.append(at), row.append(r), special.append(False)
                    begin.append(m.start()), row.append(r), special.append(True)
                    at = m.end()
                if at < end:
                    begin.append(at), row.append(r), special.append(False)
        return np.array(begin, np.int64), np.array(row, np.int64), np.array(special, bool)

    def _merge(self, pieces: list[str]) -> list[int]:
        new = [p for p in pieces if p not in self.merged]
        if len(self.merged) + len(new) > REMEMBERED:
            self.merged, new = {}, pieces
        own = {}
        for at in range(0, len(new), 4096):
            some = new[at : at + 4096]
            own.update(zip(some, (len(e.ids) for e in self.library.encode_batch_fast(some, add_special_tokens=False)), strict=True))
        sizes = [own[p] if p in own else self.merged[p] for p in pieces]
        self.merged.update((p, k) for p, k in own.items() if len(p) <= SHORT)
        return sizes


def _parts(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of about a slice, cut before a space or line break after a visible ASCII character: pieces never span that."""
    at = 0
    while at < len(data):
        end = min(at + C.SLICE_BYTES, len(data))
        while end < len(data):
            window = data[end - 1 : end + 65_536]
            cuts = np.flatnonzero((window[:-1] > 0x20) & (window[:-1] < 0x7F) & ((window[1:] == 0x20) | (window[1:] == 0x0A)))
            if len(cuts):
                end += int(cuts[0])
                break
            end = min(end + 65_536, len(data))
        yield at, end
        at = end


def _heads(points: np.ndarray, kind: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Flags of the code points where a piece begins; ``first`` flags the beginnings of segments."""
    last = np.ones(len(first), bool)
    last[:-1] = first[1:]
    heads = first.copy()
    heads[1:] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    # The last white space before something visible begins a piece; a plain space takes what follows along.
    before = np.zeros(len(first), bool)
    before[:-1] = space[:-1] & ~space[1:]
    before &= ~last
    run = heads.copy()
    heads |= before
    taken = np.flatnonzero(before & (points == 0x20)) + 1
    heads[taken] = False
    # Contractions: an apostrophe that begins a piece, with letters behind it.
    follows = np.zeros(len(first), bool)
    follows[:-1] = (kind[1:] == LETTER) & ~last[:-1]
    open_ = run & follows & (points == 0x27)
    open_[taken] = False
    at = np.flatnonzero(open_)
    if len(at):
        far = np.minimum(at + 2, len(points) - 1)
        one = points[at + 1]
        two = np.where((at + 2 < len(points)) & ~last[at + 1], points[far], 0)
        size = np.where(np.isin(one, [0x73, 0x74, 0x6D, 0x64]), 1, 0)  # s t m d
        size[((one == 0x72) | (one == 0x76)) & (two == 0x65) | (one == 0x6C) & (two == 0x6C)] = 2  # re ve ll
        at, size = at[size > 0], size[size > 0]
        heads[at + 1] = False
        after = at + 1 + size
        inside = after < len(points)
        heads[after[inside]] = True
        # What follows a contraction at a space or another class began a piece anyway.
    return heads


def token_counts(docs: DataFrame, tokenizer: str, keep: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """The kept columns and, per row, n_bytes (UTF-8), n_pieces, n_whole (pieces counted without merging) and n_tokens.

    ``tokenizer`` is the path of a tokenizer file, read on the driver."""
    if clash := {k.lower() for k in keep} & set(RESULTS):
        raise ValueError(f"kept columns named like results: {sorted(clash)}")
    with open(tokenizer, encoding="utf-8") as f:
        file = f.read()
    held = docs.sparkSession.sparkContext.broadcast((file, whole_strings(file), classes()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(*held.value)
        for batch in batches:
            for first, data, offsets in C.slices(batch.column(len(keep))):
                counts = counter.count(data, offsets)
                own = [c.slice(first, len(offsets) - 1) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.diff(offsets)), *[pa.array(c) for c in counts]], names)

    inner = [f"k{i}" for i in range(len(keep))]
    names = [*inner, *RESULTS]
    kinds = [f"{k} {docs.schema[c].dataType.simpleString()}" for k, c in zip(inner, keep, strict=True)]
    source = docs.select(*[F.col(c).alias(k) for k, c in zip(inner, keep, strict=True)], F.col(text).alias("text"))
    counted = source.mapInArrow(run, ", ".join([*kinds, *[f"{r} long" for r in RESULTS]]))
    return counted.select(*[F.col(k).alias(c) for k, c in zip(inner, keep, strict=True)], *RESULTS)
