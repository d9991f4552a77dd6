"""Language-model scores from a subword lattice.

An existing piece vocabulary gives every word the sum over all its segmentations of the products of their piece
probabilities, by forward recursion in log space over the word's bytes (each byte has an arc of its own, so nothing is
unknown). A word starts with the word-start mark; as only such pieces end the word before, these sums are a proper
distribution over words. The corpus model discounts every training count by an estimated constant and gives what
that frees to the lattice:

    P(word) = (1 - e) * (max(c - d, 0) + d * kinds * lattice(word)) / words        P(end) = e

Piece weights are the vocabulary's scores. A BPE vocabulary has merge ranks for scores; they become 1 / (rank + 2.7).
``rounds`` of expectation maximisation over the distinct training words fit the weights to the corpus; the vocabulary's own
weights stay in as ``PRIOR`` further counts.

Every distinct word goes through the lattice once a round and once for its score. The ``HOT`` most frequent words, a table of fixed size, go to all tasks,
the other words of each document are joined by a 64-bit code.

``score`` is this mixture; ``lattice_score`` is the lattice alone, with the vocabulary's weights unfitted.

Nulls: a null text is empty (its end is one token); a null id is not held out. Repeated documents count each time. Ties: words of one
frequency are broadcast together or not at all. Very long texts are read whole, in slices; very long words go through the lattice alone.
Extra columns go, whatever their names. Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import learning as L

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Words whose numbers every task holds (24 bytes each).
HOT = 1 << 17
#: Rounds of fitting the piece weights; counts that the vocabulary's own weights stand for.
ROUNDS, PRIOR = 3, 500.0
#: Longer words are taken one by one.
_LONG = 192
_MARK = "▁"


class Lattice:
    """Log probabilities of pieces as byte strings, the word-start mark being one space."""

    def __init__(self, pieces: dict[bytes, float]):
        self.pieces, self.longest = pieces, max(map(len, pieces))
        keys = list(pieces)
        codes = np.array([_code(k) for k in keys], np.uint64)
        order = np.argsort(codes)
        self.codes, self.scores = codes[order], np.array([pieces[k] for k in keys])[order]
        self.prior = self.scores

    @classmethod
    def load(cls, path: str = VOCABULARY) -> Lattice:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))]
        scores = {model.id_to_piece(i).replace(_MARK, " ").encode(): model.get_score(i) for i in ids}
        if not 0.5 < sum(map(math.exp, scores.values())) < 1.5:  # no log probabilities but ranks
            by_rank = sorted(scores, key=lambda p: (-scores[p], p))
            scores = {p: -math.log(r + 2.7) for r, p in enumerate(by_rank)}
        return cls.normal(scores)

    @classmethod
    def normal(cls, scores: dict[bytes, float]) -> Lattice:
        """Pieces with capitals never occur in lowered text and are left out; missing single bytes get the least weight."""
        kept = {p: s for p, s in scores.items() if p and not any(0x41 <= b <= 0x5A for b in p)}
        least = min(kept.values(), default=0.0)
        for b in range(256):
            kept.setdefault(bytes([b]), least)
        total = math.log(sum(map(math.exp, kept.values())))
        return cls({p: s - total for p, s in kept.items()})

    def one(self, word: bytes, expected: np.ndarray | None = None) -> float:
        said = b" " + word
        n = len(said)
        arcs = [[(i, s, said[i:j]) for i in range(max(0, j - self.longest), j) if (s := self.pieces.get(said[i:j])) is not None] for j in range(n + 1)]
        ahead, back = [0.0] + [-math.inf] * n, [-math.inf] * n + [0.0]
        for j in range(1, n + 1):
            terms = [ahead[i] + s for i, s, _ in arcs[j]]
            top = max(terms)
            ahead[j] = top + math.log(sum(math.exp(t - top) for t in terms))
        if expected is not None:
            for j in range(n, 0, -1):
                for i, s, piece in arcs[j]:
                    back[i] = float(np.logaddexp(back[i], back[j] + s))
                    expected[np.searchsorted(self.codes, np.uint64(_code(piece)))] += math.exp(ahead[i] + s + back[j] - ahead[n])
        return ahead[n]

    def many(self, data: np.ndarray, offsets: np.ndarray, expected: np.ndarray | None = None) -> np.ndarray:
        """Natural log of each word's sum; words of one length are taken together. ``expected`` gains the pieces' counts."""
        sizes, out = np.diff(offsets), np.empty(len(offsets) - 1)
        for n in np.unique(sizes):
            rows = np.flatnonzero(sizes == n)
            if n > _LONG:
                out[rows] = [self.one(data[offsets[r] : offsets[r + 1]].tobytes(), expected) for r in rows]
                continue
            for part in np.array_split(rows, -(-len(rows) // 10_000)):
                out[part] = self._same(data[offsets[part][:, None] + np.arange(n)[None, :]], expected)
        return out

    def _same(self, words: np.ndarray, expected: np.ndarray | None) -> np.ndarray:
        count, n = words.shape[0], words.shape[1] + 1
        said = np.hstack([np.full((count, 1), 0x20, np.uint8), words])
        bytes_ = [C._BYTE_CODES[said[:, i]] for i in range(n)]
        arcs: list[list[tuple]] = [[] for _ in range(n + 1)]  # by end: start, rows, pieces
        with np.errstate(over="ignore"):
            codes = list(bytes_)  # of the piece that starts at i, growing
            for size in range(1, min(n, self.longest) + 1):
                if size > 1:
                    codes = [codes[i] * C._BASE + bytes_[i + size - 1] for i in range(n - size + 1)]
                for i, code in enumerate(codes):
                    at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
                    rows = np.flatnonzero(self.codes[at] == code)
                    if len(rows):
                        arcs[i + size].append((i, rows, at[rows]))
        ahead = np.full((n + 1, count), -np.inf)
        ahead[0] = 0
        for j in range(1, n + 1):
            for i, rows, pieces in arcs[j]:
                ahead[j, rows] = np.logaddexp(ahead[j, rows], ahead[i, rows] + self.scores[pieces])
        if expected is not None:
            back = np.full((n + 1, count), -np.inf)
            back[n] = 0
            for j in range(n, 0, -1):
                for i, rows, pieces in arcs[j]:
                    on = back[j, rows] + self.scores[pieces]
                    back[i, rows] = np.logaddexp(back[i, rows], on)
                    expected += np.bincount(pieces, weights=np.exp(ahead[i, rows] + on - ahead[n, rows]), minlength=len(expected))
        return ahead[n]

    def reweighted(self, expected: np.ndarray) -> Lattice:
        """The same pieces by their expected counts and the prior."""
        new = Lattice.__new__(Lattice)
        new.codes, new.longest, new.prior = self.codes, self.longest, self.prior
        counts = expected + PRIOR * np.exp(self.prior)
        new.scores = np.log(counts / counts.sum())
        by_code = dict(zip(self.codes.tolist(), new.scores.tolist(), strict=True))
        new.pieces = {p: by_code[_code(p)] for p in self.pieces}
        return new


def _code(piece: bytes) -> int:
    code = 0
    for b in piece:
        code = (code * int(C._BASE) + int(C._BYTE_CODES[b])) % 2**64
    return code


def _gather(words: C.Words, index: np.ndarray) -> pa.Array:
    """The bytes of the words at index, as a binary column."""
    n = words.end[index] - words.start[index]
    ends = np.concatenate([[0], np.cumsum(n)])
    flat = words.data[np.repeat(words.start[index] - ends[:-1], n) + np.arange(ends[-1])]
    return pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(flat)]).cast(pa.binary())


def _binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)


def word_counts(docs: DataFrame, text: str, train: str) -> DataFrame:
    """Rows (word, code, seen, c): every distinct word, its tokens in all and in training texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            train = batch.column(0).to_numpy(zero_copy_only=False)
            for first, data, offsets in C.slices(batch.column(1), 8_000_000):
                words = C.Words(data, offsets, C.VISIBLE)
                code, index, place, seen = np.unique(words.code, return_index=True, return_inverse=True, return_counts=True)
                learned = np.bincount(place, weights=train[first + words.row], minlength=len(code)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([_gather(words, index), pa.array(C.signed(code)), pa.array(seen), pa.array(learned)], ["word", "code", "seen", "c"])

    counted = docs.select(train, text).mapInArrow(count, "word binary, code long, seen long, c long")
    return counted.groupBy("word").agg(F.first("code").alias("code"), F.sum("seen").alias("seen"), F.sum("c").alias("c"))


def fitted(lattice: Lattice, words: DataFrame, rounds: int) -> Lattice:
    """Piece weights after some rounds over the distinct words; each round brings one number for each piece to the driver."""
    for _ in range(rounds):
        now = words.sparkSession.sparkContext.broadcast(lattice)  # as large as the vocabulary

        def expect(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(now.value.codes))
            for batch in batches:
                now.value.many(*_binary(batch.column(0)), total)
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["piece", "n"])

        found = words.select("word").mapInArrow(expect, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).toArrow()
        expected = np.zeros(len(lattice.codes))
        expected[found.column("piece").to_numpy()] = found.column("n").to_numpy()
        lattice = lattice.reweighted(expected)
    return lattice


def weighed(words: DataFrame, lattice: Lattice, plain: Lattice) -> DataFrame:
    """Rows (code, seen, c, lattice, plain): ``words`` with their natural log probability in the fitted lattice, and in that of
    the vocabulary's own scores."""
    now = words.sparkSession.sparkContext.broadcast((lattice, plain))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            logs = [pa.array(x.many(*_binary(batch.column(0)))) for x in now.value]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *logs], ["code", "seen", "c", "lattice", "plain"])

    return words.mapInArrow(weigh, "code long, seen long, c long, lattice double, plain double")


def scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", modulus: int = 5, vocabulary: str = VOCABULARY, hot: int = HOT, rounds: int = ROUNDS) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score, and lattice_score: the marginal log10
    probability over all segmentations under the vocabulary's scores as they are, with the same end."""
    held = L.held_out(F.col(doc_id), modulus)
    counted = C.cut(word_counts(docs.select((~held).alias("train"), F.col(text).alias("text")), "text", "train"))
    own_scores = Lattice.load(vocabulary)
    table = C.cut(weighed(counted, fitted(own_scores, counted.where("c > 0"), rounds), own_scores))
    words, kinds, once, twice = table.where("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1)), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first()
    ends = docs.where(~held).count()
    tokens, distinct = words + ends, kinds + (ends > 0)
    discount = min(max(once / (once + 2 * twice), 0.1), 0.95) if once else 0.5
    end = (ends + 0.5) / (tokens + 1)
    base = lambda c: np.log10((c + 0.5) / (tokens + 0.5 * (distinct + 1)))

    def model(c: np.ndarray, logs: np.ndarray) -> np.ndarray:
        """log10 of P(word)."""
        if not words:
            return (np.log1p(-end) + logs) / math.log(10)
        seen = np.log(np.maximum(c - discount, 1e-300)) - math.log(words)
        unseen = math.log(discount * kinds / words) + logs
        return (math.log1p(-end) + np.where(c > 0, np.logaddexp(seen, unseen), unseen)) / math.log(10)

    def whole(logs: np.ndarray) -> np.ndarray:
        """log10 of P(word) by the lattice alone."""
        return (math.log1p(-end) + logs) / math.log(10)

    # The most frequent words, down to a frequency that at most `hot` of them reach.
    octave = F.floor(F.log2("seen") * 8)
    reached, least = 0, 0
    for r in table.groupBy(octave.alias("o")).agg(F.count(F.lit(1)).alias("n"), F.min("seen").alias("seen")).orderBy(F.desc("o")).collect():  # a few hundred rows
        reached += r["n"]
        if reached > hot:
            break
        least = r["seen"]
    top = table.where((F.col("seen") >= least) & F.lit(least > 0)).select("code", "c", "lattice", "plain").toArrow()
    code = top.column("code").to_numpy().view(np.uint64)
    order = np.argsort(code)
    own = (code[order], top.column("c").to_numpy()[order], top.column("lattice").to_numpy()[order], top.column("plain").to_numpy()[order])
    shared = docs.sparkSession.sparkContext.broadcast(own)
    names = ["id", "rid", "held_out", "n_tokens", "n_known", "base_score", "score", "lattice_score", "rest"]
    kind = docs.schema[doc_id].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_code, hot_c, hot_logs, hot_plain = shared.value
        hot_base, hot_model, hot_whole = base(hot_c), model(hot_c, hot_logs), whole(hot_plain)
        for batch in batches:
            for first, data, offsets in C.slices(batch.column(3)):
                w, n = C.Words(data, offsets, C.VISIBLE), len(offsets) - 1
                at = np.minimum(np.searchsorted(hot_code, w.code), max(len(hot_code) - 1, 0))
                hit = hot_code[at] == w.code if len(hot_code) else np.zeros(len(w.code), bool)
                add = lambda v: np.bincount(w.row[hit], weights=v[at[hit]], minlength=n)  # noqa: B023, E731
                rest, row = w.code[~hit], w.row[~hit]
                by = np.argsort(row, kind="stable")
                yield pa.RecordBatch.from_arrays(
                    [
                        *[c.slice(first, n) for c in batch.columns[:3]], pa.array(np.diff(w.first) + 1), pa.array(add(hot_c > 0).astype(np.int64) + (ends > 0)),
                        pa.array(add(hot_base) + base(ends)), pa.array(add(hot_model) + math.log10(end)), pa.array(add(hot_whole) + math.log10(end)), C.lists(C.signed(rest[by]), C.row_counts(row, n)),
                    ],
                    names,
                )

    source = docs.select(F.col(doc_id).alias("id"), F.monotonically_increasing_id().alias("rid"), held.alias("held"), F.col(text).alias("text"))
    judged = C.cut(source.mapInArrow(judge, f"id {kind}, rid long, held_out boolean, n_tokens long, n_known long, base_score double, score double, lattice_score double, rest array<long>"))

    @F.arrow_udf("double")
    def chance(c: pa.Array, logs: pa.Array) -> pa.Array:
        return pa.array(model(c.to_numpy(), logs.to_numpy()))

    rare = judged.select("rid", F.explode("rest").alias("code")).groupBy("rid", "code").agg(F.count(F.lit(1)).alias("n")).join(
        table.select("code", "c", F.log10((F.col("c") + 0.5) / F.lit(tokens + 0.5 * (distinct + 1))).alias("b"), chance("c", "lattice").alias("m"), ((F.col("plain") + math.log1p(-end)) / math.log(10)).alias("l")), "code"
    )
    more = rare.groupBy("rid").agg(F.sum(F.when(F.col("c") > 0, F.col("n"))).alias("k"), F.sum(F.col("n") * F.col("b")).alias("b"), F.sum(F.col("n") * F.col("m")).alias("m"), F.sum(F.col("n") * F.col("l")).alias("l"))
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return judged.join(more, "rid", "left").select(
        "id", "held_out", "n_tokens", plus("n_known", "k").alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"), plus("base_score", "b").alias("base_score"), plus("score", "m").alias("score"), plus("lattice_score", "l").alias("lattice_score")
    )
