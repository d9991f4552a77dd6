"""Quality by a linear-chain conditional random field over the lines of a document.

Every line is good or bad. Its features are counts of its characters and words, those of the lines before and after it, and
its place. Forward-backward gives each line's marginal; the marginals, weighted by the bytes of their lines, are the
document's share of good text, which a one-dimensional logistic curve turns into a probability.

The field is fitted on the driver on at most ``sample`` labelled documents (a parameter) of ``learning.SAMPLE_BYTES``
bytes together, where every line carries its document's label; scoring reads every text whole and runs on Arrow batches.
Documents of like line counts are scored together, so few long ones beside many short ones cost no memory; a chain of
more than ``CHAIN`` lines is cut into blocks that are scored side by side and joined by their transfer matrices.

Nulls: a null text is empty, one empty line. Without any usable label, or with only one kind, all documents score by that
prior (0.5 without labels). Ties do not arise: a document's score depends on its text alone, so repeated documents score alike.
Very long texts are scored whole. Extra columns stay; one named like the score is refused. Empty tables give no rows.
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

_CLASSES = {
    "upper": range(0x41, 0x5B), "lower": range(0x61, 0x7B), "digit": range(0x30, 0x3A), "space": (0x20, 0x09), "stop": b".,;:?!'\"()-",
    "loud": b"!", "bar": b"|", "sign": b"#$%&*+/<=>@[\\]^_`{|}~", "high": range(0x80, 0x100),
}
_BYTES = np.zeros((len(_CLASSES), 256), bool)
for _i, _members in enumerate(_CLASSES.values()):
    _BYTES[_i, list(_members)] = True
_OWN = 18
#: Lines of a chain that is scored step by step.
CHAIN = 1024
#: Bytes and lines of a long text whose features are held at once.
PART, LINES = 1_000_000, 100_000


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features per line, bytes per line, first line of each document and the end)."""
    breaks = np.flatnonzero(data == 0x0A) + 1
    starts = np.unique(np.concatenate([offsets[:-1], breaks]))
    # A document without bytes is one empty line; a break at a document's end opens no further line.
    empty = offsets[:-1][np.diff(offsets) == 0]
    starts = np.sort(np.concatenate([starts[starts < len(data)], empty])) if len(empty) else starts[starts < len(data)]
    own_first = np.searchsorted(starts, offsets[:-1], "left")
    if len(empty):  # empty documents share their offset with what follows them
        same = np.concatenate([[0], (offsets[1:-1] == offsets[:-2]).astype(int)])
        run = np.zeros(len(same), int)
        for i in range(1, len(same)):
            run[i] = run[i - 1] + 1 if same[i] else 0
        own_first = own_first + run
    first = np.concatenate([own_first, [len(starts)]])
    bounds = np.concatenate([starts, [len(data)]])
    n = np.diff(bounds)
    counts = np.empty((len(_CLASSES), len(starts)))
    for i in range(len(_CLASSES)):
        total = np.concatenate([[0], np.cumsum(_BYTES[i][data])])
        counts[i] = total[bounds[1:]] - total[bounds[:-1]]
    upper, lower, digit, space, stop, loud, bar, sign, _ = counts
    full = np.flatnonzero(n)
    words = C.Words(data, np.concatenate([starts[full], [len(data)]]), C.VISIBLE)
    w, distinct, again = (np.zeros(len(n)) for _ in range(3))
    row = full[words.row]
    w[:] = np.bincount(row, minlength=len(n))
    if len(row):
        with np.errstate(over="ignore"):
            place = words.code ^ C.mix(row.astype(np.uint64) + np.uint64(1))
        _, index = np.unique(place, return_index=True)
        distinct[:] = np.bincount(row[index], minlength=len(n))
        twice = (words.code[1:] == words.code[:-1]) & (row[1:] == row[:-1])
        again[:] = np.bincount(row[1:][twice], minlength=len(n))
    size, letters, many = np.maximum(n, 1), np.maximum(upper + lower, 1), np.maximum(w, 1)
    end = np.where(n > 0, data[np.maximum(bounds[1:] - 1 - ((n > 1) & (data[np.maximum(bounds[1:] - 1, 0)] == 0x0A)), 0)] if len(data) else 0, 0)
    shares = [upper / letters, digit / size, space / size, stop / size, loud / many, bar / many, sign / many, 1 - distinct / many, again / many]
    flags = [upper > 0.6 * letters, loud > 0.3 * w, bar > 0.15 * w, sign > 0.2 * w, (distinct < 0.5 * w) & (w > 4), again > 0.3 * w, (end == 0x2E) | (end == 0x21) | (end == 0x3F)]
    own = np.column_stack([*shares, *[f.astype(float) for f in flags], np.log1p(n) / 8, np.minimum((n - w) / many, 20) / 10])
    own[w == 0] = 0
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[first[:-1]] = 0
    after[first[1:] - 1] = 0
    place = np.zeros((len(n), 2))
    place[first[:-1], 0] = place[first[1:] - 1, 1] = 1
    return np.hstack([own, before, after, place, np.ones((len(n), 1))]), n.astype(float), first


def _padded(flat: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Line scores as (documents sorted by lines, longest first) x lines, and their order."""
    sizes = np.diff(first)
    order = np.argsort(-sizes, kind="stable")
    grid = np.zeros((len(sizes), int(sizes.max(initial=0))))
    inside = np.arange(grid.shape[1])[None, :] < sizes[order][:, None]
    grid[inside] = flat[np.concatenate([np.arange(first[d], first[d + 1]) for d in order])]
    return grid, order


def marginals(emission: np.ndarray, first: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(probability of good per line, expected counts of the four moves, log partition). ``emission``: log odds of good per
    line; ``move``: scores from state to state."""
    sizes = np.diff(first)
    flat, expected, total = np.empty(len(emission)), np.zeros((2, 2)), 0.0
    octave = np.log2(np.maximum(sizes, 1)).astype(int)
    for o in np.unique(octave):
        docs = np.flatnonzero(octave == o)
        if sizes[docs[0]] > CHAIN or sizes[docs].max() > CHAIN:
            parts = [(np.arange(first[d], first[d + 1]), _long_chain(emission[first[d] : first[d + 1]], move)) for d in docs]
        else:
            at = np.concatenate([np.arange(first[d], first[d + 1]) for d in docs])
            parts = [(at, _side_by_side(emission[at], np.concatenate([[0], np.cumsum(sizes[docs])]), move))]
        for at, (p, n, z) in parts:
            flat[at] = p
            expected += n
            total += z
    return flat, expected, total


def _long_chain(e: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """``marginals`` of one long chain, in about 2 sqrt(lines) steps: blocks side by side, then from block to block."""
    n = len(e)
    width = math.isqrt(n - 1) + 1
    blocks = -(-(n - 1) // width)
    # step[t] leads from line t to line t + 1; steps past the end change nothing.
    step = np.full((blocks * width, 2, 2), -np.inf)
    step[:, 0, 0] = step[:, 1, 1] = 0
    step[: n - 1] = move[None]
    step[: n - 1, :, 1] += e[1:, None]
    step = step.reshape(blocks, width, 2, 2)
    over = np.full((blocks, 2, 2), -np.inf)
    over[:, 0, 0] = over[:, 1, 1] = 0
    for t in range(width):
        over = np.logaddexp(over[:, :, :1] + step[:, t, None, 0], over[:, :, 1:] + step[:, t, None, 1])
    enter, leave = np.empty((blocks, 2)), np.zeros((blocks, 2))
    enter[0] = 0, e[0]
    for b in range(1, blocks):
        enter[b] = np.logaddexp(enter[b - 1, 0] + over[b - 1, 0], enter[b - 1, 1] + over[b - 1, 1])
    for b in range(blocks - 2, -1, -1):
        leave[b] = np.logaddexp(over[b + 1, :, 0] + leave[b + 1, 0], over[b + 1, :, 1] + leave[b + 1, 1])
    ahead, back = np.empty((blocks, width + 1, 2)), np.empty((blocks, width + 1, 2))
    ahead[:, 0], back[:, width] = enter, leave
    for t in range(width):
        ahead[:, t + 1] = np.logaddexp(ahead[:, t, :1] + step[:, t, 0], ahead[:, t, 1:] + step[:, t, 1])
    for t in range(width - 1, -1, -1):
        back[:, t] = np.logaddexp(step[:, t, :, 0] + back[:, t + 1, :1], step[:, t, :, 1] + back[:, t + 1, 1:])
    first, last = ahead[:, :width].reshape(-1, 2)[: n - 1], ahead[:, 1:].reshape(-1, 2)[: n - 1]
    after = back[:, 1:].reshape(-1, 2)[: n - 1]
    forward, backward = np.vstack([first[:1], last]), np.vstack([back[0, :1], after])
    total = float(np.logaddexp(*forward[-1]))
    flat = step.reshape(-1, 2, 2)[: n - 1]
    expected = np.exp(np.minimum(first[:, :, None] + flat + after[:, None, :] - total, 0)).sum(axis=0)
    odds = forward[:, 1] + backward[:, 1] - forward[:, 0] - backward[:, 0]
    return L.sigmoid(odds), expected, total


def _in_parts(data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(features, bytes) of the lines of one long text, some lines at a time, each part seeing the lines beside it."""
    starts = np.concatenate([[0], np.flatnonzero(data == 0x0A) + 1])
    starts = np.concatenate([starts[starts < len(data)], [len(data)]])
    at, end = 0, len(starts) - 1
    while at < end:
        to = min(max(int(np.searchsorted(starts, starts[at] + PART, "right")) - 1, at + 1), at + LINES, end)
        a, b = max(at - 1, 0), min(to + 1, end)
        x, n, _ = line_features(data[starts[a] : starts[b]], np.array([0, starts[b] - starts[a]]))
        x, n = x[at - a : len(x) - (b - to)], n[at - a : len(n) - (b - to)]
        yield x, n
        at = to


def _side_by_side(emission: np.ndarray, first: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """``marginals`` of chains of like length, all of them a line further in each step."""
    grid, order = _padded(emission, first)
    sizes = np.diff(first)[order]
    docs, steps = grid.shape
    live = [int(np.searchsorted(-sizes, -t, "left")) for t in range(steps + 1)]  # documents with more than t lines
    ahead, back = np.zeros((steps, docs, 2)), np.zeros((steps, docs, 2))
    ahead[0, :, 1] = grid[:, 0]
    for t in range(1, steps):
        k = live[t]
        a = ahead[t - 1, :k]
        ahead[t, :k, 0] = np.logaddexp(a[:, 0] + move[0, 0], a[:, 1] + move[1, 0])
        ahead[t, :k, 1] = np.logaddexp(a[:, 0] + move[0, 1], a[:, 1] + move[1, 1]) + grid[:k, t]
    for t in range(steps - 2, -1, -1):
        k = live[t + 1]
        b0, b1 = back[t + 1, :k, 0], back[t + 1, :k, 1] + grid[:k, t + 1]
        back[t, :k, 0] = np.logaddexp(move[0, 0] + b0, move[0, 1] + b1)
        back[t, :k, 1] = np.logaddexp(move[1, 0] + b0, move[1, 1] + b1)
    total = np.logaddexp(ahead[sizes - 1, np.arange(docs), 0], ahead[sizes - 1, np.arange(docs), 1])
    expected = np.zeros((2, 2))
    if steps > 1:
        k = np.arange(1, steps)[:, None] < sizes[None, :]
        for a in (0, 1):
            for b in (0, 1):
                z = ahead[:-1, :, a] + move[a, b] + back[1:, :, b] + (grid.T[1:] if b else 0) - total[None, :]
                expected[a, b] = np.exp(np.minimum(z[k], 0)).sum()
    log_odds = (ahead[:, :, 1] + back[:, :, 1] - ahead[:, :, 0] - back[:, :, 0]).T
    flat = np.empty(len(emission))
    inside = np.arange(steps)[None, :] < sizes[:, None]
    flat[np.concatenate([np.arange(first[d], first[d + 1]) for d in order])] = L.sigmoid(log_odds[inside])
    return flat, expected, float(total.sum())


def _share(p: np.ndarray, n: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Length-weighted mean of the marginals per document, as a log odds."""
    weight = n + 1e-3
    good = np.add.reduceat(p * weight, first[:-1]) / np.add.reduceat(weight, first[:-1])
    good = np.clip(good, 1e-4, 1 - 1e-4)
    return np.log(good / (1 - good))


class Field:
    """Weights of the chain and of the final curve."""

    def __init__(self, w: np.ndarray, move: np.ndarray, curve: np.ndarray):
        self.w, self.move, self.curve = w, move, curve

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.w is None:
            return np.full(len(offsets) - 1, self.curve[0])
        if len(offsets) == 2 and len(data) > 2 * PART:
            parts = [(x @ self.w, n) for x, n in _in_parts(data)]
            e, n = (np.concatenate(c) for c in zip(*parts, strict=True))
            first = np.array([0, len(e)])
        else:
            x, n, first = line_features(data, offsets)
            e = x @ self.w
        p, _, _ = marginals(e, first, self.move)
        return L.sigmoid(self.curve[0] * _share(p, n, first) + self.curve[1])


def fit(texts: list[str], y: np.ndarray, steps: int = 80, ridge: float = 1e-3) -> Field:
    """Gradient ascent (Adam) on the mean log likelihood per line, started from a logistic fit of single lines."""
    if len(y) == 0 or y.min() == y.max():
        return Field(None, None, np.array([float(y[0]) if len(y) else 0.5]))
    _, data, offsets = next(C.slices(pa.array(texts, pa.large_string()), 1 << 40))
    x, n, first = line_features(data, offsets)
    lines = np.repeat(y, np.diff(first)).astype(float)
    start = L.logistic(x[:, :-1], lines)
    move = np.zeros((2, 2))
    same = lines[1:].astype(int) * 2 + lines[:-1].astype(int)
    inner = np.ones(len(lines) - 1, bool)
    inner[first[1:-1] - 1] = False
    seen = np.bincount(lines[:-1][inner].astype(int) * 2 + lines[1:][inner].astype(int), minlength=4).reshape(2, 2).astype(float)
    del same
    theta = np.concatenate([start, move.ravel()])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        w, move = theta[:-4], theta[-4:].reshape(2, 2)
        p, expected, _ = marginals(x @ w, first, move)
        grad = np.concatenate([x.T @ (lines - p), (seen - expected).ravel()]) / len(lines) - ridge * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta = theta + 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    w, move = theta[:-4], theta[-4:].reshape(2, 2)
    p, _, _ = marginals(x @ w, first, move)
    return Field(w, move, L.logistic(_share(p, n, first)[:, None], y.astype(float)))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", target: str = "quality", sample: int = 2000, modulus: int | None = None) -> Field:
    """Fitted on at most ``sample`` labelled documents; with a modulus, on none with crc32(id) mod modulus = 1."""
    rows = sorted((r["id"], r["text"], r["y"]) for r in L.labelled(docs, labels, doc_id, text, target, sample, modulus).toLocalIterator())
    return fit([r[1] for r in rows], np.array([r[2] for r in rows]))


def quality(docs: DataFrame, field: Field, text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with the probability of being good."""
    if score.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"there is a column {score} already")

    @F.arrow_udf("double")
    def judged(column: pa.Array) -> pa.Array:
        parts = [field.score(d, o) for _, d, o in C.slices(column, 1_000_000)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return docs.withColumn(score, judged(F.col(text)))
