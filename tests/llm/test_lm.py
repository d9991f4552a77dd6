from __future__ import annotations

import collections
import itertools
import math
import zlib

import numpy as np
import pytest

from runlens.llm import lm


def cuts(s: bytes):
    for k in range(len(s)):
        for at in itertools.combinations(range(1, len(s)), k):
            ends = [0, *at, len(s)]
            yield [s[a:b] for a, b in itertools.pairwise(ends)]


@pytest.fixture(scope="module")
def small():
    return lm.Lattice.normal({p.encode(): s for p, s in {" a": -1.0, "b": -2.0, " ab": -1.5, "ba": -2.5, "a": -3.0, "é": -4.0, "aba": -2.0, " T": -0.5}.items()})


def test_sums_over_all_segmentations(small):
    words = ["a", "ab", "abab", "bé", "xaba", "ababa", "q" * 4]
    said = [w.encode() for w in words]
    data, off = np.frombuffer(b"".join(said), np.uint8), np.concatenate([[0], np.cumsum([len(w) for w in said])])
    expected = np.zeros(len(small.codes))
    got = small.many(data, off, expected)
    counts: collections.Counter = collections.Counter()
    for w, g in zip(said, got, strict=True):
        ways = {tuple(c): sum(small.pieces[p] for p in c) for c in cuts(b" " + w) if all(p in small.pieces for p in c)}
        z = math.log(sum(map(math.exp, ways.values())))
        assert math.isclose(g, z) and math.isclose(small.one(w), z)
        for c, s in ways.items():
            for p in c:
                counts[p] += math.exp(s - z)
    by_code = dict(zip(small.codes.tolist(), expected, strict=True))
    assert all(math.isclose(by_code[lm._code(p)], counts[p], abs_tol=1e-9) for p in small.pieces)
    alone = np.zeros(len(small.codes))
    for w in said:
        small.one(w, alone)
    assert np.allclose(alone, expected)
    assert math.isclose(np.exp(small.reweighted(expected).scores).sum(), 1)


def test_fitting_raises_the_likelihood(small):
    said = [b"abab", b"ab", b"abab", b"bab"]
    data, off = np.frombuffer(b"".join(said), np.uint8), np.concatenate([[0], np.cumsum([len(w) for w in said])])
    now, last = small, -math.inf
    for _ in range(4):
        expected = np.zeros(len(now.codes))
        total = now.many(data, off, expected).sum()
        assert total >= last - 1e-9
        last, now = total, now.reweighted(expected * 1e6)


def test_vocabulary_is_a_distribution():
    lattice = lm.Lattice.load()
    assert math.isclose(np.exp(lattice.scores).sum(), 1) and all(bytes([b]) in lattice.pieces for b in range(256))


@pytest.mark.parametrize("hot", [3, 1 << 17])
def test_base_and_counts(spark, hot):
    docs = [(i, t) for i, t in enumerate(["The cat sat", "the CAT", None, "", "zebra cat", "a\tb\n a", "É é", "rare words here " * 40, "x" * 400] * 3)] + [(None, "the unnamed"), (3, "the cat")]
    want_words = [(d, ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in (t or "").split()]) for d, t in docs]
    learn = [w for d, w in want_words if d is None or zlib.crc32(str(d).encode()) % 5 != 1]
    count = collections.Counter(x for w in learn for x in [*w, None])
    n, v = sum(count.values()), len(count)
    want = sorted((str(d), len(w) + 1, sum(count[x] > 0 for x in [*w, None]), round(sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in [*w, None]), 6)) for d, w in want_words)
    rows = lm.scores(spark.createDataFrame(docs, "doc_id long, text string").repartition(3).selectExpr("*", "1 as rid", "2 as code"), hot=hot).collect()
    assert sorted((str(r["id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in rows) == want
    assert {r["train_tokens"] for r in rows} == {n} and all(-math.inf < r["score"] < 0 for r in rows)
    by = {r["id"]: r["score"] / r["n_tokens"] for r in rows if r["id"] is not None}
    assert by[0] > by[8]  # known words beat a long unknown one


def test_scores_do_not_depend_on_the_table_of_frequent_words(spark):
    d = spark.createDataFrame([(i, f"w{i % 7} w{i % 3} common common only{i}") for i in range(50)], "doc_id long, text string")
    a, b = ({r["id"]: r["score"] for r in lm.scores(d, hot=h).collect()} for h in (2, 1 << 17))
    assert all(math.isclose(a[i], b[i], rel_tol=1e-9) for i in a)


@pytest.mark.parametrize("hot", [1, 1 << 17])
def test_lattice_score_against_all_segmentations(spark, hot):
    """The marginal of the whole text: every segmentation of every word, summed, by the vocabulary's own scores."""
    lattice = lm.Lattice.load()
    weight = {k: math.exp(v) for k, v in lattice.pieces.items()}

    def ways(word: bytes) -> float:
        if not word:
            return 1.0
        return sum(weight[word[:i]] * ways(word[i:]) for i in range(1, min(len(word), lattice.longest) + 1) if word[:i] in weight and b" " not in word[1:i])

    docs = [(i, t) for i, t in enumerate(["the cat sat", "Zq", "", None, "\u00e9 the\tthe", "cat unseenword"] * 2)]
    learn = [t or "" for i, t in docs if zlib.crc32(str(i).encode()) % 5 != 1]
    tokens = sum(len(t.split()) + 1 for t in learn)
    end = (len(learn) + 0.5) / (tokens + 1)
    got = {r["id"]: r["lattice_score"] for r in lm.scores(spark.createDataFrame(docs, "doc_id long, text string"), hot=hot).collect()}
    for i, t in docs:
        words = (t or "").lower().split()
        want = sum(math.log10((1 - end) * ways(b" " + w.encode())) for w in words) + math.log10(end)
        assert math.isclose(got[i], want, rel_tol=1e-9), (t, got[i], want)


def test_empty(spark):
    d = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert lm.scores(d.where("false")).count() == 0
    one = lm.scores(spark.createDataFrame([(2, None)], "doc_id long, text string")).first()
    assert (one["n_tokens"], one["train_tokens"]) in ((1, 1), (1, 0))
