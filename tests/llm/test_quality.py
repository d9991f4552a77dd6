from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import pytest

from runlens.llm import common as C
from runlens.llm import quality as Q


def test_marginals_against_all_labellings():
    rng = np.random.default_rng(2)
    sizes = [1, 4, 2, 6, 1, 3]
    emission, move, first = rng.normal(size=sum(sizes)), rng.normal(size=(2, 2)), np.concatenate([[0], np.cumsum(sizes)])
    p, expected, total = Q.marginals(emission, first, move)
    want_p, want_moves, want_total = np.zeros(len(emission)), np.zeros((2, 2)), 0.0
    for a, b in itertools.pairwise(first):
        weights, z = {}, 0.0
        for y in itertools.product((0, 1), repeat=b - a):
            weights[y] = math.exp(sum(emission[a + i] * y[i] for i in range(b - a)) + sum(move[y[i], y[i + 1]] for i in range(b - a - 1)))
            z += weights[y]
        want_total += math.log(z)
        for y, w in weights.items():
            for i in range(b - a):
                want_p[a + i] += y[i] * w / z
            for i in range(b - a - 1):
                want_moves[y[i], y[i + 1]] += w / z
    assert np.allclose(p, want_p) and np.allclose(expected, want_moves) and math.isclose(total, want_total)


def test_lines_of_odd_texts():
    texts = ["", None, "a\n\nb", "", "x\n", "one line", "\n\n"]
    _, data, offsets = next(C.slices(pa.array(texts)))
    x, n, first = Q.line_features(data, offsets)
    assert np.diff(first).tolist() == [1, 1, 3, 1, 1, 1, 2] and n.sum() == len(data) and len(x) == first[-1]
    # a document's features do not depend on what stands beside it
    for i, t in enumerate(texts):
        _, d, o = next(C.slices(pa.array([t])))
        assert np.allclose(Q.line_features(d, o)[0], x[first[i] : first[i + 1]])


@pytest.fixture(scope="module")
def field():
    good = [f"This is a plain sentence about topic {i}.\nIt has another line, quite normal." for i in range(60)]
    bad = [f"BUY NOW!! CHEAP!! {i}!!\nCLICK!! HERE!!" for i in range(60)]
    return Q.fit(good + bad, np.array([1] * 60 + [0] * 60))


def test_scores(spark, field):
    docs = spark.createDataFrame([(1, "A calm line of words.\nAnd one more.", 0.0), (2, "SALE!! SALE!!\nNOW!! NOW!!", 0.0), (3, None, 0.0), (4, "", 0.0), (None, "SALE!! SALE!!\nNOW!! NOW!!", 0.0), (6, "word " * 200_000, 0.0)], "doc_id long, text string, score_ double")
    got = {r["doc_id"]: r["score"] for r in Q.quality(docs, field).collect()}
    assert got[1] > 0.5 > got[2] == got[None] and got[3] == got[4] and all(0 <= s <= 1 for s in got.values())
    assert Q.quality(docs.where("false"), field).count() == 0


def test_training_without_labels_or_with_one_kind(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 1), (None, 0), (1, None), (2, 1)], "doc_id long, quality int")
    for given, want in ((labels.where("false"), 0.5), (labels, 1.0)):
        assert {r["score"] for r in Q.quality(docs, Q.train(docs, given)).collect()} == {want}


def test_blocks_of_a_long_chain(monkeypatch):
    rng = np.random.default_rng(3)
    for n in (9, 10, 17, 40, 101):
        e, move = rng.normal(size=n), rng.normal(size=(2, 2))
        for x, y in zip(Q._long_chain(e, move), Q._side_by_side(e, np.array([0, n]), move), strict=True):
            assert np.allclose(x, y)
    sizes = [1, 50, 3, 200, 7, 1]
    first, e, move = np.concatenate([[0], np.cumsum(sizes)]), rng.normal(size=sum(sizes)), rng.normal(size=(2, 2))
    plain = Q._side_by_side(e, first, move)
    monkeypatch.setattr(Q, "CHAIN", 20)
    for x, y in zip(Q.marginals(e, first, move), plain, strict=True):
        assert np.allclose(x, y)


def test_very_many_lines(spark, field, monkeypatch):
    """One text of many lines beside many short ones, and a text scored in parts."""
    texts = ["short text."] * 2000 + ["\n" * 300_000] + ["A calm line.\n" * 40 + "BUY NOW!!\n" * 40]
    got = {r["doc_id"]: r["score"] for r in Q.quality(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), field).collect()}
    assert len(got) == len(texts) and all(0 <= s <= 1 for s in got.values())
    _, data, offsets = next(C.slices(pa.array(texts[-1:])))
    whole = field.score(data, offsets)
    for part, lines in ((100, 1000), (1, 3)):
        monkeypatch.setattr(Q, "PART", part)
        monkeypatch.setattr(Q, "LINES", lines)
        assert np.allclose(field.score(data, offsets), whole)


def test_repeated_labelled_id_is_one_row(spark):
    docs = spark.createDataFrame([(i % 4 and i, f"text {i}") for i in range(400)], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(0, 1)], "doc_id long, quality int")
    from runlens.llm import learning as L

    got = L.labelled(docs, labels, "doc_id", "text", "quality", 50, None).collect()
    assert len(got) <= 50 and len({r["id"] for r in got}) == len(got)
    assert sum(len(r["text"]) for r in L.labelled(docs, labels, "doc_id", "text", "quality", 500, None, most_bytes=70).collect()) <= 70
    assert L.labelled(docs, labels, "doc_id", "text", "quality", 500, None).where("id = 0").count() == 1


def test_clashing_score_is_refused(spark, field):
    with pytest.raises(ValueError, match="score"):
        Q.quality(spark.createDataFrame([("a", 1.0)], "text string, Score double"), field)
