"""Spelling variants against all pairs."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from runlens.llm import spelling as S


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i:] == b[i + 1 :]


def plain(counts, times=5):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= times * counts[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), counts[w], len(near[w]), counts.get(form[w])) for w in counts}


def words(seed, n=250, sizes=(6, 7, 8), letters="abé"):
    rng = random.Random(seed)
    found = {"".join(rng.choice(letters) for _ in range(rng.choice(sizes))): rng.choice([5, 6, 30, 160, 900, 5000]) for _ in range(n)}
    return found


@pytest.mark.parametrize(("counts", "long"), [
    (words(1), 40),
    (words(2, letters="abcdefÿ", n=400) | {"x" * 6: 5, "x" * 7: 25, "x" * 8: 125, "x" * 9: 625}, 40),
    (words(3), 7),  # both ways, with the limit among the sizes
    (words(4, sizes=(1, 2, 3, 4), n=120), 40),
    (words(5, sizes=(50, 51), n=30) | {"a" * 60: 9, "a" * 61: 90, "a" * 39 + "b": 7, "a" * 40 + "b": 70, "a" * 41 + "b": 700}, 40),
], ids=["dense", "sparse", "limit", "short", "long"])
def test_groups_are_the_plain_ones(spark, counts, long):
    df = spark.createDataFrame(list(counts.items()), "word string, n int").repartition(3)
    got = [tuple(r) for r in S.spelling_groups(df, long=long).collect()]
    assert len(got) == len(counts) and set(got) == plain(counts)


def test_typed_words(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["Straße", "ÉTÉ", "naïve", "Hello", "x", "wörter×ÿ", "a1b"]) for _ in range(300)) for _ in range(40)]
    rows = [(None if i == 3 else i, t, "z") for i, t in enumerate(texts)] + [(3, None, "z"), (4, "", "z"), (5, "q" * 50_000, "z")] + [(7, texts[7], "z")]
    want = Counter()
    for i, t, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            want[run] += 1
    got = S.typed_words(spark.createDataFrame(rows, "doc_id long, text string, word string").repartition(3))
    assert {r["word"]: r["n"] for r in got.collect()} == dict(want)


def test_very_long_word(spark):
    base = "ab" * 30_000
    counts = {base: 5, base[:40_000] + "c" + base[40_000:]: 50, base[:-1] + "z": 7, "c" + base[1:]: 400}
    got = {tuple(r) for r in S.spelling_groups(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()}
    assert got == plain(counts)


def test_empty(spark):
    assert S.spelling_groups(spark.createDataFrame([], "word string, n long")).count() == 0
    assert S.spelling_groups(S.typed_words(spark.createDataFrame([], "doc_id long, text string"))).count() == 0
