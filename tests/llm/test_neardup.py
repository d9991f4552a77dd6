from __future__ import annotations

import random

import pytest

from runlens.llm import neardup


def shingles(text, k=5):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(docs, percent):
    sets = [shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            same_id = docs[i][0] is not None and docs[i][0] == docs[j][0]
            if sets[i] and sets[j] and (same_id or 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])):
                parent[root(i)] = root(j)
    ids = {}
    for i, (d, _) in enumerate(docs):
        ids.setdefault(root(i), []).append(d)
    return sorted(((d, len(sets[i]), min((x for x in ids[root(i)] if x is not None), default=None)) for i, (d, _) in enumerate(docs)), key=str)


@pytest.mark.parametrize("similarity", [0.8, 0.85])
def test_against_brute_force(spark, similarity):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    docs, base = [], [" ".join(rng.choices(vocabulary, k=n)) for n in (30, 120, 150, 400)]
    for b in base:
        for _ in range(25):
            w = b.split()
            for _ in range(rng.randint(0, 6)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            docs.append(" ".join(w))
    docs += ["", None, "one", "one two", "ONE two", "a b c d e", " a  b\tc d\ne ", "x " * 3000, "x " * 10, *base, *[base[0]] * 30]
    rows = list(enumerate(docs, 100)) + [(None, docs[3]), (None, "nobody knows this text at all"), (None, "nobody knows this text at all"), (101, docs[1])]
    df = spark.createDataFrame([(i, t, "k", 0) for i, t in rows], "doc_id long, text string, key string, n int").repartition(4)
    got = neardup.near_duplicates(df, similarity=similarity).collect()
    assert sorted(((r["id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute(rows, round(similarity * 100))
    for r in got:
        assert r["kept"] is None or r["kept"] == (r["id"] == r["component_id"])
    groups = {r["component_id"] for r in got if r["n_shingles"]}
    assert {r["component_id"] for r in got if r["chosen"] and r["n_shingles"]} == groups


def test_one_id_with_several_texts(spark):
    """Rows (1, A), (1, B), (2, A'), (3, B'): all are one component; so are chains of such ids."""
    rng = random.Random(11)
    vocabulary = [f"v{i}" for i in range(900)]
    base = [" ".join(rng.choices(vocabulary, k=120)) for _ in range(6)]
    near = lambda t: t.rsplit(" ", 1)[0] + " other"
    rows = [(1, base[0]), (1, base[1]), (2, near(base[0])), (3, near(base[1])), (7, base[2]), (9, base[2]), (9, base[3]), (12, near(base[3])), (20, base[4]), (21, base[5]), (20, None), (None, near(base[5]))]
    got = neardup.near_duplicates(spark.createDataFrame([(i, t) for i, t in rows], "doc_id int, text string").repartition(3)).collect()
    assert sorted(((r["id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute(rows, 80)
    assert sorted(r["id"] for r in got if r["chosen"] and r["n_shingles"]) == [1, 7, 20, 21]


def test_empty(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_a_chain(spark):
    n = 70
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(200, 201)], "u long, v long")
    got = {r["c"]: r["component"] for r in neardup.components(edges).collect()}
    assert got == {**dict.fromkeys(range(n + 1), 0), 200: 200, 201: 200}


def test_components_of_stars_take_no_round(spark, monkeypatch):
    """One table of edges; a round would write others."""
    made, cut = [], neardup.C.cut
    monkeypatch.setattr(neardup.C, "cut", lambda df: made.append(1) or cut(df))
    edges = spark.createDataFrame([(1, i) for i in range(2, 40)] + [(70 + i, 60) for i in range(20)] + [(60, 70), (5, 5)], "u long, v long")
    got = {r["c"]: r["component"] for r in neardup.components(edges).collect()}
    assert got == {**dict.fromkeys(range(1, 40), 1), 60: 60, **dict.fromkeys(range(70, 90), 60)}
    assert len(made) == 1
    assert neardup.components(edges.where("false")).count() == 0


def test_components_of_a_random_graph(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(-150, 150), rng.randrange(-150, 150)) for _ in range(170)]
    least = {c: c for e in edges if e[0] != e[1] for c in e}
    for _ in least:
        for u, v in edges:
            if u != v:
                least[u] = least[v] = min(least[u], least[v])
    got = [(r["c"], r["component"]) for r in neardup.components(spark.createDataFrame(edges, "u long, v long")).collect()]
    assert sorted(got) == sorted(least.items())


def test_bands_reach_the_threshold():
    for s in (0.7, 0.8, 0.85, 0.9):
        assert (1 - s**5) ** neardup.bands(s) <= 1e-6
