from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from runlens.llm import mixing


def water(sizes, weights, share=1.5, cap=2):
    """Targets by sharing out again and again."""
    target, open_ = dict.fromkeys(sizes, 0.0), set(sizes)
    left = share * sum(sizes.values())
    while open_:
        w = sum(weights[s] for s in open_)
        over = {s for s in open_ if left * weights[s] / w > cap * sizes[s] + 1e-9}
        if not over:
            for s in open_:
                target[s] = left * weights[s] / w
            break
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def docs(seed=3):
    rng = random.Random(seed)
    rows = [(i, " ".join("w" * rng.randint(1, 3) for _ in range(rng.randint(0, 400))), rng.choice(["b", "a", "a", "a", "Z", "é", None, "tiny"][: 7 if i % 150 else 8]), "clash") for i in range(600)]
    return [*rows, (None, "one two", "a", "x"), (None, "one two", "a", "x"), (3, None, "b", "x"), (9000, "", None, "x")]


def run(spark, rows, **args):
    return mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string, digest string").repartition(4), **args).collect()


def check(rows, got):
    sizes: dict = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = water(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)})
    assert len(got) == len(rows)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    return {s: (taken[s], want[s]) for s in sizes}


def test_targets_are_met(spark):
    rows = docs()
    for args, slack in (({}, 40), ({"shard_words": 3000, "shard_rows": 20}, 40 * 40), ({"block": 1}, 2)):
        for s, (taken, want) in check(rows, run(spark, rows, **args)).items():
            assert abs(taken - want) <= slack, (args, s, taken, want)


def test_reruns_agree(spark):
    key = lambda r: str(r)
    assert sorted(run(spark, docs(), shard_words=5000), key=key) == sorted(run(spark, list(reversed(docs())), shard_words=5000), key=key)


def test_seats_go_by_highest_quotients(spark):
    rng = random.Random(9)
    units = [(g, f"u{i}", rng.choice([0, 1, 1, 3, 7, 50, 400])) for g, n in (("x", 40), ("y", 3), ("z", 1)) for i in range(n)]
    seats = {"x": 97, "y": 5, "z": 4}
    d = spark.createDataFrame([(*u, seats[u[0]]) for u in units], "g string, k string, w long, s long")
    got = {(r["g"], r["k"]): r["won"] for r in mixing.apportion(d, ["g"], ["g", "k"], "w", "s").collect()}
    want = dict.fromkeys(((g, k) for g, k, _ in units), 0)
    for g, n in seats.items():
        if not any(w for h, _, w in units if h == g):
            continue
        for _ in range(n):
            best = min(((h, k, w) for h, k, w in units if h == g), key=lambda u: (-u[2] / (2 * want[u[0], u[1]] + 1), u[1]))
            want[best[0], best[1]] += 1
    assert got == want


def test_empty(spark):
    assert run(spark, [(1, None, None, "")])[0]["taken"] == 0
    d = spark.createDataFrame([], "doc_id long, text string, source string").withColumn("n", F.lit(1))
    assert mixing.mix(d).count() == 0
