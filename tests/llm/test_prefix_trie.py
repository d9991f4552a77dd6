"""The trie against a plain one, with components split down to single nodes and scans cut into short ranges."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from runlens.llm import prefix_trie as T

SCHEMA = "conv_id long, turn long, role string, text string, conv string, w int"


def rebuilt(rows, block=20, most=4):
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % most for c in own}
    return {c: own.get(c - c % block, [])[: h[c]] + own[c][h[c] :] for c in own}


def plain(convs):
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for key in nodes:
        if key:
            kids.setdefault(key[:-1], []).append(key)
    sums = {}
    for key in sorted(nodes, key=len, reverse=True):
        words = len(key[-1][1].translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ")) - key[-1][1].translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ").count("") if key else 0
        below = [sums[k] for k in kids.get(key, [])]
        sums[key] = (sum(x[0] for x in below) or 1, (len(nodes[key]) - 1) * words + sum(x[1] for x in below))
    out = []
    for key, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(convs[c]) == len(key))
        out.append((min(members), len(key), min(nodes[key[:-1]]) if key else None, len(members), len(kids.get(key, [])), *sums[key], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(spark, rows):
    df = spark.createDataFrame([(*r, "x", 9) for r in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in T.prefix_trie(*T.shared_openings(T.ordered_turns(df))).collect()), key=str)


def some(n, seed, deep=0, copies=0):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.randrange(1, 7)):
            rows.append((c, t if rng.random() > 0.05 else None, rng.choice(["user", "assistant", None, ""]), rng.choice(["a", "b c", "", None, " d\te \n", "é　x"])))
    rows += [(500, i, "user", f"t {i % 3}") for i in range(deep)]
    rows += [(500 + 20 * (c % 3) + c, i, "user", "same" if i < 2 or c % 4 else f"own {c}") for c in range(1, copies) for i in range(4)]
    return rows


@pytest.mark.parametrize(("small", "span", "pack", "rows"), [
    (1, 7, 2, some(40, 1, deep=45, copies=30)),
    (5, 1000, 1024, some(60, 2, deep=20, copies=40)),
    (512, 1000, 3, some(80, 3)),
], ids=["single nodes", "small components", "at once"])
def test_against_a_plain_trie(spark, monkeypatch, small, span, pack, rows):
    monkeypatch.setattr(T, "SMALL", small)
    monkeypatch.setattr(T, "RANGE", span)
    monkeypatch.setattr(T, "PACK", pack)
    assert got(spark, rows) == plain(rebuilt(rows))


def test_repeats_ties_nulls_and_turnless(spark):
    rows = [(None, 0, "user", "x"), (0, 1, "b", "y"), (0, 1, "a", "z"), (0, 1, "a", "z"), (3, 0, "user", "gone"), (23, 0, "u", "v"), (41, None, None, None), (60, 0, "q", "long " * 200_000)]
    convs = rebuilt(rows)
    assert any(not v for v in convs.values())  # one without turns
    assert got(spark, rows) == plain(convs)


def test_empty(spark):
    assert got(spark, []) == []
