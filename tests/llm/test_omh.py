"""Order MinHash against a plain version, and the order of documents."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest

from runlens.llm import common as C
from runlens.llm import omh


def naive(text: str) -> list[int]:
    if not text:
        return []
    k = min(omh.K, len(text))
    grams = [text[i : i + k] for i in range(len(text) - k + 1)]
    base, full, seen, numbered = int(C._BASE), 2**64, {}, []
    for place, g in enumerate(grams):
        code = 0
        for c in g:
            code = (code * base + ord(c)) % full
        code = int(C.mix(np.array([code], np.uint64))[0])
        n = seen[g] = seen.get(g, -1) + 1
        x = int(C.mix(np.array([(code + n * int(omh._DRAW[0, -1])) % full], np.uint64))[0]) >> 32
        numbered.append((x, place, code))
    out = []
    for i in range(omh.HASHES):
        a, b = (int(omh._DRAW[0, i]) | 1) % 2**32, int(omh._DRAW[1, i]) % 2**32
        least = sorted(((x * a + b) % 2**32, place, code) for x, place, code in numbered)[: omh.PICK]
        e = 0
        for _, _, code in sorted(least, key=lambda t: t[1]):
            e = int(C.mix(np.array([(e * base + code) % full], np.uint64))[0])
        out.append(e >> 32)
    return out


@pytest.mark.parametrize("text", ["", "a", "abcdefg", "abcdefghi", "ananananananananananas", "Éçeau aianre 😀😀 leèvi leèvi leèvi leèvi", "x" * 60])
def test_fingerprint_is_the_plain_one(text):
    assert omh.fingerprint(text).tolist() == naive(text)


def test_order_matters():
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdefghij"), 7)) for _ in range(300)]
    a, shuffled = " ".join(words), " ".join(rng.permutation(words))
    moved = " ".join([*words[:-3], "new", "words"])
    assert omh.likeness(omh.fingerprint(a), omh.fingerprint(moved)) > 0.7 > omh.likeness(omh.fingerprint(a), omh.fingerprint(shuffled)) + 0.2


@pytest.mark.parametrize("range_rows", [3, 10_000])
def test_next_document(spark, range_rows):
    rows = [(i, None if i % 7 == 0 else "" if i % 5 == 0 else f"text {i} " * (i % 13), 1) for i in range(40)]
    rows += [(None, "nameless one", 1), (None, "nameless two", 1), (12, "a second twelve", 1), (13, rows[13][1], 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, range int").repartition(5)
    got = omh.with_next(df, range_rows=range_rows).collect()
    hashed = df.selectExpr("doc_id", "coalesce(text, '') as text", "xxhash64(coalesce(text, '')) as h").collect()
    order = sorted(hashed, key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0), r["h"], r["text"]))
    want = []
    for a, b in zip(order, order[1:] + order[:1], strict=True):
        changed = omh.edited(a["text"], b["text"])
        f, g, h = (omh.fingerprint(t) for t in (a["text"], changed, b["text"]))
        want.append((a["doc_id"], len(a["text"]), hashlib.sha256(changed.encode()).hexdigest(), omh.text_of(f), omh.text_of(g), omh.likeness(f, g), omh.likeness(f, h)))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)


def test_one_row_and_none(spark):
    one = omh.with_next(spark.createDataFrame([(5, "alone here")], "doc_id long, text string")).collect()
    assert [(r["id"], r["near_next"]) for r in one] == [(5, 1.0)]
    assert omh.with_next(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_fingerprints_column(spark):
    got = omh.fingerprints(spark.createDataFrame([("same", 1), ("same", 2), (None, 3)], "text string, fingerprint_ int")).orderBy("fingerprint_").collect()
    assert got[0]["fingerprint"] == got[1]["fingerprint"] and got[2]["fingerprint"] == ""
