from __future__ import annotations

import re

from runlens.llm import license as lic

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def places(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return len(w), [(i, label) for label, said in lic.PHRASES for i in range(len(w)) if w[i : i + len(said.split())] == said.split()]


TEXTS = [
    "Released under the MIT License.", "mit-license MIT  LICENSE mit license license", "GNU General Public License, version 3; general public general public license", None, "", "mit", "license mit",
    "the apache\nlicense and the mit, license", "x " * 3000 + "general public license", "Émit license mit é license", "general public general public license license",
]


def test_places_are_exact(spark):
    rows = [(i, t, "clash", 1) for i, t in enumerate(TEXTS)] + [(None, TEXTS[0], "c", 2), (0, TEXTS[0], "c", 3)]
    got = lic.licenses(spark.createDataFrame(rows, "doc_id long, text string, label string, rid int").repartition(3), keep=("doc_id", "label")).collect()
    assert len(got) == len(rows)
    for r in got:
        n, found = places(TEXTS[r["doc_id"] or 0])
        starts = [i for i, _ in found]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (n, len(found), min(starts, default=None), max(starts, default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in found})) and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1 and (r["score"] == 1) == bool(found) or r["labels"]


def test_sentences_survive_small_edits(spark):
    said = dict(reversed(x) for x in lic.SENTENCES)
    bsd = next(s for s in said if said[s] == "bsd").split()
    docs = {
        "whole": " ".join(bsd), "one word put in": " ".join([*bsd[:9], "really", *bsd[9:]]), "one word left out": " ".join(bsd[:8] + bsd[9:]), "half": " ".join(bsd[: len(bsd) // 2]), "none": "some other words entirely",
    }
    got = {r["doc_id"]: r for r in lic.licenses(spark.createDataFrame(list(docs.items()), "doc_id string, text string")).collect()}
    assert {k for k, r in got.items() if "bsd" in r["labels"].split(",")} == {"whole", "one word put in", "one word left out"}
    assert got["whole"]["score"] == 1 and 0.8 <= got["one word put in"]["score"] < 1 and got["half"]["score"] == 0 == got["none"]["score"]


def test_versions_exclude_each_other(spark):
    docs = {
        "gpl-2": "the GNU General Public License, version 2", "gpl-3": "the GNU General Public License, version 3", "gpl-2,gpl-3": "GNU General Public License version 2. Or the GNU General Public License version 3",
        "lgpl": "GNU Lesser General Public License version 3", "": "GNU General Public License version 1",
    }
    got = lic.licenses(spark.createDataFrame(list(docs.items()), "doc_id string, text string")).collect()
    assert {r["doc_id"]: r["labels"] for r in got} == {k: ",".join(x for x in ("gpl", k) if x) for k in docs}


def test_whole_license_texts(spark):
    words = [f"w{i}" for i in range(300)]
    docs = {"whole": words, "edited": [*words[:70], "new", *words[70:200], *words[201:]], "part": words[:200], "later": words[180:]}
    got = lic.licenses(spark.createDataFrame([(k, " ".join(w)) for k, w in docs.items()], "doc_id string, text string"), sentences=[("all", " ".join(words)), ("end", " ".join(words[180:]))]).collect()
    assert {r["doc_id"]: r["labels"] for r in got} == {"whole": "all,end", "edited": "all,end", "part": "", "later": "end"}
    assert {r["doc_id"]: r["score"] for r in got if r["doc_id"] in ("whole", "later")} == {"whole": 1, "later": 1}


def test_spans_don_t_drift_on(spark):
    """A sentence's pairs in order but far apart, each written twice, or shuffled, are not the sentence."""
    said = dict(reversed(x) for x in lic.SENTENCES)
    mit = next(s for s in said if said[s] == "mit-text").split()
    pairs = list(zip(mit, mit[1:], strict=False))
    docs = {
        "filler": " ".join(f"{a} {b} filler" for a, b in pairs), "twice": " ".join(f"{a} {b} {a} {b}" for a, b in pairs), "backwards": " ".join(f"{a} {b}" for a, b in reversed(pairs)),
        "shuffled": " ".join(f"{a} {b}" for i in range(0, len(pairs), 6) for a, b in pairs[i : i + 6][::-1]), "whole": "x y " + " ".join(mit) + " z",
    }
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in lic.licenses(spark.createDataFrame(list(docs.items()), "doc_id string, text string")).collect()}
    assert got == {"whole": ("mit-text", 1.0)} | dict.fromkeys(("filler", "twice", "backwards", "shuffled"), ("", 0.0))


def test_longest_chain(spark):
    import random

    rng = random.Random(1)
    rows = [([rng.randrange(12) for _ in range(rng.randrange(20))],) for _ in range(60)]
    got = [r[0] for r in spark.createDataFrame(rows, "p array<int>").select(lic._longest_chain(lic.F.col("p"))).collect()]
    for (p,), ends in zip(rows, got, strict=True):
        assert len(ends) == max(_best(p), default=0)


def _best(p):
    out = []
    for i, x in enumerate(p):
        out.append(1 + max((out[j] for j in range(i) if p[j] < x), default=0))
    return out


def test_empty(spark):
    assert lic.licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0
