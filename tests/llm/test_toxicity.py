from __future__ import annotations

import random

import numpy as np

from runlens.llm import toxicity as T


def corpus(n=300):
    rng = random.Random(4)
    calm = [f"calm{i}" for i in range(60)]
    rows, labels = [], []
    for i in range(n):
        words = rng.choices(calm, k=30)
        toxic = i % 5 == 0
        if toxic:
            words[rng.randrange(30)] = rng.choice(["idiot", "trash", "loser", "Idiot,", "grolbix", "grolbane"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_chain(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1.0 as toxicity_")
    chain = T.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert chain.names == ("insult", "contempt", "disgust", "toxic") and len(chain.chosen) <= 256
    assert [len(w) - len(chain.chosen) for w in chain.weights] == [1, 2, 3, 4]  # each sees those before it, and an intercept
    new = [(1, "calm1 calm2 you idiot"), (2, "calm1 calm2 calm3"), (3, None), (4, ""), (5, "calm3 grolbicious calm9"), (None, "calm1 calm2 you idiot"), (6, "calm1 " * 100_000 + "trash")]
    got = {r["doc_id"]: r["toxicity"] for r in T.toxicity(spark.createDataFrame(new, "doc_id long, text string"), chain).collect()}
    assert got[1]["toxic"] > 0.5 > got[2]["toxic"] and got[1] == got[None] and got[3] == got[4] and got[5]["toxic"] > 0.5 and got[6]["toxic"] > 0.5
    assert got[1]["insult"] > max(got[1]["contempt"], got[2]["insult"])


def test_later_models_learn_from_unseen_opinions():
    rng = np.random.default_rng(1)
    x = (rng.random((90, 3)) < 0.5).astype(float)
    y = np.column_stack([x[:, 0], x[:, 0]])
    first, second = T.fit(x, y, np.arange(90) % 3)
    assert first[0] > 1 and second[3] > 1


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    chain = T.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert all(r["toxicity"]["toxic"] < 1e-9 for r in T.toxicity(docs, chain).collect())
    assert T.toxicity(docs.where("false"), chain).count() == 0
