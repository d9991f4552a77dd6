"""The pipeline on a small corpus with planted cases, against plain versions of its stages."""

from __future__ import annotations

import random

import corpus_pipeline as P
import pytest

from test_decontam import brute as contaminated
from test_mixing import water
from test_neardup import brute as components

ITEM = "twelve quite unusual benchmark words stand here in a row of their own"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    words = [f"calm{i}" for i in range(300)]
    prose = lambda n: "\n".join(" ".join(rng.choices(words, k=12)).capitalize() + "." for _ in range(n))
    rows, labels = [], []
    for i in range(240):
        text, toxic, good = prose(5), 0, 1
        if i % 6 == 1:
            text, toxic = text.replace(" ", " idiot ", 1), 1
        elif i % 6 == 2:
            text, good = text.upper().replace(" ", "!! "), 0
        elif i % 24 == 3:
            text = text + "\n" + ITEM + "."
        rows.append((i, text, "en", f"s{i % 3}", len(text), "extra"))
        labels.append((i, good, toxic))
    for i in range(0, 60, 6):  # near copies, a whole row twice, ids that are null
        text = rows[i][1].rsplit(" ", 1)[0] + " end."
        rows.append((1000 + i, text, "en", "s1", len(text), "copy"))
    rows += [rows[4], (None, None, None, None, None, None), (None, rows[5][1] + " tail", "en", None, 1, None), (2000, "", "en", "s0", 0, "e"), (2001, None, "de", "s2", None, "n")]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, toxicity string").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([*labels, (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def ids(rows):
    return sorted(str(r["doc_id"]) for r in rows)


def test_stages(spark, folder, tmp_path):
    assert [n for n, _ in P.STAGES] == ["toxicity", "quality", "near_duplicates", "decontamination", "mixing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    given = docs.collect()
    for name, stage in P.STAGES:
        out = stage(spark, docs, folder)
        if name != "mixing":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        left = out.collect()
        if name == "toxicity":
            assert ids(left) == ids(r for r in given if "idiot" not in (r["text"] or ""))
        elif name == "quality":
            assert ids(left) == ids(r for r in given if "!!" not in (r["text"] or ""))
        elif name == "near_duplicates":
            found = components([(r["doc_id"], r["text"]) for r in given], 80)
            groups = {(c if n else ("alone", i)) for i, (d, n, c) in enumerate(found)}
            assert len(left) == len(groups) and len(left) < len(given)
            assert ids(left) == ids([*({"doc_id": c} for c in {c for _, n, c in found if n}), *({"doc_id": d} for d, n, _ in found if not n)])
        elif name == "decontamination":
            assert ids(left) == ids(r for r in given if not contaminated(r["text"], [(1, ITEM), (2, None)])[-1]) and len(left) < len(given)
        else:
            sizes: dict = {}
            for r in given:
                sizes[r["source"]] = sizes.get(r["source"], 0) + len((r["text"] or "").split())
            order = sorted(sizes, key=lambda s: (s is None, s or ""))
            want = water(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)})
            assert ids(left) == ids(given) and all(abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, r["target"]) and 0 <= r["taken"] <= 2 * r["size"] for r in left)
        docs, given = out, left
    assert ids(P.run(spark, folder).collect()) == ids(given)


def test_empty_tables(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").where("false").write.parquet(f"{tmp_path}/{t}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
    for name, stage in P.STAGES[:2]:
        assert stage(spark, docs, str(tmp_path)).count() == docs.count(), name


@pytest.mark.parametrize("kind", ["int", "long", "smallint"])
def test_contaminated_rows_go_whatever_the_type_of_ids(spark, folder, kind):
    docs = spark.createDataFrame([(i, f"{ITEM} {i}" if i % 2 else f"nothing of that kind {i}", i) for i in range(40)] + [(None, ITEM, 1), (None, None, 2)], "doc_id long, text string, _id int")
    docs = docs.withColumn("doc_id", docs["doc_id"].cast(kind))
    left = P.drop_contaminated(spark, docs, folder)
    assert left.schema == docs.schema and sorted(str(r["doc_id"]) for r in left.collect()) == sorted([*(str(i) for i in range(0, 40, 2)), "None"])
    empty = P.drop_contaminated(spark, docs.where("false"), folder)
    assert empty.count() == 0
