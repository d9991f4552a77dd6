from __future__ import annotations

import hashlib
import re

import numpy as np

from runlens.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items):
    w, hit, names = split(text), set(), set()
    for item, said in items:
        v = split(said)
        n = min(10, len(v))
        for s in range(len(v) - n + 1) if n else ():
            for d in range(len(w) - n + 1):
                if w[d : d + n] == v[s : s + n]:
                    hit |= set(range(d, d + n))
                    names.add("" if item is None else str(item))
    return len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)


def test_against_brute_force(spark):
    long = " ".join(f"w{i}" for i in range(40))
    items = [(1, long), (2, "Ein KURZER Satz"), (10, "ein kurzer satz"), (3, None), (None, "éa ß"), (4, ""), (5, "w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 tail"), (2, "Ein KURZER Satz"), (6, "same same same same")]
    docs = [
        (1, f"before {long} after"), (2, "w1 w2 w3 w4 w5 w6 w7 w8 w9 x w10"), (3, "ein, kurzer: SATZ! ein kurzer satz"), (4, None), (5, ""), (6, "same " * 9), (7, "w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 w15"),
        (8, "éa ß"), (9, "É a ß"), (None, long), (1, "w30 w31 w32 w33 w34 w35 w36 w37 w38 w39"), (11, "x " * 5000 + long), (12, "kurzer satz ein"),
    ]
    df = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, rid string").repartition(3)
    got = decontam.contamination(df, spark.createDataFrame(items, "item_id long, text string"), keep=("doc_id", "rid")).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got), key=key) == sorted(((d, *brute(t, items)) for d, t in docs), key=key)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert [r["contaminated"] for r in decontam.contamination(docs, items.where("false")).collect()] == [False]
    assert decontam.contamination(docs.where("false"), items).count() == 0


def test_code_filter_is_not_a_job_per_partition(spark):
    """However many partitions hold the filter's slices, the driver starts a few jobs."""
    from runlens.llm import common as C

    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.sparkContext.setJobGroup("code filter", "")
    try:
        packed = C.code_filter(spark.range(1000).selectExpr("xxhash64(id) AS code"))
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("code filter"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in held.items():
            spark.conf.set(k, v)
    codes = np.array([r[0] for r in spark.range(1000).selectExpr("xxhash64(id)").collect()], np.int64).view(np.uint64)
    assert C.may_hold(C.unpacked(packed), codes).all() and not C.may_hold(C.unpacked(packed), codes + np.uint64(1)).all()
    assert jobs < 20
