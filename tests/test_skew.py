"""Skew-safe building blocks against brute force."""

from __future__ import annotations

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from runlens import session
from runlens.operators import skew, trees


def rows(n=400, seed=7):
    rng = random.Random(seed)
    return [(rng.choice(["a", "a", "a", "b", None]), rng.randrange(50), i, rng.uniform(-5, 5)) for i in range(n)]


def frame(spark, data):
    return spark.createDataFrame(data, "k string, t int, id int, v double")


def chunk():
    return F.floor(F.col("t") / 7)


@pytest.mark.parametrize("cut", [chunk, lambda: None, lambda: 30])
def test_running_sum_and_numbers(spark, cut):
    data = rows()
    out = skew.running_sum(frame(spark, data), ["k"], ["t", "id"], {"s": F.col("v")}, cut())
    out = skew.numbered(out, ["k"], ["t", "id"], "rn", cut())
    got = {r.id: (round(r.s, 6), r.rn) for r in out.collect()}
    want = {}
    for key in ("a", "b", None):
        total = 0.0
        for n, (_, _, i, v) in enumerate(sorted((r for r in data if r[0] == key), key=lambda r: (r[1], r[2])), 1):
            total += v
            want[i] = (round(total, 6), n)
    assert got == want


@pytest.mark.parametrize("following", [False, True])
@pytest.mark.parametrize("cut", [chunk, lambda: None, lambda: 30])
def test_neighbours(spark, following, cut):
    data = rows()
    out = skew.with_neighbour(frame(spark, data), ["k"], ["t", "id"], {"other": F.col("id")}, following=following, chunk=cut())
    got = {r.id: r.other for r in out.collect()}
    want = {}
    for key in ("a", "b", None):
        ids = [r[2] for r in sorted((r for r in data if r[0] == key), key=lambda r: (r[1], r[2]))]
        for i, x in enumerate(ids):
            j = i + 1 if following else i - 1
            want[x] = ids[j] if 0 <= j < len(ids) else None
    assert got == want


def test_one_key_at_one_instant_is_cut_evenly(spark):
    """30 % of all rows with one key and one timestamp: no range has more than twice the median range's rows."""
    data = [("hot" if i % 10 < 3 else str(i % 700), 5 if i % 10 < 3 else i % 90, i, 1.0) for i in range(40_000)]
    cut = skew.cut_ranges(frame(spark, data), ["k"], ["t", "id"], 1_000)
    sizes = sorted(r["count"] for r in cut.where("k = 'hot'").groupBy("_k").count().collect())
    assert len(sizes) == 12 and sum(sizes) == 12_000 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
    assert cut.where("k <> 'hot'").select("_k.c").distinct().count() == 1
    got = {r.id: r.rn for r in skew.numbered(frame(spark, data), ["k"], ["t", "id"], "rn", 1_000).where("k = 'hot'").collect()}
    assert got == {x: n for n, x in enumerate(sorted(got), 1)}


def test_exact_percentiles_with_zero_and_negative_values(spark):
    rng = random.Random(3)
    values = [("x", rng.choice([0.0, rng.uniform(-100, 100), rng.uniform(-0.01, 0.01), 5.0])) for _ in range(501)] + [("y", 2.5)]
    points = [0.0, 0.25, 0.5, 0.9, 0.99, 1.0]
    out = skew.exact_percentiles(spark.createDataFrame(values, "k string, v double"), ["k"], "v", points).collect()
    got = {(r.k, r.p): r.value for r in out}
    for p in points:
        assert got[("x", p)] == pytest.approx(np.quantile([v for k, v in values if k == "x"], p), rel=1e-12, abs=1e-12)
        assert got[("y", p)] == 2.5


def test_neighbours_by_value_and_both_ways(spark):
    from runlens.operators.ordering import neighbours

    rng = random.Random(9)
    data = [(str(i), "p", rng.choice([0.0, 1.0, rng.uniform(0, 1000)])) for i in range(120)] + [("n", "p", None)]
    got = {r.id: (r.previous_id, r.next_id) for r in neighbours(spark.createDataFrame(data, "id string, project_id string, cost double"), sort="cost").collect()}
    ids = [x[0] for x in sorted(data, key=lambda r: (r[2] is not None, r[2] or 0, r[0]))]
    want = {x: (ids[i - 1] if i else None, ids[i + 1] if i + 1 < len(ids) else None) for i, x in enumerate(ids)}
    assert got == want


def test_ordered_lists_keep_order_and_every_item(spark):
    d = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), *[("b", i, str(i)) for i in range(12_000)]], "k string, o int, v string").repartition(3)
    got = {r.k: (r.l, r.l_size) for r in skew.ordered_lists(d, ["k"], F.col("v"), F.col("o"), "l").collect()}
    assert got == {"a": (["x", "y"], 2), "b": ([str(i) for i in range(12_000)], 12_000)}


def test_parts_hold_every_item_in_order(spark):
    """A key with most rows, at one instant: no part holds more than its items, and parts in order are the list."""
    data = [("hot", 1, i, f"v{i}") for i in range(5_000)] + [(f"k{i % 40}", i % 3, i, f"v{i}") for i in range(200)] + [(None, 1, 7, "n")]
    d = spark.createDataFrame(data, "k string, t int, id int, v string").repartition(6)
    rows = skew.ordered_parts(d, ["k"], F.col("v"), ["t", "id"], "l", items=300, chunk=800).collect()
    assert max(len(r.l) for r in rows) == 300 and all(r.l_size == len(r.l) for r in rows)
    got: dict = {}
    for r in sorted(rows, key=lambda r: (str(r.k), r.part)):
        got.setdefault(r.k, []).extend(r.l)
    assert got == {k: [v for *_, v in sorted((x for x in data if x[0] == k), key=lambda x: x[1:3])] for k in {x[0] for x in data}}
    base = spark.createDataFrame([("hot",), ("k1",), ("none",)], "k string")
    joined = skew.beside_parts(base, ["k"], skew.ordered_parts(d, ["k"], F.col("v"), ["t", "id"], "l", items=2_500), skew.ordered_parts(d.where("id < 3"), ["k"], F.col("id"), ["id"], "m")).collect()
    assert sorted((r.k, r.part, r.l_size, r.m_size) for r in joined) == [("hot", 0, 2500, 3), ("hot", 1, 2500, None), ("k1", 0, 5, 1), ("none", 0, None, None)]


def test_trees_survive_depth_missing_parents_and_cycles(spark):
    chain = [(str(i), str(i - 1) if i else None) for i in range(140)]
    odd = [("orphan", "gone"), ("c1", "c2"), ("c2", "c1")]
    runs = spark.createDataFrame(chain + odd, "id string, parent_run_id string")
    got = {r.id: (r.root_id, r.depth) for r in trees.roots(runs).collect()}
    want = {str(i): ("0", i) for i in range(140)} | {"orphan": ("orphan", 0)}
    assert got == want
    assert {r.id for r in trees.cycles(runs).collect()} == {"c1", "c2"}
    deep = {r.id: r.v for r in trees.fold_up(runs, F.when(F.col("id") == "0", "top"), "v").collect()}
    assert all(deep[str(i)] == "top" for i in range(140)) and deep["orphan"] is None
    near = {r.id: r.v for r in trees.fold_up(runs, F.when(F.col("id") == "0", "top"), "v", within=5).collect()}
    assert {i for i in near if near[i]} == {str(i) for i in range(6)}


def test_descendants_of_chosen_runs(spark):
    runs = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("x", None), ("p", "q"), ("q", "p")], "id string, parent_run_id string")
    starts = runs.where("id in ('a', 'b', 'p')").select("id")
    got = {(r.root_id, r.id, r.depth) for r in trees.descendants(runs, starts).collect()}
    assert got == {("a", "a", 0), ("a", "b", 1), ("a", "c", 2), ("b", "b", 0), ("b", "c", 1), ("p", "p", 0), ("p", "q", 1)}


def test_trace_lines_keep_unnamed_runs_and_escape(spark):
    runs = spark.createDataFrame([("a", None), ("b", "a"), ("c", "a"), ("z", None)], "id string, parent_run_id string")
    runs = runs.selectExpr("*", "'llm' as type", "'n\"q' as name", "'success' as status", "timestamp_seconds(1) as created_at", "cast(null as string) as input", "cast(null as string) as output")
    full = traces(trees.trace_lines(runs))
    assert [c["id"] for c in full["a"]["children"]] == ["b", "c"] and full["z"]["name"] == 'n"q'
    assert trees.node_paths(runs).count() == 4
    odd = runs.union(spark.createDataFrame([("d", "c")], "id string, parent_run_id string").selectExpr("*", "'llm'", "'line\\nbreak'", "'success'", "timestamp_seconds(1)", "'__NOT_INGESTED__'", "null"))
    odd = odd.withColumn("name", F.when(F.col("id") != "c", F.col("name")))
    c = traces(trees.trace_lines(odd))["a"]["children"][1]
    assert c["name"] is None and c["children"][0]["name"] == "line\nbreak" and c["children"][0]["status"] == "filtered"


def traces(lines):
    import json
    from itertools import groupby

    rows = sorted(lines.collect(), key=lambda r: (r.root_id, r.place))
    assert [r.place for _, g in groupby(rows, lambda r: r.root_id) for r in g] == [i for _, g in groupby(rows, lambda r: r.root_id) for i, _ in enumerate(g)]
    return {root: json.loads("".join(r.line for r in g)) for root, g in groupby(rows, lambda r: r.root_id)}


def test_a_trace_of_a_third_of_all_runs(spark, monkeypatch):
    """One trace of 500 runs among 1 000 others: a chain with a hub below it, cut into ranges of 50; and a missing parent."""
    monkeypatch.setattr(skew, "RANGE_ROWS", 50)
    rng = random.Random(4)
    data = [("t0", None, 0)] + [(f"t{i}", f"t{i - 1}" if i < 200 else "t150" if i < 400 else f"t{rng.randrange(i)}", rng.randrange(5)) for i in range(1, 500)]
    data += [(f"o{i}", None if i % 4 == 0 else f"o{i - i % 4}" if i % 3 else "gone", i % 7) for i in range(1000)]
    runs = spark.createDataFrame(data, "id string, parent_run_id string, at int").repartition(5)
    runs = runs.selectExpr("id", "parent_run_id", "'llm' as type", "'n' as name", "'s' as status", "timestamp_seconds(at) as created_at", "'' as input", "'' as output")
    known, kids = {r[0] for r in data}, {}
    for r in data:
        kids.setdefault(r[1] if r[1] in known else None, []).append(r)

    def nest(r):
        return {"id": r[0], "type": "llm", "name": "n", "status": "s", "children": [nest(k) for k in sorted(kids.get(r[0], []), key=lambda k: (k[2], k[0]))]}

    assert traces(trees.trace_lines(runs)) == {r[0]: nest(r) for r in kids[None]}
    assert trees.trace_lines(runs.where("false")).count() == 0


def test_event_log_reads_what_a_batch_touches(spark, tmp_path):
    """A long history: the same small batch reads about as much after 60 batches as after 4, and every event of its keys."""
    from pyspark.sql import types as T

    from runlens.streaming.log import EventLog

    schema = T.StructType().add("run_id", "string").add("n", "long")
    log = EventLog(spark, str(tmp_path / "log"), "run_id", schema, fan=2, buckets=8)
    rows, read, all_bytes = [], {}, {}
    ids = spark.createDataFrame([("r3",), ("r17",)], "run_id string")
    for i in range(33):
        new = [(f"r{(i * 977 + j * 13) % 5000}", i * 100 + j) for j in range(100)] + ([("r3", -i)] if i % 5 == 0 else [])
        rows += new
        log.append(spark.createDataFrame(new, schema), i)
        if i == 9:
            log.append(spark.createDataFrame(new, schema), i)  # a retried batch
        if i + 1 in (4, 8, 16, 32, 33):
            got = sorted(tuple(r) for r in log.events_of(ids, i + 1).collect())
            assert got == sorted(r for r in rows if r[0] in ("r3", "r17"))
            read[i + 1] = log.bytes_for(ids, i + 1)
            all_bytes[i + 1] = sum(n for s in log.segments(i + 1) for _, n in log.paths(s, None))
    assert all_bytes[32] > 5 * all_bytes[4] and read[32] < 1.5 * read[4] and read[33] < 3 * read[4]
    assert log.segments(33) == [(5, 0), (0, 32)] and EventLog(spark, "", "k", schema).segments(27) == [(2, 0), (1, 16), (1, 20), (0, 24), (0, 25), (0, 26)]


@pytest.mark.parametrize(("minutes", "slide"), [(60, 1), (30, 30), (6, 2)])
def test_sliding_percentiles(spark, minutes, slide):
    rng = random.Random(12)
    data = [(rng.choice("ab"), rng.randrange(0, 90 * 60), rng.choice([0.0, 1.0, rng.uniform(-3, 50)])) for _ in range(400)] + [("a", -50, 2.0), ("a", 30, None), ("c", 86_400, 7.0)]
    df = spark.createDataFrame(data, "k string, s long, v double").withColumn("at", F.timestamp_seconds("s"))
    points = [0.0, 0.5, 0.9, 1.0]
    got = {(r.k, int(r.window_end.timestamp()), r.p): r.value for r in skew.sliding_percentiles(df, ["k"], "at", "v", points, minutes, slide).collect()}
    want = {}
    for key in "abc":
        own = [(s, v) for k, s, v in data if k == key and v is not None]
        for end in {(s // (slide * 60) + 1 + i) * slide * 60 for s, _ in own for i in range(minutes // slide)}:
            values = [v for s, v in own if end - minutes * 60 <= s < end]
            want.update({(key, end, p): float(np.quantile(values, p)) for p in points})
    assert got.keys() == want.keys() and all(got[x] == pytest.approx(want[x], rel=1e-9, abs=1e-12) for x in want)
    with pytest.raises(ValueError, match="whole number"):
        skew.sliding_percentiles(df, ["k"], "at", "v", points, 5, 2)


def test_csv_records_over_many_splits(spark, tmp_path):
    """Fields with quotes, separators and line breaks, in splits of a few hundred bytes: as one task reads them."""
    import csv as plain

    from runlens.sources import datasets as imports

    rng = random.Random(3)
    said = lambda: "".join(rng.choice(["a", "b ", '"', ",", "\n", "é", "\n\n", "x" * 30]) for _ in range(rng.randrange(1, 14))).strip() or "z"
    for name in ("one", "two"):
        with open(tmp_path / f"{name}.csv", "w", newline="", encoding="utf-8") as f:
            w = plain.writer(f, lineterminator="\n")
            w.writerow(["Input", "expected_output", "other"])
            w.writerows([said(), said() if i % 3 else "", i] for i in range(300))
            f.write("\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "400")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        records = imports.csv_records(spark, str(tmp_path))
        assert records.select("at").distinct().count() > 20
        got = sorted((tuple(r) for r in imports.read_csv_items(spark, str(tmp_path)).collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    whole = imports.items_from_rows(spark.read.csv(str(tmp_path), header=True, quote='"', escape='"', multiLine=True, mode="FAILFAST"))
    assert got == sorted((tuple(r) for r in whole.collect()), key=str) and len(got) == 600


def test_csv_records_shuffle_no_text(spark, tmp_path):
    """Records that lie in one split, over lines or not, are read in place; one that crosses splits, whole ones too, is joined."""
    from runlens.sources import datasets as imports

    long = "\n".join(["", '""', "x" * 900, " ", "", "y" * 900, ",", ""])
    (tmp_path / "one.csv").write_text("\n  \ninput,output\n" + f'a,"b\n\n""c"""\n\n"{long}",d\n \n' + "e,f\n" * 40 + '"' + "\n" * 700 + '"' + ",g")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        records = imports.csv_records(spark, str(tmp_path))
        got = [tuple(r) for r in imports.read_csv_items(spark, str(tmp_path)).collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert "Exchange" not in records._jdf.queryExecution().executedPlan().toString()
    said = long.replace('""', '"')
    assert [(r[0], r[2]) for r in got] == [("a", 'b\n\n"c"'), (said, "d"), *[("e", "f")] * 40, ("\n" * 700, "g")]


@pytest.mark.parametrize("ascending", [True, False])
def test_far_pages(spark, ascending):
    """Every page sought by key is that of a whole sort: frequent values, nulls, ties, the end and beyond."""
    from runlens.operators import ordering

    rng = random.Random(5)
    data = [(f"r{i:04}", None if i % 11 == 0 else 5.0 if i % 3 == 0 else round(rng.uniform(0, 9), 1)) for i in range(900)]
    df = spark.createDataFrame(data, "id string, cost double").repartition(5)
    some = sorted((r for r in data if r[1] is not None), key=lambda r: (r[1] if ascending else -r[1], r[0]))
    want = [r[0] for r in some + sorted(r for r in data if r[1] is None)]
    for page in (0, 3, 7, 12, 17, 18, 40):
        for near in (0, 100, 10_000):
            got = [r.id for r in ordering.page_of_runs(df, "cost", ascending, page, 50, near=near, bins=8).collect()]
            assert got == want[page * 50 : page * 50 + 50], (page, near)
    assert ordering.page_of_runs(df.where("false"), "cost", ascending, 3, 50, near=0).count() == 0


def test_replicated_changes(spark, tmp_path):
    """Updates, deletions and late old versions over many batches; a batch that runs twice changes nothing."""
    from runlens.streaming import sinks

    rng = random.Random(8)
    schema = "id string, updated_at long, is_deleted boolean, v string"
    batches = [[(f"k{rng.randrange(30)}", rng.randrange(50), rng.random() < 0.2, f"b{b}r{i}") for i in range(25)] for b in range(6)]
    source = str(tmp_path / "in")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(source)
    files = sorted((tmp_path / "in").glob("part-*"), key=lambda f: f.stat().st_mtime_ns)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(source)
    path, check = str(tmp_path / "table"), str(tmp_path / "check")
    sinks.replicate_changes(stream, path, check, buckets=4).awaitTermination()
    assert len(files) == 6
    latest = {}
    for rows in batches:
        for k, at, gone, v in rows:
            latest.setdefault(k, []).append((at, gone, v))
    got = {r.id: (r.updated_at, r.v) for r in sinks.current(spark, path).collect()}
    want = {k: max((at, gone) for at, gone, _ in rows) for k, rows in latest.items()}
    assert {k: at for k, (at, _) in got.items()} == {k: at for k, (at, gone) in want.items() if not gone}
    assert all((got[k][0], False, got[k][1]) in latest[k] for k in got)
    before = sorted(map(tuple, sinks.current(spark, path).collect()))
    last = max((tmp_path / "check" / "commits").glob("[0-9]*"), key=lambda f: int(f.name))
    for f in (last, last.with_name(f".{last.name}.crc")):
        f.unlink(missing_ok=True)  # as if the job had died before its last commit
    sinks.replicate_changes(stream, path, check, buckets=4).awaitTermination()
    assert sorted(map(tuple, sinks.current(spark, path).collect())) == before


class _Cluster:
    """A session on a master that is no local one."""

    class conf:
        get = staticmethod(lambda key, default=None: default)

    class sparkContext:
        master = "local-cluster[2,1,1024]"
        getConf = staticmethod(lambda: _Cluster.conf)
        getCheckpointDir = staticmethod(lambda: None)


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(_Cluster)


def test_released_folders_are_gone(spark):
    session.cut_lineage(spark.range(3))
    path = session._MADE[-1]
    assert os.path.isdir(path.removeprefix("file:"))
    assert session.release(spark) >= 1 and not os.path.exists(path.removeprefix("file:")) and not session._MADE
