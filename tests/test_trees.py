"""What the tree operators write, and traces as lines of JSON."""

from __future__ import annotations

import json

from runlens.operators import trees
from runlens.sources import export


def runs_of(spark, data):
    runs = spark.createDataFrame(data, "id string, parent_run_id string")
    return runs.selectExpr("*", "'llm' as type", "'n' as name", "'s' as status", "timestamp_seconds(1) as created_at", "'' as input", "'' as output")


def test_doubling_rounds_write_runs_with_children_only(spark, monkeypatch):
    written = []
    cut = trees.cut_lineage
    monkeypatch.setattr(trees, "cut_lineage", lambda df: (out := cut(df), written.append(out.count()))[0])
    runs = runs_of(spark, [(f"{i:03}", f"{i // 4:03}" if i else None) for i in range(400)])
    assert trees.preorder(runs).count() == 400 and sum(written) < 4 * 400 + 15 * 100
    written.clear()
    assert trees.roots(runs).where("root_id = '000'").count() == 400 and sum(written) < 400 + 6 * 100


def test_roots_of_repeated_runs_are_as_by_plain_joins(spark):
    """Every run comes twice: a row for each way up, twice the run times twice its parent a step."""
    data = [("a", None), ("b", "a"), ("c", "b"), ("x", "gone")]
    got = sorted(tuple(r) for r in trees.roots(runs_of(spark, data * 2).select("id", "parent_run_id")).collect())
    assert got == sorted([("a", "a", 0)] * 2 + [("b", "a", 1)] * 4 + [("c", "a", 2)] * 16 + [("x", "x", 0)] * 2)


def test_a_trace_is_one_line_of_the_export(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(export, "PART_ITEMS", 2)
    runs = runs_of(spark, [("a", None), ("b", "a"), ("c", "a"), ("d", "b"), ("e", "c"), ("z", None)])
    export.export_runs(runs, str(tmp_path / "out"), "jsonl", "trace", fields=("name",))
    node = lambda i, *kids: {"id": i, "name": "n", "children": list(kids)}
    got = [json.loads(r[0]) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert sorted(got, key=lambda t: t["id"]) == [node("a", node("b", node("d")), node("c", node("e"))), node("z")]
