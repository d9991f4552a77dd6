"""Batches of text pairs in slices of bounded size; scores that are computed once."""

from __future__ import annotations

import pyarrow as pa

from runlens.functions import similarity as S
from runlens.plans import catalog, fixtures as fx


def test_overlaps_are_counted_in_slices(monkeypatch):
    ref = pa.array([["a", "b", "a"], None, [], ["c"] * 9, ["x", "y"]] * 3)
    hyp = pa.array([["a", "a", "c"], ["a"], None, ["c", "d"], ["y", "y", "z"]] * 3)
    whole, sizes, counts = S._overlap.func(ref, hyp), [], S._counts
    monkeypatch.setattr(S, "SLICE_TOKENS", 12)
    monkeypatch.setattr(S, "_counts", lambda sides: (sizes.append(sum(len(x.flatten()) for x in sides)), counts(sides))[1])
    assert S._overlap.func(ref, hyp).to_pylist() == whole.to_pylist() and len(sizes) > 3 and max(sizes) <= 12 + 11
    assert whole.to_pylist()[0] == {"hits": 2, "ref_size": 3, "hyp_size": 3, "dot": 4.0, "ref_sq": 5.0, "hyp_sq": 5.0}
    assert S._overlap.func(ref.slice(0, 0), hyp.slice(0, 0)).to_pylist() == []


def test_subsequences_take_one_pair_at_a_time():
    got = S._lcs.func(pa.array(["a b c", None, "x y"]), pa.array(["b c d", "a", "y x y"]))
    assert got.to_pylist() == [2, 0, 2]


def test_toxicity_is_scored_once(spark, tmp_path):
    put = lambda name, rows: spark.createDataFrame(rows, fx.TABLE_SCHEMAS[name]).write.parquet(f"{tmp_path}/{name}.parquet")
    put("documents", [(i, f"{'bad' if i % 2 else 'fine'} words {i}", "en", "s", 9) for i in range(40)])
    put("labels", [(i, i % 2, i % 2) for i in range(40)])
    out = catalog.queries()["n6_toxicity"](spark, str(tmp_path))
    assert out.count() == 40 and "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()
