"""Streaming queries over tables that are folders of files."""

from __future__ import annotations

from datetime import datetime

from runlens.plans import catalog, fixtures as fx


def test_streams_read_tables_that_are_folders(spark, tmp_path):
    d = str(tmp_path)
    put = lambda name, rows: spark.createDataFrame(rows, fx.TABLE_SCHEMAS[name]).repartition(2).write.parquet(f"{d}/{name}.parquet")
    put("conversations", [(c, t, "user" if t % 2 == 0 else "assistant", f"said {t}") for c in range(3) for t in range(4)])
    put("documents", [(i, "some text", "en", "s1", 9) for i in range(6)])
    put("labels", [(0, 1, 0)])
    chat = catalog.queries()["stream_b19_chat"](spark, d)
    assert sorted(r["thread_id"] for r in chat.collect()) == sorted(f"t{c}" for c in range(3) for _ in range(4))
    backlog = catalog.queries()["stream_n11_evaluator_backlog"](spark, d)
    assert sorted(tuple(r) for r in backlog.collect()) == [(str(i), '{"length": 9}') for i in range(1, 6)]


def test_arriving_batches_are_many_files_each(spark, tmp_path, monkeypatch):
    from runlens.plans import streams

    monkeypatch.setattr(streams, "_work", lambda s: str(tmp_path / "work"))
    kinds = ("view", "error", "purchase")
    rows = [(i, datetime(2024, 1, 1, 0, 0, i), i % 3, kinds[i % 3], 5.0, '{"k": 7}') for i in range(60)]
    spark.createDataFrame(rows, fx.TABLE_SCHEMAS["events"]).repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    got = {r["id"]: r for r in catalog.queries()["stream_b15_late"](spark, str(tmp_path)).collect()}
    want = {r["id"]: r for r in catalog.queries()["b13_run_fold"](spark, str(tmp_path)).collect()}
    assert len(got) == 60 and got == want
    files, batches = list((tmp_path / "work" / "in").glob("part-*")), list((tmp_path / "work" / "out").glob("batch=*"))
    assert len(batches) == 6 and len(files) == 6 * 3
