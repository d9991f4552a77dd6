"""Trailing metrics over gaps."""

from __future__ import annotations

from datetime import datetime, timedelta

from runlens.operators import alerts


def test_every_minute_of_a_gap_has_a_value(spark):
    first, last = datetime(2024, 1, 1, 23, 58), datetime(2024, 1, 4, 0, 1)
    rows = [("p", first, "e", 1.0, None), ("p", last, None, 2.0, None), ("q", last, None, 3.0, None)]
    runs = spark.createDataFrame(rows, "project_id string, created_at timestamp, error string, cost double, feedback string")
    for name, at_first in (("error_rate", 100.0), ("cost", 1.0), ("feedback", 0.0)):
        got = {(r["project_id"], r["window_end"]): r["value"] for r in alerts.metric(runs, ["project_id"], name, 5).collect()}
        minutes = int((last - first) / timedelta(minutes=1)) + 5
        assert sorted(t for p, t in got if p == "p") == [first + timedelta(minutes=i + 1) for i in range(minutes + 1)]
        assert got["p", first + timedelta(minutes=5)] == at_first and got["p", datetime(2024, 1, 3)] == 0.0
        assert sum(p == "q" for p, _ in got) == 6
