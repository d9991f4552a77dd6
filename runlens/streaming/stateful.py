"""Stateful twins: run fold and alert state, keyed by run and rule. (Chat exchanges: ``streaming.chat``.)

State per key is a few scalars. Event time drives it: late rows behind the watermark are
dropped by Spark, timers end what never completes.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RANK = {"start": 0, "end": 1, "error": 1}

FOLD_SCHEMA = (
    "id string, type string, name string, status string, created_at timestamp, ended_at timestamp, parent_run_id string, user_id string, "
    "input string, output string, error string, metadata string, feedback string, prompt_tokens int, completion_tokens int"
)
FOLD_STATE = "body string"
EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
START_KEYS = ("type", "name", "parent_run_id", "user_id", "input")


def _merge(a: str | None, b: str | None) -> str | None:
    if a is None or b is None:
        return b if a is None else a
    return json.dumps({**json.loads(a), **json.loads(b)}, separators=(",", ":"))


class RunState:
    """The fold of one run's events, independent of arrival order: every field remembers the sequence of what set it."""

    def __init__(self, body: dict | None = None):
        self.d = body or {"start": None, "end": None, "fb": {}, "meta": {}}

    def add(self, e: dict) -> None:
        seq = [e["us"], RANK.get(e["event"], 2)]
        if e["event"] == "start":
            if self.d["start"] is None or seq < self.d["start"][0]:
                self.d["start"] = [seq, {k: e[k] for k in START_KEYS}, e["us"], e["metadata"]]
        elif e["event"] in ("end", "error"):
            if self.d["end"] is None or seq >= self.d["end"][0]:
                old = self.d["end"]
                keep = lambda k: e[k] if e[k] is not None else (old[1][k] if old else None)
                self.d["end"] = [seq, {"event": e["event"], "us": e["us"], **{k: keep(k) for k in ("output", "error", "metadata", "prompt", "completion", "input")}}]
        elif e["event"] == "feedback":
            for k, v in {**json.loads(e["feedback"] or "{}"), **json.loads(e["extra"] or "{}")}.items():
                if k not in self.d["fb"] or seq >= self.d["fb"][k][0]:
                    self.d["fb"][k] = [seq, v]

    def latest_ms(self) -> int:
        marks = [x[0][0] for x in (self.d["start"], self.d["end"], *self.d["fb"].values()) if x]
        return max(marks, default=0) // 1000

    def row(self, run_id: str) -> dict | None:
        s, e = self.d["start"], self.d["end"]
        if s is None:
            return None
        end = e[1] if e else {}
        ts = lambda us: EPOCH + timedelta(microseconds=us) if us is not None else None
        return {
            "id": run_id, "type": s[1]["type"], "name": s[1]["name"],
            "status": "started" if not e else ("error" if end["event"] == "error" else "success"),
            "created_at": ts(s[2]), "ended_at": ts(end.get("us")), "parent_run_id": s[1]["parent_run_id"], "user_id": s[1]["user_id"],
            "input": end.get("input") or s[1]["input"], "output": end.get("output"), "error": end.get("error"),
            "metadata": _merge(s[3], end.get("metadata")),
            "feedback": json.dumps({k: v[1] for k, v in sorted(self.d["fb"].items())}, separators=(",", ":")) if self.d["fb"] else None,
            "prompt_tokens": end.get("prompt"), "completion_tokens": end.get("completion"),
        }


class RunFold(StatefulProcessor):
    """Emits the current row of a run whenever it changes; state is dropped ``wait_ms`` after its last event."""

    def __init__(self, wait_ms: int = 3_600_000):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("run", FOLD_STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # every call on the handle is a round trip to the JVM: one read, one write, one timer per new run
        stored = self.state.get()
        fold = RunState(json.loads(stored[0]) if stored else None)
        for e in rows:
            fold.add(e.asDict())
        self.state.update((json.dumps(fold.d),))
        if not stored:
            self.handle.registerTimer(max(timerValues.getCurrentWatermarkInMs(), fold.latest_ms()) + self.wait_ms)
        row = fold.row(key[0])
        if row is not None:
            yield Row(**row)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        stored = self.state.get()
        due = RunState(json.loads(stored[0])).latest_ms() + self.wait_ms if stored else 0
        if due > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(due)  # events came since: wait on
        else:
            self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def fold_stream(events: DataFrame, late: str = "1 hour", wait_ms: int = 3_600_000) -> DataFrame:
    """Streaming run fold. Output mode update: the last row per id is the run."""
    rows = events.select(
        "run_id", "event", "type", "name", "parent_run_id", "user_id", "input", "output", "error", "metadata", "feedback", "extra",
        F.col("tokens_usage.prompt").alias("prompt"), F.col("tokens_usage.completion").alias("completion"), "ts", F.unix_micros("ts").alias("us"),
    ).withWatermark("ts", late)
    return rows.groupBy("run_id").transformWithState(
        statefulProcessor=RunFold(wait_ms), outputStructType=FOLD_SCHEMA, outputMode="Update", timeMode="EventTime"
    )


ALERT_SCHEMA = "rule_id string, at timestamp, kind string, value double"


class AlertState(StatefulProcessor):
    """One boolean per rule; emits a row at every change."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("alert", "hot boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        stored = self.state.get()
        hot = bool(stored[0]) if stored else False
        # a rule has one value per minute, so a batch of one rule is short
        for at, value, threshold in sorted((r.window_end, r.value, r.threshold) for r in rows):
            now = value > threshold
            if now != hot:
                yield Row(rule_id=key[0], at=at, kind="triggered" if now else "resolved", value=float(value))
            hot = now
        self.state.update((hot,))

    def close(self) -> None:
        pass


def alert_stream(values: DataFrame, rules: DataFrame) -> DataFrame:
    """values: rule_id, window_end, value (stream); rules: rule_id, threshold (table)."""
    with_rule = values.join(rules.select("rule_id", "threshold"), "rule_id").select("rule_id", "window_end", "value", "threshold")
    return with_rule.groupBy("rule_id").transformWithState(
        statefulProcessor=AlertState(), outputStructType=ALERT_SCHEMA, outputMode="Append", timeMode="None"
    )
