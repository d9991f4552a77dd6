"""Cleaning, folding and chat reconciliation on hand-written and random events."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from runlens.operators import chat, clean, fold, tokens
from runlens.sources import events as ev

T = "2024-01-01T00:00:{:02d}Z"


def parse(spark, *texts):
    return ev.parse_events(spark.createDataFrame([(t if isinstance(t, str) else json.dumps(t),) for t in texts], "value string"))


def cleaned(spark, *events):
    return clean.clean(parse(spark, *events), "p0")


def folded(spark, *events):
    e = cleaned(spark, *events)
    return {r.id: r for r in fold.with_feedback(fold.fold_runs(e), fold.fold_feedback(e)).collect()}


def test_source_shapes(spark):
    one = {"type": "llm", "event": "start", "runId": "a"}
    got = parse(spark, one, [one, {"type": "llm", "event": "end", "run_id": "b"}], {"events": [one, [{"type": "tool", "event": "start", "run-id": "c"}]]}, [[one]]).collect()
    assert sorted(r.run_id for r in got) == ["a", "a", "a", "a", "b", "c"]
    assert {r.type for r in got} == {"llm", "tool"}


def test_run_id(spark):
    keep = "123e4567-e89b-12d3-a456-426614174000"
    d = spark.createDataFrame([("run-abc",), (keep,), ("",), (None,)], "i string").select(clean.run_uuid("i").alias("o"))
    assert [r.o for r in d.collect()] == ["fccb04a3-43a2-4038-aa0f-a6bb8003bc0a", keep, "", None]


def test_fold_order_duplicates_errors_and_input_override(spark):
    a, b, c = "a" * 36, "b" * 36, "c" * 36
    runs = folded(
        spark,
        {"type": "llm", "event": "end", "runId": a, "timestamp": T.format(2), "output": "late", "metadata": {"y": 2}, "input": "new"},
        {"type": "llm", "event": "start", "runId": a, "timestamp": T.format(1), "input": "old", "metadata": {"x": 1, "y": 1}, "tags": "solo"},
        {"type": "llm", "event": "start", "runId": a, "timestamp": T.format(3), "input": "second"},
        {"type": "tool", "event": "start", "runId": b, "timestamp": T.format(1), "parentRunId": "missing"},
        {"type": "tool", "event": "error", "runId": b, "timestamp": T.format(4), "error": {"message": "m"}},
        {"type": "llm", "event": "end", "runId": c, "timestamp": T.format(4)},
    )
    assert set(runs) == {a, b}
    assert runs[a].input == "new" and runs[a].status == "success" and runs[a].tags == ["solo"]
    assert json.loads(runs[a].metadata) == {"x": 1, "y": 2}
    assert runs[b].status == "error" and json.loads(runs[b].error) == {"message": "m"}


def test_missing_parent_becomes_null_and_user_cascades(spark):
    d = spark.createDataFrame([("r", None, "boss"), ("s", "r", "own"), ("t", "s", None), ("u", "gone", "me")], "id string, parent_run_id string, user_id string")
    fixed = {r.id: r.parent_run_id for r in fold.without_missing_parents(d).collect()}
    assert fixed == {"r": None, "s": "r", "t": "s", "u": None}
    assert {r.id: r.user_id for r in fold.cascade_users(d).collect()} == {"r": "boss", "s": "boss", "t": "boss", "u": "me"}


def test_feedback_merge(spark):
    a = "a" * 36
    say = lambda s, f: {"type": "llm", "event": "feedback", "runId": a, "timestamp": T.format(s), "feedback": f}
    e = cleaned(spark, say(3, {"thumb": "down"}), say(1, {"thumb": "up"}), say(2, {"comment": "x"}))
    assert [json.loads(r.feedback) for r in fold.fold_feedback(e).collect()] == [{"thumb": "down", "comment": "x"}]
    stored = spark.createDataFrame([(a, '{"thumb":"up","rating":5}')], "id string, feedback string")
    assert json.loads(fold.fold_feedback(e, stored).collect()[0].feedback) == {"thumb": "down", "comment": "x", "rating": 5}


def test_update_event_replaces_metadata(spark):
    a = "a" * 36
    r = folded(
        spark,
        {"type": "llm", "event": "start", "runId": a, "timestamp": T.format(1), "metadata": {"x": 1}},
        {"type": "llm", "event": "end", "runId": a, "timestamp": T.format(2), "metadata": {"y": 1}},
        {"type": "llm", "event": "update", "runId": a, "timestamp": T.format(3), "metadata": {"z": 1}},
    )[a]
    assert json.loads(r.metadata) == {"z": 1}


def test_report_marks_each_bad_event(spark):
    e = cleaned(
        spark,
        {"type": "llm", "event": "start", "runId": "a" * 36, "timestamp": T.format(1)},
        {"type": "llm", "event": "start", "runId": "a" * 36, "timestamp": T.format(2)},
        {"type": "llm", "event": "end", "runId": "b" * 36, "timestamp": T.format(2)},
        {"type": "chat", "event": "chat", "runId": "c" * 36, "timestamp": T.format(2)},
        {"type": "llm", "event": "start", "runId": "d" * 36, "timestamp": "never"},
        {"type": "weird", "event": "start", "runId": "e" * 36, "timestamp": T.format(1)},
    ).withColumn("event_no", F.monotonically_increasing_id())
    got = {(r.run_id[:1], r.event, r.error) for r in clean.report(e).collect()}
    assert got == {
        ("a", "start", None), ("a", "start", "run already started"), ("b", "end", "no start for this run"), ("c", "chat", "missing parent run id"),
        ("d", "start", "invalid timestamp"), ("e", "start", "unknown type"),
    }


def test_redaction_rules(spark):
    events = []
    for i, name in zip("abc", ("gpt", "other", "tagged")):
        events.append({"type": "llm", "event": "start", "runId": i * 36, "timestamp": T.format(1), "name": name, "input": "secret", "tags": ["t"] if i == "c" else []})
        events.append({"type": "llm", "event": "end", "runId": i * 36, "timestamp": T.format(2), "output": "secret"})
    rules = {"p0": ["OR", {"id": "models", "params": {"models": ["gpt"]}}, ["AND", {"id": "tags", "params": {"tags": ["t"]}}]]}
    runs = {r.id[:1]: (r.input, r.output) for r in fold.fold_runs(clean.redact(cleaned(spark, *events), rules)).collect()}
    mask = '"__NOT_INGESTED__"'
    assert runs == {"a": (mask, mask), "b": ("secret", "secret"), "c": (mask, mask)}


def simulate(msgs):
    """What happens message by message: the plain reading of the reconciliation rules."""
    done, prev = [], None
    for m in sorted(msgs, key=lambda m: m["t"]):
        role, item = m["role"], m["id"]
        side = "output" if role in chat.OUTPUT_ROLES else "input" if role in chat.INPUT_ROLES else None
        if m["custom"]:
            prev = {"id": item, "custom": True, "input": None, "output": None, "sibling": None}
            done.append(prev)
            continue
        fresh = {"id": item, "custom": False, "input": None, "output": None, "sibling": None}
        if prev is not None and m["retry"]:
            fresh.update(sibling=prev["id"], output=[item] if side == "output" else None, input=[item] if side == "input" else (list(prev["input"]) if prev["input"] else None))
        elif prev is None or prev["custom"] or side is None or (side == "input" and prev["output"]):
            if side:
                fresh[side] = [item]
        else:
            prev[side] = (prev[side] or []) + [item]
            prev["id"] = item
            continue
        prev = fresh
        done.append(prev)
    return [(x["id"], x["input"], x["output"], x["sibling"]) for x in done]


@pytest.mark.parametrize("seed", range(3))
def test_chat_matches_message_by_message_reading(spark, seed):
    rng = random.Random(seed)
    threads = {}
    for th in range(12):
        threads[f"t{th}"] = [
            {"id": f"m{th}-{i:03d}", "t": i * 600, "role": rng.choice(["user", "user", "system", "assistant", "assistant", "tool", "function"]), "retry": rng.random() < 0.15, "custom": rng.random() < 0.1}
            for i in range(rng.randrange(1, 40))
        ]
    data = [(th, m["id"], m["t"], m["role"], m["id"], m["retry"], m["custom"]) for th, ms in threads.items() for m in ms]
    d = spark.createDataFrame(data, "thread_id string, id string, t long, role string, content string, is_retry boolean, is_custom boolean").withColumn("timestamp", F.timestamp_seconds("t"))
    texts = lambda a: [x.content for x in a] if a else None
    got = {}
    for r in chat.chat_runs(d).collect():
        got.setdefault(r.parent_run_id, []).append((r.exchange, r.id, texts(r.input), texts(r.output), r.sibling_run_id))
    for th, ms in threads.items():
        assert [g[1:] for g in sorted(got[th])] == simulate(ms), th


def test_chat_goes_on_from_carried_state(spark):
    rng = random.Random(5)
    data = [("t", f"m{i:03d}", i * 60, rng.choice(["user", "assistant", "tool"]), "x", rng.random() < 0.1, rng.random() < 0.1) for i in range(60)]
    d = spark.createDataFrame(data, "thread_id string, id string, t long, role string, content string, is_retry boolean, is_custom boolean").withColumn("timestamp", F.timestamp_seconds("t"))
    pick = lambda x: {(r.id, r.exchange, r.input_group, r.previous_id) for r in x.collect()}
    whole = pick(chat.exchange_messages(d))
    first = chat.exchange_messages(d.where("t < 1500"))
    second = chat.exchange_messages(d.where("t >= 1500"), carried=chat.thread_state(first))
    assert pick(first) | pick(second) == whole


def test_chat_examples(spark):
    roles = ["system", "user", "assistant", "assistant", "user", "tool"]
    d = spark.createDataFrame([("t", str(i), i, r, r) for i, r in enumerate(roles)], "thread_id string, id string, t long, role string, content string").withColumn("timestamp", F.timestamp_seconds("t"))
    got = [([m.content for m in r.input], [m.content for m in r.output], r.id) for r in chat.chat_runs(d).orderBy("exchange").collect()]
    assert got == [(["system", "user"], ["assistant", "assistant"], "3"), (["user"], ["tool"], "5")]
    first = chat.chat_runs(d).orderBy("exchange").collect()[0]
    assert (first.input_size, first.output_size) == (2, 2)


def test_token_completion_and_custom_encoder(spark):
    r = spark.createDataFrame([("llm", '[{"role":"user","content":"a b c"}]', '"x y"', None, 7)], "type string, input string, output string, prompt_tokens int, completion_tokens int").withColumn("params", F.lit(None).cast("string"))
    one = tokens.complete_tokens(r).collect()[0]
    assert (one.prompt_tokens, one.completion_tokens) == (3 + 1 + 4 + 3, 7)
    by_char = tokens.complete_tokens(r, tokens.python_counter(list)).collect()[0]
    assert by_char.prompt_tokens == 3 + 1 + len("a b c\nuser") + 3


def test_metadata_and_names(spark):
    d = spark.createDataFrame([('{"a":1,"b":"x","c":{"d":1},"e":[1,"y",true],"f":[{"g":1}],"h":null,"enrichment":{"k":[]}}',)], "m string")
    kept = json.loads(d.select(clean.clean_metadata("m").alias("o")).collect()[0].o)
    assert kept == {"a": 1, "b": "x", "e": [1, "y", True], "enrichment": {"k": []}}


def test_redaction_by_user_and_by_leaf(spark):
    e = spark.createDataFrame(
        [("start", "p", f"r{i}", u, n, "in", None, "llm") for i, (u, n) in enumerate([("anna", "m1"), ("bob", "m1"), ("anna", None), (None, "m2")])]
        + [("start", "q", "other", "anna", "m1", "in", None, "llm"), ("end", "p", "r0", None, None, None, "out", "llm")],
        "event string, project_id string, run_id string, user_id string, name string, input string, output string, type string",
    )
    users = spark.createDataFrame([(1, "anna"), (2, "carl")], "id long, external_id string")
    rules = {"p": ["AND", {"id": "users", "params": {"users": ["1", "2"]}}, {"id": "models", "params": {"models": ["m2"]}}], "q": ["AND", {"id": "models", "params": {"models": ["m9"]}}]}
    got = clean.redact(e, rules, users).collect()
    hidden = {(r.run_id, r.event) for r in got if clean.REDACTED in (r.input or r.output)}
    assert hidden == {("r0", "start"), ("r0", "end"), ("r2", "start"), ("r3", "start")} and len(got) == 6
    assert clean.redact(e, {}, users).count() == 6


def test_spans_of_one_row_group_are_many_tasks(spark, tmp_path):
    """Events in one file with one row group: the spans, which cost more than a read, are dealt out."""
    from runlens.plans import ingest

    kinds = ["view", "click", "purchase", "signup", "error"]
    data = [(None if i == 7 else i % 300, 5, kinds[i % 5], 1.5, '{"k": %d}' % i) for i in range(400)]
    events = spark.createDataFrame(data, "event_id long, user_id long, event_type string, value double, props string").withColumn("ts", F.lit("2024-01-01").cast("timestamp_ntz"))
    events.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    dealt = ingest.spans(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()
    assert len(dealt) > 1 and sum(r["count"] for r in dealt) == 400
    got = ingest.a5(spark, str(tmp_path)).collect()
    assert sorted((r.event_id is None, r.event_id or 0, r.prompt, r.name) for r in got) == sorted((e[0] is None, e[0] or 0, i, f"m-{e[2]}") for i, e in enumerate(data))
