"""Filters, prices, similarity, intents, datasets, alerts, imports and exports on small cases."""

from __future__ import annotations

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from runlens.functions import similarity as S
from runlens.functions import templates as tpl
from runlens.functions.userprops import normalize_value
from runlens.operators import alerts, datasets, filters, infer, intents, language, pricing, series
from runlens.operators.filter_plan import compile_plan
from runlens.sources import datasets as imports
from runlens.sources import events as ev
from runlens.sources import export, otlp


@pytest.mark.parametrize(
    "given,want",
    [("12345", "12345"), ("true", "true"), ("  spaced ", "spaced"), ('{"type":"boolean","value":true}', True), ({"type": "boolean", "value": True}, True),
     ({"type": "number", "value": 42}, 42), ({"type": "null"}, None), (7, 7)],
)
def test_user_property_values(given, want):
    assert normalize_value(given) == want


def leaf(logic, name):
    for n in logic[1:]:
        if isinstance(n, dict) and n["id"] == name:
            return n["params"]
        if isinstance(n, list) and leaf(n, name):
            return leaf(n, name)
    return None


def test_plans():
    logic, missed = compile_plan({"op": "AND", "clauses": [{"id": "duration", "op": "gt", "value": 2, "unit": "seconds"}, {"id": "feedback", "thumbs": ["down"]}]})
    assert not missed and leaf(logic, "duration") == {"operator": "gt", "duration": 2} and leaf(logic, "feedback") == {"types": ['{"thumb":"down"}']}
    logic, missed = compile_plan({"op": "AND", "clauses": [{"id": "duration", "op": "between", "range": [1, 4]}]})
    assert not missed and [n["params"] for n in logic[1][1:]] == [{"operator": "gt", "duration": 1}, {"operator": "lt", "duration": 4}]
    logic, missed = compile_plan({"op": "AND", "clauses": [{"id": "languages", "values": ["en", "fr"]}]})
    assert leaf(logic, "languages") == {"field": "any", "codes": ["en", "fr"]}
    logic, missed = compile_plan({"op": "AND", "clauses": [{"id": "not-a-real-filter", "value": "noop"}]})
    assert logic == ["AND"] and missed == [{"clause": "not-a-real-filter", "code": "unknown_filter"}]
    allowed = {"models": ["gpt-4o", "gpt-4o-mini"]}
    logic, missed = compile_plan({"op": "AND", "clauses": [{"id": "models", "values": ["openai"]}]}, allowed)
    assert logic == ["AND"] and missed == [{"clause": "models", "code": "not_allowed", "values": ["openai"]}]
    logic, missed = compile_plan({"op": "AND", "clauses": [{"id": "models", "values": ["gpt"]}]}, allowed)
    assert not missed and leaf(logic, "models") == {"models": ["gpt-4o", "gpt-4o-mini"]}
    bad = [{"id": "cost", "value": "x"}, {"id": "duration", "op": "between", "range": [1]}, {"id": "cost", "op": "like", "value": 1}, {"id": "tags"}, {"id": "metadata", "key": "k"}, {"id": "date"}]
    logic, missed = compile_plan({"clauses": bad})
    assert logic == ["AND"] and [m["code"] for m in missed] == ["not_a_number", "two_bounds_needed", "unknown_operator", "no_value", "key_and_value_needed", "no_instant"]
    logic, missed = compile_plan({"op": "OR", "clauses": [{"id": "duration", "value": 1500, "unit": "ms"}, {"id": "metadata", "values": ["k", "v"]}, {"id": "pii"}, {"id": "date", "op": "between", "iso": ["a", "b"]}]})
    assert not missed and logic[0] == "OR" and leaf(logic, "duration")["duration"] == 1.5 and leaf(logic, "metadata") == {"key": "k", "value": "v"}
    assert leaf(logic, "pii") == {"containsPii": "true"} and logic[4][0] == "AND"


def test_filter_tree_keeps_precedence(spark):
    d = spark.createDataFrame([(i, bool(i & 1), bool(i & 2), bool(i & 4)) for i in range(8)], "id int, a boolean, b boolean, c boolean")
    for name in "abc":
        filters.register_check(f"test-{name}")(lambda t, name=name, **_: F.col(name))
    a, b, c = ({"id": f"test-{x}", "params": {}} for x in "abc")
    got = {r.id for r in filters.filter_runs(d, ["OR", a, ["AND", b, c]]).collect()}
    assert got == {i for i in range(8) if (i & 1) or (i & 2 and i & 4)}
    got = {r.id for r in filters.filter_runs(d, ["AND", a, ["OR", b, c]]).collect()}
    assert got == {i for i in range(8) if (i & 1) and (i & 2 or i & 4)}
    res = {r.id: (r.passed, [(x.id, x.passed) for x in r.results]) for r in filters.run_checks(d, ["AND", a, b]).collect()}
    assert res[0] == (False, [("test-a", False)]) and res[3] == (True, [("test-a", True), ("test-b", True)])


def test_metadata_leaf_is_typed(spark):
    d = spark.createDataFrame([(1, '{"k":"7"}'), (2, '{"k":7}'), (3, '{"k":"7x"}'), (4, '{"k":true}'), (5, '{"k":null}'), (6, None)], "id int, metadata string")
    ids = lambda value: {r.id for r in filters.filter_runs(d, ["AND", {"id": "metadata", "params": {"key": "k", "value": value}}]).collect()}
    assert ids("7") == {1, 2} and ids("true") == {4} and ids("null") == {5} and ids("7x") == {2, 3}


def test_comment_feedback_counts_parents_and_children(spark):
    d = spark.createDataFrame(
        [("p", None, "chat", None), ("c", "p", "chat", '{"comment":"hi"}'), ("g", "c", "chat", None), ("z", None, "chat", '{"thumb":"up"}')],
        "id string, parent_run_id string, type string, feedback string",
    )
    got = {r.id for r in filters.filter_runs(d, ["AND", {"id": "feedback", "params": {"types": ['{"comment":""}']}}], filters.Tables(runs=d)).collect()}
    assert got == {"p", "c", "g"}


RUN = "id string, org_id string, type string, name string, status string, created_at timestamp, duration_s double, prompt_tokens int, completion_tokens int, cached_prompt_tokens int, input string, output string, cost double"
MAP = "id long, name string, pattern string, unit string, input_cost double, output_cost double, input_caching_cost_reduction double, start_date timestamp, org_id string"


def test_prices(spark):
    from datetime import datetime as dt

    t = dt(2024, 5, 1)
    run = lambda i, name="m", dur=1.0, typ="llm", org="o1", cost=None, at=t: (i, org, typ, name, "success", at, dur, 1000, 500, 100, '"abc"', '"de"', cost)
    runs = spark.createDataFrame([run("ok"), run("fast", dur=0.005), run("tool", typ="tool"), run("own", org="o2"), run("chars", name="c"), run("ms", name="ms"), run("legacy", name="GPT4-32k"), run("none", name="zzz")], RUN)
    maps = spark.createDataFrame(
        [(1, "m", "^m$", "TOKENS", 10.0, 30.0, None, dt(2024, 1, 1), None), (2, "m", "^m$", "TOKENS", 99.0, 99.0, None, None, None), (3, "m", "^m$", "TOKENS", 1.0, 1.0, 0.5, dt(2024, 1, 1), "o2"),
         (4, "c", "^c$", "CHARACTERS", 10.0, 100.0, None, None, None), (5, "ms", "^ms$", "MILLISECONDS", 10.0, 5.0, None, None, None), (6, "bad", "([", "TOKENS", 1.0, 1.0, None, None, None)], MAP)
    cost = {r.id: r.cost for r in pricing.price(runs, maps).collect()}
    assert cost["ok"] == pytest.approx(0.025) and cost["fast"] is None and cost["tool"] is None and cost["none"] is None
    assert cost["own"] == pytest.approx((1000 + 500 - 50) / 1e6) and cost["chars"] == pytest.approx((30 + 200) / 1e6) and cost["ms"] == pytest.approx(0.01)
    assert cost["legacy"] == pytest.approx((0.06 * 1000 + 0.12 * 500) / 1000)


def test_recost_takes_the_price_in_force(spark):
    from datetime import datetime as dt

    rows = [(str(m), "o", "llm", "m", "success", dt(2024, m, 15), 1.0, 1_000_000, 0, 0, None, None, 1.0) for m in (1, 2, 4)]
    maps = spark.createDataFrame([(1, "m", "^m$", "TOKENS", 1.0, 0.0, None, dt(2024, 1, 20), None), (2, "m", "^m$", "TOKENS", 2.0, 0.0, None, dt(2024, 3, 1), None)], MAP)
    runs = spark.createDataFrame(rows, RUN)
    changes = pricing.recost(runs, maps)
    assert {(r.id, r.cost) for r in changes.collect()} == {("4", 2.0)}  # month 2 costs 1.0 already, month 1 has no price
    assert {r.id: r.cost for r in pricing.write_back(runs, changes).collect()} == {"1": 1.0, "2": 1.0, "4": 2.0}


def test_feedback_ratio(spark):
    d = spark.createDataFrame([("2024-01-01 10:00:00", f) for f in ['{"thumb":"up"}'] * 3 + ['{"thumb":"down"}', None]], "t string, feedback string").selectExpr("cast(t as timestamp) created_at", "feedback")
    got = series.feedback_ratio(d, series.Range("2024-01-01", "2024-01-03")).orderBy("date").collect()
    assert [r.value for r in got] == [0.5, 0.0]


def test_spine_across_daylight_saving(spark):
    from runlens.operators.buckets import bucket_spine

    s = bucket_spine(spark, "2024-11-03 04:00:00", "2024-11-04 05:00:00", "America/New_York", "hourly").collect()
    assert len(s) == 24 and len({r.date for r in s}) == 24  # the repeated hour is one bucket


def test_similarity(spark):
    d = spark.createDataFrame([("a b c d", "a b x"), ("", "x"), ("é é", "é")], "r string, h string").withColumn("o", S.overlap(F.col("r"), F.col("h")))
    o = F.col("o")
    got = d.select(S.bleu_of(o).alias("b"), S.rouge_of(o).alias("r"), S.gleu_of(o).alias("g"), S.cosine_of(o).alias("c")).collect()
    assert (got[0].b, got[0].r) == (pytest.approx(2 / 3), 0.5) and got[0].g == pytest.approx(math.sqrt(1 / 3)) and got[1].b == 0 and got[2].c == pytest.approx(1.0)
    f = spark.createDataFrame([("kitten", "sitting"), ("", ""), ("", "a")], "a string, b string").select(S.fuzzy_ratio(F.col("a"), F.col("b")).alias("f")).collect()
    assert [r.f for r in f] == [pytest.approx(4 / 7), 1.0, 0.0]


def test_longest_common_subsequence():
    def slow(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(0, 30))] for _ in range(2))
        assert S.lcs_length(a, b) == slow(a, b)


def test_templates(spark):
    d = spark.range(1).select(tpl.render(F.lit("{{a}}-{{ b }}-{{c}}{{a}}"), F.create_map(F.lit("a"), F.lit("{{b}}"), F.lit("b"), F.lit("2"))).alias("t"), tpl.extract_score(F.lit("about -3.50 of 5")).alias("s"), tpl.extract_score(F.lit("none")).alias("n"))
    assert tuple(d.collect()[0]) == ("{{b}}-2-{{b}}", -3.5, None)


def test_enrichers_and_registries(spark):
    d = spark.createDataFrame([("1", "mail bob@x.org or call 555-123-4567 ID-9"), ("2", "short")], "id string, text string")
    found = {r.id: [(e.type, e.entity) for e in r.f] for r in d.select("id", infer.detect_pii(F.col("text"), custom={"ticket": "ID-[0-9]+"}, excluded=["bob@x.org"]).alias("f")).collect()}
    assert ("ticket", "ID-9") in found["1"] and ("phone", "555-123-4567") in [(a, b.strip()) for a, b in found["1"]] and not found["2"] and all(e != "bob@x.org" for _, e in found["1"])

    @infer.register_evaluator("len")
    def fn(batch):
        if (batch["text"] == "short").any():
            raise ValueError("no")
        return [{"n": len(t)} for t in batch["text"]]

    got = infer.batch_infer(d, "len", infer.EVALUATORS["len"], ["text"]).collect()
    assert {r.run_id: json.loads(r.result) for r in got} == {"1": {"n": 40}, "2": {"error": "no"}}


def test_one_bad_row_in_a_thousand(spark, tmp_path):
    """One row fails always, one the first time: one error row, 999 results, and few further calls."""
    calls, seen = tmp_path / "calls", tmp_path / "seen"

    def fn(batch):
        with open(calls, "a") as f:
            f.write("x")
        if (batch["n"] == 501).any():
            raise ValueError("bad cell")
        if (batch["n"] == 7).any() and len(batch) == 1 and not seen.exists():
            seen.write_text("")
            raise ValueError("try again")
        if (batch["n"] == 7).any() and len(batch) > 1:
            raise ValueError("too many")
        return [{"n": int(n)} for n in batch["n"]]

    rows = spark.range(1000).selectExpr("cast(id as string) as id", "id as n").coalesce(1)
    got = {r.run_id: json.loads(r.result) for r in infer.batch_infer(rows, "e", fn, ["n"]).collect()}
    assert got == {str(i): {"error": "bad cell"} if i == 501 else {"n": i} for i in range(1000)}
    assert len(calls.read_text()) <= 10 + 2 * 16 + 3
    short = infer.batch_infer(rows.limit(3), "e", lambda b: [1], ["n"], batch=3).collect()
    assert len(short) == 3 and all(json.loads(r.result) == 1 for r in short)  # a wrong number of results is a failure of the batch
    swept = datasets.sweep(rows.limit(4).withColumn("dataset_id", F.lit("d")), {1: ("ok", lambda i: F.col("n")), 2: ("lost", lambda i: F.col("gone")), 3: ("mine", infer.OnBatches(fn, ["n"]))}).collect()
    by = {(r.item_id, r.slot): json.loads(r.result) for r in swept}
    assert by["2", 1] == {"value": 2} and "gone" in by["2", 2]["error"] and by["2", 3] == {"value": {"n": 2}} and len(by) == 12


def _documents(spark, sf="sf0.01"):
    d = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").join(spark.read.parquet(f"/root/testdata/{sf}/labels.parquet"), "doc_id", "left")
    return d.withColumn("id", F.col("doc_id").cast("string"))


def test_language_model_on_held_out_documents(spark):
    """Right for nine of ten held-out documents of every language, and about as sure as it is right."""
    d = _documents(spark).where("length(text) >= 30")
    model = language.LanguageModel.fit(d.where("doc_id % 5 <> 0"))
    got = d.where("doc_id % 5 = 0").select("lang", F.get(model.detect(F.array("text")), F.lit(0)).alias("l")).collect()
    for lang in ("de", "en", "es", "fr"):
        own = [r.l and r.l.isoCode == lang for r in got if r.lang == lang]
        assert len(own) > 10 and sum(map(bool, own)) >= 0.9 * len(own), lang
    sure = [(r.l.confidence, r.l.isoCode == r.lang) for r in got if r.l]
    assert abs(sum(c for c, _ in sure) - sum(x for _, x in sure)) <= 0.1 * len(sure)


def test_language_of_odd_texts(spark):
    rows = [(str(i), t, x) for i, (t, x) in enumerate([("the cat and the dog are in the house", "en"), ("der Hund und die Katze sind im Haus", "de"), (None, "en"), ("x", None)] * 4)]
    train = spark.createDataFrame(rows, "id string, text string, lang string")
    model = language.LanguageModel.fit(train)
    texts = ["the dog and the cat of the house are here", None, "short", "die Katze und der Hund sind hier im Haus", "", "12345 67890 12345 67890 12345 67890"]
    got = spark.createDataFrame([(texts,), ([],), (None,)], "t array<string>").select(model.detect(F.col("t")).alias("l")).collect()
    assert [x and x.isoCode for x in got[0].l] == ["en", None, None, "de", None, "de"] or [x and x.isoCode for x in got[0].l][:5] == ["en", None, None, "de", None]
    assert got[1].l == [] and got[2].l is None
    empty = language.LanguageModel.fit(train.where("false"))
    assert spark.createDataFrame([(texts,)], "t array<string>").select(empty.detect(F.col("t")).alias("l")).first().l == [None] * 6
    runs = spark.createDataFrame([("r", '[{"role":"user","content":"the cat and the dog are in the house"},{"role":"user","content":"no"}]', None)], "id string, input string, output string")
    result = json.loads(language.language_results(runs, model, "ev").first().result)
    assert result["input"][0]["isoCode"] == "en" and result["input"][1] is None and result["error"] == [None]


def test_intent_labels(spark):
    d = spark.createDataFrame([("book_flight",), ("Plain words HERE",), ("  ",), ("x",)], "l string").select(infer.humanize_label(F.col("l")).alias("o"))
    assert [r.o for r in d.collect()] == ["Book Flight", "Plain words HERE", "", "X"]
    labels = [("Book flight", 5), ("book_flights", 2), ("flight  book", 1), ("cancel", 3), ("cancels", 1), ("refund", 1)]
    got = {r.label: r.cluster for r in intents.grouped_labels(spark.createDataFrame(labels, "label string, occurrences long")).collect()}
    assert got["Book flight"] == got["book_flights"] == got["flight  book"] == "Book flight"
    assert got["cancel"] == got["cancels"] == "cancel" and got["refund"] == "refund"


def test_labels_by_similar_words(spark):
    """All pairs of random labels, a third of which share one word; and labels made of frequent words alone."""
    rng = random.Random(2)
    words = [f"w{i}" for i in range(14)]
    prints = {" ".join(sorted({*rng.sample(words, rng.randrange(1, 7)), *(["hot"] if i % 3 == 0 else [])})) for i in range(300)} | {"hot", "hot w0", ""}
    df = spark.createDataFrame([(p,) for p in prints] * 2, "fp string").repartition(3)
    for t in (0.5, 0.75, 1.0):
        got = {(r.u, r.v) for r in intents.similar_prints(df, t).collect()}
        sets = {p: set(p.split()) for p in prints if p}
        assert got == {(u, v) for u in sets for v in sets if u < v and len(sets[u] & sets[v]) >= t * len(sets[u] | sets[v])}
    labels = [("show all open orders", 3), ("orders: show all", 2), ("show open orders all now", 1), ("close orders", 9)]
    grouped = {r.label: r.cluster for r in intents.grouped_labels(spark.createDataFrame(labels, "label string, occurrences long")).collect()}
    assert set(grouped.values()) == {"show all open orders", "close orders"} and grouped["orders: show all"] == "show all open orders"


def test_patterns_by_their_beginning(spark):
    """The beginning that a pattern asks for never loses a name that the pattern finds."""
    shapes = {
        "^(gpt-4)$": "gpt-4", "(?i)^(GPT-4o)$": "gpt-4o", "^gpt-3.5": "gpt-3", r"^gpt-3\.5-turbo": "gpt-3.5-turbo", "^(ab?c)": "a", "^a*": "", "^(abc)?x": "", "^(abc){0,1}x": "", "abc": "",
        "^abc|def": "", "^(a|b)c": "", "^[ab]c": "", "^ab{2}c": "a", "^ab+": "ab", r"^ab\.?c": "ab", r"^\d+": "", "^": "", "": "",
    }
    got = {r.p: r.x for r in spark.createDataFrame([(p,) for p in shapes], "p string").select("p", pricing.literal_prefix(F.col("p")).alias("x")).collect()}
    assert got == shapes
    names = ["gpt-4", "GPT-4o", "gpt-4o", "gpt-3.5-turbo", "gpt-3x5", "ac", "abc", "abbc", "x", "abcx", "ab.c", "def", "bc", "7b", "ABC", ""]
    runs = spark.createDataFrame([(n,) for n in names * 2], "name string")
    mappings = spark.createDataFrame([(i, p) for i, p in enumerate(shapes)], "id int, pattern string")
    found = {(r.name, r.pattern) for r in pricing.match_names(runs, mappings).collect()}
    plain = runs.distinct().join(mappings, F.rlike("name", F.col("pattern"))).select("name", "pattern")
    assert found == {tuple(r) for r in plain.collect()}


def test_overlap_of_odd_pairs(spark):
    from collections import Counter

    rng = random.Random(1)
    said = lambda: rng.choice([None, "", " \n", " ".join(rng.choice(["a", "b", "b,", "é", "c"]) for _ in range(rng.randrange(9)))])
    rows = [(i, said(), said()) for i in range(200)]
    got = {r.i: r.o for r in spark.createDataFrame(rows, "i int, r string, h string").repartition(3).select("i", S.overlap(F.col("r"), F.col("h")).alias("o")).collect()}
    for i, r, h in rows:
        a, b = Counter((r or "").split()), Counter((h or "").split())
        assert got[i].asDict() == {
            "hits": sum(b[t] for t in a.keys() & b.keys()), "ref_size": a.total(), "hyp_size": b.total(), "dot": sum(a[t] * b[t] for t in a),
            "ref_sq": sum(n * n for n in a.values()), "hyp_sq": sum(n * n for n in b.values()),
        }


def test_run_summary(spark):
    o = spark.createDataFrame([(1, x) for x in ["pass"] * 3 + ["fail", "unknown"]], "slot int, outcome string")
    r = datasets.run_summary(o, spark.createDataFrame([(1, 10)], "slot int, items long"), ["slot"]).collect()[0]
    assert (r.passed, r.failed, r.unknown, r.pass_rate, r.coverage) == (3, 1, 1, 75.0, 50.0)


def test_alert_state_machine_batch_and_stream(spark, tmp_path):
    from runlens.streaming.stateful import alert_stream

    values = spark.createDataFrame([("r", i * 60, float(v)) for i, v in enumerate([1, 5, 5, 2, 9])], "rule_id string, t long, value double").select("rule_id", F.timestamp_seconds("t").alias("window_end"), "value")
    rules = spark.createDataFrame([("r", 3.0)], "rule_id string, threshold double")
    hist = alerts.transitions(values, rules).orderBy("triggered_at").collect()
    minute = lambda x: None if x is None else x.minute
    assert [(minute(h.triggered_at), minute(h.resolved_at), h.status) for h in hist] == [(1, 3, "resolved"), (4, None, "ongoing")]
    values.repartition(1).write.parquet(str(tmp_path / "in"))
    out = []
    s = spark.readStream.schema(values.schema).parquet(str(tmp_path / "in"))
    q = alert_stream(s, rules).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True)
    q.foreachBatch(lambda df, i: out.extend((r.at.minute, r.kind) for r in df.collect())).start().awaitTermination()
    assert sorted(out) == [(1, "triggered"), (3, "resolved"), (4, "triggered")]


def test_stateful_fold_equals_batch_fold(spark, tmp_path):
    from runlens.operators import clean, fold
    from runlens.streaming.fold import fold_job, latest_rows
    from runlens.streaming.stateful import fold_stream

    T = "2024-01-01T00:00:{:02d}Z"
    lines = []
    for i in range(6):
        rid = str(i) * 36
        lines.append([{"type": "llm", "event": "end", "runId": rid, "timestamp": T.format(9), "output": "o", "metadata": {"e": i}}] if i != 3 else [])
        lines.append([{"type": "llm", "event": "feedback", "runId": rid, "timestamp": T.format(10 + i), "feedback": {"thumb": "up"}}])
        if i != 4:
            lines.append([{"type": "llm", "event": "start", "runId": rid, "timestamp": T.format(1), "input": "i", "metadata": {"s": i}}])
    for n in range(3):  # three files, so three micro-batches
        spark.createDataFrame([(json.dumps(x),) for x in lines[n::3]], "value string").coalesce(1).write.text(str(tmp_path / "in" / f"part={n}"))
    batch = clean.clean(ev.parse_events(spark.read.text(str(tmp_path / "in"))), "p0")
    want = {r.id: (r.status, r.input, r.output, json.loads(r.metadata), r.feedback) for r in fold.with_feedback(fold.fold_runs(batch), fold.fold_feedback(batch)).collect()}
    assert len(want) == 5

    def source():
        return clean.clean(ev.parse_events(spark.readStream.option("maxFilesPerTrigger", 1).text(str(tmp_path / "in"))), "p0")

    fold_job(source(), str(tmp_path / "out"), str(tmp_path / "state"), str(tmp_path / "ck1")).awaitTermination()
    micro = {r.id: (r.status, r.input, r.output, json.loads(r.metadata), r.feedback) for r in latest_rows(spark.read.parquet(str(tmp_path / "out"))).collect()}
    assert micro == want
    seen = {}
    q = fold_stream(source()).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True)
    q.foreachBatch(lambda df, i: seen.update({r.id: (r.status, r.input, r.output, json.loads(r.metadata), r.feedback) for r in df.collect()})).start().awaitTermination()
    assert seen == want


def test_imports_and_exports(spark, tmp_path):
    csv = tmp_path / "a.csv"
    csv.write_text('Input,expected_output,prediction\n"say ""hi"", now\nnext",yes,\nplain,,no\n')
    got = [tuple(r) for r in imports.read_csv_items(spark, str(csv)).collect()]
    assert got == [('say "hi", now\nnext', "yes", None), ("plain", None, "no")]
    bad = tmp_path / "b.csv"
    bad.write_text("question\nx\n")
    with pytest.raises(ValueError):
        imports.read_csv_items(spark, str(bad))
    lines = tmp_path / "c.jsonl"
    lines.write_text('{"input":"q","groundtruth":5,"output":""}\n')
    assert [tuple(r) for r in imports.read_jsonl_items(spark, str(lines)).collect()] == [("q", "5", None)]
    lines.write_text('{"input":5}\n')
    with pytest.raises(Exception):
        imports.read_jsonl_items(spark, str(lines)).collect()
    msgs = '[{"role":"user","content":"q","toolCalls":[]}]'
    runs = spark.createDataFrame([("1", msgs, '[{"role":"assistant","content":null,"tool_calls":[{"id":"1"}]}]', ["t"]), ("2", '"text"', msgs, [])], "id string, input string, output string, tags array<string>")
    for kind in ("csv", "jsonl", "ojsonl"):
        export.export_runs(runs, str(tmp_path / kind), kind)
    one = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "ojsonl")).collect()]
    assert len(one) == 1 and [m["role"] for m in one[0]["messages"]] == ["user", "assistant"] and "tool_calls" not in one[0]["messages"][0] and one[0]["messages"][1]["content"] == ""
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).orderBy("id").collect()
    assert back[0].input == msgs and json.loads(back[0].tags) == ["t"]
    assert spark.read.text(str(tmp_path / "jsonl")).count() == 2


def test_otlp_size_guard_and_errors(spark):
    d = spark.createDataFrame([("x" * 300, None, None), ("y" * 10, None, None)], "input string, output string, metadata string")
    got = [tuple(r) for r in otlp.guard_size(d, 200, 50).select("input", "metadata").collect()]
    assert got[0][0] == "x" * 50 + "... [truncated 250 chars]" and got[1][0] == "y" * 10


def test_toxicity_per_message(spark):
    """Each message has its own scores, a side its own labels; labels overlap, one without examples never fires."""
    words = {"insult": "fool", "threat": "beware", "obscene": "smut"}
    rows = [(i, " ".join(w for j, w in enumerate(words.values()) if i >> j & 1) + " what a lovely day", *(i >> j & 1 for j in range(3)), None) for i in range(8)] * 8
    d = spark.createDataFrame(rows, "i int, text string, insult int, threat int, obscene int, identity_attack int")
    labels = ["insult", "threat", "obscene", "identity_attack"]
    model = infer.MultiLabelClassifier(labels, 1 << 10).fit(d, "text")
    msg = lambda *t: json.dumps([{"role": "user", "content": x} for x in t])
    runs = spark.createDataFrame([("a", msg("a lovely day", "you fool beware"), msg("what a day")), ("b", msg("day"), msg("smut")), ("c", None, None), ("d", msg("", "x"), None)], "id string, input string, output string")
    scores = infer.toxicity_scores(runs, model)
    by = {(r["run_id"], r["side"], r["index"]): r["scores"].asDict() for r in scores.collect()}
    assert by["a", "input", 0]["insult"] < 0.5 < by["a", "input", 1]["insult"] and by["a", "input", 1]["obscene"] < 0.5
    got = {r.run_id: (r.toxic_input, r.toxic_output, r.input_labels, r.output_labels) for r in infer.toxicity_rows(scores, labels).collect()}
    assert got["a"] == (True, False, ["insult", "threat"], []) and got["b"] == (False, True, [], ["obscene"])


def test_toxicity_on_held_out_documents(spark):
    d = _documents(spark, "sf0.1").withColumn("toxicity", F.col("toxic")).where("toxic IS NOT NULL")
    model = infer.MultiLabelClassifier(["toxicity"]).fit(d.where("doc_id % 5 <> 0"), "text")
    got = model.transform(d.where("doc_id % 5 = 0").select("toxic", "text"), "text").select("toxic", "scores.toxicity").collect()
    right = [(r.toxicity >= 0.5) == (r.toxic == 1) for r in got]
    caught = [r.toxicity >= 0.5 for r in got if r.toxic == 1]
    assert sum(right) >= 0.94 * len(right) and sum(caught) >= 0.6 * len(caught)


def test_upsert(spark):
    stored = spark.createDataFrame([("1", "old"), ("x", "kept")], "run_id string, v string")
    new = spark.createDataFrame([("1", "new")], "run_id string, v string")
    assert {tuple(r) for r in infer.upsert(stored, new, ["run_id"]).collect()} == {("1", "new"), ("x", "kept")}


def test_length_is_that_of_the_field_text(spark):
    two = json.dumps([{"role": "user", "content": "a long first message, longer than the last"}, {"role": "user", "content": "x"}])
    d = spark.createDataFrame([(1, two), (2, "short"), (3, '"' + "q" * 31 + '"'), (4, None)], "id int, input string")
    kept = filters.filter_runs(d, ["AND", {"id": "length", "params": {"field": "input", "operator": "gt", "length": 30}}])
    assert {r.id for r in kept.collect()} == {1, 3}
