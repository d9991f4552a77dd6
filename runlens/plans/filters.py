"""D: filter leaves and trees. Every query returns the ids that match."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import enrich, filter_plan
from ..operators.filters import Tables, enrichment_split, filter_runs, regex_match, run_checks, user_props_split
from ..operators.similarity import with_reference
from . import fixtures as fx
from .registry import query


def tables(spark, d) -> Tables:
    r = fx.runs(spark, d)
    return Tables(runs=r, users=fx.users(spark, d), template_versions=fx.template_versions(spark, d))


def doc_tables(spark, d) -> Tables:
    return Tables(
        runs=fx.doc_runs(spark, d), results=fx.doc_results(spark, d), toxicity=fx.doc_toxicity(spark, d),
        intent_aliases=fx.intent_aliases(spark, d),
    )


def leaf(check: str, **params):
    return {"id": check, "params": params}


def on_runs(name: str, logic, where: str):
    @query(name, f"SELECT id FROM run WHERE {where}")
    def q(spark, d):
        t = tables(spark, d)
        return filter_runs(t.runs, logic, t).select("id")


def on_docs(name: str, logic, where: str):
    @query(name, f"SELECT id FROM doc_run WHERE {where}")
    def q(spark, d):
        t = doc_tables(spark, d)
        return filter_runs(t.runs, logic, t).select("id")


ALL = "AND"
on_runs("d0_and_or_tree", ["OR", leaf("models", models=["view"]), [ALL, leaf("cost", operator="gt", cost=50), leaf("status", status="success")]],
        "name = 'view' OR (cost > 50 AND status = 'success')")
on_runs("d0_nested_members", ["OR", leaf("feedback", types=['{"thumb":"up"}']), [ALL, leaf("user-props", key="plan", value="team"), leaf("tokens", field="prompt", operator="gte", tokens=90)]],
        """thumb = 'up' OR id IN (SELECT parent_run_id FROM run WHERE thumb = 'up') OR (prompt_tokens >= 90 AND
        external_user_id IN (SELECT id FROM ext_user WHERE plan = 'team'))""")
on_runs("d0_unknown_leaf", [ALL, leaf("no-such-leaf"), leaf("status", status="error")], "status = 'error'")
on_runs("d10_type", [ALL, leaf("type", type="llm")], "type = 'llm'")
on_runs("d10_type_trace", [ALL, leaf("type", type="trace")],
        "type IN ('agent','chain') AND (parent_run_id IS NULL OR parent_run_id IN (SELECT id FROM run WHERE type = 'chat'))")
on_runs("d11_models", [ALL, leaf("models", models=["view", "click"])], "name IN ('view','click')")
on_runs("d12_tools", [ALL, leaf("tools", toolName="CL")], "name ILIKE '%CL%'")
on_runs("d12_retrievers", [ALL, leaf("retrievers", retrieverName="ie")], "name ILIKE '%ie%'")
on_runs("d13_tags", [ALL, leaf("tags", tags=["b3", "signup"])], "list_has_any(tags, ['b3','signup'])")
on_runs("d14_templates", [ALL, leaf("templates", templates=[1, 2])], "template_version_id IN (SELECT id FROM tmpl WHERE template_id IN (1, 2))")
on_runs("d15_metadata", [ALL, leaf("metadata", key="k", value="42")], "prompt_tokens = 42")
on_runs("d16_status", [ALL, leaf("status", status="error")], "status = 'error'")
on_docs("d17_languages", [ALL, leaf("languages", field="input", codes=["de", "fr"])], "lang IN ('de','fr')")
on_docs("d17_languages_any", [ALL, leaf("languages", field="any", codes=["es"])], "lang = 'es'")
on_docs("d18_pii", [ALL, leaf("pii", containsPii="true")], f"regexp_matches(text, '{fx.EMAIL}')")
on_docs("d18_pii_false", [ALL, leaf("pii", containsPii="false")], f"NOT regexp_matches(text, '{fx.EMAIL}')")
on_docs("d19_sentiment", [ALL, leaf("sentiment", sentiment="positive")], "quality = 1")
on_docs("d20_toxicity", [ALL, leaf("toxicity", field="input", type="toxic")], "toxic = 1")
on_docs("d20_toxicity_output", [ALL, leaf("toxicity", field="output", type="toxic")], "quality = 0")
on_docs("d21_topics", [ALL, leaf("topics", field="input", topics=["src1", "src2"])], "source IN ('src1','src2')")
on_docs("d22_intents", [ALL, leaf("intents", intents=["Group 2", "ask src3"])], "CAST(substr(source, 4) AS INT) % 5 = 2 OR source = 'src3'")
on_runs("d23_users", [ALL, leaf("users", users=[1, 2, 3])], "external_user_id IN (1, 2, 3)")
on_runs("d24_user_props", [ALL, leaf("user-props", key="plan", value="  team ")], "external_user_id IN (SELECT id FROM ext_user WHERE plan = 'team')")
on_runs("d24_user_props_number", [ALL, leaf("user-props", key="k", value='{"type":"number","value":42}')], "external_user_id IN (SELECT id FROM ext_user WHERE k = 42)")
on_runs("d24_user_props_text_is_not_number", [ALL, leaf("user-props", key="k", value="42")], "false")
on_runs("d25_feedback", [ALL, leaf("feedback", types=['{"thumb":"down"}'])], "thumb = 'down' OR id IN (SELECT parent_run_id FROM run WHERE thumb = 'down')")
on_runs("d25_feedback_none", [ALL, leaf("feedback", types=['{"thumb":null}'])],
        "thumb IS NULL AND id NOT IN (SELECT parent_run_id FROM run WHERE thumb IS NOT NULL AND parent_run_id IS NOT NULL)")
on_runs("d25_feedback_comment", [ALL, leaf("feedback", types=['{"comment":""}', '{"thumb":"up"}'])], "thumb = 'up' OR id IN (SELECT parent_run_id FROM run WHERE thumb = 'up')")
on_runs("d28_date", [ALL, leaf("date", operator="gte", date="2024-01-15T00:00:00")], "created_at >= TIMESTAMP '2024-01-15'")
on_runs("d28_date_invalid", [ALL, leaf("date", operator="gte", date="not a date")], "true")
on_runs("d29_duration", [ALL, leaf("duration", operator="lt", duration=0.5)], "duration_s < 0.5")
on_runs("d30_cost", [ALL, leaf("cost", operator="lte", cost=12.5)], "cost <= 12.5")
on_runs("d31_tokens", [ALL, leaf("tokens", field="total", operator="gt", tokens=100)], "prompt_tokens + completion_tokens > 100")
on_runs("d33_search", [ALL, leaf("search", query="USER 1")], "input ILIKE '%USER 1%' OR output ILIKE '%USER 1%'")
on_runs("d34_string_starts", [ALL, leaf("string", fields="output", type="starts", text="USER 1", sensitive="false")], "starts_with(lower('user ' || external_user_id), 'user 1') AND status <> 'error'")
on_docs("d27_length", [ALL, leaf("length", field="input", operator="gt", length=1500)], "length(CAST(to_json([{'role': 'user', 'content': text}]) AS VARCHAR)) > 1500")
on_docs("d33_search_text", [ALL, leaf("search", query="THE")], "text ILIKE '%THE%'")
on_docs("d34_string", [ALL, leaf("string", fields="any", type="contains", text="und", sensitive="true")], "contains(text, 'und')")
on_docs("d34_string_not", [ALL, leaf("string", fields="input", type="notcontains", text="The", sensitive="false")], "NOT contains(lower(text), 'the')")
on_docs("d35_regex", [ALL, leaf("regex", regex="[0-9]{3}-[0-9]{4}", type="contains", field="output")], "regexp_matches(text, '[0-9]{3}-[0-9]{4}')")
on_docs("d36_json", [ALL, leaf("json", field="output", type="invalid")], "NOT json_valid(text)")


@query("d35_regex_match", "SELECT id, regexp_extract(text, '[0-9]+', 0) AS match FROM doc_run")
def d35m(spark, d):
    return fx.doc_runs(spark, d).select("id", regex_match("[0-9]+").alias("match"))


@query("d36_json_props", "SELECT id FROM run WHERE json_valid(metadata)")
def d36(spark, d):
    r = fx.runs(spark, d)
    return filter_runs(r.withColumn("output", F.col("metadata")), [ALL, leaf("json", field="output", type="valid")]).select("id")


@query("d36_json_contains", "SELECT id FROM run WHERE regexp_matches(metadata, '\\{.*?\\}')")
def d36c(spark, d):
    r = fx.runs(spark, d).withColumn("output", F.concat(F.lit('"see '), F.regexp_replace("metadata", '"', ""), F.lit('"'))).withColumn("output", F.concat(F.lit("see "), F.col("metadata")))
    return filter_runs(r, [ALL, leaf("json", field="output", type="contains")]).select("id")


@query("d26_custom_events", "SELECT id FROM run WHERE name IN ('view', 'signup')")
def d26(spark, d):
    r = fx.runs(spark, d).withColumn("type", F.lit("custom-event"))
    return filter_runs(r, [ALL, leaf("custom-events", customEvents=["view", "signup"])]).select("id")


@query("d32_messages", "SELECT thread_id AS id FROM chat_msg GROUP BY 1 HAVING count(*) >= 5")
def d32(spark, d):
    m = fx.messages(spark, d)
    threads = m.groupBy(F.col("thread_id").alias("id")).agg(F.min("timestamp").alias("created_at"))
    t = Tables(runs=threads, thread_stats=enrich.message_stats(m))
    return filter_runs(threads, [ALL, leaf("messages", operator="gte", messages=5)], t).select("id")


@query(
    "d2_enrichment_split",
    "SELECT id FROM doc_run WHERE lang IN ('de','en') AND source IN ('src1','src2') AND length(text) > 200",
)
def d2(spark, d):
    t = doc_tables(spark, d)
    logic = [ALL, leaf("languages", field="any", codes=["de", "en"]), leaf("length", field="input", operator="gt", length=200), leaf("topics", field="any", topics=["src1", "src2"])]
    enrichment, rest = enrichment_split(logic)
    return filter_runs(filter_runs(t.runs, rest, t), enrichment, t).select("id")


@query("d3_user_props_split", "SELECT id FROM run WHERE status = 'success' AND external_user_id IN (SELECT id FROM ext_user WHERE plan = 'pro')")
def d3(spark, d):
    t = tables(spark, d)
    props, rest = user_props_split([ALL, leaf("user-props", key="plan", value="pro"), leaf("status", status="success")])
    return filter_runs(filter_runs(t.runs, rest, t), props, t).select("id")


@query(
    "d4_filter_by_plan",
    "SELECT id FROM run WHERE duration_s > 0.06 AND duration_s < 2.0 AND name IN ('view') AND (status = 'success' OR cost > 10)",
)
def d4(spark, d):
    t = tables(spark, d)
    plan = {
        "op": "AND",
        "clauses": [
            {"id": "duration", "op": "between", "range": [60, 2000], "unit": "milliseconds"},
            {"id": "models", "values": ["view", "nothing"]},
            {"id": "astrology", "value": 1},
        ],
        "groups": [{"op": "OR", "clauses": [{"id": "status", "value": "success"}, {"id": "cost", "op": "gt", "value": 10}]}],
    }
    df, _ = filter_plan.filter_by_plan(t.runs, plan, {"models": ["view", "click"]}, t)
    return df.select("id")


@query(
    "d5_check_runner",
    """SELECT id, (status = 'success' AND cost > 20 AND prompt_tokens < 80) AS passed,
     CAST(CASE WHEN status <> 'success' THEN 1 WHEN NOT cost > 20 THEN 2 ELSE 3 END AS BIGINT) AS n_results FROM run""",
)
def d5(spark, d):
    t = tables(spark, d)
    logic = [ALL, leaf("status", status="success"), leaf("cost", operator="gt", cost=20), leaf("tokens", field="prompt", operator="lt", tokens=80)]
    return run_checks(t.runs, logic, t).select("id", "passed", F.size("results").cast("long").alias("n_results"))


@query(
    "d6_checklist",
    """SELECT id, (contains(text, 'the') OR length(CAST(to_json([{'role': 'assistant', 'content': text}]) AS VARCHAR)) > 300) AS passed,
     CAST(CASE WHEN contains(text, 'the') THEN 1 ELSE 2 END AS BIGINT) AS n_results FROM doc_run""",
)
def d6(spark, d):
    t = doc_tables(spark, d)
    logic = ["OR", leaf("string", fields="output", type="contains", text="the", sensitive="true"), leaf("length", field="output", operator="gt", length=300)]
    return run_checks(t.runs, logic, t).select("id", "passed", F.size("results").cast("long").alias("n_results"))


def _tok(x):
    return f"list_filter(regexp_split_to_array({x}, '\\s+'), lambda t: t <> '')"


@query(
    "d37_rouge_threshold",
    f"""SELECT id FROM (SELECT id, {_tok('text')} AS h, {_tok('ref')} AS r FROM
     (SELECT r.id, r.text, b.text AS ref FROM doc_run r JOIN benchmark b ON b.item_id = r.doc_id % (SELECT count(*) FROM benchmark)))
     WHERE len(list_distinct(list_intersect(h, r)))::DOUBLE / len(r) * 100 >= 30""",
)
def d37(spark, d):
    r = with_reference(fx.doc_runs(spark, d), fx.table(spark, d, "benchmark"))
    return filter_runs(r, [ALL, leaf("rouge", percent="30", rouge="n")]).select("id")


@query(
    "d38_similarity_threshold",
    f"""SELECT id FROM (SELECT id, {_tok('text')} AS h, {_tok('ref')} AS r FROM
     (SELECT r.id, r.text, b.text AS ref FROM doc_run r JOIN benchmark b ON b.item_id = r.doc_id % (SELECT count(*) FROM benchmark)))
     WHERE 1 + 99 * len(list_intersect(list_distinct(h), list_distinct(r)))::DOUBLE / len(list_distinct(list_concat(h, r))) >= 4""",
)
def d38(spark, d):
    r = with_reference(fx.doc_runs(spark, d), fx.table(spark, d, "benchmark"))
    return filter_runs(r, [ALL, leaf("similarity", algorithm="jaccard", percent=4)]).select("id")


@query("d39_judged_check", "SELECT id FROM doc_run WHERE quality = 1")
def d39(spark, d):
    """Factualness verdicts as an enricher stores them; the leaf accepts the choices A and B."""
    t = doc_tables(spark, d)
    verdict = F.when(F.col("quality") == 1, "A").otherwise("D")
    judged = t.runs.where("quality is not null").select(
        F.col("id").alias("run_id"), F.lit("ev-fact").alias("evaluator_id"), F.lit("factualness").alias("type"), F.concat(F.lit('{"result":"'), verdict, F.lit('"}')).alias("result")
    )
    t.results = t.results.unionByName(judged)
    return filter_runs(t.runs, [ALL, leaf("factualness", choices=["A", "B"])], t).select("id")
