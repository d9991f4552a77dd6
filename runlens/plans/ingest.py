"""A1–A8, B: sources, cleaning and folding. The event log is derived from the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import json as J
from ..functions import messages as M
from ..operators import chat, clean, fold, runs as runview, tokens
from ..session import shared_folder
from ..sources import events as ev
from ..sources import otlp
from . import fixtures as fx
from .registry import query


L = F.lit
TYPE_SQL = "CASE event_type WHEN 'click' THEN 'tool' WHEN 'purchase' THEN 'agent' WHEN 'signup' THEN 'chain' ELSE 'llm' END"
UUID_SQL = "substr({h},1,8)||'-'||substr({h},9,4)||'-4'||substr({h},14,3)||'-a'||substr({h},18,3)||'-'||substr({h},21,12)"
RUN_ID = UUID_SQL.format(h="sha256('run-' || event_id)")
PARENT_ID = UUID_SQL.format(h="sha256('run-' || (event_id // 4))")

fx.SQL_VIEWS["logged"] = f"""
SELECT event_id, ts, user_id, event_type, value, props, CAST(json_extract(props,'$.k') AS INT) AS k, {TYPE_SQL} AS type, {RUN_ID} AS run_id,
 CASE WHEN event_id >= 64 THEN {PARENT_ID} END AS parent_run_id, event_type = 'error' AS failed,
 ts + to_microseconds(CAST(round(value*10000) AS BIGINT)) AS ended_at FROM events
"""


def log_lines(e):
    """One JSON text per row of events: an array of a run's start, its end or error, and its feedback."""
    k = F.get_json_object("props", "$.k")
    kind = F.when(F.col("event_type") == "click", "tool").when(F.col("event_type") == "purchase", "agent").when(F.col("event_type") == "signup", "chain").otherwise("llm")
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    begun = F.col("ts").cast("timestamp")
    done = F.timestamp_micros(F.unix_micros(begun) + F.round(F.col("value") * 10000).cast("long"))
    later = F.timestamp_micros(F.unix_micros(done) + 1_000_000)
    rid = F.concat(L("run-"), F.col("event_id").cast("string"))
    parent = F.when(F.col("event_id") >= fx.ROOTS, F.concat(L('"parentRunId":"run-'), F.floor(F.col("event_id") / 4).cast("string"), L('",'))).otherwise(L(""))
    start = F.concat(
        L('{"type":"'), kind, L('","event":"start","runId":"'), rid, L('",'), parent, L('"timestamp":"'), iso(begun), L('","name":"models/'), "event_type",
        L('","input":[{"role":"user","content":"hello '), k, L('"}],"tags":["'), "event_type", L('"],"userId":"u'), F.col("user_id").cast("string"),
        L('","userProps":{"k":'), k, L('},"metadata":{"k":'), k, L(',"deep":{"x":1}}}'),
    )
    failed = F.col("event_type") == "error"
    usage = F.concat(L(',"tokensUsage":{"prompt":'), k, L(',"completion":'), F.col("value").cast("int").cast("string"), L("}"))
    end = F.concat(
        L('{"type":"'), kind, L('","event":"'), F.when(failed, "error").otherwise("end"), L('","runId":"'), rid, L('","timestamp":"'), iso(done), L('"'),
        F.when(failed, L(',"error":{"message":"failed"}}')).otherwise(F.concat(L(',"output":[{"role":"assistant","content":"bye"}],"metadata":{"done":true}'), usage, L("}"))),
    )
    said = lambda thumb: F.concat(
        L(',{"type":"llm","event":"feedback","runId":"'), rid, L('","timestamp":"'), iso(later), L('","feedback":{"thumb":"'), L(thumb), L('"},"extra":{"comment":"c'), k, L('"}}')
    )
    tail = F.when(F.col("event_type") == "purchase", said("up")).when(failed, said("down")).otherwise(L(""))
    return e.select(F.concat(L("["), end, L(","), start, tail, L("]")).alias("value"))


def parsed(spark, d):
    return ev.parse_events(log_lines(fx.table(spark, d, "events")))


def log(spark, d):
    return clean.clean(parsed(spark, d), "p0")


def ntz(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.col(c).cast("timestamp_ntz"))
    return df


@query(
    "a1_event_source",
    """SELECT 'run-' || event_id AS run_id, 'start' AS event, type, 'models/' || event_type AS name, 'u' || user_id AS user_id FROM logged
     UNION ALL SELECT 'run-' || event_id, CASE WHEN failed THEN 'error' ELSE 'end' END, type, NULL, NULL FROM logged
     UNION ALL SELECT 'run-' || event_id, 'feedback', 'llm', NULL, NULL FROM logged WHERE event_type IN ('purchase', 'error')""",
)
def a1(spark, d):
    """Log files below the shared folder, read by the event source."""
    path = shared_folder(spark, "log")
    log_lines(fx.table(spark, d, "events")).write.text(path)
    return ev.read_events(spark, path).select("run_id", "event", "type", "name", "user_id")


@query(
    "a2_event_ordering",
    "SELECT run_id, 'start' AS first_event, CASE WHEN event_type IN ('purchase','error') THEN 'feedback' ELSE 'end' END AS last_event FROM logged",
)
def a2(spark, d):
    seq = ev.sequence_key("ts")
    return log(spark, d).groupBy("run_id").agg(F.min_by("event", seq).alias("first_event"), F.max_by("event", seq).alias("last_event"))


def spans(spark, d):
    """Decoded spans of the event runs. A row gets much longer and dearer here than it is in the table, whose files may be few
    row groups; so the rows are dealt to all tasks first."""
    tasks = 3 * spark.sparkContext.defaultParallelism
    e = fx.table(spark, d, "events").select("event_id", "event_type", "ts", "props").repartition(tasks)
    k = F.get_json_object("props", "$.k").cast("long")
    kind = F.col("event_type")
    null = lambda t: L(None).cast(t)

    def kv(key, s=None, i=None, b=None):
        val = F.struct((s if s is not None else null("string")).alias("string_value"), (b if b is not None else null("boolean")).alias("bool_value"),
                       (i if i is not None else null("bigint")).alias("int_value"), null("double").alias("double_value"), null("string").alias("array_value"),
                       null("string").alias("kvlist_value"))
        return F.struct(L(key).alias("key"), val.alias("value"))

    op = F.when(kind == "purchase", "invoke_agent").when(kind == "click", "execute_tool").when(kind == "signup", "other").otherwise("chat")
    events = F.concat(L('[{"role":"user","content":"q'), k.cast("string"), L('"},{"message":{"role":"assistant","content":"a"}}]'))
    common = [kv("gen_ai.operation.name", op), kv("gen_ai.request.model", F.concat(L("models/m-"), kind)), kv("gen_ai.request.max_tokens", i=k), kv("gen_ai.request.stop_sequences", L('["x"]')),
              kv("gen_ai.usage.input_tokens", i=k), kv("gen_ai.usage.output_tokens", i=k * 2), kv("gen_ai.response.id", F.concat(L("r"), k.cast("string"))), kv("gen_ai.system", L("sys")),
              kv("logfire.msg.kind", L("hi")), kv("logfire.blob", L("data:abc")), kv("custom.flag", b=kind == "view"), kv("span_name", kind), kv("events", events)]
    extra = F.when(kind == "click", F.array(kv("gen_ai.tool.name", L("search")), kv("tool_arguments", L('{"q":1}')))).when(
        kind == "purchase", F.array(kv("agent_name", L("shopper")), kv("final_result", L("sold")))).when(kind == "error", F.array(kv("error.type", L("E1")), kv("error.message", L("bad")))).otherwise(F.array().cast("array<struct<key:string,value:struct<string_value:string,bool_value:boolean,int_value:bigint,double_value:double,array_value:string,kvlist_value:string>>>"))
    ns = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    return e.select(
        "event_id", kind.alias("event_type"), F.lower(F.lpad(F.hex("event_id"), 16, "0")).alias("span_id"), L("").alias("parent_span_id"), ns.alias("start_time_unix_nano"),
        (ns + 5_000_000).alias("end_time_unix_nano"), F.concat(F.array(*common), extra).alias("attributes"), L(None).cast("string").alias("events"),
    )


SPAN = "lpad(lower(to_hex(event_id)), 16, '0')"
SPAN_TYPE = "CASE event_type WHEN 'click' THEN 'tool' WHEN 'purchase' THEN 'agent' WHEN 'signup' THEN 'chain' ELSE 'llm' END"


@query(
    "a3_spans_to_events",
    f"""SELECT {SPAN} AS run_id, {SPAN_TYPE} AS type, 'start' AS event,
      CASE event_type WHEN 'click' THEN 'search' WHEN 'purchase' THEN 'shopper' WHEN 'signup' THEN 'signup' ELSE 'models/m-' || event_type END AS name,
      CASE WHEN event_type IN ('view','error') THEN '[{{"role":"user","content":"q' || k || '"}}]' WHEN event_type = 'click' THEN '{{"q":1}}' WHEN event_type='signup' THEN '{{}}' END AS input,
      NULL AS output, NULL AS prompt FROM logged
     UNION ALL SELECT {SPAN}, {SPAN_TYPE}, 'end', CASE event_type WHEN 'click' THEN 'search' WHEN 'purchase' THEN 'shopper' WHEN 'signup' THEN 'signup' ELSE 'models/m-' || event_type END, NULL,
      CASE WHEN event_type IN ('view','error') THEN '{{"role":"assistant","content":"a"}}' WHEN event_type = 'purchase' THEN '"sold"'
       WHEN event_type = 'click' THEN '[{{"role":"user","content":"q' || k || '"}},{{"message":{{"role":"assistant","content":"a"}}}}]' END,
      CASE WHEN event_type IN ('view','error') THEN k END FROM logged""",
)
def a3(spark, d):
    return otlp.spans_to_events(spans(spark, d)).select("run_id", "type", "event", "name", "input", "output", F.col("tokens_usage.prompt").alias("prompt"))


@query("a4_attribute_flattening", """SELECT event_id, '"m"' AS text, CAST(k AS VARCHAR) AS number, CASE WHEN event_type = 'view' THEN 'true' ELSE 'false' END AS flag, '["x"]' AS listed FROM logged""")
def a4(spark, d):
    s = spans(spark, d).withColumn("a", otlp.attribute_map())
    at = lambda key: F.try_element_at(F.col("a"), L(key))
    return s.select("event_id", F.regexp_replace(at("gen_ai.request.model"), "odels/m-[a-z]+", "").alias("text"), at("gen_ai.usage.input_tokens").alias("number"), at("custom.flag").alias("flag"), at("gen_ai.request.stop_sequences").alias("listed"))


@query(
    "a5_attribute_mapping",
    """SELECT event_id, 'm-' || event_type AS name, k AS prompt, CAST(k AS VARCHAR) AS max_tokens, '["x"]' AS stop, 'r' || k AS response_id, 'sys' AS system,
      'hi' AS logfire_msg_kind, NULL::VARCHAR AS logfire_blob, CASE WHEN failed THEN 'bad' END AS message, CASE WHEN event_type='click' THEN 'search' END AS tool_name FROM logged""",
)
def a5(spark, d):
    s = otlp.with_attributes(spans(spark, d))
    meta = lambda key: J.get_text("metadata", key).alias(key)
    return s.select("event_id", "name", F.col("tokens_usage.prompt").alias("prompt"), J.get_text("params", "max_tokens").alias("max_tokens"), J.get_text("params", "stop").alias("stop"),
                    meta("response_id"), meta("system"), meta("logfire_msg_kind"), meta("logfire_blob"), J.get_text("error", "message").alias("message"), meta("tool_name"))


GUARD = (50, 100)


@query(
    "a6_event_size_guard",
    f"""SELECT page_id, CASE WHEN big AND length(html) > {GUARD[1]} THEN substr(html, 1, {GUARD[1]}) || '... [truncated ' || (length(html) - {GUARD[1]}) || ' chars]' ELSE html END AS input
     FROM (SELECT page_id, html, true AS big FROM pages)""",
)
def a6(spark, d):
    p = fx.table(spark, d, "pages").select("page_id", F.col("html").alias("input"), L(None).cast("string").alias("output"), L(None).cast("string").alias("metadata"))
    return otlp.guard_size(p, *GUARD).select("page_id", "input")


@query(
    "a7_logs_to_events",
    f"""SELECT {SPAN_TYPE.replace("'agent'", "'message'").replace("'chain'", "'log'")} AS type,
      CASE event_type WHEN 'click' THEN 'complete' WHEN 'purchase' THEN 'user' WHEN 'signup' THEN 'exception' WHEN 'error' THEN 'stream' ELSE 'end' END AS event,
      {UUID_SQL.format(h=f"sha256({SPAN})")} AS run_id, CASE WHEN event_type IN ('click','view','error') THEN 'b' || k END AS output,
      CASE WHEN event_type IN ('purchase','signup') THEN 'b' || k END AS message FROM logged""",
)
def a7(spark, d):
    s = spans(spark, d)
    kind = F.col("event_type")
    name = F.when(kind == "click", "gen_ai.tool.message").when(kind == "purchase", "gen_ai.user.message").when(kind == "signup", "gen_ai.exception").otherwise("gen_ai.choice")
    null = lambda t: L(None).cast(t)
    finish = F.struct(L("gen_ai.choice.finish_reason").alias("key"), F.struct(L("stop").alias("string_value"), null("boolean").alias("bool_value"), null("bigint").alias("int_value"), null("double").alias("double_value"), null("string").alias("array_value"), null("string").alias("kvlist_value")).alias("value"))
    logs = s.select(L("t").alias("trace_id"), "span_id", F.col("start_time_unix_nano").alias("time_unix_nano"), name.alias("name"),
                    F.concat(L("b"), F.regexp_extract(F.to_json("attributes"), 'input_tokens","value":\\{"int_value":([0-9]+)', 1)).alias("body"),
                    F.when(kind == "view", F.concat("attributes", F.array(finish))).otherwise(F.col("attributes")).alias("attributes"))
    return otlp.logs_to_events(logs).select("type", "event", "run_id", "output", "message")


def tool_events(spark, d):
    """Orders as agent ends, their line items as tool calls."""
    o = fx.table(spark, d, "orders").select(
        F.concat(L("o"), "o_orderkey").alias("run_id"), L(None).cast("string").alias("parent_run_id"), L("agent").alias("type"), L("end").alias("event"),
        F.col("o_orderdate").cast("timestamp").alias("ts"), L(None).cast("string").alias("input"), L('{"ok":true}').alias("output"), L(None).cast("string").alias("metadata"))
    li = fx.table(spark, d, "lineitem").select(
        F.concat_ws("-", L("l"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("run_id"), F.concat(L("o"), "l_orderkey").alias("parent_run_id"), L("tool").alias("type"), L("end").alias("event"),
        F.col("l_shipdate").cast("timestamp").alias("ts"), F.col("l_partkey").cast("string").alias("input"), L(None).cast("string").alias("output"),
        F.concat(L('{"tool_call_id":"'), "l_linenumber", L('","tool_name":"ship"}')).alias("metadata"))
    return o.unionByName(li)


@query("a8_tool_call_rollup", "SELECT 'o' || o_orderkey AS run_id, count(l_orderkey) AS calls FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def a8(spark, d):
    out = otlp.roll_up_tool_calls(tool_events(spark, d)).where("type = 'agent'")
    return out.select("run_id", F.regexp_count("output", L('"name":"ship"')).cast("long").alias("calls"))


# --- B
@query("b1_key_normalisation", """SELECT event_id, '{"run_id":' || k || ',"user_props":{"first_name":"A_b-C","deep_list":[{"in_ner":1}]}}' AS body FROM logged""")
def b1(spark, d):
    e = fx.table(spark, d, "events")
    raw = F.concat(L('{"runId":'), F.get_json_object("props", "$.k"), L(',"user-props":{"firstName":"A_b-C","deepList":[{"inNer":1}]}}'))
    return e.select("event_id", clean.normalize_keys(raw).alias("body"))


@query("b2_metadata_cleaning", """SELECT event_id, '{"a":' || k || ',"b":"x","e":[1,"y",true],"enrichment":{"z":1}}' AS metadata FROM logged""")
def b2(spark, d):
    raw = F.concat(L('{"a":'), F.get_json_object("props", "$.k"), L(',"b":"x","c":{"d":1},"e":[1,"y",true],"enrichment":{"z":1},"f":[{"g":1}],"n":null}'))
    return fx.table(spark, d, "events").select("event_id", clean.clean_metadata(raw.alias("m")).alias("metadata"))


@query("b3_model_name_cleaning", "SELECT event_id, event_type || 'models/x' AS name FROM events")
def b3(spark, d):
    raw = F.concat(L("models/"), "event_type", L("models/x"))
    return fx.table(spark, d, "events").select("event_id", clean.clean_model_prefix(raw).alias("name"))


@query("b4_tag_coercion", "SELECT event_id, CASE WHEN event_type IN ('view','click') THEN event_type WHEN event_type = 'error' THEN 'a,b' ELSE 'm' END AS tags FROM events")
def b4(spark, d):
    kind = F.col("event_type")
    tags = F.when(kind.isin("view", "click"), kind).when(kind == "error", L('["a","b"]'))
    return fx.table(spark, d, "events").select("event_id", F.array_join(clean.tag_array(tags, L('{"tags":["m"]}')), ",").alias("tags"))


@query("b5_deterministic_run_id", "SELECT event_id, run_id FROM logged")
def b5(spark, d):
    return fx.table(spark, d, "events").select("event_id", clean.run_uuid(F.concat(L("run-"), F.col("event_id").cast("string"))).alias("run_id"))


H6 = "sha256('run-' || event_id || 'p0')"


@query("b6_sdk_run_id", f"SELECT event_id, substr({H6},1,8)||'-'||substr({H6},9,4)||'-'||substr({H6},13,4)||'-'||substr({H6},17,4)||'-'||substr({H6},21,12) AS run_id FROM events")
def b6(spark, d):
    return fx.table(spark, d, "events").select("event_id", clean.sdk_run_uuid(F.concat(L("run-"), F.col("event_id").cast("string")), L("p0")).alias("run_id"))


@query("b7_project_remap", "SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 'p' || user_id WHEN user_id % 3 = 1 THEN 'p' || user_id ELSE 'batch' END AS project_id FROM events")
def b7(spark, d):
    e = fx.table(spark, d, "events")
    u = F.col("user_id").cast("string")
    keys = e.select(F.explode(F.array(F.concat(L("pub"), u), F.concat(L("sec"), u))).alias("api_key"), F.concat(L("p"), u).alias("project_id")).distinct()
    app = F.when(F.col("user_id") % 3 == 0, F.concat(L("sec"), u)).when(F.col("user_id") % 3 == 1, F.concat(L("p"), u)).otherwise("unknown")
    return clean.remap_project(e.select("event_id", app.alias("app_id"), L("batch").alias("project_id")), keys).select("event_id", "project_id")


@query("b8_template_fallback", "SELECT event_id, CASE event_type WHEN 'view' THEN k WHEN 'click' THEN k + 1 ELSE k + 2 END AS template_version_id FROM logged")
def b8(spark, d):
    k, kind = F.get_json_object("props", "$.k").cast("int"), F.col("event_type")
    s = lambda c: c.cast("string")
    meta = F.concat(L('{"template_id":'), s(k + 2), L("}"))
    return fx.table(spark, d, "events").select("event_id", clean.template_id(F.when(kind == "view", s(k)), F.when(kind.isin("view", "click"), s(k + 1)), meta).alias("template_version_id"))


COUNT_SQL = "len(regexp_extract_all({x}, '[\\pL\\p{{N}}_]+|[^\\pL\\p{{N}}_\\s]'))"


@query(
    "b9_token_completion",
    f"""SELECT id, CAST(3 + 1 + 3 + {COUNT_SQL.format(x="text || chr(10) || 'user'")} AS BIGINT) AS prompt_tokens, CAST({COUNT_SQL.format(x="text")} AS BIGINT) AS completion_tokens FROM doc_run""",
)
def b9(spark, d):
    count = lambda text: F.regexp_count(text, L("[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]"))
    r = fx.doc_runs(spark, d).withColumn("prompt_tokens", L(None).cast("int")).withColumn("completion_tokens", L(0)).withColumn("params", L(None).cast("string"))
    r = r.withColumn("output", F.to_json(F.struct("text")))
    return tokens.complete_tokens(r, count).select("id", F.col("prompt_tokens").cast("long").alias("prompt_tokens"), F.col("completion_tokens").cast("long").alias("completion_tokens"))


@query(
    "b9_encoder_per_model",
    f"""WITH m AS (SELECT id, text, text || chr(10) || 'user' AS asked, doc_id % 3 AS k FROM doc_run)
     SELECT id, CAST(7 + CASE k WHEN 0 THEN length(asked) WHEN 1 THEN 1 ELSE {COUNT_SQL.format(x="asked")} END AS BIGINT) AS prompt_tokens,
      CAST(CASE k WHEN 0 THEN length(text) WHEN 1 THEN 1 ELSE {COUNT_SQL.format(x="text")} END AS BIGINT) AS completion_tokens FROM m""",
)
def b9e(spark, d):
    """Characters for one encoding, 1 for another, words and marks for the rest."""
    k = F.col("doc_id") % 3
    r = fx.doc_runs(spark, d).withColumn("prompt_tokens", L(None).cast("int")).withColumn("completion_tokens", L(0)).withColumn("params", L(None).cast("string"))
    r = r.withColumn("output", F.to_json(F.struct("text"))).withColumn("name", F.when(k == 0, "gpt-4o-mini").when(k == 1, "curie").otherwise("unheard-of"))
    counters = {
        "o200k_base": F.length, "r50k_base": lambda t: F.when(F.length(t) > 0, 1), "cl100k_base": lambda t: F.regexp_count(t, L("[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]")),
    }
    return tokens.complete_tokens(r, counters).select("id", F.col("prompt_tokens").cast("long").alias("prompt_tokens"), F.col("completion_tokens").cast("long").alias("completion_tokens"))


@query("b10_encoding_selection", "SELECT event_id, CASE event_type WHEN 'view' THEN 'o200k_base' WHEN 'click' THEN 'p50k_base' WHEN 'error' THEN 'r50k_base' ELSE 'cl100k_base' END AS encoding FROM events")
def b10(spark, d):
    kind = F.col("event_type")
    model = F.when(kind == "view", F.concat(L("gpt-4o-"), kind)).when(kind == "click", "text-davinci-003").when(kind == "error", "curie").when(kind == "signup", "my-claude").otherwise("unheard-of")
    return fx.table(spark, d, "events").select("event_id", tokens.encoding_of(model).alias("encoding"))


@query("b11_user_upsert", "SELECT 'u' || user_id AS external_id, min(ts) AS created_at, max(ts) AS last_seen, CAST(arg_max(k, (ts, event_id)) AS VARCHAR) AS k FROM logged GROUP BY 1")
def b11(spark, d):
    u = fold.fold_users(log(spark, d))
    return ntz(u.select("external_id", "created_at", "last_seen", J.get_text("props", "k").alias("k")), "created_at", "last_seen")


@query(
    "b12_user_cascade",
    """WITH RECURSIVE up AS (SELECT event_id, event_id AS root FROM events WHERE event_id < 64
      UNION ALL SELECT e.event_id, up.root FROM up JOIN events e ON e.event_id // 4 = up.event_id AND e.event_id >= 64)
     SELECT l.run_id AS id, 'u' || r.user_id AS user_id FROM up JOIN logged l ON l.event_id = up.event_id JOIN events r ON r.event_id = up.root""",
)
def b12(spark, d):
    return fold.cascade_users(fold.fold_runs(log(spark, d))).select("id", "user_id")


FOLDED = """SELECT run_id AS id, type, event_type AS name, CASE WHEN failed THEN 'error' ELSE 'success' END AS status, ts AS created_at, ended_at, parent_run_id,
 'u' || user_id AS user_id, CASE WHEN failed THEN NULL ELSE k END AS prompt_tokens, CASE WHEN failed THEN NULL ELSE CAST(trunc(value) AS INT) END AS completion_tokens,
 CASE WHEN failed THEN '{"k":' || k || '}' ELSE '{"done":true,"k":' || k || '}' END AS metadata,
 CASE event_type WHEN 'purchase' THEN '{"comment":"c' || k || '","thumb":"up"}' WHEN 'error' THEN '{"comment":"c' || k || '","thumb":"down"}' END AS feedback FROM logged"""


@query("b13_run_fold", FOLDED)
def b13(spark, d):
    e = log(spark, d)
    r = fold.with_feedback(fold.fold_runs(e), fold.fold_feedback(e))
    r = r.withColumn("metadata", F.to_json(F.parse_json("metadata")))  # canonical key order
    return ntz(r, "created_at", "ended_at").select("id", "type", "name", "status", "created_at", "ended_at", "parent_run_id", "user_id", "prompt_tokens", "completion_tokens", "metadata", "feedback")


@query("b14_duplicate_starts", "SELECT run_id, CAST(1 AS BIGINT) AS extra FROM logged WHERE event_type = 'view'")
def b14(spark, d):
    e = log(spark, d)
    again = e.where("event = 'start' and name = 'view'").withColumn("ts", F.col("ts") + F.expr("interval 1 second")).withColumn("name", L("second"))
    return fold.duplicate_starts(e.unionByName(again))


@query("b14_first_start_wins", "SELECT run_id AS id, event_type AS name, ts AS created_at FROM logged")
def b14f(spark, d):
    e = log(spark, d)
    again = e.where("event = 'start' and name = 'view'").withColumn("ts", F.col("ts") + F.expr("interval 1 second")).withColumn("name", L("second"))
    return ntz(fold.fold_runs(e.unionByName(again)).select("id", "name", "created_at"), "created_at")


@query(
    "b15_late_and_orphans",
    """SELECT l.run_id AS id, CASE WHEN p.event_type <> 'signup' THEN l.parent_run_id END AS parent_run_id FROM logged l LEFT JOIN logged p ON p.run_id = l.parent_run_id WHERE l.event_type <> 'signup'""",
)
def b15(spark, d):
    e = log(spark, d)
    lost = e.where(~((F.col("event") == "start") & (F.coalesce("name", L("")) == "signup")))
    return fold.without_missing_parents(fold.fold_runs(lost)).select("id", "parent_run_id")


@query("b16_feedback_merge", """SELECT run_id, CASE WHEN event_type = 'purchase' THEN '{"comment":"c' || k || '","thumb":"down"}' ELSE '{"comment":"c' || k || '","thumb":"down"}' END AS feedback FROM logged WHERE event_type IN ('purchase','error')""")
def b16(spark, d):
    e = log(spark, d)
    later = e.where("event = 'feedback'").withColumn("ts", F.col("ts") + F.expr("interval 1 minute")).withColumn("feedback", L('{"thumb":"down"}')).withColumn("extra", L(None).cast("string"))
    return fold.fold_feedback(e.unionByName(later))


@query("b17_metadata_update", "SELECT run_id, '{\"v\":2}' AS metadata FROM logged WHERE type = 'llm'")
def b17(spark, d):
    e = log(spark, d).where("event = 'start' and type = 'llm'").withColumn("event", L("update"))
    two = e.withColumn("metadata", L('{"v":1}')).unionByName(e.withColumn("ts", F.col("ts") + F.expr("interval 5 seconds")).withColumn("metadata", L('{"v":2}')))
    return fold.update_metadata(two)


@query("b18_score_upsert", "SELECT CAST(user_id AS VARCHAR) AS run_id, event_type AS label, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2")
def b18(spark, d):
    s = fx.table(spark, d, "events").select(F.col("user_id").cast("string").alias("run_id"), F.col("event_type").alias("label"), "value", L("").alias("comment"), "ts")
    return fold.fold_scores(s).select("run_id", "label", "value")


def chat_log(spark, d):
    """Message log with retries (an answer in every third thread's turn 3) and a custom event at turn 2 of every fifth."""
    m = fx.messages(spark, d)
    conv = F.regexp_extract("thread_id", "[0-9]+", 0).cast("long")
    return m.withColumn("is_retry", (conv % 3 == 0) & (F.col("turn") == 3) & (F.col("role") == "assistant")).withColumn("is_custom", (conv % 5 == 1) & (F.col("turn") == 2))


CHAT = """src AS (SELECT *, (conv_id % 3 = 0 AND turn = 3 AND role = 'assistant') AS retry, (conv_id % 5 = 1 AND turn = 2) AS custom FROM chat_msg),
 sided AS (SELECT *, CASE WHEN custom THEN NULL WHEN role IN ('assistant','tool','bot') THEN 'output' WHEN role IN ('user','system') THEN 'input' END AS side FROM src),
 looked AS (SELECT *, lag(id) OVER w AS pid, lag(side) OVER w AS pside, coalesce(lag(custom) OVER w, false) AS pcustom FROM sided WINDOW w AS (PARTITION BY thread_id ORDER BY turn)),
 opened AS (SELECT *, (pid IS NULL OR custom OR retry OR pcustom OR side IS NULL OR (side = 'input' AND pside = 'output')) AS opens, (retry AND NOT custom AND pid IS NOT NULL) AS inherits FROM looked),
 ex AS (SELECT *, CAST(sum(opens::INT) OVER (PARTITION BY thread_id ORDER BY turn) AS BIGINT) AS exchange, sum((opens AND NOT inherits)::INT) OVER (PARTITION BY thread_id ORDER BY turn) AS grp FROM opened)"""


@query(
    "b19_chat_reconciliation",
    f"""WITH {CHAT} SELECT thread_id AS parent_run_id, exchange, arg_max(id, turn) AS id, min(timestamp) AS created_at, max(timestamp) AS ended_at,
     CASE WHEN bool_or(custom) THEN 'custom-event' ELSE 'chat' END AS type, max(CASE WHEN retry THEN pid END) AS sibling_run_id FROM ex GROUP BY 1, 2""",
)
def b19(spark, d):
    r = chat.exchanges(chat.exchange_messages(chat_log(spark, d)))
    return ntz(r, "created_at", "ended_at").select("parent_run_id", "exchange", "id", "created_at", "ended_at", "type", "sibling_run_id")


@query(
    "b19_chat_messages",
    f"""WITH {CHAT} SELECT thread_id, exchange, side, id, content FROM ex WHERE side IS NOT NULL
     UNION ALL SELECT g.thread_id, t.exchange, 'input', g.id, g.content FROM ex g JOIN (SELECT DISTINCT thread_id, grp, exchange FROM ex WHERE inherits) t
      ON t.thread_id = g.thread_id AND t.grp = g.grp AND g.exchange < t.exchange WHERE g.side = 'input'""",
)
def b19m(spark, d):
    return chat.chat_messages(chat.exchange_messages(chat_log(spark, d))).select("thread_id", "exchange", "side", "id", "content")


@query(
    "b19_chat_runs",
    f"""WITH {CHAT}, msgs AS (SELECT thread_id, exchange, side, turn, content FROM ex WHERE side IS NOT NULL
     UNION ALL SELECT g.thread_id, t.exchange, 'input', g.turn, g.content FROM ex g JOIN (SELECT DISTINCT thread_id, grp, exchange FROM ex WHERE inherits) t
      ON t.thread_id = g.thread_id AND t.grp = g.grp AND g.exchange < t.exchange WHERE g.side = 'input')
     SELECT e.thread_id AS parent_run_id, e.exchange, string_agg(m.content, '|' ORDER BY m.turn) FILTER (m.side = 'input') AS inputs,
      string_agg(m.content, '|' ORDER BY m.turn) FILTER (m.side = 'output') AS outputs
     FROM (SELECT DISTINCT thread_id, exchange FROM ex) e LEFT JOIN msgs m ON m.thread_id = e.thread_id AND m.exchange = e.exchange GROUP BY 1, 2""",
)
def b19r(spark, d):
    r = chat.chat_runs(chat_log(spark, d))
    text = lambda c: F.array_join(F.transform(c, lambda m: m["content"]), "|")
    return r.select("parent_run_id", "exchange", text("input").alias("inputs"), text("output").alias("outputs"))


@query("b20_thread_upsert", "SELECT thread_id AS id, min(timestamp) AS created_at, arg_max(content, turn) AS content FROM chat_msg GROUP BY 1")
def b20(spark, d):
    return ntz(chat.thread_runs(fx.messages(spark, d)).select("id", "created_at", F.get_json_object("input", "$.content").alias("content")), "created_at")


@query("b21_custom_events", "SELECT run_id AS id, ts AS created_at, ts AS ended_at, parent_run_id FROM logged WHERE parent_run_id IS NOT NULL")
def b21(spark, d):
    e = log(spark, d).where("event = 'start'").withColumn("event", L("custom-event"))
    return ntz(fold.custom_event_runs(e).select("id", "created_at", "ended_at", "parent_run_id"), "created_at", "ended_at")


@query("b22_log_events", "SELECT run_id, 'info' AS level, event_type AS message FROM logged")
def b22(spark, d):
    e = log(spark, d).where("event = 'start'").withColumn("type", L("log")).withColumn("level", L("info")).withColumn("message", F.col("name"))
    return fold.log_rows(e).select("run_id", "level", "message")


@query(
    "b23_redaction",
    """SELECT run_id AS id, CASE WHEN event_type IN ('view', 'error') THEN '"__NOT_INGESTED__"' ELSE '[{"role":"user","content":"hello ' || k || '"}]' END AS input,
     CASE WHEN failed THEN NULL WHEN event_type = 'view' THEN '"__NOT_INGESTED__"' ELSE '[{"role":"assistant","content":"bye"}]' END AS output FROM logged""",
)
def b23(spark, d):
    rules = {"p0": ["AND", {"id": "models", "params": {"models": ["view"]}}, {"id": "tags", "params": {"tags": ["error"]}}]}
    return fold.fold_runs(clean.redact(log(spark, d), rules)).select("id", "input", "output")


@query(
    "b24_event_report",
    """SELECT run_id, 'start' AS event, true AS success, NULL AS error FROM logged WHERE event_type <> 'view'
     UNION ALL SELECT run_id, CASE WHEN failed THEN 'error' ELSE 'end' END, event_type <> 'view', CASE WHEN event_type = 'view' THEN 'no start for this run' END FROM logged
     UNION ALL SELECT run_id, 'feedback', true, NULL FROM logged WHERE event_type IN ('purchase','error')""",
)
def b24(spark, d):
    e = log(spark, d).where(~((F.col("event") == "start") & (F.coalesce("name", L("")) == "view"))).withColumn("event_no", F.xxhash64("run_id", "event", "ts"))
    return clean.report(e).select("run_id", "event", "success", "error")


@query("b25_chat_message_preview", "SELECT id, substr(text, 1, 100) AS preview, true AS valid FROM doc_run")
def b25(spark, d):
    r = fx.doc_runs(spark, d)
    return r.select("id", M.preview(F.concat(L('{"input":'), F.col("input"), L("}"))).alias("preview"), M.valid_messages("input").isNotNull().alias("valid"))


@query("b26_run_formatting", "SELECT id, text AS content, lang AS language, source AS topic, CASE WHEN quality IS NULL THEN NULL WHEN quality = 1 THEN 'positive' ELSE 'negative' END AS sentiment FROM doc_run")
def b26(spark, d):
    out = runview.formatted(fx.doc_runs(spark, d), fx.doc_results(spark, d))
    m = F.col("input_messages")[0]
    return out.select("id", m["content"].alias("content"), J.get_text(m["language"], "isoCode").alias("language"), F.get_json_object(m["topics"], "$[0].topic").alias("topic"), J.get_text(m["sentiment"], "label").alias("sentiment"))
