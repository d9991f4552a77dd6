"""Run-shaped views over the given tables, in Spark and as SQL text for the oracle.

Both twins use the same casts. Nothing is materialised: a view is a projection that
Catalyst prunes to the columns a query reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

START, END = "2024-01-01 00:00:00", "2024-02-01 00:00:00"
TYPE_OF_EVENT = {"view": "llm", "click": "chat", "error": "llm", "purchase": "agent", "signup": "thread"}
ROOTS = 64  # the first runs have no parent; later ones form a four-ary tree below them


# fixed values: the columns of the given tables; a stated schema saves reading footers on the driver
TABLE_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
    "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.schema(TABLE_SCHEMAS[name]).parquet(f"{d}/{name}.parquet")


def runs(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.col("event_type")
    typed = F.coalesce(*[F.when(kind == a, F.lit(b)) for a, b in TYPE_OF_EVENT.items()])
    failed = kind == "error"
    created = F.col("ts").cast("timestamp")
    return e.select(
        F.col("event_id").cast("string").alias("id"),
        F.concat(F.lit("p"), (F.col("user_id") % 4).cast("string")).alias("project_id"),
        F.concat(F.lit("o"), (F.col("user_id") % 2).cast("string")).alias("org_id"),
        typed.alias("type"),
        kind.alias("name"),
        F.when(failed, "error").otherwise("success").alias("status"),
        created.alias("created_at"),
        F.timestamp_micros(F.unix_micros(created) + F.round(F.col("value") * 10000).cast("long")).alias("ended_at"),
        (F.col("value") / 100).alias("duration_s"),
        F.when(F.col("event_id") >= ROOTS, F.floor(F.col("event_id") / 4).cast("string")).alias("parent_run_id"),
        F.col("user_id").alias("external_user_id"),
        F.concat(F.lit('[{"role":"user","content":"'), kind, F.lit(" "), k.cast("string"), F.lit('"}]')).alias("input"),
        F.when(
            ~failed,
            F.concat(F.lit('[{"role":"assistant","content":"user '), F.col("user_id").cast("string"), F.lit('"}]')),
        ).alias("output"),
        F.when(failed, F.lit('{"message":"failed"}')).alias("error"),
        F.col("props").alias("metadata"),
        F.when(kind == "purchase", F.lit('{"thumb":"up"}')).when(failed, F.lit('{"thumb":"down"}')).alias("feedback"),
        F.array(kind, F.concat(F.lit("b"), F.floor(k / 25).cast("string"))).alias("tags"),
        k.alias("prompt_tokens"),
        F.col("value").cast("int").alias("completion_tokens"),
        F.lit(0).alias("cached_prompt_tokens"),
        F.col("value").alias("cost"),
        F.floor(k / 10).cast("int").alias("template_version_id"),
        F.lit(False).alias("is_deleted"),
    )


RUN_SQL = """
SELECT CAST(event_id AS VARCHAR) AS id, 'p' || (user_id % 4) AS project_id, 'o' || (user_id % 2) AS org_id,
 CASE event_type WHEN 'view' THEN 'llm' WHEN 'click' THEN 'chat' WHEN 'error' THEN 'llm'
  WHEN 'purchase' THEN 'agent' WHEN 'signup' THEN 'thread' END AS type,
 event_type AS name, CASE WHEN event_type='error' THEN 'error' ELSE 'success' END AS status,
 ts AS created_at, ts + to_microseconds(CAST(round(value*10000) AS BIGINT)) AS ended_at, value/100 AS duration_s,
 CASE WHEN event_id >= 64 THEN CAST(event_id // 4 AS VARCHAR) END AS parent_run_id, user_id AS external_user_id,
 '[{"role":"user","content":"' || event_type || ' ' || k || '"}]' AS input,
 CASE WHEN event_type <> 'error' THEN '[{"role":"assistant","content":"user ' || user_id || '"}]' END AS output,
 CASE WHEN event_type = 'error' THEN '{"message":"failed"}' END AS error, props AS metadata,
 CASE event_type WHEN 'purchase' THEN 'up' WHEN 'error' THEN 'down' END AS thumb,
 [event_type, 'b' || (k // 25)] AS tags, k AS prompt_tokens, CAST(trunc(value) AS INT) AS completion_tokens,
 value AS cost, k // 10 AS template_version_id
FROM (SELECT *, CAST(json_extract(props,'$.k') AS INT) AS k FROM events)
"""


def users(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    agg = e.groupBy("user_id").agg(
        F.min("ts").cast("timestamp").alias("created_at"),
        F.max("ts").cast("timestamp").alias("last_seen"),
        F.min_by(k, F.struct("ts", "event_id")).alias("k"),
    )
    return agg.select(
        F.col("user_id").alias("id"),
        F.concat(F.lit("p"), (F.col("user_id") % 4).cast("string")).alias("project_id"),
        F.concat(F.lit("ext-"), F.col("user_id").cast("string")).alias("external_id"),
        "created_at",
        "last_seen",
        F.concat(
            F.lit('{"k":'), F.col("k").cast("string"), F.lit(',"plan":"'),
            F.when(F.col("k") % 3 == 0, "free").when(F.col("k") % 3 == 1, "team").otherwise("pro"),
            F.lit('","name":"User '), F.col("user_id").cast("string"), F.lit('"}'),
        ).alias("props"),
        F.col("k").cast("string").alias("k"),
    )


USER_SQL = """
SELECT user_id AS id, 'p' || (user_id % 4) AS project_id, 'ext-' || user_id AS external_id,
 created_at, last_seen, k, CASE k % 3 WHEN 0 THEN 'free' WHEN 1 THEN 'team' ELSE 'pro' END AS plan,
 'User ' || user_id AS uname
FROM (SELECT user_id, min(ts) AS created_at, max(ts) AS last_seen,
   arg_min(CAST(json_extract(props,'$.k') AS INT), (ts, event_id)) AS k FROM events GROUP BY user_id)
"""


def messages(spark: SparkSession, d: str) -> DataFrame:
    """Chat message log: thread, position, role, text, time."""
    c = table(spark, d, "conversations")
    return c.select(
        F.concat(F.lit("t"), F.col("conv_id").cast("string")).alias("thread_id"),
        F.concat(F.lit("m"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("id"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 600 + F.col("turn") * 10).alias("timestamp"),
        "turn",
        "role",
        F.col("text").alias("content"),
    )


def doc_runs(spark: SparkSession, d: str) -> DataFrame:
    """One llm run per document: a user message in, the same text out, quality and toxicity where labelled."""
    t, lab = table(spark, d, "documents"), table(spark, d, "labels")
    msg = lambda role: F.to_json(F.array(F.struct(F.lit(role).alias("role"), F.col("text").alias("content"))))
    return t.join(lab, "doc_id", "left").select(
        F.col("doc_id").cast("string").alias("id"),
        "doc_id",
        F.lit("p0").alias("project_id"),
        F.lit("llm").alias("type"),
        F.col("source").alias("name"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60).alias("created_at"),
        msg("user").alias("input"),
        msg("assistant").alias("output"),
        "text",
        "lang",
        "source",
        "n_chars",
        "quality",
        "toxic",
    )


SQL_VIEWS = {"run": RUN_SQL, "ext_user": USER_SQL}


EMAIL = "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}"


def doc_results(spark: SparkSession, d: str) -> DataFrame:
    """Evaluation results of the document runs, one row per run and evaluator: (run_id, evaluator_id, type, result)."""
    doc = doc_runs(spark, d)
    iso = F.struct(F.col("lang").alias("isoCode"), F.lit(0.9).alias("confidence"))
    body = {
        "language": F.struct(F.array(iso).alias("input"), F.array(iso).alias("output")),
        "pii": F.struct(F.array(F.regexp_extract_all("text", F.lit(EMAIL), F.lit(0))).alias("input"), F.array().cast("array<array<string>>").alias("output")),
        "topics": F.struct(F.array(F.array(F.struct(F.col("source").alias("topic")))).alias("input"), F.array().cast("array<array<struct<topic:string>>>").alias("output")),
        "sentiment": F.struct(
            F.array(
                F.struct(F.lit(1).alias("index"), F.when(F.col("quality") == 1, "positive").otherwise("negative").alias("label")),
                F.struct(F.lit(0).alias("index"), F.lit("neutral").alias("label")),
            ).alias("input"),
        ),
        "intent": F.struct(
            F.array(F.struct(F.array(F.struct(F.concat(F.lit(" ask "), F.col("source")).alias("label"), F.lit(0.7).alias("confidence"))).alias("intents"))).alias("input"),
            F.array(F.struct(F.array(F.struct(F.concat(F.lit("in "), F.col("lang")).alias("label"), F.lit(0.6).alias("confidence"))).alias("intents"))).alias("output"),
        ),
    }
    parts = [
        (doc.where("quality is not null") if kind == "sentiment" else doc).select(
            F.col("id").alias("run_id"), F.lit(f"ev-{kind}").alias("evaluator_id"), F.lit(kind).alias("type"), F.to_json(col).alias("result")
        )
        for kind, col in body.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def doc_toxicity(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").select(
        F.col("doc_id").cast("string").alias("run_id"),
        (F.col("toxic") == 1).alias("toxic_input"),
        (F.col("quality") == 0).alias("toxic_output"),
    )


def intent_aliases(spark: SparkSession, d: str) -> DataFrame:
    """alias → canonical label, derived from the sources seen."""
    n = F.regexp_extract("source", "[0-9]+", 0).cast("int")
    return table(spark, d, "documents").select(
        F.concat(F.lit("ask "), F.col("source")).alias("alias"), F.concat(F.lit("Group "), (n % 5).cast("string")).alias("label")
    ).distinct()


def template_versions(spark: SparkSession, d: str) -> DataFrame:
    """Prompt template versions seen in the runs: version v belongs to template v div 3."""
    v = F.col("template_version_id")
    return runs(spark, d).groupBy(v.alias("id")).agg(F.min("created_at").alias("created_at"), F.max("created_at").alias("published_at")).select(
        "id", F.floor(F.col("id") / 3).cast("int").alias("template_id"), "created_at", "published_at", (F.col("id") % 3 == 1).alias("is_draft")
    )


DOC_SQL = """
SELECT CAST(t.doc_id AS VARCHAR) AS id, t.doc_id, t.source AS name, t.text, t.lang, t.source, t.n_chars, l.quality, l.toxic,
 TIMESTAMP '2024-01-01' + to_seconds(t.doc_id * 60) AS created_at
FROM documents t LEFT JOIN labels l ON l.doc_id = t.doc_id
"""
MSG_SQL = """
SELECT 't' || conv_id AS thread_id, 'm' || conv_id || '-' || turn AS id, conv_id, turn, role, text AS content,
 TIMESTAMP '2024-01-01' + to_seconds(conv_id * 600 + turn * 10) AS timestamp FROM conversations
"""
TEMPLATE_SQL = """
SELECT template_version_id AS id, template_version_id // 3 AS template_id, min(created_at) AS created_at,
 max(created_at) AS published_at, template_version_id % 3 = 1 AS is_draft FROM run GROUP BY template_version_id
"""
SQL_VIEWS.update({"doc_run": DOC_SQL, "chat_msg": MSG_SQL, "tmpl": TEMPLATE_SQL})


def trade_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Trace tree of five levels: region → nation → customer → order → line item."""
    pick = lambda source, **cols: table(spark, d, source).select(*[F.expr(v).alias(k) for k, v in cols.items()])
    common = {"status": "'success'", "input": "cast(null as string)", "output": "cast(null as string)"}
    at = lambda n: f"timestamp_seconds(1704067200 + {n})"
    parts = [
        pick("region", id="concat('r', r_regionkey)", parent_run_id="cast(null as string)", type="'agent'", name="r_name",
             created_at=at("r_regionkey"), cost="cast(null as double)", prompt_tokens="cast(null as int)", completion_tokens="cast(null as int)", **common),
        pick("nation", id="concat('n', n_nationkey)", parent_run_id="concat('r', n_regionkey)", type="'chain'", name="n_name",
             created_at=at("n_nationkey"), cost="cast(null as double)", prompt_tokens="cast(null as int)", completion_tokens="cast(null as int)", **common),
        pick("customer", id="concat('c', c_custkey)", parent_run_id="concat('n', c_nationkey)", type="'chat'", name="c_mktsegment",
             created_at=at("c_custkey"), cost="cast(null as double)", prompt_tokens="cast(null as int)", completion_tokens="cast(null as int)", **common),
        pick("orders", id="concat('o', o_orderkey)", parent_run_id="concat('c', o_custkey)", type="'agent'", name="o_orderpriority",
             created_at="cast(o_orderdate as timestamp)", cost="cast(null as double)", prompt_tokens="cast(null as int)", completion_tokens="cast(null as int)", **common),
        pick("lineitem", id="concat('l', l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey)", parent_run_id="concat('o', l_orderkey)", type="'llm'", name="l_returnflag",
             created_at="cast(l_shipdate as timestamp)", cost="l_extendedprice * (1 - l_discount)", prompt_tokens="cast(l_quantity as int)", completion_tokens="l_linenumber", **common),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


TRADE_SQL = """
SELECT 'r' || r_regionkey AS id, NULL AS parent_run_id, 'agent' AS type, r_name AS name, NULL::DOUBLE AS cost, NULL::INT AS prompt_tokens, NULL::INT AS completion_tokens FROM region
UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'chain', n_name, NULL, NULL, NULL FROM nation
UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'chat', c_mktsegment, NULL, NULL, NULL FROM customer
UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, 'agent', o_orderpriority, NULL, NULL, NULL FROM orders
UNION ALL SELECT 'l' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey, 'o' || l_orderkey, 'llm', l_returnflag,
  l_extendedprice * (1 - l_discount), CAST(l_quantity AS INT), l_linenumber FROM lineitem
"""


def org_usage(spark: SparkSession, d: str) -> DataFrame:
    """Runs of an organisation (region) with its projects (nations): one llm run per line item, model = brand."""
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    c, n, r = table(spark, d, "customer"), table(spark, d, "nation"), table(spark, d, "region")
    p = table(spark, d, "part")
    return (
        li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
        .join(r, n.n_regionkey == r.r_regionkey).join(p, li.l_partkey == p.p_partkey)
        .select(
            F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"),
            F.col("r_name").alias("org_id"), F.col("n_name").alias("project_id"), F.lit("llm").alias("type"),
            F.col("p_brand").alias("name"), F.col("l_shipdate").cast("timestamp").alias("created_at"),
            F.col("l_quantity").cast("int").alias("prompt_tokens"), F.col("l_linenumber").alias("completion_tokens"),
            (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("cost"), F.lit("success").alias("status"),
            F.lit(2.0).alias("duration_s"),
        )
    )


ORG_SQL = """
SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id, r_name AS org_id, n_name AS project_id, p_brand AS name,
 l_shipdate AS created_at, CAST(l_quantity AS INT) AS prompt_tokens, l_linenumber AS completion_tokens, l_extendedprice * (1 - l_discount) AS cost
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
 JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey
"""
SQL_VIEWS.update({"trade_node": TRADE_SQL, "org_run": ORG_SQL})
