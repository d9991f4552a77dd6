"""E, G, H, J, K: enriched joins, top lists, ordering, facets and trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import json as J
from ..operators import buckets, enrich, facets, ordering, topk, trees
from . import fixtures as fx
from .registry import query
from .series import DAILY, NY, USER_RUN, WEEKLY, bucket_sql, r6, spine_sql

L = F.lit


def scores(spark, d):
    """One label score per labelled document: (run_id, label, value, comment)."""
    lab = fx.table(spark, d, "labels")
    both = F.explode(F.array(F.struct(L("quality").alias("label"), F.col("quality").cast("string").alias("value")), F.struct(L("toxic").alias("label"), F.col("toxic").cast("string").alias("value"))))
    return lab.select(F.col("doc_id").cast("string").alias("run_id"), both.alias("s")).select("run_id", "s.label", "s.value", L(None).cast("string").alias("comment"))


@query(
    "e1_enriched_run_view",
    """SELECT r.id, u.external_id, t.template_id, p.id AS parent_chat_id FROM run r LEFT JOIN ext_user u ON u.id = r.external_user_id
     LEFT JOIN tmpl t ON t.id = r.template_version_id LEFT JOIN run p ON p.id = r.parent_run_id AND p.type = 'chat'
     WHERE r.created_at >= TIMESTAMP '2024-01-01' AND r.created_at < TIMESTAMP '2024-02-01'""",
)
def e1(spark, d):
    out = enrich.enriched(
        fx.runs(spark, d), fx.START, fx.END, users=fx.users(spark, d), versions=fx.template_versions(spark, d), include=("users", "templates", "parent_chat"),
    )
    return out.select("id", F.col("user_external_id").alias("external_id"), "template_id", "parent_chat_id")


@query(
    "e2_results_per_run",
    "SELECT id, CAST(4 + CASE WHEN quality IS NULL THEN 0 ELSE 1 END AS BIGINT) AS n, 'intent' AS first_type, lang FROM doc_run",
)
def e2(spark, d):
    out = enrich.with_results(fx.doc_runs(spark, d), fx.doc_results(spark, d))
    lang = F.filter("results", lambda x: x["type"] == "language")[0]["result"]
    return out.select("id", F.size("results").cast("long").alias("n"), F.col("results")[0]["type"].alias("first_type"), F.get_json_object(lang, "$.input[0].isoCode").alias("lang"))


@query("e3_scores_per_run", "SELECT id, CASE WHEN quality IS NULL THEN NULL ELSE quality || '/' || toxic END AS scores FROM doc_run")
def e3(spark, d):
    out = enrich.with_scores(fx.doc_runs(spark, d), scores(spark, d))
    return out.select("id", F.when(F.col("scores").isNotNull(), F.array_join(F.transform("scores", lambda s: s["value"]), "/")).alias("scores"))


def chat_rated(spark, d):
    """Event runs where chats carry the feedback: views of the conversation tree."""
    r = fx.runs(spark, d)
    return r.withColumn("feedback", F.when(F.col("type") == "chat", F.concat(L('{"thumb":"'), F.when(F.col("prompt_tokens") % 2 == 0, "up").otherwise("down"), L('"}'))))


CHAT_RATED = "(SELECT *, CASE WHEN type='chat' THEN '{\"thumb\":\"' || CASE WHEN prompt_tokens % 2 = 0 THEN 'up' ELSE 'down' END || '\"}' END AS fb FROM run)"


@query(
    "e4_parent_feedback",
    f"""WITH RECURSIVE up AS (SELECT r.id, r.parent_run_id AS anc, 1 AS lvl FROM run r WHERE parent_run_id IS NOT NULL
       UNION ALL SELECT up.id, r.parent_run_id, lvl + 1 FROM up JOIN run r ON r.id = up.anc WHERE r.parent_run_id IS NOT NULL)
     SELECT r.id, b.fb AS parent_feedback FROM run r LEFT JOIN
      (SELECT up.id, arg_min(c.fb, up.lvl) AS fb FROM up JOIN {CHAT_RATED} c ON c.id = up.anc WHERE c.fb IS NOT NULL GROUP BY 1) b ON b.id = r.id""",
)
def e4(spark, d):
    return enrich.with_parent_feedback(chat_rated(spark, d)).select("id", "parent_feedback")


@query("e5_child_feedbacks", f"SELECT parent_run_id AS parent_id, id AS child_id, created_at, fb AS feedback FROM {CHAT_RATED} WHERE type='chat' AND parent_run_id IS NOT NULL")
def e5(spark, d):
    return enrich.child_feedbacks(chat_rated(spark, d)).withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))


@query("e5_child_feedbacks_array", f"""SELECT r.id, coalesce(c.part, 0) AS part, c.fbs FROM run r LEFT JOIN
   (SELECT parent_run_id AS id, part, string_agg(fb, ',' ORDER BY created_at, id) AS fbs FROM
      (SELECT *, (row_number() OVER (PARTITION BY parent_run_id ORDER BY created_at, id) - 1) // 2 AS part FROM {CHAT_RATED} WHERE type='chat' AND parent_run_id IS NOT NULL) GROUP BY 1, 2) c ON c.id = r.id""")
def e5a(spark, d):
    """Parts of two, so that runs with more feedbacks have several."""
    return enrich.with_child_feedbacks(chat_rated(spark, d), items=2).select("id", "part", F.array_join("child_feedbacks", ",").alias("fbs"))


@query("e6_thread_stats", "SELECT thread_id, count(*) AS messages_count, arg_min(content, (timestamp, id)) AS first_message FROM chat_msg GROUP BY 1")
def e6(spark, d):
    return enrich.message_stats(fx.messages(spark, d))


@query("e6_thread_stats_of_chats", """WITH m AS (SELECT parent_run_id AS thread_id, created_at, id, 0 AS side, json_extract_string(input, '$[0].content') AS content FROM run WHERE type = 'chat' AND parent_run_id IS NOT NULL
   UNION ALL SELECT parent_run_id, created_at, id, 1, json_extract_string(output, '$[0].content') FROM run WHERE type = 'chat' AND parent_run_id IS NOT NULL AND output IS NOT NULL)
 SELECT thread_id, count(*) AS messages_count, arg_min(content, (created_at, id, side)) AS first_message FROM m GROUP BY 1""")
def e6c(spark, d):
    return enrich.thread_stats(fx.runs(spark, d))


@query("e7_bucket_join", f"SELECT s.date, r.id FROM ({spine_sql(DAILY)}) s LEFT JOIN run r ON {bucket_sql(DAILY, 'r.created_at')} = s.date")
def e7(spark, d):
    s = buckets.bucket_spine(spark, DAILY.start, DAILY.end, NY, "daily")
    return buckets.join_on_bucket(s, fx.runs(spark, d), NY, "daily").select("date", "id")


@query("e8_weekly_bucket_join", f"SELECT s.date, count(r.id) AS runs FROM ({spine_sql(WEEKLY)}) s LEFT JOIN run r ON {bucket_sql(WEEKLY, 'r.created_at')} >= s.date AND {bucket_sql(WEEKLY, 'r.created_at')} < s.date + INTERVAL 7 DAY GROUP BY 1")
def e8(spark, d):
    s = buckets.bucket_spine(spark, WEEKLY.start, WEEKLY.end, NY, "weekly")
    return buckets.join_on_bucket(s, fx.runs(spark, d), NY, "weekly").groupBy("date").agg(F.count("id").alias("runs"))


@query(
    "e9_interval_join",
    f"""SELECT s.date, r.id FROM ({spine_sql(DAILY)}) s LEFT JOIN run r ON r.created_at >= ((s.date AT TIME ZONE '{NY}') AT TIME ZONE 'UTC')
     AND r.created_at < (((s.date + INTERVAL 1 DAY) AT TIME ZONE '{NY}') AT TIME ZONE 'UTC')""",
)
def e9(spark, d):
    s = buckets.bucket_spine(spark, DAILY.start, DAILY.end, NY, "daily")
    return buckets.join_on_interval(s, fx.runs(spark, d), NY, "daily").select("date", "id")


@query("e10_semi_join", "SELECT id FROM doc_run WHERE quality IS NOT NULL")
def e10(spark, d):
    lab = fx.doc_toxicity(spark, d).withColumnRenamed("run_id", "id")
    return enrich.keep_matching(fx.doc_runs(spark, d), lab, ["id"]).select("id")


@query("e10_activated_projects", "SELECT DISTINCT n_name AS project_id FROM nation WHERE n_name IN (SELECT project_id FROM org_run)")
def e10p(spark, d):
    projects = fx.table(spark, d, "nation").select(F.col("n_name").alias("project_id"))
    return enrich.keep_matching(projects, fx.org_usage(spark, d), ["project_id"])


@query("e11_anti_join", "SELECT id FROM doc_run WHERE quality IS NULL")
def e11(spark, d):
    res = fx.doc_results(spark, d).where("type = 'sentiment'")
    return enrich.unscored(fx.doc_runs(spark, d), res, "ev-sentiment", fx.doc_toxicity(spark, d)).select("id")


@query("e13_theta_join", "SELECT b.p_brand AS name, count(*) AS n FROM (SELECT DISTINCT p_brand FROM part) b JOIN part p ON regexp_matches(b.p_brand, '^(' || p.p_brand || ')$') GROUP BY 1")
def e13(spark, d):
    from ..operators.pricing import match_names

    p = fx.table(spark, d, "part")
    mappings = p.select(F.col("p_partkey").alias("id"), F.concat(L("^("), "p_brand", L(")$")).alias("pattern"))
    return match_names(p.select(F.col("p_brand").alias("name")), mappings).groupBy("name").agg(F.count(L(1)).alias("n"))


@query("e14_second_dimension_users", "SELECT CAST(k AS VARCHAR) AS sd, id AS user_id FROM ext_user")
def e14(spark, d):
    return enrich.second_dimension_users(fx.users(spark, d), "k")


@query(
    "e15_evaluation_grid",
    "SELECT b.item_id AS prompt_id, o.conv_id || '-' || o.turn AS variation_id, p.name AS provider FROM benchmark b JOIN conversations o ON o.conv_id % (SELECT count(*) FROM benchmark) = b.item_id CROSS JOIN (SELECT DISTINCT p_type AS name FROM part) p",
)
def e15(spark, d):
    prompts = fx.table(spark, d, "benchmark").select(F.col("item_id").alias("prompt_id"))
    variations = fx.table(spark, d, "conversations").select((F.col("conv_id") % prompts.count()).alias("prompt_id"), F.concat_ws("-", "conv_id", "turn").alias("variation_id"))
    providers = fx.table(spark, d, "part").select(F.col("p_type").alias("provider")).distinct()
    return enrich.evaluation_grid(prompts, variations, providers)


@query("e16_run_detail", "SELECT id, CAST(4 + CASE WHEN quality IS NULL THEN 0 ELSE 1 END AS BIGINT) AS results, CAST(CASE WHEN quality IS NULL THEN 0 ELSE 2 END AS BIGINT) AS scores FROM doc_run")
def e16(spark, d):
    out = enrich.run_detail(fx.doc_runs(spark, d), fx.doc_results(spark, d), scores(spark, d))
    return out.select("id", F.size("results").cast("long").alias("results"), F.coalesce(F.size("scores"), L(0)).cast("long").alias("scores"))


# --- G
SUMS = """CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens,
 CAST(sum(prompt_tokens + completion_tokens) AS BIGINT) AS total_tokens"""


@query("g1_top_models", f"SELECT name, {SUMS}, round(sum(cost), 4) AS cost FROM run WHERE type='llm' GROUP BY 1 ORDER BY total_tokens DESC, cost DESC, name LIMIT 5")
def g1(spark, d):
    return topk.top_models(fx.runs(spark, d)).withColumn("cost", F.round("cost", 4))


@query(
    "g2_top_models_of_org",
    f"""WITH per AS (SELECT project_id, name, {SUMS}, sum(cost) AS cost FROM org_run GROUP BY 1, 2)
     SELECT name, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens,
      CAST(sum(total_tokens) AS BIGINT) AS total_tokens, round(sum(cost), 2) AS cost, first(project_id ORDER BY total_tokens DESC, cost DESC, project_id) AS project_name
     FROM per GROUP BY 1 ORDER BY total_tokens DESC, cost DESC, name LIMIT 20""",
)
def g2(spark, d):
    return topk.top_models_of_org(fx.org_usage(spark, d)).withColumn("cost", F.round("cost", 2))


@query("h1_rank_in_partition", f"SELECT project_id, name, total_tokens, row_number() OVER (PARTITION BY name ORDER BY total_tokens DESC, cost DESC, project_id) AS rank FROM (SELECT project_id, name, {SUMS}, sum(cost) AS cost FROM org_run GROUP BY 1, 2)")
def h1(spark, d):
    return topk.ranked_projects(fx.org_usage(spark, d)).select("project_id", "name", "total_tokens", F.col("rank").cast("long").alias("rank"))


@query("g3_top_templates", f"SELECT t.template_id, count(*) AS usage, {SUMS}, round(sum(cost), 4) AS cost FROM run r JOIN tmpl t ON t.id = r.template_version_id GROUP BY 1 ORDER BY usage DESC, 1 LIMIT 5")
def g3(spark, d):
    return topk.top_templates(fx.runs(spark, d), fx.template_versions(spark, d)).withColumn("cost", F.round("cost", 4))


ATTRIBUTED = """seeds AS (SELECT r.id, r.name, (r.type IN ('agent','chain') AND (r.parent_run_id IS NULL OR p.id IS NOT NULL)) AS seed, r.parent_run_id
   FROM {t} r LEFT JOIN {t} p ON p.id = r.parent_run_id AND p.type = 'chat'),
  sub AS (SELECT id, name AS agent_name FROM seeds WHERE seed UNION ALL
   SELECT s.id, sub.agent_name FROM sub JOIN seeds s ON s.parent_run_id = sub.id WHERE NOT s.seed)"""


@query("g4_top_agents", f"WITH RECURSIVE {ATTRIBUTED.format(t='run')} SELECT agent_name AS name, {SUMS}, round(sum(cost), 4) AS cost FROM sub JOIN run r ON r.id = sub.id GROUP BY 1 ORDER BY cost DESC, 1 LIMIT 5")
def g4(spark, d):
    return topk.top_agents(fx.runs(spark, d)).withColumn("cost", F.round("cost", 4))


@query("g5_top_languages", "SELECT lang AS language, count(*) AS runs FROM documents GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def g5(spark, d):
    return topk.top_languages(fx.doc_results(spark, d))


@query("g6_top_topics", "SELECT source AS topic, count(*) AS runs FROM documents GROUP BY 1")
def g6(spark, d):
    return topk.top_topics(fx.doc_results(spark, d))


@query("g7_user_list", "SELECT u.id, u.external_id, round(sum(r.cost), 4) AS cost FROM ext_user u LEFT JOIN run r ON r.external_user_id = u.id WHERE u.external_id ILIKE '%1%' OR u.uname ILIKE '%1%' GROUP BY 1, 2 ORDER BY sum(r.cost) DESC NULLS LAST, 1 LIMIT 30")
def g7(spark, d):
    return topk.user_list(fx.users(spark, d), fx.runs(spark, d), search="1", size=30).select("id", "external_id", F.round("cost", 4).alias("cost"))


@query("g7_top_users", "SELECT external_user_id AS id, round(sum(cost), 4) AS cost FROM run GROUP BY 1 ORDER BY sum(cost) DESC, 1 LIMIT 5")
def g7t(spark, d):
    return topk.user_list(fx.users(spark, d), fx.runs(spark, d), size=5).select("id", F.round("cost", 4).alias("cost"))


@query("g8_hourly_metering", "SELECT org_id, date_trunc('hour', created_at) AS hour, count(*) AS runs FROM run GROUP BY 1, 2")
def g8(spark, d):
    return topk.metering_windows(fx.runs(spark, d)).withColumn("hour", F.col("hour").cast("timestamp_ntz"))


@query("g8_last_hour", "SELECT org_id, count(*) AS runs FROM run WHERE created_at >= TIMESTAMP '2024-01-15 11:00:00' AND created_at < TIMESTAMP '2024-01-15 12:00:00' GROUP BY 1")
def g8l(spark, d):
    return topk.hourly_metering(fx.runs(spark, d), "2024-01-15 12:00:00")


@query(
    "g9_usage_limit_flag",
    """SELECT r_name AS org_id, coalesce(n > 10000, false) AND r_regionkey % 2 = 0 AS limited, (coalesce(n > 10000, false) AND r_regionkey % 2 = 0) <> (r_regionkey = 1) AS changed
     FROM region LEFT JOIN (SELECT org_id, count(*) AS n FROM org_run WHERE created_at < TIMESTAMP '2003-01-01' AND created_at >= TIMESTAMP '2003-01-01' - INTERVAL 4000 DAY GROUP BY 1) u ON u.org_id = r_name""",
)
def g9(spark, d):
    orgs = fx.table(spark, d, "region").select(F.col("r_name").alias("org_id"), F.when(F.col("r_regionkey") % 2 == 0, "free").otherwise("team").alias("plan"), (F.col("r_regionkey") == 1).alias("limited"))
    return topk.usage_flags(fx.org_usage(spark, d), orgs, "2003-01-01 00:00:00", days=4000)


@query("g10_item_counts", "SELECT o_orderkey AS dataset_id, count(l_orderkey) AS items FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def g10(spark, d):
    parents = fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("dataset_id"))
    return topk.item_counts(parents, fx.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("dataset_id")), "dataset_id")


@query("g11_templates_with_versions", "SELECT template_id, 0::BIGINT AS part, string_agg(id::VARCHAR, ',' ORDER BY id) AS versions FROM tmpl GROUP BY 1")
def g11(spark, d):
    t = topk.templates_with_versions(fx.template_versions(spark, d))
    return t.select("template_id", "part", F.array_join(F.transform("versions", lambda v: v["id"].cast("string")), ",").alias("versions"))


# --- H
@query("h2_neighbours", "SELECT id, lag(id) OVER w AS previous_id, lead(id) OVER w AS next_id FROM run WINDOW w AS (PARTITION BY project_id ORDER BY created_at, id)")
def h2(spark, d):
    return ordering.neighbours(fx.runs(spark, d)).select("id", "previous_id", "next_id")


@query("h3_item_numbering", "SELECT project_id AS dataset_id, id, row_number() OVER (PARTITION BY project_id ORDER BY created_at, id) AS item_index FROM run")
def h3(spark, d):
    items = fx.runs(spark, d).select(F.col("project_id").alias("dataset_id"), "id", "created_at")
    return ordering.item_numbers(items).select("dataset_id", "id", "item_index")


@query("h4_one_run_per_user_and_day", f"SELECT external_user_id, {bucket_sql(DAILY)} AS date, arg_min(id, (created_at, id)) AS id FROM run GROUP BY 1, 2")
def h4(spark, d):
    return ordering.one_per_user_and_bucket(buckets.with_bucket(fx.runs(spark, d), NY, "daily"))


@query("h5_latest_published_version", "SELECT template_id, arg_max(id, (published_at, id)) AS id FROM tmpl WHERE NOT is_draft GROUP BY 1")
def h5(spark, d):
    return ordering.latest_published(fx.template_versions(spark, d)).select("template_id", "id")


@query("h6_one_row_per_user", f"SELECT DISTINCT external_user_id AS id, plan FROM {USER_RUN}")
def h6(spark, d):
    joined = enrich.with_users(fx.runs(spark, d), fx.users(spark, d)).select(F.col("external_user_id").alias("id"), J.get_text("user_props", "plan").alias("plan"))
    return ordering.one_per_id(joined)


@query("h7_page_of_runs", "SELECT id, CAST(prompt_tokens + completion_tokens AS BIGINT) AS total_tokens FROM run ORDER BY prompt_tokens + completion_tokens DESC NULLS LAST, id LIMIT 50 OFFSET 100")
def h7(spark, d):
    return ordering.page_of_runs(fx.runs(spark, d), "tokens", page=2).select("id", F.col("total_tokens").cast("long").alias("total_tokens"))


@query("h7_far_page", "SELECT id, created_at FROM run ORDER BY created_at DESC NULLS LAST, id LIMIT 50 OFFSET 4000")
def h7f(spark, d):
    """A page that is sought by key, whatever lies before it."""
    return ordering.page_of_runs(fx.runs(spark, d), "created_at", page=80, near=1_000).select("id", F.col("created_at").cast("timestamp_ntz").alias("created_at"))


@query("h8_filtered_count", "SELECT count(*) AS count FROM run WHERE status = 'error'")
def h8(spark, d):
    return ordering.filtered_count(fx.runs(spark, d).where("status = 'error'"))


def cluster_versions(spark, d):
    """Taxonomy versions: one per (model, day) on which it ran."""
    r = fx.runs(spark, d)
    return r.groupBy(F.col("name").alias("evaluator_id"), F.date_trunc("day", "created_at").alias("created_at")).agg(F.min("id").alias("id"))


@query("h9_latest_cluster_version", "SELECT evaluator_id, arg_max(id, created_at) AS id FROM (SELECT name AS evaluator_id, date_trunc('day', created_at) AS created_at, min(id) AS id FROM run GROUP BY 1, 2) GROUP BY 1")
def h9(spark, d):
    return ordering.latest_cluster_version(cluster_versions(spark, d)).select("evaluator_id", "id")


# --- J
@query("j1_union_of_sides", "SELECT id AS run_id, 'input' AS side, 'ask ' || source AS label FROM doc_run UNION ALL SELECT id, 'output', 'in ' || lang FROM doc_run")
def j1(spark, d):
    found = facets.elements(fx.doc_results(spark, d).where("type = 'intent'"), "run_id", facets.INTENT)
    return found.select("run_id", "side", F.explode("element.intents").alias("i")).select("run_id", "side", F.trim("i.label").alias("label"))


@query("j2_retention_windows", "SELECT DISTINCT n_name AS org_id, CAST(CASE WHEN n_nationkey % 2 = 0 THEN 30 ELSE 60 + n_regionkey END AS BIGINT) AS days FROM nation")
def j2(spark, d):
    n = fx.table(spark, d, "nation").select(F.col("n_name").alias("org_id"), F.when(F.col("n_nationkey") % 2 == 0, "free").otherwise("team").alias("plan"), (60 + F.col("n_regionkey")).alias("retention_days"))
    return facets.retention_windows(n).withColumn("days", F.col("days").cast("long"))


@query("j3_feedback_kinds", "SELECT DISTINCT project_id, 'thumb' AS key, thumb AS value FROM run WHERE thumb IS NOT NULL")
def j3(spark, d):
    return facets.feedback_kinds(fx.runs(spark, d))


@query("j4_models", "SELECT DISTINCT name AS value FROM run WHERE type = 'llm'")
def j4(spark, d):
    return facets.models(fx.runs(spark, d))


@query("j5_tags", "SELECT DISTINCT unnest(tags) AS value FROM run")
def j5(spark, d):
    return facets.tags(fx.runs(spark, d))


@query("j6_topics", "SELECT DISTINCT source AS value FROM documents")
def j6(spark, d):
    return facets.topics(fx.doc_results(spark, d))


@query("j7_intents", "SELECT DISTINCT 'ask ' || source AS value FROM documents UNION SELECT DISTINCT 'in ' || lang FROM documents")
def j7(spark, d):
    return facets.intents(fx.doc_results(spark, d))


@query(
    "j7_intents_canonical",
    """SELECT DISTINCT CASE WHEN n_nationkey // 5 > 2 OR n_nationkey % 7 = 0 THEN 'other' ELSE n_name END AS value
     FROM nation WHERE n_regionkey = (SELECT max(r_regionkey) FROM region)""",
)
def j7c(spark, d):
    """A taxonomy version per region, its clusters are nations; the tail and the cluster named Other become one."""
    versions = fx.table(spark, d, "region").select(L("intent").alias("evaluator_id"), F.col("r_regionkey").alias("id"), F.timestamp_seconds("r_regionkey").alias("created_at"))
    key = F.col("n_nationkey")
    clusters = fx.table(spark, d, "nation").select(F.col("n_regionkey").alias("version_id"), F.when(key % 7 == 0, "Other").otherwise(F.col("n_name")).alias("label"), F.floor(key / 5).alias("sort_order"))
    return facets.intents(fx.doc_results(spark, d), versions, clusters, max_intents=2)


@query("a15_metadata_key_cache", "SELECT DISTINCT project_id, type, 'k' AS key FROM run")
def a15(spark, d):
    return facets.metadata_keys(fx.runs(spark, d))


@query("j8_metadata_keys", "SELECT DISTINCT 'k' AS value FROM run WHERE project_id = 'p1'")
def j8(spark, d):
    return facets.metadata_key_facet(facets.metadata_keys(fx.runs(spark, d)), "p1")


@query("j9_user_search", "SELECT id FROM ext_user WHERE external_id ILIKE '%12%' OR uname ILIKE '%12%'")
def j9(spark, d):
    return facets.find_users(fx.users(spark, d), "12").select("id")


@query("j9_user_property_keys", "SELECT unnest(['k','plan','name']) AS value WHERE EXISTS (SELECT 1 FROM ext_user)")
def j9k(spark, d):
    return facets.user_property_keys(fx.users(spark, d))


@query("j9_user_property_values", "SELECT DISTINCT CAST(k AS VARCHAR) AS value FROM ext_user")
def j9v(spark, d):
    return facets.user_property_values(fx.users(spark, d), "k")


@query("j10_templates", "SELECT DISTINCT CAST(template_id AS BIGINT) AS value FROM tmpl")
def j10(spark, d):
    return facets.templates(fx.template_versions(spark, d)).withColumn("value", F.col("value").cast("long"))


@query("j10_custom_events", "SELECT DISTINCT name AS value FROM run")
def j10c(spark, d):
    return facets.custom_events(fx.runs(spark, d).withColumn("type", L("custom-event")))


# --- K
def tree_sql(runs: str, node: str) -> str:
    """CTEs up to ``lines`` (root_id, place, depth, id, line): nodes in preorder, each followed by the brackets that end there."""
    step = "strftime(created_at, '%Y%m%d%H%M%S%f') || id"
    return f"""walk AS (SELECT *, id AS root_id, 0 AS lvl, [{step}] AS path FROM {runs} WHERE parent_run_id IS NULL
      UNION ALL SELECT r.*, w.root_id, w.lvl + 1, list_append(w.path, strftime(r.created_at, '%Y%m%d%H%M%S%f') || r.id) FROM walk w JOIN {runs} r ON r.parent_run_id = w.id),
    onward AS (SELECT *, lead(lvl) OVER (PARTITION BY root_id ORDER BY path) AS nxt, row_number() OVER (PARTITION BY root_id ORDER BY path) - 1 AS place, CAST(to_json({{{node}}}) AS VARCHAR) AS own FROM walk),
    lines AS (SELECT root_id, place, CAST(lvl AS BIGINT) AS depth, id, left(own, length(own) - 1) || ',"children":[' ||
       CASE WHEN nxt IS NULL THEN repeat(']}}', lvl + 1) WHEN nxt > lvl THEN '' ELSE repeat(']}}', lvl - nxt + 1) || ',' END AS line FROM onward)"""


UP = """up AS (SELECT id, id AS root_id, 0 AS depth FROM {t} WHERE parent_run_id IS NULL
  UNION ALL SELECT r.id, up.root_id, up.depth + 1 FROM up JOIN {t} r ON r.parent_run_id = up.id)"""


@query("k1_descendants", f"WITH RECURSIVE {UP.format(t='run')} SELECT id, root_id, CAST(depth AS BIGINT) AS depth FROM up")
def k1(spark, d):
    return trees.descendants(fx.runs(spark, d)).select("id", "root_id", F.col("depth").cast("long").alias("depth"))


@query(
    "k1_descendants_of_agents",
    """WITH RECURSIVE down AS (SELECT id, id AS root_id, 0 AS depth FROM run WHERE type = 'agent'
     UNION ALL SELECT r.id, down.root_id, down.depth + 1 FROM down JOIN run r ON r.parent_run_id = down.id) SELECT id, root_id, CAST(depth AS BIGINT) AS depth FROM down""",
)
def k1a(spark, d):
    r = fx.runs(spark, d)
    return trees.descendants(r, r.where("type = 'agent'")).select("id", "root_id", F.col("depth").cast("long").alias("depth"))


@query("k2_root_of_run", f"WITH RECURSIVE {UP.format(t='trade_node')} SELECT id, root_id FROM up")
def k2(spark, d):
    return trees.roots(fx.trade_nodes(spark, d)).select("id", "root_id")


ODD_NAME = "CASE WHEN CAST(id AS BIGINT) % 7 = 0 THEN NULL WHEN CAST(id AS BIGINT) % 11 = 0 THEN name || chr(10) || '\"x\"' ELSE name END"


@query(
    "k3_nested_tree",
    f"""WITH RECURSIVE odd AS (SELECT * REPLACE ({ODD_NAME} AS name) FROM run), {tree_sql('odd', "'id': id, 'type': type, 'name': name, 'status': status")}
     SELECT root_id, place, depth, id, line FROM lines""",
)
def k3(spark, d):
    """Some runs are unnamed, some names hold a line break and quotes."""
    number = F.col("id").cast("long")
    odd = F.when(number % 7 == 0, None).when(number % 11 == 0, F.concat("name", F.lit('\n"x"'))).otherwise(F.col("name"))
    return trees.trace_lines(fx.runs(spark, d).withColumn("name", odd))


@query("k4_subtree_attribution", f"WITH RECURSIVE {ATTRIBUTED.format(t='trade_node')} SELECT id, agent_name FROM sub")
def k4(spark, d):
    return trees.attributed_to_agents(fx.trade_nodes(spark, d)).select("id", "agent_name")


@query(
    "k5_feedback_inheritance",
    f"""WITH RECURSIVE up AS (SELECT r.id, r.id AS anc, 0 AS lvl FROM run r
       UNION ALL SELECT up.id, r.parent_run_id, lvl + 1 FROM up JOIN run r ON r.id = up.anc WHERE r.parent_run_id IS NOT NULL AND lvl < 5)
     SELECT r.id, b.fb AS feedback FROM run r LEFT JOIN (SELECT up.id, arg_min(c.fb, lvl) AS fb FROM up JOIN {CHAT_RATED} c ON c.id = up.anc WHERE c.fb IS NOT NULL GROUP BY 1) b ON b.id = r.id""",
)
def k5(spark, d):
    return trees.inherited_feedback(chat_rated(spark, d))


@query(
    "k6_trace_totals",
    f"WITH RECURSIVE {UP.format(t='trade_node')} SELECT root_id, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens, round(sum(cost), 2) AS cost, count(*) AS runs FROM up JOIN trade_node n ON n.id = up.id GROUP BY 1",
)
def k6(spark, d):
    return trees.subtree_totals(fx.trade_nodes(spark, d)).withColumn("cost", F.round("cost", 2))


@query(
    "k7_thread_transcript",
    """SELECT thread_id, row_number() OVER (PARTITION BY thread_id ORDER BY turn) AS position, role, content, CASE WHEN turn % 3 = 1 THEN '[{"id":"c' || turn || '"}]' END AS tool_calls, timestamp AS created_at FROM chat_msg""",
)
def k7(spark, d):
    """Every third message calls a tool."""
    m = fx.messages(spark, d)
    calls = F.when(F.col("turn") % 3 == 1, F.concat(L('[{"id":"c'), F.col("turn").cast("string"), L('"}]')))
    one = F.to_json(F.array(F.struct("role", "content", calls.alias("tool_calls"))))
    chats = m.select("id", F.col("thread_id").alias("parent_run_id"), L("chat").alias("type"), F.col("timestamp").alias("created_at"),
                     F.when(F.col("role") != "assistant", one).alias("input"), F.when(F.col("role") == "assistant", one).alias("output"))
    threads = m.groupBy(F.col("thread_id").alias("id")).agg(F.min("timestamp").alias("created_at")).select(
        "id", L(None).cast("string").alias("parent_run_id"), L("thread").alias("type"), "created_at", L(None).cast("string").alias("input"), L(None).cast("string").alias("output"))
    return trees.transcript(threads.unionByName(chats)).withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
