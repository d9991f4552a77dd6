"""L, M, N, O: scalar families, text similarity, enrichment and intents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import json as J
from ..functions import messages as M
from ..functions import similarity as S
from ..functions import templates as T
from ..functions.time import local_bucket, seconds_between
from ..operators import infer, intents, language, similarity as sim
from ..session import cut_lineage
from . import fixtures as fx
from .registry import query

L = F.lit


# --- L
@query("l1_json_access", "SELECT id, prompt_tokens AS k, CASE WHEN status='success' THEN 'user ' || external_user_id END AS said FROM run")
def l1(spark, d):
    return fx.runs(spark, d).select("id", J.get_typed("metadata", "k", "int").alias("k"), F.get_json_object("output", "$[0].content").alias("said"))


@query("l2_json_containment", "SELECT id, prompt_tokens = 42 AS number_hit, false AS text_hit, true AS has_k FROM run")
def l2(spark, d):
    return fx.runs(spark, d).select("id", J.contains_value("metadata", "k", 42).alias("number_hit"), J.contains_value("metadata", "k", "42").alias("text_hit"), J.has_key("metadata", "k").alias("has_k"))


@query("l3_json_path_array", "SELECT id AS run_id, lang AS code FROM doc_run")
def l3(spark, d):
    r = fx.doc_results(spark, d).where("type = 'language'")
    return r.select("run_id", F.array_join(F.transform(J.path_array("result", "input", "struct<isoCode:string>"), lambda e: e["isoCode"]), ",").alias("code"))


@query("l4_json_keys_and_types", "SELECT id, 'k,name,plan' AS keys, 'BIGINT' AS k_type FROM ext_user")
def l4(spark, d):
    return fx.users(spark, d).select("id", F.array_join(F.array_sort(F.json_object_keys("props")), ",").alias("keys"), J.type_at("props", "k").alias("k_type"))


@query("l5_json_build", """SELECT id, '{"k":' || k || ',"x":1}' AS built FROM ext_user""")
def l5(spark, d):
    return fx.users(spark, d).select("id", J.merge(J.without_key("props", "plan", "name"), L('{"x":1}')).alias("built"))


@query("l6_arrays", "SELECT id, list_has_any(tags, ['view','b1']) AS hit, CAST(len(tags) AS BIGINT) AS n FROM run")
def l6(spark, d):
    return fx.runs(spark, d).select("id", F.arrays_overlap("tags", F.array(L("view"), L("b1"))).alias("hit"), F.size("tags").cast("long").alias("n"))


@query("l7_strings", "SELECT doc_id, length(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) AS n, text ILIKE '%the%' AS has FROM documents")
def l7(spark, d):
    t = fx.table(spark, d, "documents")
    return t.select("doc_id", F.length(F.trim(F.regexp_replace(F.lower("text"), r"\s+", " "))).cast("long").alias("n"), F.col("text").ilike("%the%").alias("has"))


@query("l8_date_time", "SELECT id, date_trunc('month', (created_at AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York') AS month, round(epoch_us(ended_at) / 1e6 - epoch_us(created_at) / 1e6, 4) AS seconds FROM run")
def l8(spark, d):
    return fx.runs(spark, d).select("id", local_bucket("created_at", "America/New_York", "monthly").alias("month"), F.round(seconds_between(F.col("created_at"), F.col("ended_at")), 4).alias("seconds"))


@query("l9_null_and_conditional", "SELECT id, coalesce(output, error) AS body, CASE WHEN status = 'error' THEN 1 ELSE 0 END AS bad FROM run")
def l9(spark, d):
    return fx.runs(spark, d).select("id", F.coalesce("output", "error").alias("body"), F.when(F.col("status") == "error", 1).otherwise(0).alias("bad"))


@query("l10_math", "SELECT id, round(tanh(cost / 100), 6) AS t, round(sqrt(cost), 6) AS s FROM run")
def l10(spark, d):
    return fx.runs(spark, d).select("id", F.round(F.tanh(F.col("cost") / 100), 6).alias("t"), F.round(F.sqrt("cost"), 6).alias("s"))


@query("l11_template_rendering", "SELECT id, 'Hi ' || uname || ', plan ' || plan || ' / {{name}} / .' AS text FROM ext_user")
def l11(spark, d):
    u = fx.users(spark, d).withColumn("vars", F.map_concat(J.as_map("props"), F.create_map(L("raw"), L("{{name}}"))))
    return u.select("id", T.render(L("Hi {{name}}, plan {{ plan }} / {{raw}} / {{missing}}."), F.col("vars")).alias("text"))


@query("l12_evaluator_prompt", "SELECT doc_id AS id, 'Q: ' || text || ' T: ' || source || ' A: ' || lang AS prompt FROM documents")
def l12(spark, d):
    t = fx.table(spark, d, "documents")
    return t.select(F.col("doc_id").alias("id"), T.fill_prompt(L("Q: {{input}} T: {{ground_truth}} A: {{output}}"), F.col("text"), F.col("source"), F.col("lang")).alias("prompt"))


@query("l13_score_extraction", "SELECT id, cost AS score FROM run")
def l13(spark, d):
    return fx.runs(spark, d).select("id", T.extract_score(F.concat(L("Score: "), F.format_string("%.2f", "cost"), L(" of 100"))).alias("score"))


# --- M
PAIR = """pair AS (SELECT id, text, ref, list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t <> '') AS h, list_filter(regexp_split_to_array(ref, '\\s+'), lambda t: t <> '') AS r
  FROM (SELECT r.id, r.text, b.text AS ref FROM doc_run r JOIN benchmark b ON b.item_id = r.doc_id % (SELECT count(*) FROM benchmark))),
 term AS (SELECT id, t, sum(h) AS h, sum(r) AS r FROM (SELECT id, unnest(h) AS t, 1 AS h, 0 AS r FROM pair UNION ALL SELECT id, unnest(r), 0, 1 FROM pair) GROUP BY 1, 2),
 stat AS (SELECT p.id, coalesce(sum(CASE WHEN t.r > 0 THEN t.h END), 0) AS hits, sum(t.h) AS nh, sum(t.r) AS nr, sum(t.h * t.r) AS dot, sum(t.h * t.h) AS hh, sum(t.r * t.r) AS rr FROM pair p LEFT JOIN term t ON t.id = p.id GROUP BY 1)"""


def pairs(spark, d):
    return sim.with_reference(fx.doc_runs(spark, d), fx.table(spark, d, "benchmark"))


def scored(spark, d, method):
    return sim.score_pair(pairs(spark, d), F.col("ideal_output"), F.col("text"), method).select("id", F.round("score", 6).alias("score"))


@query("m1_bleu", f"WITH {PAIR} SELECT id, round(CASE WHEN nh = 0 THEN 0 ELSE hits / nh END, 6)::DOUBLE AS score FROM stat")
def m1(spark, d):
    return scored(spark, d, "bleu")


@query("m2_rouge", f"WITH {PAIR} SELECT id, round(CASE WHEN nr = 0 THEN 0 ELSE hits / nr END, 6)::DOUBLE AS score FROM stat")
def m2(spark, d):
    return scored(spark, d, "rouge")


@query("m3_rouge_n", f"WITH {PAIR} SELECT id, round(len(list_intersect(h, r))::DOUBLE / len(r), 6) AS score FROM (SELECT id, list_distinct(h) AS h, r FROM pair)")
def m3(spark, d):
    return pairs(spark, d).select("id", F.round(S.rouge_n(M.last_text("output"), F.col("ideal_output")), 6).alias("score"))


@query("m3_rouge_l")
def m3l(spark, d):
    """Longest common subsequence has no SQL form; tested against brute force."""
    return pairs(spark, d).select("id", F.round(S.rouge_l(F.col("text"), F.col("ideal_output")), 6).alias("score"))


@query("m4_gleu", f"WITH {PAIR} SELECT id, round(CASE WHEN nh = 0 OR nr = 0 THEN 0 ELSE sqrt((hits / nh) * (hits / nr)) END, 6)::DOUBLE AS score FROM stat")
def m4(spark, d):
    return scored(spark, d, "gleu")


@query("m5_term_cosine", f"WITH {PAIR} SELECT id, round(CASE WHEN hh = 0 OR rr = 0 THEN 0 ELSE dot / (sqrt(hh) * sqrt(rr)) END, 6)::DOUBLE AS score FROM stat")
def m5(spark, d):
    return scored(spark, d, "cosine")


@query(
    "m6_embedding_cosine",
    "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) * 100, 4) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
)
def m6(spark, d):
    a = fx.table(spark, d, "embeddings")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return a.join(b, "vec_id").select("vec_id", F.round(S.embedding_cosine(F.col("embedding"), F.col("other")) * 100, 4).alias("score"))


@query("m7_jaccard", f"WITH {PAIR} SELECT id, round(1 + 99 * len(list_intersect(h, r))::DOUBLE / len(list_distinct(list_concat(h, r))), 6) AS score FROM (SELECT id, list_distinct(h) AS h, list_distinct(r) AS r FROM pair)")
def m7(spark, d):
    return pairs(spark, d).select("id", F.round(S.jaccard_percent(F.col("text"), F.col("ideal_output")), 6).alias("score"))


@query("m8_fuzzy_ratio", "SELECT p_partkey, round((greatest(length(p_name), length(p_type)) - levenshtein(p_name, lower(p_type)))::DOUBLE / greatest(length(p_name), length(p_type)), 6) AS score FROM part")
def m8(spark, d):
    p = fx.table(spark, d, "part")
    return p.select("p_partkey", F.round(S.fuzzy_ratio(F.col("p_name"), F.lower("p_type")), 6).alias("score"))


@query("m9_method_dispatch", f"WITH {PAIR} SELECT id, (CASE WHEN nh = 0 THEN 0 ELSE hits / nh END) >= 0.2 AS passed FROM stat")
def m9(spark, d):
    return sim.evaluate(pairs(spark, d), F.col("ideal_output"), F.col("text"), "bleu", 0.2).select("id", "passed")


@query("m10_string_comparator", "SELECT id, text = 'x' AS eq, text <> 'x' AS ne, contains(text, 'The') AS has, contains(lower(text), 'the') AS ihas FROM doc_run")
def m10(spark, d):
    t = M.content_text("output")
    return fx.doc_runs(spark, d).select("id", sim.compare_text(t, "equals", "x").alias("eq"), sim.compare_text(t, "not_equals", "x").alias("ne"), sim.compare_text(t, "contains", "The").alias("has"), sim.compare_text(t, "contains_ignore_case", "The").alias("ihas"))


LABELS = ["Und", "the ", "que"]


@query(
    "m11_labeler",
    "SELECT id, list_filter(['Und', 'the', 'que'], lambda x: contains(lower(text), lower(x)))[1] AS primary_label, len(list_filter(['Und', 'the', 'que'], lambda x: contains(lower(text), lower(x)))) > 0 AS passed FROM doc_run",
)
def m11(spark, d):
    r = fx.doc_runs(spark, d).select("id", sim.label(M.content_text("output"), LABELS).alias("l"))
    return r.select("id", "l.primary_label", "l.passed")


@query("m12_word_score", "SELECT id, round(10 * tanh(n / 100), 6) AS score, 10 * tanh(n / 100) >= 5 AS passed FROM (SELECT id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t <> '')) AS n FROM doc_run)")
def m12(spark, d):
    r = fx.doc_runs(spark, d).select("id", sim.word_score(M.content_text("output")).alias("s"))
    return r.select("id", F.round("s.score", 6).alias("score"), "s.passed")


# --- N
@query("n1_batch_inference", """SELECT id AS run_id, 'chars' AS evaluator_id, '{"chars": ' || length(text) || '}' AS result FROM doc_run WHERE length(text) >= 100""")
def n1(spark, d):
    def count_chars(batch):
        return [None if len(t) < 100 else {"chars": len(t)} for t in batch["text"]]

    return infer.batch_infer(fx.doc_runs(spark, d), "chars", count_chars, ["text"])


@query("n2_message_text", "SELECT id, text AS input, '' AS redacted FROM doc_run")
def n2(spark, d):
    r = fx.doc_runs(spark, d).withColumn("masked", L('"__NOT_INGESTED__"'))
    return r.select("id", F.array_join(M.texts("input"), " ").alias("input"), F.array_join(M.texts("masked"), " ").alias("redacted"))


SAID = "' ' || trim(regexp_replace(lower({0}), '[^\\pL]+', ' ', 'g')) || ' '"
#: The n-gram model of documents whose id is no multiple of 5, and the language of every document by it.
N3 = f"""WITH known AS (SELECT lang, left(text, {language.CHARS}) AS text FROM doc_run WHERE lang IS NOT NULL AND CAST(id AS BIGINT) % 5 <> 0 ORDER BY md5(id), text LIMIT {language.SAMPLE}),
 counted AS (SELECT lang, substr(t, CAST(i AS INT), 3) AS gram, count(*) AS n FROM (SELECT lang, t, unnest(range(1, length(t) - 1)) AS i FROM (SELECT lang, {SAID.format("text")} AS t FROM known)) GROUP BY 1, 2),
 kept AS (SELECT gram FROM counted GROUP BY gram ORDER BY sum(n) DESC, gram LIMIT {language.FEATURES}),
 langs AS (SELECT lang, ln(count(*) / sum(count(*)) OVER ()) AS prior FROM known GROUP BY lang),
 every_ AS (SELECT k.gram, l.lang, coalesce(c.n, 0) AS n FROM kept k, langs l LEFT JOIN counted c ON c.gram = k.gram AND c.lang = l.lang),
 weights AS (SELECT gram, lang, ln((n + 0.5) / (sum(n) OVER (PARTITION BY lang) + 0.5 * count(*) OVER (PARTITION BY lang))) AS w FROM every_),
 said AS (SELECT id, substr(t, CAST(i AS INT), 3) AS gram FROM (SELECT id, t, unnest(range(1, length(t) - 1)) AS i FROM (SELECT id, {SAID.format("text")} AS t FROM doc_run WHERE length(text) >= {language.MIN_CHARS}))),
 summed AS (SELECT id, lang, sum(w) / 3 AS s FROM said JOIN weights USING (gram) GROUP BY id, lang),
 scored AS (SELECT d.id, l.lang, prior + coalesce(s, 0) AS s FROM doc_run d CROSS JOIN langs l LEFT JOIN summed u ON u.id = d.id AND u.lang = l.lang WHERE length(d.text) >= {language.MIN_CHARS}),
 best AS (SELECT id, arg_max(lang, s) AS iso, max(s) AS top, list(s) AS all_ FROM scored GROUP BY id)
 SELECT d.id, CASE WHEN 1 / list_sum(list_transform(all_, lambda x: exp(x - top))) >= {language.MIN_CONFIDENCE} THEN iso END AS iso,
   CASE WHEN 1 / list_sum(list_transform(all_, lambda x: exp(x - top))) >= {language.MIN_CONFIDENCE} THEN round(1 / list_sum(list_transform(all_, lambda x: exp(x - top))), 6) END AS confidence
 FROM doc_run d LEFT JOIN best USING (id)"""


@query("n3_language_detection", N3)
def n3(spark, d):
    """Languages by a model of four fifths of the documents; the last fifth was not seen in training."""
    r = fx.doc_runs(spark, d)
    model = language.LanguageModel.fit(r.where(F.col("doc_id") % 5 != 0))
    found = r.select("id", F.get(model.detect(M.texts("output")), F.lit(0)).alias("l"))
    return found.select("id", F.col("l.isoCode").alias("iso"), F.round("l.confidence", 6).alias("confidence"))


@query("n4_pii_detection", f"SELECT id, len(regexp_extract_all(text, '{infer.PII_PATTERNS['email']}')) AS emails, len(regexp_extract_all(text, 'ID-[0-9]+')) AS custom FROM doc_run")
def n4(spark, d):
    found = infer.detect_pii(F.col("text"), types=["email"], custom={"ticket": "ID-[0-9]+"})
    n = lambda kind: F.size(F.filter("found", lambda e: e["type"] == kind)).cast("long")
    return fx.doc_runs(spark, d).select("id", found.alias("found")).select("id", n("email").alias("emails"), n("ticket").alias("custom"))


@query("n5_topic_tagging", "SELECT id, array_to_string(list_filter(['the','und','que'], lambda t: list_contains(regexp_split_to_array(lower(text), '\\s+'), t)), ',') AS topics FROM doc_run")
def n5(spark, d):
    return fx.doc_runs(spark, d).select("id", F.array_join(F.transform(infer.tag_topics(F.col("text"), ["the", "und", "que"]), lambda x: x["topic"]), ",").alias("topics"))


@query("n6_toxicity")
def n6(spark, d):
    """Two labels, trained on the labelled documents whose id is no multiple of 5; every message has a score for each, and
    the answer is another text than the question. No SQL form."""
    r = fx.doc_runs(spark, d).withColumn("toxicity", F.col("toxic")).withColumn("junk", 1 - F.col("quality"))
    model = infer.MultiLabelClassifier(["toxicity", "junk"]).fit(r.where(F.col("doc_id") % 5 != 0), "text")
    asked = r.withColumn("output", F.to_json(F.array(F.struct(L("assistant").alias("role"), F.reverse(F.col("text")).alias("content")))))
    scores = cut_lineage(infer.toxicity_scores(asked, model))  # read twice, scored once
    wide = lambda side: F.max(F.when(F.col("side") == side, F.round("scores.toxicity", 6))).alias(f"{side}_toxicity")
    by_message = scores.groupBy("run_id").agg(wide("input"), wide("output"))
    rows = infer.toxicity_rows(scores, model.labels)
    return rows.join(by_message, "run_id").select("run_id", "toxic_input", "toxic_output", F.array_join("input_labels", ",").alias("input_labels"), "input_toxicity", "output_toxicity")


def _lex(words) -> str:
    return "len(list_filter(w, lambda x: x IN (" + ", ".join(f"'{x}'" for x in words) + ")))"


@query(
    "n7_sentiment",
    f"""WITH c AS (SELECT id, text, regexp_split_to_array(lower(text), '[^\\pL]+') AS w FROM doc_run), s AS (SELECT id, text, {_lex(infer.POSITIVE)} AS up, {_lex(infer.NEGATIVE)} AS down FROM c)
     SELECT id, CASE WHEN length(text) < 10 OR up + down = 0 THEN 'neutral' WHEN round(ceil(1 + 4 * up / (up + down)::DOUBLE) / 5, 2) >= 0.7 THEN 'positive'
      WHEN round(ceil(1 + 4 * up / (up + down)::DOUBLE) / 5, 2) <= 0.4 THEN 'negative' ELSE 'neutral' END AS label FROM s""",
)
def n7(spark, d):
    return fx.doc_runs(spark, d).select("id", infer.user_sentiments(F.col("input"))[0]["s"]["label"].alias("label"))


N8 = """WITH c AS (SELECT thread_id, turn, role, trim(content, chr(32)) AS content FROM chat_msg WHERE trim(content, chr(32)) <> ''),
 d AS (SELECT *, lag(role) OVER w AS pr, lag(content) OVER w AS pc FROM c WINDOW w AS (PARTITION BY thread_id ORDER BY turn)),
 l AS (SELECT thread_id, row_number() OVER (PARTITION BY thread_id ORDER BY turn) AS n, role, content FROM d WHERE NOT (role IS NOT DISTINCT FROM pr AND content IS NOT DISTINCT FROM pc)),
 t AS (SELECT *, n || '. ' || upper(role) || ': ' || content AS line FROM l),
 s AS (SELECT *, sum(length(line) + 2) OVER (PARTITION BY thread_id) AS total, sum(length(line) + 2) OVER (PARTITION BY thread_id ORDER BY n DESC) AS from_end, max(n) OVER (PARTITION BY thread_id) AS last FROM t)
 SELECT thread_id, string_agg(line, chr(10) || chr(10) ORDER BY n) AS transcript FROM s WHERE total - 2 <= {limit} OR from_end <= {limit} OR n = last GROUP BY 1"""


@query("n8_intent_transcript", N8.format(limit=12000))
def n8(spark, d):
    return infer.transcripts(fx.messages(spark, d))


@query("n8_intent_transcript_tail", N8.format(limit=600))
def n8t(spark, d):
    return infer.transcripts(fx.messages(spark, d), limit=600)


@query("n9_label_normalisation", "SELECT id, upper(name[1]) || name[2:] || ' ' || 'Now' AS label, least(cost / 100, 1.0) AS confidence FROM run")
def n9(spark, d):
    found = F.array(F.struct(F.concat("name", L("__NOW-")).alias("label"), (F.col("cost") / 100).alias("confidence")), F.struct(L("  ").alias("label"), L(0.1).alias("confidence")))
    return fx.runs(spark, d).select("id", infer.normalize_intents(found).alias("i")).select("id", F.col("i")[0]["label"].alias("label"), F.col("i")[0]["confidence"].alias("confidence"))


@query("n10_judge", """SELECT id AS run_id, '{"result": ' || CASE WHEN contains(text, 'the') THEN 'true' ELSE 'false' END || ', "reason": "rule"}' AS result FROM doc_run""")
def n10(spark, d):
    def says_the(batch):
        import json

        return [{"result": "the" in json.loads(o)[0]["content"], "reason": "rule"} for o in batch["output"]]

    return infer.judge(fx.doc_runs(spark, d), "assertion", says_the).select("run_id", "result")


@query("n11_backlog_round", f"""SELECT id, evaluator_id FROM (SELECT id, 'ev-sentiment' AS evaluator_id, row_number() OVER (ORDER BY created_at DESC, id) AS n FROM doc_run WHERE quality IS NULL
   UNION ALL SELECT id, 'ev-new', row_number() OVER (ORDER BY created_at DESC, id) FROM doc_run WHERE length(CAST(to_json([{{'role': 'user', 'content': text}}]) AS VARCHAR)) > 100) WHERE n <= 100""")
def n11r(spark, d):
    """The newest hundred of two evaluators' backlogs."""
    longer = ["AND", {"id": "length", "params": {"field": "input", "operator": "gt", "length": 100}}]
    evaluators = [{"id": "ev-sentiment", "type": "sentiment"}, {"id": "ev-new", "type": "length", "filters": longer}]
    return infer.next_round(fx.doc_runs(spark, d), fx.doc_results(spark, d), evaluators).select("id", "evaluator_id")


@query("n11_backlog", "SELECT id FROM doc_run WHERE quality IS NULL AND length(CAST(to_json([{'role': 'user', 'content': text}]) AS VARCHAR)) > 100")
def n11(spark, d):
    logic = ["AND", {"id": "length", "params": {"field": "input", "operator": "gt", "length": 100}}]
    return infer.backlog(fx.doc_runs(spark, d), fx.doc_results(spark, d), "ev-sentiment", "sentiment", logic).select("id")


# --- O
STATS = "SELECT label, count(*) AS occurrences FROM (SELECT 'ask ' || source AS label FROM documents UNION ALL SELECT 'in ' || lang FROM documents) GROUP BY 1"


@query("o1_intent_statistics", STATS)
def o1(spark, d):
    return intents.intent_stats(fx.doc_results(spark, d))


def part_labels(spark, d):
    """Part names as intent labels: spelled three ways, and in two longer requests."""
    p = fx.table(spark, d, "part")
    way = F.col("p_partkey") % 5
    label = (
        F.when(way == 0, F.col("p_name")).when(way == 1, F.upper(F.replace("p_name", L(" "), L("_")))).when(way == 2, F.concat("p_name", L("s")))
        .when(way == 3, F.concat(L("show "), "p_name", L(" parts"))).otherwise(F.concat(L("Show all parts: "), "p_name"))
    )
    return p.groupBy(label.alias("label")).agg(F.count(L(1)).alias("occurrences"))


#: Every pair of fingerprints is compared: shared shortenings, or three quarters of all words in common.
O2 = """WITH RECURSIVE s AS (SELECT CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN upper(replace(p_name, ' ', '_')) WHEN 2 THEN p_name || 's' WHEN 3 THEN 'show ' || p_name || ' parts' ELSE 'Show all parts: ' || p_name END AS label,
   count(*) AS occurrences FROM part GROUP BY 1),
 f AS (SELECT *, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(label), '[^\\pL\\pN]+'), lambda w: w <> ''))) AS words FROM s),
 n AS (SELECT DISTINCT array_to_string(words, ' ') AS fp, words FROM f),
 c AS (SELECT fp, words, CASE WHEN length(fp) > 3 THEN list_append(list_transform(range(1, length(fp) + 1), lambda i: left(fp, i - 1) || substr(fp, i + 1)), fp) ELSE [fp] END AS cuts FROM n),
 e AS (SELECT a.fp AS u, b.fp AS v FROM c a JOIN c b ON list_has_any(a.cuts, b.cuts) OR len(list_intersect(a.words, b.words)) >= 0.75 * (len(a.words) + len(b.words) - len(list_intersect(a.words, b.words)))),
 r(u, v) AS (SELECT u, v FROM e UNION SELECT r.u, e.v FROM r JOIN e ON e.u = r.v),
 g AS (SELECT u AS fp, min(v) AS comp FROM r GROUP BY u),
 m AS (SELECT label, occurrences, comp FROM f JOIN g ON g.fp = array_to_string(words, ' ')),
 t AS (SELECT comp, arg_max(label, (occurrences, label)) AS cluster FROM m GROUP BY comp)
 SELECT label, occurrences, cluster FROM m JOIN t USING (comp)"""


@query("o2_label_grouping", O2)
def o2(spark, d):
    """Clusters of near-equal labels."""
    return intents.grouped_labels(part_labels(spark, d))


@query("o3_coverage_repair", f"SELECT label, occurrences, CASE WHEN label LIKE 'ask%' THEN 'Asking' ELSE 'Other' END AS cluster FROM ({STATS})")
def o3(spark, d):
    stats = intents.intent_stats(fx.doc_results(spark, d))
    groups = stats.where("label like 'ask%'").select(F.upper("label").alias("label"), L("Asking").alias("cluster"))
    return intents.with_coverage(stats, groups)


@query(
    "o4_overflow",
    f"""WITH s AS ({STATS}), top AS (SELECT label FROM s ORDER BY occurrences DESC, label LIMIT 4)
     SELECT label, occurrences, CASE WHEN label IN (SELECT label FROM top) THEN label ELSE 'Other' END AS cluster FROM s""",
)
def o4(spark, d):
    stats = intents.intent_stats(fx.doc_results(spark, d))
    return intents.with_overflow(stats.withColumn("cluster", F.col("label")), 4)


@query(
    "o4_fallback",
    f"""WITH s AS ({STATS}), top AS (SELECT label FROM s ORDER BY occurrences DESC, label LIMIT 2)
     SELECT label, occurrences, CASE WHEN label IN (SELECT label FROM top) THEN upper(label[1]) || label[2:3] || upper(label[4]) || label[5:] ELSE 'Other' END AS cluster FROM s""",
)
def o4f(spark, d):
    stats = intents.intent_stats(fx.doc_results(spark, d))
    return intents.with_overflow(stats.withColumn("cluster", L("Other")), 2)


@query("o5_cluster_totals", f"WITH s AS ({STATS}) SELECT cluster, total, row_number() OVER (ORDER BY total DESC, cluster) AS sort_order FROM (SELECT label[1:2] AS cluster, CAST(sum(occurrences) AS BIGINT) AS total FROM s GROUP BY 1)")
def o5(spark, d):
    g = intents.intent_stats(fx.doc_results(spark, d)).withColumn("cluster", F.substring("label", 1, 2))
    return intents.clusters(g, 10).withColumn("sort_order", F.col("sort_order").cast("long"))


@query(
    "o6_alias_mapping",
    """SELECT id AS run_id, 'ask ' || source AS label, 'Group ' || CAST(substr(source, 4) AS INT) % 5 AS canonical, CAST(substr(source, 4) AS INT) % 5 > 2 AS is_other FROM doc_run
     UNION ALL SELECT id, 'in ' || lang, 'in ' || lang, false FROM doc_run""",
)
def o6(spark, d):
    aliases = fx.intent_aliases(spark, d)
    ordered = aliases.select(F.col("label").alias("cluster")).distinct().withColumn("sort_order", F.regexp_extract("cluster", "[0-9]+", 0).cast("int"))
    return intents.map_labels(fx.doc_results(spark, d), aliases, ordered, 2)
