"""A9–A16, P: imports, exports, datasets and evaluations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import datasets as ds
from ..operators import enrich, similarity as sim, trees
from ..operators.infer import OnBatches
from ..operators.filters import run_checks
from ..sources import datasets as imports
from ..session import shared_folder
from ..sources import export
from . import fixtures as fx
from .ingest import ntz
from .registry import query
from .relations import tree_sql
from .text import PAIR

L = F.lit


def sheet(spark, d):
    """Documents as a spreadsheet with aliased headers and blanks."""
    t = fx.table(spark, d, "documents")
    return t.select(F.col("text").alias("Input"), F.when(F.col("lang") == "en", " ").otherwise(F.col("lang")).alias("expectedOutput"), F.col("source").alias("model_output"))


@query("a9_csv_dataset_import", "SELECT nullif(trim(text, chr(32)), '') AS input, CASE WHEN lang <> 'en' THEN lang END AS ground_truth, source AS output FROM documents")
def a9(spark, d):
    """Written as CSV and read back."""
    path = shared_folder(spark, "csv")
    quoting = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    sheet(spark, d).write.csv(path, header=True, **quoting)
    return imports.read_csv_items(spark, path)


@query("a10_jsonl_dataset_import", "SELECT text AS input, CAST(n_chars AS VARCHAR) AS ground_truth, CASE WHEN lang <> 'en' THEN lang END AS output FROM documents")
def a10(spark, d):
    t = fx.table(spark, d, "documents")
    line = F.to_json(F.struct(F.col("text").alias("input"), F.col("n_chars").alias("groundtruth"), F.when(F.col("lang") == "en", "").otherwise(F.col("lang")).alias("prediction")))
    path = shared_folder(spark, "jsonl")
    t.select(line.alias("value")).write.text(path)
    return imports.read_jsonl_items(spark, path)


@query("a11_run_export_csv", """SELECT id, name, '["' || tags[1] || '","' || tags[2] || '"]' AS tags FROM run""")
def a11(spark, d):
    path = shared_folder(spark, "export")
    export.export_runs(fx.runs(spark, d).select("id", "name", "tags"), path)
    return spark.read.csv(path, header=True, escape='"', schema="id string, name string, tags string")


@query("a12_run_export_jsonl", """SELECT '{"id":"' || id || '","name":"' || name || '","prompt_tokens":' || prompt_tokens || '}' AS value FROM run""")
def a12(spark, d):
    path = shared_folder(spark, "export")
    export.export_runs(fx.runs(spark, d).select("id", "name", "prompt_tokens"), path, "jsonl")
    return spark.read.text(path)


NODE = "'id': id, 'type': type, 'name': name, 'status': status, 'cost': cost, 'prompt_tokens': prompt_tokens"


@query("a12_trace_export_jsonl", f"WITH RECURSIVE {tree_sql('run', NODE)} SELECT string_agg(line, '' ORDER BY place) AS value FROM lines GROUP BY root_id")
def a12t(spark, d):
    path = shared_folder(spark, "export")
    export.export_runs(fx.runs(spark, d), path, "jsonl", "trace", fields=("type", "name", "status", "cost", "prompt_tokens"))
    return spark.read.text(path)


@query("a13_fine_tuning_export", """SELECT id, event AS asked, said FROM (SELECT id, name || ' ' || prompt_tokens AS event, 'user ' || external_user_id AS said, status FROM run) WHERE status = 'success'""")
def a13(spark, d):
    out = export.training_lines(fx.runs(spark, d))
    at = lambda i: F.get_json_object("value", f"$.messages[{i}].content")
    return out.select("id", at(0).alias("asked"), at(1).alias("said"))


def items(spark, d):
    """Line items as dataset items: one dataset per return flag."""
    return fx.table(spark, d, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_extendedprice").cast("decimal(12,2)").cast("string")).alias("id"),
        F.col("l_returnflag").alias("dataset_id"), F.col("l_shipdate").cast("timestamp").alias("created_at"),
        F.concat(L("q"), "l_partkey").alias("input"), F.col("l_linestatus").alias("ground_truth"), F.col("l_returnflag").alias("output"), "l_linenumber", "l_quantity", "l_extendedprice",
    )


fx.SQL_VIEWS["item"] = """
SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || CAST(l_extendedprice AS DECIMAL(12,2)) AS id, l_returnflag AS dataset_id, l_shipdate AS created_at,
 'q' || l_partkey AS input, l_linestatus AS ground_truth, l_linenumber, l_quantity, l_extendedprice FROM lineitem
"""


def versions(spark, d):
    return fx.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("dataset_id"), F.col("l_linenumber").alias("version_number")).distinct()


SNAP = """SELECT i.dataset_id, v.n + 1 AS version_number, row_number() OVER (PARTITION BY i.dataset_id ORDER BY created_at, id) AS item_index, id AS source_item_id, input
 FROM item i JOIN (SELECT l_returnflag AS dataset_id, max(l_linenumber) AS n FROM lineitem GROUP BY 1) v ON v.dataset_id = i.dataset_id"""


@query("p1_snapshot_version", SNAP)
def p1(spark, d):
    return ds.snapshot(items(spark, d), versions(spark, d)).select("dataset_id", "version_number", "item_index", "source_item_id", "input")


@query("p2_restore_version", f"SELECT source_item_id AS id, dataset_id, TIMESTAMP '1970-01-01' + to_seconds(item_index) AS created_at, input FROM ({SNAP}) WHERE version_number = 8")
def p2(spark, d):
    return ntz(ds.restore(ds.snapshot(items(spark, d), versions(spark, d)), 8).select("id", "dataset_id", "created_at", "input"), "created_at")


def named_sets(spark, d):
    n = F.regexp_extract("p_brand", "[0-9]+", 0).cast("int")
    name = F.when(n % 2 == 0, F.concat(L("Set "), n)).otherwise(F.concat(L("Set "), n - 1, L(" copy")))
    return fx.table(spark, d, "part").groupBy(F.col("p_brand").alias("dataset_id")).agg(F.min("p_size").alias("created_at"), F.max("p_size").alias("updated_at")).withColumn(
        "n", F.regexp_extract("dataset_id", "[0-9]+", 0).cast("int")
    ).select("dataset_id", "created_at", "updated_at", F.when(F.col("n") % 2 == 0, F.concat(L("Set "), "n")).otherwise(F.concat(L("Set "), F.col("n") - 1, L(" copy"))).alias("name"))


BRANDS = "(SELECT p_brand AS dataset_id, CAST(regexp_extract(p_brand, '[0-9]+') AS INT) AS n, min(p_size) AS created_at, max(p_size) AS updated_at FROM part GROUP BY 1, 2)"


@query(
    "p3_duplicate_dataset",
    f"""WITH b AS (SELECT * FROM {BRANDS}) SELECT a.dataset_id AS source_dataset_id, CASE WHEN a.n % 2 = 1 THEN 'Set ' || (a.n - 1) || ' copy copy'
      WHEN c.n IS NOT NULL THEN 'Set ' || a.n || ' copy (2)' ELSE 'Set ' || a.n || ' copy' END AS name FROM b a LEFT JOIN b c ON c.n = a.n + 1 AND a.n % 2 = 0""",
)
def p3(spark, d):
    copies, _ = ds.duplicate(named_sets(spark, d), items(spark, d))
    return copies.select("source_dataset_id", "name")


@query("p3_duplicate_items", f"SELECT 'copy of ' || dataset_id AS dataset_id, count(*) AS items FROM item GROUP BY 1")
def p3i(spark, d):
    it = items(spark, d)
    sets = it.select("dataset_id").distinct().withColumn("name", F.col("dataset_id"))
    copies, moved = ds.duplicate(sets, it)
    back = copies.select("dataset_id", F.concat(L("copy of "), "source_dataset_id").alias("name"))
    return moved.join(back, "dataset_id").groupBy(F.col("name").alias("dataset_id")).agg(F.count(L(1)).alias("items"))


@query("p4_dataset_from_runs", "SELECT id AS run_id, 'user ' || external_user_id AS content FROM run WHERE status = 'success'")
def p4(spark, d):
    r = fx.runs(spark, d).withColumn("input", F.col("output"))
    return ds.from_runs(r).select("run_id", F.col("messages")[0]["content"].alias("content"))


def resolved(spark, d):
    items, said = fx.table(spark, d, "benchmark"), fx.table(spark, d, "conversations")
    prompts = items.select(F.col("item_id").alias("prompt_id"), F.concat(L("{{role}} says {{text}} about {{nothing}}: "), "text").alias("template"))
    variations = said.select((F.col("conv_id") % items.count()).alias("prompt_id"), F.concat_ws("-", "conv_id", "turn").alias("variation_id"), F.create_map(L("role"), "role", L("text"), "text").alias("variables"), F.col("role").alias("ideal_output"))
    return ds.resolve(prompts, variations)


@query("p5_dataset_resolve", "SELECT b.item_id AS prompt_id, c.conv_id || '-' || c.turn AS variation_id, c.role || ' says ' || c.text || ' about : ' || b.text AS input, c.role AS ideal_output FROM benchmark b JOIN conversations c ON c.conv_id % (SELECT count(*) FROM benchmark) = b.item_id")
def p5(spark, d):
    return resolved(spark, d)


def swept(spark, d, more=None):
    docs = sim.with_overlap(sim.with_reference(fx.doc_runs(spark, d), fx.table(spark, d, "benchmark")), F.col("ideal_output"), F.col("text")).withColumn("dataset_id", F.col("lang"))
    from ..functions import similarity as S

    return ds.sweep(docs, {1: ("labels", lambda i: sim.label(F.col("text"), ["the", "und"])["primary_label"]), 2: ("bleu", lambda i: F.round(S.bleu_of(F.col("overlap")), 4))} | (more or {}))


SWEPT = f"""{PAIR}, swept AS (SELECT p.id AS item_id, 1 AS slot, CASE WHEN contains(lower(text), 'the') THEN 'the' WHEN contains(lower(text), 'und') THEN 'und' END AS label, NULL::DOUBLE AS score FROM pair p
 UNION ALL SELECT id, 2, NULL, round(CASE WHEN nh = 0 THEN 0 ELSE hits / nh END, 4)::DOUBLE FROM stat)"""


@query("p6_evaluator_sweep", f"""WITH {SWEPT} SELECT item_id, slot, label, score, NULL AS error FROM swept
 UNION ALL SELECT id, 3, CASE WHEN doc_id % 7 <> 3 THEN lang END, NULL, CASE WHEN doc_id % 7 = 3 THEN 'no answer for ' || id END FROM doc_run
 UNION ALL SELECT id, 4, NULL, NULL, 'unresolved' FROM doc_run""")
def p6(spark, d):
    """Beside two evaluators that work: one that fails on some items, and one that reads a column that isn't there."""

    def picky(batch):
        for i, n in zip(batch["id"], batch["doc_id"], strict=True):
            if n % 7 == 3:
                raise ValueError(f"no answer for {i}")
        return list(batch["lang"])

    s = swept(spark, d, {3: ("picky", OnBatches(picky, ["id", "doc_id", "lang"])), 4: ("lost", lambda i: F.col("not_there"))})
    v, error = F.get_json_object("result", "$.value"), F.get_json_object("result", "$.error")
    return s.select("item_id", "slot", F.when(F.col("slot") != 2, v).alias("label"), F.when(F.col("slot") == 2, v).cast("double").alias("score"), F.when((F.col("slot") == 4) & error.isNotNull(), "unresolved").otherwise(error).alias("error"))


def outcomes(spark, d):
    s = swept(spark, d)
    v = F.get_json_object("result", "$.value")
    kind = F.when(F.col("slot") == 1, "model-labeler").otherwise("model-scorer")
    return s.select("item_id", "dataset_id", "slot", F.when(F.col("slot") == 1, F.col("evaluator_id")).alias("evaluator_id"), ds.outcome(kind, F.when(F.col("slot") == 1, v), F.when(F.col("slot") == 2, v).cast("double"), ["the"], 0.2).alias("outcome"))


OUTCOMES = f"""{SWEPT}, outs AS (SELECT item_id, slot, CASE WHEN slot = 1 THEN CASE WHEN label IS NULL THEN 'unknown' WHEN label = 'the' THEN 'pass' ELSE 'fail' END
 ELSE CASE WHEN score >= 0.2 THEN 'pass' ELSE 'fail' END END AS outcome, d.lang AS dataset_id FROM swept JOIN doc_run d ON d.id = swept.item_id)"""


@query("p7_pass_outcome", f"WITH {OUTCOMES} SELECT item_id, slot, outcome FROM outs")
def p7(spark, d):
    return outcomes(spark, d).select("item_id", "slot", "outcome")


SUMMARY = """count(*) FILTER (outcome='pass') AS passed, count(*) FILTER (outcome='fail') AS failed, count(*) FILTER (outcome='unknown') AS unknown, count(*) AS evaluated,
 coalesce(round(count(*) FILTER (outcome='pass') * 100.0::DOUBLE / nullif(count(*) FILTER (outcome IN ('pass','fail')), 0), 2), 0) AS pass_rate"""


@query(
    "p8_run_summary",
    f"""WITH {OUTCOMES}, t AS (SELECT lang AS dataset_id, count(*) * 2 AS items FROM documents GROUP BY 1)
     SELECT o.dataset_id, o.slot, {SUMMARY}, t.items, round(count(*) * 100.0::DOUBLE / t.items, 2) AS coverage FROM outs o JOIN t ON t.dataset_id = o.dataset_id GROUP BY 1, 2, t.items""",
)
def p8(spark, d):
    totals = fx.table(spark, d, "documents").groupBy(F.col("lang").alias("dataset_id")).agg((F.count(L(1)) * 2).alias("items"))
    return ds.run_summary(outcomes(spark, d), totals, ["dataset_id", "slot"])


@query(
    "p9_summary_across_runs",
    f"""WITH {OUTCOMES} SELECT CASE WHEN slot = 1 THEN 'labels' ELSE 'slot-2' END AS evaluator, {SUMMARY}, count(DISTINCT dataset_id) AS runs FROM outs GROUP BY 1""",
)
def p9(spark, d):
    totals = fx.table(spark, d, "documents").groupBy(F.col("lang").alias("dataset_id")).agg(F.count(L(1)).alias("items"))
    per = ds.run_summary(outcomes(spark, d), totals, ["dataset_id", "slot", "evaluator_id"])
    return ds.summary_across(per)


def grid_results(spark, d):
    """Every prompt variation under every provider; the answer repeats the question, shouted by every second provider."""
    providers = fx.table(spark, d, "part").select(F.col("p_type").alias("provider")).distinct()
    prompts = resolved(spark, d).select("prompt_id").distinct()
    variations = resolved(spark, d).select("prompt_id", "variation_id", "input", "ideal_output")
    grid = enrich.evaluation_grid(prompts, variations, providers)

    def answers(batch):
        out = []
        for asked, provider, cell in zip(batch["input"], batch["provider"], batch["variation_id"], strict=True):
            if provider == "PROMO" and cell.endswith("-1"):
                raise TimeoutError("no answer")
            out.append({"output": asked.upper() if len(provider) % 2 == 0 else asked, "duration_s": len(provider) / 10, "cost": len(provider) / 100})
        return out

    answer = lambda g: ds.answered(g, OnBatches(answers, ["input", "provider", "variation_id"]))
    checks = ["AND", {"id": "string", "params": {"fields": "output", "type": "contains", "text": "says", "sensitive": "true"}}, {"id": "length", "params": {"field": "output", "operator": "gt", "length": 400}}]
    return ds.run_grid(grid, answer, checks, run_checks)


GRID = """grid AS (SELECT b.item_id AS prompt_id, c.conv_id || '-' || c.turn AS variation_id, p.name AS provider, c.role || ' says ' || c.text || ' about : ' || b.text AS input
  FROM benchmark b JOIN conversations c ON c.conv_id % (SELECT count(*) FROM benchmark) = b.item_id
  CROSS JOIN (SELECT DISTINCT p_type AS name FROM part) p),
 res AS (SELECT *, contains(CASE WHEN length(provider) % 2 = 0 THEN upper(input) ELSE input END, 'says') AND length(input) > 400 AS ok, provider = 'PROMO' AND variation_id LIKE '%-1' AS lost, CASE WHEN NOT lost THEN ok END AS passed FROM grid)"""


@query("p10_evaluation_grid", f"WITH {GRID} SELECT prompt_id, variation_id, provider, passed, CASE WHEN lost THEN 'error' ELSE 'success' END AS status, CASE WHEN lost THEN 'no answer' END AS error FROM res")
def p10(spark, d):
    """One provider fails on every second turn: those cells have their error, all others their verdict."""
    return grid_results(spark, d).select("prompt_id", "variation_id", "provider", "passed", "status", "error")


@query(
    "p11_results_matrix",
    f"WITH {GRID} SELECT variation_id, provider, count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed, round(avg(CASE WHEN NOT lost THEN length(provider) / 10 END), 4) AS mean_duration, round(avg(CASE WHEN NOT lost THEN length(provider) / 100 END), 4) AS mean_cost FROM res GROUP BY 1, 2",
)
def p11(spark, d):
    m = ds.results_matrix(grid_results(spark, d))
    return m.withColumn("mean_duration", F.round("mean_duration", 4)).withColumn("mean_cost", F.round("mean_cost", 4))


@query(
    "a16_evaluation_matrix_csv",
    f"WITH {GRID} SELECT variation_id, provider, count(*) FILTER (passed) AS passed FROM res GROUP BY 1, 2",
)
def a16(spark, d):
    """The CSV has a column per provider, read back as rows."""
    wide = export.evaluation_matrix(grid_results(spark, d))
    path = shared_folder(spark, "matrix")
    wide.write.option("header", True).csv(path)
    read = spark.read.option("header", True).csv(path)
    return read.unpivot("variation_id", [F.col(f"`{c}`") for c in read.columns[1:]], "provider", "passed").withColumn("passed", F.col("passed").cast("long"))


@query(
    "p12_dataset_list",
    f"""SELECT b.dataset_id, CASE WHEN n % 2 = 0 THEN 'Set ' || n ELSE 'Set ' || (n - 1) || ' copy' END AS name, items FROM {BRANDS} b JOIN (SELECT p_brand AS dataset_id, count(*) AS items FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1) i
     ON i.dataset_id = b.dataset_id WHERE n % 2 = 1 ORDER BY items DESC, 1 LIMIT 10""",
)
def p12(spark, d):
    li, p = fx.table(spark, d, "lineitem"), fx.table(spark, d, "part")
    it = li.join(p, li.l_partkey == p.p_partkey).select(F.col("p_brand").alias("dataset_id"))
    return ds.dataset_list(named_sets(spark, d), it, search="COPY", sort="items", size=10).select("dataset_id", "name", "items")
