"""C: pricing over the line-item runs; the price list comes from the parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pricing
from . import fixtures as fx
from .registry import query

L = F.lit
REGIONS = "['AFRICA','AMERICA','ASIA','EUROPE','MIDDLE EAST']"
# half the parts are global prices, the rest belong to one organisation
fx.SQL_VIEWS["mapping"] = f"""
SELECT p_partkey AS id, p_name AS name, p_brand AS brand, CASE p_size % 3 WHEN 0 THEN 'TOKENS' WHEN 1 THEN 'CHARACTERS' ELSE 'MILLISECONDS' END AS unit,
 p_retailprice AS input_cost, p_retailprice * 2 AS output_cost, TIMESTAMP '1995-01-01' + to_days(p_size * 30) AS start_date,
 CASE WHEN p_partkey % 2 = 1 THEN {REGIONS}[CAST(p_partkey % 5 AS INT) + 1] END AS org_id FROM part
"""


def mappings(spark, d):
    p = fx.table(spark, d, "part")
    names = F.array(*[L(x) for x in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")])
    return p.select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.concat(L("^("), "p_brand", L(")$")).alias("pattern"),
        F.when(F.col("p_size") % 3 == 0, "TOKENS").when(F.col("p_size") % 3 == 1, "CHARACTERS").otherwise("MILLISECONDS").alias("unit"),
        F.col("p_retailprice").alias("input_cost"), (F.col("p_retailprice") * 2).alias("output_cost"), L(None).cast("double").alias("input_caching_cost_reduction"),
        (L("1995-01-01").cast("timestamp") + F.make_dt_interval(F.col("p_size") * 30)).alias("start_date"),
        F.when(F.col("p_partkey") % 2 == 1, F.get(names, (F.col("p_partkey") % 5).cast("int"))).alias("org_id"),
    )


def priced_runs(spark, d):
    return fx.org_usage(spark, d).withColumn("cached_prompt_tokens", L(0)).withColumn("input", L('"0123456789"')).withColumn("output", L('"01234"'))


BEST = """best AS (SELECT o.org_id, o.name, arg_max(m, (m.start_date, m.org_id IS NOT NULL, -m.id)) AS m FROM (SELECT DISTINCT org_id, name FROM org_run) o
  JOIN mapping m ON m.brand = o.name AND (m.org_id IS NULL OR m.org_id = o.org_id) GROUP BY 1, 2)"""


@query("c1_best_mapping", f"WITH {BEST} SELECT org_id, name, m.unit AS unit, m.input_cost AS input_cost FROM best")
def c1(spark, d):
    return pricing.best_mapping(fx.org_usage(spark, d), mappings(spark, d)).select("org_id", "name", "unit", "input_cost")


@query(
    "c2_run_cost",
    f"""WITH {BEST} SELECT r.id, round(CASE b.m.unit WHEN 'TOKENS' THEN b.m.input_cost * prompt_tokens / 1e6 + b.m.output_cost * completion_tokens / 1e6
      WHEN 'CHARACTERS' THEN b.m.input_cost * 10 / 1e6 + b.m.output_cost * 5 / 1e6 ELSE b.m.input_cost * 2000 / 1e6 END, 8) AS cost
     FROM org_run r JOIN best b ON b.org_id = r.org_id AND b.name = r.name""",
)
def c2(spark, d):
    return pricing.price(priced_runs(spark, d), mappings(spark, d)).select("id", F.round("cost", 8).alias("cost"))


LEGACY_NAMES = ["Azure-GPT4-32k", "gpt-35-turbo", "Claude3-opus", "my-gpt-4o", "mistral-tiny", "nobody"]


@query(
    "c3_legacy_price",
    """SELECT id, round(CASE n WHEN 0 THEN 0.06 * p + 0.12 * c WHEN 1 THEN 0.0005 * p + 0.0015 * c WHEN 2 THEN 0.015 * p + 0.075 * c WHEN 3 THEN 0.005 * p + 0.015 * c WHEN 4 THEN 0.00014 * p + 0.00042 * c END / 1000, 9) AS legacy_cost
     FROM (SELECT id, CAST(regexp_extract(name, '[0-9]+') AS INT) % 6 AS n, prompt_tokens AS p, completion_tokens AS c FROM org_run)""",
)
def c3(spark, d):
    n = F.regexp_extract("name", "[0-9]+", 0).cast("int") % 6
    r = fx.org_usage(spark, d).withColumn("name", F.get(F.array(*[L(x) for x in LEGACY_NAMES]), n))
    return pricing.legacy_cost(r).select("id", F.round("legacy_cost", 9).alias("legacy_cost"))


@query("c4_model_alias_cleanup", "SELECT DISTINCT 'gpt-4-' || lower(p_brand) AS a, 'gpt-3.5-' || lower(p_brand) AS b, 'claude-3-' || lower(p_brand) AS c FROM part")
def c4(spark, d):
    p = fx.table(spark, d, "part").select("p_brand").distinct()
    name = lambda prefix: pricing.clean_model_name(F.concat(L(prefix), "p_brand"))
    return p.select(name("GPT4-").alias("a"), name("gpt35-").alias("b"), name("Claude3-").alias("c"))


@query(
    "c5_recost_as_of",
    """WITH cand AS (SELECT r.id, r.cost AS old, r.prompt_tokens, r.completion_tokens,
       arg_max(struct_pack(i := m.input_cost, o := m.output_cost), (m.org_id IS NOT NULL, length(m.name), m.start_date, -m.id)) AS m
      FROM org_run r JOIN mapping m ON m.brand = r.name AND (m.org_id IS NULL OR m.org_id = r.org_id) AND m.start_date <= r.created_at GROUP BY 1, 2, 3, 4)
     SELECT id, round(m.i * prompt_tokens / 1e6 + m.o * completion_tokens / 1e6, 8) AS cost FROM cand""",
)
def c5(spark, d):
    return pricing.recost(priced_runs(spark, d), mappings(spark, d)).select("id", F.round("cost", 8).alias("cost"))


@query(
    "c6_text_quote",
    """SELECT id, round(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t <> '')) * (SELECT arg_max(input_cost, (start_date, id)) FROM mapping WHERE brand = 'Brand#7') / 1e6, 8) AS quote FROM doc_run""",
)
def c6(spark, d):
    from ..functions.similarity import tokens as words

    q = pricing.quote(fx.doc_runs(spark, d), "Brand#7", mappings(spark, d), F.size(words(F.col("text"))))
    return q.select("id", F.round("quote", 8).alias("quote"))
