"""F: time-bucketed series over the event runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import buckets, series
from .fixtures import END, START, runs, users
from .registry import query

NY = "America/New_York"
DAILY = series.Range(START, END, NY, "daily")
WEEKLY = series.Range(START, END, NY, "weekly")
HOURLY = series.Range(START, END, "UTC", "hourly")
MONTHLY = series.Range(START, END, "UTC", "monthly")


def bucket_sql(r: series.Range, ts: str = "created_at") -> str:
    return f"date_trunc('{r_unit(r)}', ({ts} AT TIME ZONE 'UTC') AT TIME ZONE '{r.tz}')"


def r_unit(r: series.Range) -> str:
    return {"hourly": "hour", "daily": "day", "weekly": "week", "monthly": "month"}[r.granularity]


def spine_sql(r: series.Range) -> str:
    unit = r_unit(r)
    step = {"week": "7 days"}.get(unit, f"1 {unit}")
    local = lambda t: f"date_trunc('{unit}', ({t} AT TIME ZONE 'UTC') AT TIME ZONE '{r.tz}')"
    lo, hi = local(f"TIMESTAMP '{r.start}'"), local(f"(TIMESTAMP '{r.end}' - INTERVAL 1 MICROSECOND)")
    return f"SELECT unnest(generate_series({lo}, {hi}, INTERVAL '{step}')) AS date"


def named_sql(r: series.Range, name: str, value: str, source: str = "run", zero: str = "0") -> str:
    """Oracle of a named series: spine left join of per-bucket aggregates."""
    return f"""WITH spine AS ({spine_sql(r)}),
     agg AS (SELECT {bucket_sql(r)} AS date, {name} AS name, {value} AS value FROM {source}
             WHERE created_at >= TIMESTAMP '{r.start}' AND created_at < TIMESTAMP '{r.end}' GROUP BY 1, 2)
     SELECT s.date, coalesce(a.value, {zero}) AS value, a.name FROM spine s LEFT JOIN agg a ON a.date = s.date"""


def single_sql(r: series.Range, label: str, value: str, source: str = "run", zero: str = "0", tail: str = "") -> str:
    return f"""WITH spine AS ({spine_sql(r)}),
     agg AS (SELECT {bucket_sql(r)} AS date, {value} AS value FROM {source}
             WHERE created_at >= TIMESTAMP '{r.start}' AND created_at < TIMESTAMP '{r.end}' GROUP BY 1)
     SELECT s.date, coalesce(a.value, {zero}) AS value, '{label}' AS name FROM spine s LEFT JOIN agg a ON a.date = s.date {tail}"""


def r6(df, *cols):
    """Round doubles for comparison with the oracle."""
    for c in cols or ("value",):
        df = df.withColumn(c, F.round(c, 6))
    return df


NEW_RUN = """(SELECT r.*, u.k AS uk, u.plan FROM run r JOIN ext_user u ON u.id = r.external_user_id
  WHERE u.created_at <= r.created_at AND u.created_at >= r.created_at - INTERVAL 7 DAY)"""
USER_RUN = "(SELECT r.*, u.k AS uk, u.plan FROM run r LEFT JOIN ext_user u ON u.id = r.external_user_id)"


@query(
    "f0_bucket_spine",
    f"""SELECT d AS date, (d AT TIME ZONE '{NY}') AT TIME ZONE 'UTC' AS start_utc,
     ((d + INTERVAL 1 DAY) AT TIME ZONE '{NY}') AT TIME ZONE 'UTC' AS end_utc
     FROM (SELECT unnest(generate_series(min(b), max(b), INTERVAL 1 DAY)) AS d
           FROM (SELECT {bucket_sql(DAILY)} AS b FROM run))""",
)
def f0(spark, d):
    s = buckets.spine_of(runs(spark, d), NY, "daily")
    return s.withColumn("start_utc", F.col("start_utc").cast("timestamp_ntz")).withColumn(
        "end_utc", F.col("end_utc").cast("timestamp_ntz")
    )


@query("f1_local_bucket", f"SELECT id, {bucket_sql(WEEKLY)} AS date FROM run")
def f1(spark, d):
    return buckets.with_bucket(runs(spark, d), NY, "weekly").select("id", "date")


@query("f2_tokens_by_model", named_sql(DAILY, "name", "CAST(sum(prompt_tokens + completion_tokens) AS BIGINT)"))
def f2(spark, d):
    return series.tokens_by_model(runs(spark, d), DAILY)


@query("f3_cost_by_model", named_sql(DAILY, "name", "round(sum(cost), 6)"))
def f3(spark, d):
    return r6(series.cost_by_model(runs(spark, d), DAILY))


@query("f3_cost_by_model_weekly", named_sql(WEEKLY, "name", "round(sum(cost), 6)"))
def f3w(spark, d):
    return r6(series.cost_by_model(runs(spark, d), WEEKLY))


@query("f4_errors", single_sql(DAILY, "error", "count(error)"))
def f4(spark, d):
    return series.errors(runs(spark, d), DAILY)


@query("f4_errors_weekly", single_sql(WEEKLY, "error", "count(error)", tail="WHERE coalesce(a.value, 0) > 0"))
def f4w(spark, d):
    return series.errors(runs(spark, d), WEEKLY)


@query("f5_new_users", single_sql(DAILY, "Count", "count(DISTINCT external_user_id)", NEW_RUN))
def f5(spark, d):
    return series.new_users(runs(spark, d), users(spark, d), DAILY)


@query("f5_new_users_stat", f"SELECT count(DISTINCT external_user_id) AS stat FROM {NEW_RUN} WHERE created_at >= TIMESTAMP '{START}' AND created_at < TIMESTAMP '{END}'")
def f5s(spark, d):
    return series.new_users_stat(runs(spark, d), users(spark, d), DAILY)


@query("f6_new_users_by_property", named_sql(DAILY, "coalesce(plan, 'Unknown')", "count(DISTINCT external_user_id)", NEW_RUN))
def f6(spark, d):
    return series.new_users_by_property(runs(spark, d), users(spark, d), DAILY, "plan")


TWO = "SELECT CAST({k} AS VARCHAR) AS second, coalesce(plan, 'Unknown') AS first, count(DISTINCT external_user_id) AS value FROM {src} WHERE created_at >= TIMESTAMP '{a}' AND created_at < TIMESTAMP '{b}' AND {k} IS NOT NULL GROUP BY 1, 2"


@query("f7_new_users_by_two_properties", TWO.format(k="uk", src=NEW_RUN, a=START, b=END))
def f7(spark, d):
    return series.new_users_by_two(runs(spark, d), users(spark, d), DAILY, "plan", "k")


@query(
    "f7_new_users_pivot",
    f"""SELECT CAST(uk AS VARCHAR) AS second, count(DISTINCT external_user_id) FILTER (plan='free') AS free,
     count(DISTINCT external_user_id) FILTER (plan='pro') AS pro, count(DISTINCT external_user_id) FILTER (plan='team') AS team
     FROM {NEW_RUN} WHERE created_at >= TIMESTAMP '{START}' AND created_at < TIMESTAMP '{END}' GROUP BY 1""",
)
def f7p(spark, d):
    return series.pivot_pairs(series.new_users_by_two(runs(spark, d), users(spark, d), DAILY, "plan", "k"), ["free", "pro", "team"])


@query("f8_active_users", single_sql(WEEKLY, "Count", "count(DISTINCT external_user_id)"))
def f8(spark, d):
    return series.active_users(runs(spark, d), WEEKLY)


@query("f8_active_users_monthly", single_sql(MONTHLY, "Count", "count(DISTINCT external_user_id)"))
def f8m(spark, d):
    return series.active_users(runs(spark, d), MONTHLY)


@query("f8_active_users_stat", f"SELECT count(DISTINCT external_user_id) AS stat FROM run WHERE created_at >= TIMESTAMP '{START}' AND created_at < TIMESTAMP '{END}'")
def f8s(spark, d):
    return series.active_users_stat(runs(spark, d), DAILY)


@query("f9_active_users_by_property", named_sql(DAILY, "coalesce(plan, 'Unknown')", "count(DISTINCT external_user_id)", USER_RUN))
def f9(spark, d):
    return series.active_users_by_property(runs(spark, d), users(spark, d), DAILY, "plan")


@query("f9_active_users_by_two_properties", TWO.format(k="uk", src=USER_RUN, a=START, b=END))
def f9b(spark, d):
    return series.active_users_by_two(runs(spark, d), users(spark, d), DAILY, "plan", "k")


@query(
    "f10_average_user_cost",
    f"""SELECT date, round(avg(total) + 1e-9, 6) AS value, 'Cost' AS name FROM
     (SELECT {bucket_sql(DAILY)} AS date, external_user_id, coalesce(sum(cost), 0) AS total FROM run
      WHERE created_at >= TIMESTAMP '{START}' AND created_at < TIMESTAMP '{END}' GROUP BY 1, 2) GROUP BY 1 HAVING avg(total) <> 0""",
)
def f10(spark, d):
    # the nudge keeps exact ties at the sixth digit from rounding apart
    return r6(series.average_user_cost(runs(spark, d), DAILY).withColumn("value", F.col("value") + 1e-9))


@query("f10_average_user_cost_stat", "SELECT round(avg(t), 6) AS stat FROM (SELECT sum(cost) AS t FROM run WHERE cost IS NOT NULL GROUP BY external_user_id)")
def f10s(spark, d):
    return r6(series.average_user_cost_stat(runs(spark, d), DAILY), "stat")


@query("f11_runs_by_type", named_sql(HOURLY, "type", "count(*)"))
def f11(spark, d):
    return series.runs_by_type(runs(spark, d), HOURLY)


TAGGED = "(SELECT created_at, unnest(list_distinct(tags)) AS tag FROM run)"


@query("f12_runs_by_tag", named_sql(DAILY, "tag", "count(tag)", TAGGED))
def f12(spark, d):
    return series.runs_by_tag(runs(spark, d), DAILY)


@query("f13_run_volume", single_sql(DAILY, "Events", "count(*)"))
def f13(spark, d):
    return series.run_volume(runs(spark, d), DAILY)


@query(
    "f14_latency_percentiles",
    f"""WITH spine AS ({spine_sql(DAILY)}),
     agg AS (SELECT {bucket_sql(DAILY)} AS date, quantile_cont(duration_s, [0.5, 0.75, 0.9, 0.95, 0.99]) AS q FROM run
       WHERE created_at >= TIMESTAMP '{START}' AND created_at < TIMESTAMP '{END}' GROUP BY 1),
     names AS (SELECT unnest(['p50','p75','p90','p95','p99']) AS name, unnest([1,2,3,4,5]) AS i)
     SELECT s.date, coalesce(round(a.q[n.i], 6), 0) AS value, n.name FROM spine s CROSS JOIN names n LEFT JOIN agg a ON a.date = s.date""",
)
def f14(spark, d):
    return r6(series.latency_percentiles(runs(spark, d), DAILY))


@query("f14_latency_stat", "SELECT round(avg(duration_s), 6) AS stat FROM run WHERE type = 'llm'")
def f14s(spark, d):
    return r6(series.latency_stat(runs(spark, d), DAILY), "stat")


@query("f15_active_threads", single_sql(DAILY, "Threads", "count(*)", "(SELECT * FROM run WHERE type = 'thread')"))
def f15(spark, d):
    return series.active_threads(runs(spark, d), DAILY)


@query("f16_thumbs_up", single_sql(DAILY, "Thumbs Up", "CAST(sum(CASE WHEN thumb='up' THEN 1 ELSE 0 END) AS BIGINT)"))
def f16u(spark, d):
    return series.thumbs(runs(spark, d), DAILY, "up")


@query("f16_thumbs_down", single_sql(WEEKLY, "Thumbs Down", "CAST(sum(CASE WHEN thumb='down' THEN 1 ELSE 0 END) AS BIGINT)"))
def f16d(spark, d):
    return series.thumbs(runs(spark, d), WEEKLY, "down")


@query("f17_feedback_ratio", single_sql(DAILY, "Ratio", "round((count(*) FILTER (thumb='up') - count(*) FILTER (thumb='down')) / nullif(count(thumb), 0)::DOUBLE, 6)"))
def f17(spark, d):
    return r6(series.feedback_ratio(runs(spark, d), DAILY))


@query("f18_custom_events", named_sql(DAILY, "name", "count(*)"))
def f18(spark, d):
    return series.custom_events(runs(spark, d).withColumn("type", F.lit("custom-event")), DAILY)


@query("f19_daily_usage", "SELECT org_id, project_id, date_trunc('day', created_at) AS date, count(*) AS value FROM run WHERE created_at >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 30 DAY AND created_at < TIMESTAMP '2024-01-31 00:00:00' GROUP BY 1, 2, 3")
def f19(spark, d):
    return series.daily_usage(runs(spark, d), ["org_id", "project_id"], "2024-01-31 00:00:00")


USAGE = """CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens,
 round(sum(cost), 6) AS cost, count(*) FILTER (status='error') AS errors, count(*) FILTER (status='success') AS success"""


@query("f20_usage_summary", f"SELECT name, type, {USAGE} FROM run WHERE created_at >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 60 DAY GROUP BY 1, 2")
def f20(spark, d):
    return r6(series.usage_summary(runs(spark, d), "2024-01-31 00:00:00", 60), "cost")


@query("f20_usage_summary_daily", f"SELECT date_trunc('day', created_at) AS date, name, type, {USAGE} FROM run WHERE created_at >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 60 DAY AND duration_s * 1000 >= 1000 GROUP BY 1, 2, 3")
def f20d(spark, d):
    return r6(series.usage_summary(runs(spark, d), "2024-01-31 00:00:00", 60, daily=True), "cost")


@query("f21_usage_per_user", f"SELECT external_user_id, name, type, {USAGE} FROM run WHERE NOT (type = 'agent' AND parent_run_id IS NOT NULL) GROUP BY 1, 2, 3")
def f21(spark, d):
    return r6(series.usage_per_user(runs(spark, d)), "cost")


@query(
    "f22_zero_filled",
    f"""WITH s AS (SELECT {bucket_sql(HOURLY)} AS date, name, sum(cost) AS value FROM run GROUP BY 1, 2)
     SELECT d.date, n.name, round(coalesce(s.value, 0), 6) AS value FROM ({spine_sql(HOURLY)}) d
     CROSS JOIN (SELECT DISTINCT name FROM run) n LEFT JOIN s ON s.date = d.date AND s.name = n.name""",
)
def f22(spark, d):
    return r6(series.zero_filled(series.cost_by_model(runs(spark, d), HOURLY), HOURLY))


@query(
    "f22_wide_series",
    f"""WITH spine AS ({spine_sql(DAILY)})
     SELECT s.date, {', '.join(f"count(r.id) FILTER (r.type='{t}') AS {t}" for t in ('llm', 'chat', 'agent', 'thread'))}
     FROM spine s LEFT JOIN run r ON {bucket_sql(DAILY, 'r.created_at')} = s.date
     AND r.created_at >= TIMESTAMP '{START}' AND r.created_at < TIMESTAMP '{END}' GROUP BY 1""",
)
def f22w(spark, d):
    return series.wide(series.runs_by_type(runs(spark, d), DAILY), ["llm", "chat", "agent", "thread"])


@query("f23_headline", f"SELECT avg(CAST(n AS DOUBLE)) AS headline FROM (SELECT {bucket_sql(DAILY)} AS b, count(*) AS n FROM run WHERE created_at >= TIMESTAMP '{START}' AND created_at < TIMESTAMP '{END}' GROUP BY 1)")
def f23(spark, d):
    return series.headline(series.run_volume(runs(spark, d), DAILY), "avg")


@query("f24_top_types", "SELECT type AS name, count(*) AS value FROM run GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def f24(spark, d):
    return series.series_totals(series.runs_by_type(runs(spark, d), DAILY), 5)


@query("f24_top_tags", f"SELECT tag AS name, count(*) AS value FROM {TAGGED} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def f24t(spark, d):
    return series.series_totals(series.runs_by_tag(runs(spark, d), DAILY), 5)
