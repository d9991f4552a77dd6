"""Q and streaming: alerts, retention, and streaming twins run to completion over the given files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alerts, infer, retention

from ..operators import clean
from ..session import shared_folder
from ..sources import events as ev
from ..streaming import sinks
from ..streaming.chat import chat_job
from ..streaming.fold import fold_job, latest_rows
from . import fixtures as fx
from . import ingest
from .ingest import CHAT, FOLDED, ntz
from .registry import query

L = F.lit


def trailing_sql(minutes: int, value: str, extra: str = "") -> str:
    return f"""WITH m AS (SELECT project_id, date_trunc('minute', created_at) AS minute, count(*) AS runs, count(error) AS errors, sum(cost) AS cost, count(*) FILTER (thumb = 'up') AS up, count(*) FILTER (thumb = 'down') AS down FROM run GROUP BY 1, 2),
     b AS (SELECT project_id, unnest(generate_series(min(minute), max(minute) + INTERVAL {minutes} MINUTE, INTERVAL 1 MINUTE)) AS minute FROM m GROUP BY 1),
     t AS (SELECT b.project_id, b.minute + INTERVAL 1 MINUTE AS window_end, coalesce(sum(runs) OVER w, 0) AS runs, coalesce(sum(errors) OVER w, 0) AS errors, coalesce(sum(cost) OVER w, 0) AS cost, coalesce(sum(up) OVER w, 0) AS up
       FROM b LEFT JOIN m ON m.project_id = b.project_id AND m.minute = b.minute WINDOW w AS (PARTITION BY b.project_id ORDER BY b.minute RANGE BETWEEN INTERVAL {minutes - 1} MINUTE PRECEDING AND CURRENT ROW)){extra}
     SELECT project_id, window_end, round({value}, 4)::DOUBLE AS value FROM t"""


def shown(df):
    return ntz(df.withColumn("value", F.round("value", 4)), "window_end")


@query("qa_error_rate_window", trailing_sql(60, "CASE WHEN runs > 0 THEN errors * 100.0::DOUBLE / runs ELSE 0 END"))
def qa(spark, d):
    return shown(alerts.metric(fx.runs(spark, d), ["project_id"], "error_rate", 60))


@query("qb_cost_window", trailing_sql(30, "cost"))
def qb(spark, d):
    return shown(alerts.metric(fx.runs(spark, d), ["project_id"], "cost", 30))


@query("qc_feedback_window", trailing_sql(120, "CASE WHEN runs > 0 THEN up * 100.0::DOUBLE / runs ELSE 0 END"))
def qc(spark, d):
    return shown(alerts.metric(fx.runs(spark, d), ["project_id"], "feedback", 120))


@query(
    "qd_latency_window",
    """WITH w AS (SELECT project_id, duration_s, time_bucket(INTERVAL 30 MINUTE, created_at, TIMESTAMP '1970-01-01') + unnest([INTERVAL 30 MINUTE, INTERVAL 60 MINUTE]) AS window_end FROM run),
     q AS (SELECT project_id, window_end, quantile_cont(duration_s, [0.5, 0.75, 0.9, 0.95, 0.99]) AS q FROM w GROUP BY 1, 2),
     n AS (SELECT unnest(['p50','p75','p90','p95','p99']) AS name, unnest([1,2,3,4,5]) AS i)
     SELECT project_id, window_end, name, round(q[i] + 1e-9, 6) AS value FROM q CROSS JOIN n""",
)
def qd(spark, d):
    out = alerts.latency(fx.runs(spark, d), ["project_id"], 60, 30)
    return ntz(out.withColumn("value", F.round(F.col("value") + 1e-9, 6)), "window_end")


def alert_inputs(spark, d):
    r = fx.runs(spark, d)
    values = alerts.metric(r, ["project_id"], "error_rate", 60).withColumnRenamed("project_id", "rule_id")
    rules = r.select(F.col("project_id").alias("rule_id")).distinct().withColumn("threshold", L(40.0))
    return values, rules


HISTORY = trailing_sql(
    60, "0",
    """, v AS (SELECT project_id AS rule_id, window_end, CASE WHEN runs > 0 THEN errors * 100.0::DOUBLE / runs ELSE 0 END AS val FROM t),
     h AS (SELECT *, val > 40 AS hot, coalesce(lag(val > 40) OVER (PARTITION BY rule_id ORDER BY window_end), false) AS was FROM v),
     e AS (SELECT *, lead(window_end) OVER (PARTITION BY rule_id ORDER BY window_end) AS nxt FROM h WHERE hot <> was),
     hist AS (SELECT rule_id, window_end AS triggered_at, nxt AS resolved_at, round(val, 4) AS value, CASE WHEN nxt IS NULL THEN 'ongoing' ELSE 'resolved' END AS status FROM e WHERE hot)""",
).rsplit("SELECT project_id, window_end", 1)[0]


@query("qe_alert_transitions", HISTORY + "SELECT * FROM hist")
def qe(spark, d):
    return ntz(alerts.transitions(*alert_inputs(spark, d)).withColumn("value", F.round("value", 4)), "triggered_at", "resolved_at")


@query("qf_alert_notifications", HISTORY + "SELECT rule_id, triggered_at AS at, 'triggered' AS kind, value FROM hist UNION ALL SELECT rule_id, resolved_at, 'resolved', NULL FROM hist WHERE resolved_at IS NOT NULL")
def qf(spark, d):
    return ntz(alerts.notifications(alerts.transitions(*alert_inputs(spark, d))).withColumn("value", F.round("value", 4)), "at")


@query("qj_alert_history", HISTORY + "SELECT rule_id, triggered_at, status, 40.0::DOUBLE AS threshold FROM hist")
def qj(spark, d):
    values, rules = alert_inputs(spark, d)
    return ntz(alerts.history_report(alerts.transitions(values, rules), rules).select("rule_id", "triggered_at", "status", "threshold"), "triggered_at")


def policies(spark, d):
    days = F.when(F.col("project_id") == "p1", 30).when(F.col("project_id") == "p2", 60)
    return fx.runs(spark, d).select("project_id").distinct().select("project_id", days.alias("days")).where("days is not null")


NOW = "2024-02-20 00:00:00"


@query("qh_retention_redact", f"SELECT id, CASE WHEN old THEN NULL ELSE input END AS input, CASE WHEN old THEN NULL ELSE metadata END AS metadata, old AS is_deleted FROM (SELECT *, project_id = 'p1' AND created_at < TIMESTAMP '{NOW}' - INTERVAL 30 DAY OR project_id = 'p2' AND created_at < TIMESTAMP '{NOW}' - INTERVAL 60 DAY AS old FROM run)")
def qh(spark, d):
    return retention.redact_old(fx.runs(spark, d), policies(spark, d), NOW).select("id", "input", "metadata", "is_deleted")


@query("qh_affected_partitions", f"SELECT DISTINCT project_id, CAST(created_at AS DATE) AS date FROM run WHERE project_id = 'p1' AND created_at < TIMESTAMP '{NOW}' - INTERVAL 30 DAY OR project_id = 'p2' AND created_at < TIMESTAMP '{NOW}' - INTERVAL 60 DAY")
def qha(spark, d):
    return retention.affected_dates(fx.runs(spark, d), policies(spark, d), NOW)


def plans(spark, d):
    o = fx.runs(spark, d).select("org_id").distinct()
    return o.select("org_id", F.when(F.col("org_id") == "o0", "free").otherwise("team").alias("plan"), F.when(F.col("org_id") == "o1", 40).alias("retention_days"))


KEPT = f"(org_id = 'o0' AND created_at >= TIMESTAMP '{NOW}' - INTERVAL 30 DAY OR org_id = 'o1' AND created_at >= TIMESTAMP '{NOW}' - INTERVAL 40 DAY)"


@query("qi_retention_purge", f"SELECT id FROM run WHERE {KEPT}")
def qi(spark, d):
    return retention.purge_old(fx.runs(spark, d), plans(spark, d), NOW).select("id")


@query("e12_delete_by_join", f"SELECT id AS run_id FROM run WHERE {KEPT}")
def e12(spark, d):
    r = fx.runs(spark, d)
    results = r.select(F.col("id").alias("run_id"), L("x").alias("evaluator_id"), F.col("metadata").alias("result"))
    return retention.purge_results(results, retention.purge_old(r, plans(spark, d), NOW)).select("run_id")


# --- streaming twins: run over the files with an availableNow trigger
def _work(spark) -> str:
    return shared_folder(spark, "stream")


def stream(spark, d, name):
    """The files of a table, which is one file or a folder of them: a stream reads folders only, unless a pattern names the file."""
    return spark.readStream.schema(fx.TABLE_SCHEMAS[name]).parquet(f"{d}/{name}.parque[t]")


@query("stream_b13_run_fold", FOLDED)
def stream_fold(spark, d):
    """Events arrive in many batches, in no order; the last row written per run is the run."""
    return _streamed_fold(spark, d, F.xxhash64("value"))


@query("stream_b15_late", FOLDED)
def stream_late(spark, d):
    """Ends, then feedback, then starts: whatever a run needs comes late."""
    kind = F.get_json_object("value", "$.event")
    return _streamed_fold(spark, d, F.when(kind == "start", 2).when(kind == "feedback", 1).otherwise(0) * 2 + F.pmod(F.xxhash64("value"), L(2)))


def _streamed_fold(spark, d, deal, batches=6):
    work = _work(spark)
    lines = ingest.log_lines(fx.table(spark, d, "events")).select(F.explode(F.from_json("value", "array<string>")).alias("value"))
    lines.withColumn("batch", F.pmod(deal, L(batches))).write.partitionBy("batch").parquet(f"{work}/dealt")
    dealt = spark.read.schema("value string, batch int").parquet(f"{work}/dealt")
    files = max(1, spark.read.parquet(f"{work}/dealt").where("batch = 0").rdd.getNumPartitions())
    for i in range(batches):  # files that arrive one after the other
        dealt.where(F.col("batch") == i).select("value").repartition(files).write.mode("append").option("compression", "gzip").text(f"{work}/in")
    source = spark.readStream.option("maxFilesPerTrigger", files).text(f"{work}/in")
    fold_job(clean.clean(ev.parse_events(source), "p0"), f"{work}/out", f"{work}/log", f"{work}/ckpt").awaitTermination()
    last = latest_rows(spark.read.parquet(f"{work}/out"))
    last = last.withColumn("metadata", F.to_json(F.parse_json("metadata")))
    return ntz(last, "created_at", "ended_at").select("id", "type", "name", "status", "created_at", "ended_at", "parent_run_id", "user_id", "prompt_tokens", "completion_tokens", "metadata", "feedback")


@query("stream_b19_chat", f"WITH {CHAT} SELECT thread_id, id, exchange, side FROM ex")
def stream_chat(spark, d):
    work = _work(spark)
    c = stream(spark, d, "conversations")
    conv, turn = F.col("conv_id"), F.col("turn")
    m = c.select(
        F.concat(L("t"), conv.cast("string")).alias("thread_id"), F.concat(L("m"), conv.cast("string"), L("-"), turn.cast("string")).alias("id"),
        F.timestamp_seconds(L(1704067200) + conv * 600 + turn * 10).alias("timestamp"), "role", F.col("text").alias("content"),
        ((conv % 3 == 0) & (turn == 3) & (F.col("role") == "assistant")).alias("is_retry"), ((conv % 5 == 1) & (turn == 2)).alias("is_custom"),
    )
    chat_job(m, f"{work}/out", f"{work}/state", f"{work}/ckpt").awaitTermination()
    return spark.read.parquet(f"{work}/out").select("thread_id", "id", "exchange", "side")


@query("a14_incremental_replication", "SELECT id, project_id, CAST(created_at AS DATE) AS date FROM run")
def a14(spark, d):
    work = _work(spark)
    e = stream(spark, d, "events")
    rows = e.select(F.col("event_id").cast("string").alias("id"), F.concat(L("p"), (F.col("user_id") % 4).cast("string")).alias("project_id"), F.col("ts").cast("timestamp").alias("created_at"))
    sinks.replicate(rows, f"{work}/out", f"{work}/ckpt").awaitTermination()
    return spark.read.parquet(f"{work}/out").select("id", "project_id", "date")


@query("stream_a14_replicated_changes", """SELECT CAST(user_id AS VARCHAR) || '-' || CAST(event_id % 50 AS VARCHAR) AS id, max(event_id) AS updated_at, arg_max(event_type, event_id) AS name
 FROM events GROUP BY 1 HAVING arg_max(event_type, event_id) <> 'error'""")
def stream_changes(spark, d):
    """Events as changes of 50 rows per user: the latest event of each, and its row is gone where that is an error."""
    work = _work(spark)
    e = stream(spark, d, "events")
    key = F.concat_ws("-", F.col("user_id").cast("string"), (F.col("event_id") % 50).cast("string"))
    rows = e.select(key.alias("id"), F.col("event_id").alias("updated_at"), (F.col("event_type") == "error").alias("is_deleted"), F.col("event_type").alias("name"))
    sinks.replicate_changes(rows, f"{work}/table", f"{work}/ckpt", buckets=8).awaitTermination()
    return sinks.current(spark, f"{work}/table").select("id", "updated_at", "name")


@query("stream_n11_evaluator_backlog", """SELECT id AS run_id, '{"length": ' || length(text) || '}' AS result FROM doc_run WHERE quality IS NULL""")
def stream_backlog(spark, d):
    work = _work(spark)
    docs = stream(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), L("llm").alias("type"), "text")
    done = fx.doc_results(spark, d)
    score = lambda df: infer.batch_infer(df, "ev-sentiment", lambda b: [{"length": len(t)} for t in b["text"]], ["text"])
    sinks.evaluator_job(docs, f"{work}/out", f"{work}/ckpt", score, lambda df: infer.backlog(df, done, "ev-sentiment", "sentiment")).awaitTermination()
    return spark.read.parquet(f"{work}/out").select("run_id", "result")


@query("stream_b14_duplicates", "SELECT id FROM run")
def stream_duplicates(spark, d):
    """Every start is sent twice; the second one inside the watermark is rejected."""
    work = _work(spark)
    e = stream(spark, d, "events")
    rows = e.select(F.col("event_id").cast("string").alias("one"), F.col("ts").cast("timestamp").alias("created_at")).select(F.explode(F.array("one", "one")).alias("id"), "created_at")
    seen = rows.withWatermark("created_at", "10 minutes").dropDuplicatesWithinWatermark(["id"])
    q = seen.writeStream.format("parquet").outputMode("append").option("path", f"{work}/out").option("checkpointLocation", f"{work}/ckpt").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{work}/out").select("id")


@query(
    "qg_windowed_stream",
    """SELECT project_id, window_end, count(*) AS runs, count(error) AS errors, round(sum(cost), 4) AS cost FROM
     (SELECT project_id, error, cost, date_trunc('minute', created_at) + to_minutes(unnest(generate_series(1, 5))) AS window_end FROM run) GROUP BY 1, 2""",
)
def qg(spark, d):
    """Watermarked sliding windows over the stream; the last update of a window counts."""
    work = _work(spark)
    e = stream(spark, d, "events")
    rows = e.select(
        F.concat(L("p"), (F.col("user_id") % 4).cast("string")).alias("project_id"), F.col("ts").cast("timestamp").alias("created_at"),
        F.when(F.col("event_type") == "error", "failed").alias("error"), F.col("value").alias("cost"),
    )
    w = sinks.windowed_metric_stream(rows, ["project_id"], 5)
    q = w.writeStream.outputMode("update").option("checkpointLocation", f"{work}/ckpt").trigger(availableNow=True)
    q.foreachBatch(lambda df, i: sinks.versioned_write(df, f"{work}/out", i)).start().awaitTermination()
    out = spark.read.parquet(f"{work}/out").groupBy("project_id", "window_end").agg(F.max_by(F.struct("runs", "errors", "cost"), "batch").alias("r"))
    return ntz(out.select("project_id", "window_end", "r.runs", "r.errors", F.round("r.cost", 4).alias("cost")), "window_end")
