"""Event cleaning: ids, keys, metadata, names, tags, projects, templates, redaction, validation."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from ..functions import json as J
from ..functions.messages import REDACTED
from .filters import Tables, filter_runs

# fixed values: accepted event types
EVENT_TYPES = ("llm", "chain", "agent", "tool", "log", "embed", "retriever", "chat", "convo", "message", "thread", "custom-event")


def run_uuid(run_id: Column | str) -> Column:
    """Ids of 36 characters (or empty) stay; others become a UUID-shaped digest."""
    c = F.col(run_id) if isinstance(run_id, str) else run_id
    # one digest, cut by one pattern
    made = F.regexp_replace(F.sha2(c, 256), "^(.{8})(.{4}).(.{3}).(.{3})(.{12}).*$", "$1-$2-4$3-a$4-$5")
    return F.when(F.length(c).isin(0, 36), c).otherwise(made)


def sdk_run_uuid(run_id: Column, project_id: Column) -> Column:
    """UUID text from the first 32 hex digits of sha256(run_id ++ project_id)."""
    return F.regexp_replace(F.sha2(F.concat(run_id, project_id), 256), "^(.{8})(.{4})(.{4})(.{4})(.{12}).*$", "$1-$2-$3-$4-$5")


def _snake(key: str) -> str:
    out = []
    for i, ch in enumerate(key):
        if ch == "-":
            out.append("_")
        elif ch.isupper() and i and (key[i - 1].islower() or key[i - 1].isdigit()):
            out.append("_" + ch.lower())
        else:
            out.append(ch.lower())
    return "".join(out)


def _snake_keys(node):
    if isinstance(node, list):
        return [_snake_keys(x) for x in node]
    if isinstance(node, dict):
        return {_snake(k): _snake_keys(v) for k, v in node.items()}
    return node


@pandas_udf(StringType())
def normalize_keys(texts: pd.Series) -> pd.Series:
    """Nested keys of a JSON text → snake_case; top-level event keys are handled by the reader."""

    def one(t):
        if t is None:
            return None
        try:
            return json.dumps(_snake_keys(json.loads(t)), separators=(",", ":"), ensure_ascii=False)
        except ValueError:
            return t

    return texts.map(one, na_action="ignore")


def clean_metadata(col: Column | str) -> Column:
    """First-level scalars, arrays of scalars and the key ``enrichment``."""
    m = J.as_variant_map(col)
    flat = "STRING|BOOLEAN|BIGINT|DECIMAL.*|DOUBLE|FLOAT|INT|SMALLINT|TINYINT"
    known = f"^({flat}|ARRAY<({flat}|VOID)>)$"
    mixed = lambda v: F.forall(F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>")), lambda x: F.schema_of_variant(x).rlike(f"^({flat})$"))
    shape = lambda v: F.schema_of_variant(v)
    keep = lambda k, v: (k == "enrichment") | shape(v).rlike(known) | (shape(v).startswith("ARRAY<VARIANT") & mixed(v))
    return F.to_json(F.map_filter(m, keep))


def clean_model_prefix(name: Column | str) -> Column:
    """Only the first ``models/`` goes."""
    return F.regexp_replace(F.col(name) if isinstance(name, str) else name, "^((?:(?!models/).)*)models/", "$1")


def tag_array(tags: Column | str, metadata: Column | str | None = None) -> Column:
    """A JSON array of tags, or a single tag text; metadata.tags when there is none."""
    t = F.col(tags) if isinstance(tags, str) else tags
    parse = lambda c: F.when(c.startswith("["), F.from_json(c, "array<string>")).when(c.isNotNull(), F.array(c))
    out = parse(t)
    return out if metadata is None else F.coalesce(out, parse(J.get_text(metadata, "tags")))


def template_id(template_version: Column, template: Column, metadata: Column) -> Column:
    return F.coalesce(template_version, template, J.get_text(metadata, "template_id"), J.get_text(metadata, "template_version_id")).cast("int")


def clean(events: DataFrame, project: str | Column | None = None) -> DataFrame:
    """All per-event cleaning steps over parsed events."""
    p = F.lit(project) if isinstance(project, str) else project
    d = events.withColumn("ts", F.try_to_timestamp("timestamp"))
    if p is not None:
        d = d.withColumn("project_id", p)
    return (
        d.withColumn("run_id", run_uuid("run_id"))
        .withColumn("parent_run_id", run_uuid("parent_run_id"))
        .withColumn("name", clean_model_prefix("name"))
        .withColumn("tags", tag_array("tags", "metadata"))
        .withColumn("template_version_id", template_id(F.col("template_version_id"), F.col("template_id"), F.col("metadata")))
        .withColumn("metadata", clean_metadata("metadata"))
    )


def remap_project(events: DataFrame, api_keys: DataFrame) -> DataFrame:
    """project_id of an event: owner of app_id as an API key, app_id as a project, else the batch project.

    The key table lists two keys per project; both uses are one join on a union of keys.
    """
    owners = (
        api_keys.select(F.col("api_key").alias("app_id"), F.col("project_id").alias("_owner"), F.lit(0).alias("_o"))
        .unionByName(api_keys.select(F.col("project_id").alias("app_id"), F.col("project_id").alias("_owner"), F.lit(1).alias("_o")))
        .groupBy("app_id").agg(F.min_by("_owner", "_o").alias("_owner"))
    )
    return events.join(owners, "app_id", "left").withColumn("project_id", F.coalesce("_owner", "project_id")).drop("_owner")


def _ingest_leaf(node: dict) -> Column | None:
    """Ingestion forms of a leaf on the event; None for leaves that have none."""
    p = node.get("params", {})
    return {
        "models": lambda: F.col("name").isin(list(p["models"])),
        "tools": lambda: (F.col("type") == "tool") & (F.col("name") == p.get("toolName")),
        "retrievers": lambda: (F.col("type") == "retriever") & (F.col("name") == p.get("retrieverName")),
        "tags": lambda: F.arrays_overlap("tags", F.array(*[F.lit(str(t)) for t in p["tags"]])),
        "metadata": lambda: J.contains_value("metadata", p.get("key"), p.get("value")),
    }.get(node["id"], lambda: None)()


def redact(events: DataFrame, rules: dict[str, list], users: DataFrame | None = None) -> DataFrame:
    """Input and output of matching runs become the redaction mark; an end follows its start.

    Under a rule's top level any matching leaf redacts. ``rules`` maps a project to its tree. All leaves on the
    event itself, and all leaves on users, are one condition and one join whatever the number of projects;
    only a nested tree is a scan of its own.
    """
    starts = events.where("event = 'start'")
    on_event, named, trees = F.lit(False), [], []
    for project, logic in rules.items():
        mine = F.col("project_id") == project
        own = F.lit(False)
        for node in logic[1:]:
            if isinstance(node, dict) and node["id"] == "users":
                named += [(project, int(u)) for u in node["params"]["users"]]
                continue
            leaf = _ingest_leaf(node) if isinstance(node, dict) else None
            if leaf is None:
                trees.append(filter_runs(starts.where(mine), ["AND", node], Tables(users=users)).select("run_id"))
            else:
                own = own | F.coalesce(leaf, F.lit(False))
        on_event = on_event | (mine & own)
    if not any(logic[1:] for logic in rules.values()):
        return events
    hits = starts.where(on_event).select("run_id")
    if named:
        asked = events.sparkSession.createDataFrame(named, "_project string, id long")
        known = users.join(asked, "id").select("_project", F.col("external_id").alias("_user")).distinct()
        hits = hits.unionAll(starts.join(known, (F.col("project_id") == F.col("_project")) & (F.col("user_id") == F.col("_user")), "left_semi").select("run_id"))
    for found in trees:
        hits = hits.unionAll(found)
    flagged = hits.distinct().withColumn("_hit", F.lit(True))
    out = events.join(flagged, "run_id", "left")
    mask = lambda c: F.when(F.col("_hit") & F.col(c).isNotNull(), F.lit(f'"{REDACTED}"')).otherwise(F.col(c)).alias(c)
    for c in ("input", "output"):
        out = out.withColumn(c, mask(c))
    return out.drop("_hit")


def report(events: DataFrame) -> DataFrame:
    """(run_id, event, ts, success, error) per event; a bad event never stops the others."""
    firsts = events.where("event = 'start'").groupBy("run_id").agg(F.min(F.struct("ts", "event_no")).alias("_first"))
    d = events.join(firsts, "run_id", "left")
    ends_alone = (F.col("type") == "llm") & F.col("event").isin("end", "error") & F.col("_first").isNull()
    error = (
        F.when(F.col("ts").isNull(), "invalid timestamp")
        .when(F.coalesce(F.col("run_id"), F.lit("")) == "", "missing run id")
        .when(~F.col("type").isin(*EVENT_TYPES), "unknown type")
        .when(F.col("type").isin("chat", "custom-event") & F.col("parent_run_id").isNull(), "missing parent run id")
        .when((F.col("event") == "start") & (F.struct("ts", "event_no") > F.col("_first")), "run already started")
        .when(ends_alone, "no start for this run")
    )
    return d.select("run_id", "event", "ts", "event_no", error.isNull().alias("success"), error.alias("error"))


def dead_letters(events: DataFrame, verdicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, bad) events by their report."""
    bad = verdicts.where("not success").select("event_no", "error")
    return events.join(bad, "event_no", "left_anti"), events.join(bad, "event_no")


