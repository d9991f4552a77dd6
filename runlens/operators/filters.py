"""Filter algebra: ``["AND"|"OR", {"id", "params"}, nested…]`` → filtered runs.

A leaf is a boolean Column, or membership in a set of keys taken from another table.
Membership directly under a top-level AND becomes a semi or anti join; elsewhere it is a
flag joined from distinct keys, so that OR keeps its meaning. Every leaf is its own
Column object, so precedence can never leak between leaves.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import json as J
from ..functions import messages as M
from ..functions import similarity as S
from ..functions.userprops import normalize_value

TRUE = lambda: F.lit(True)

COMPARE: dict[str, Callable[[Column, object], Column]] = {
    "gt": lambda a, b: a > b,
    "gte": lambda a, b: a >= b,
    "lt": lambda a, b: a < b,
    "lte": lambda a, b: a <= b,
    "eq": lambda a, b: a == b,
    "neq": lambda a, b: a != b,
    "iequals": lambda a, b: a.ilike(b),
    "icontains": lambda a, b: a.ilike(b),
    "istartswith": lambda a, b: a.ilike(b),
    "iendswith": lambda a, b: a.ilike(b),
    "contains": lambda a, b: a.like(b),
    "startswith": lambda a, b: a.like(b),
    "endswith": lambda a, b: a.like(b),
}


@dataclass
class Tables:
    """Side tables a leaf may read; only those a tree mentions are joined."""

    runs: DataFrame | None = None
    users: DataFrame | None = None
    template_versions: DataFrame | None = None
    results: DataFrame | None = None  # run_id, type, result
    toxicity: DataFrame | None = None  # run_id, toxic_input, toxic_output
    intent_aliases: DataFrame | None = None  # alias, label (latest version)
    thread_stats: DataFrame | None = None  # thread_id, messages_count


@dataclass
class Member:
    """``df[on]`` is (or is not) among the distinct keys of ``ids``."""

    ids: DataFrame
    on: str = "id"
    negate: bool = False


@dataclass
class Either:
    """A Column over the run combined with members by OR (or AND)."""

    column: Column
    members: list[Member] = field(default_factory=list)
    conjunctive: bool = False


Leaf = Column | Member | Either
CHECKS: dict[str, Callable[..., Leaf]] = {}


def register_check(name: str):
    """Add a leaf: a function of (tables, **params)."""

    def put(fn):
        CHECKS[name] = fn
        return fn

    return put


def _member(ids: DataFrame, key: str, on: str = "id", negate: bool = False) -> Member:
    return Member(ids.where(F.col(key).isNotNull()).select(F.col(key).alias("_key")).distinct(), on, negate)


@register_check("type")
def type_leaf(t: Tables, type: str, **_) -> Leaf:
    if type != "trace":
        return F.col("type") == type
    rooted = F.col("parent_run_id").isNull()
    under_chat = _member(t.runs.where("type = 'chat'"), "id", on="parent_run_id")
    tops = F.col("type").isin("agent", "chain")
    return Either(tops, [_any_of(rooted, under_chat)], conjunctive=True)


def _any_of(column: Column, *members: Member) -> "Either":
    return Either(column, list(members))


@register_check("models")
def models_leaf(t, models, **_):
    return F.col("name").isin(list(models))


@register_check("tools")
def tools_leaf(t, toolName=None, **_):
    return F.col("name").ilike(f"%{toolName}%") if toolName else TRUE()


@register_check("retrievers")
def retrievers_leaf(t, retrieverName=None, **_):
    return F.col("name").ilike(f"%{retrieverName}%") if retrieverName else TRUE()


@register_check("tags")
def tags_leaf(t, tags, **_):
    return F.arrays_overlap("tags", F.array(*[F.lit(x) for x in tags]))


@register_check("templates")
def templates_leaf(t: Tables, templates, **_):
    versions = t.template_versions.where(F.col("template_id").isin([int(x) for x in templates]))
    return _member(versions, "id", on="template_version_id")


@register_check("metadata")
def metadata_leaf(t, key=None, value=None, **_):
    if not key or value in (None, ""):
        return TRUE()
    cond = J.contains_value("metadata", key, value)
    alternatives: list[object] = []
    if value in ("true", "false"):
        alternatives.append(value == "true")
    if value == "null":
        cond = cond | J.contains_value("metadata", key, None)
    number = _leading_int(value)
    if number is not None:
        alternatives.append(number)
    for v in alternatives:
        cond = cond | J.contains_value("metadata", key, v)
    return cond


def _leading_int(value) -> int | None:
    digits = ""
    for i, ch in enumerate(str(value).strip()):
        if ch.isdigit() or (i == 0 and ch in "+-"):
            digits += ch
        else:
            break
    return int(digits) if digits.strip("+-") else None


@register_check("status")
def status_leaf(t, status, **_):
    return F.col("status") == status


def _results(t: Tables, kind: str) -> DataFrame:
    return t.results.where(F.col("type") == kind)


def _side(field: str) -> list[str]:
    return ["input", "output"] if field == "any" else [field]


def _any_side(fields: list[str], test: Callable[[str], Column]) -> Column:
    cond = F.lit(False)
    for f in fields:
        cond = cond | F.coalesce(test(f), F.lit(False))
    return cond


@register_check("languages")
def languages_leaf(t: Tables, field="any", codes=None, **_):
    if not codes:
        return TRUE()
    has = lambda f: F.exists(J.path_array("result", f, "struct<isoCode:string>"), lambda e: e["isoCode"].isin(list(codes)))
    return _member(_results(t, "language").where(_any_side(_side(field), has)), "run_id")


@register_check("pii")
def pii_leaf(t: Tables, containsPii=None, **_):
    if not containsPii:
        return TRUE()
    has = lambda f: F.exists(J.path_array("result", f, "array<string>"), lambda e: F.get(e, F.lit(0)).isNotNull())
    return _member(_results(t, "pii").where(_any_side(["input", "output"], has)), "run_id", negate=containsPii == "false")


@register_check("sentiment")
def sentiment_leaf(t: Tables, sentiment=None, **_):
    if not sentiment:
        return TRUE()

    def last_label(f: str) -> Column:
        found = J.path_array("result", f, "struct<index:int,label:string>")
        return F.element_at(F.array_sort(F.filter(found, lambda e: e.isNotNull())), -1)["label"] == sentiment

    guard = lambda f: F.when(F.size(J.path_array("result", f, "string")) > 0, last_label(f))
    return _member(_results(t, "sentiment").where(_any_side(["input", "output"], guard)), "run_id")


@register_check("toxicity")
def toxicity_leaf(t: Tables, field="input", type="toxic", **_):
    toxic = type in ("toxic", "contains", "true")
    return _member(t.toxicity.where(_any_side(_side(field), lambda f: F.col(f"toxic_{f}"))), "run_id", negate=not toxic)


@register_check("topics")
def topics_leaf(t: Tables, field="any", topics=None, **_):
    if not topics:
        return TRUE()
    has = lambda f: F.exists(
        J.path_array("result", f, "array<struct<topic:string>>"), lambda e: F.get(e, F.lit(0))["topic"].isin(list(topics))
    )
    return _member(_results(t, "topics").where(_any_side(_side(field), has)), "run_id")


INTENT_DDL = "struct<intents:array<struct<label:string,confidence:double>>>"


@register_check("intents")
def intents_leaf(t: Tables, intents=None, **_):
    if not intents:
        return TRUE()
    labels = (
        _results(t, "intent")
        .select("run_id", F.explode(J.path_array("result", "input", INTENT_DDL)).alias("p"))
        .select("run_id", F.explode("p.intents").alias("i"))
        .select("run_id", F.trim("i.label").alias("alias"))
    )
    wanted = list(intents)
    matched = labels.join(t.intent_aliases.select("alias", "label"), "alias", "left").where(
        F.col("alias").isin(wanted) | F.col("label").isin(wanted)
    )
    return _member(matched, "run_id")


@register_check("users")
def users_leaf(t, users, **_):
    return F.col("external_user_id").isin([int(u) for u in users])


@register_check("user-props")
def user_props_leaf(t: Tables, key=None, value=None, **_):
    if not key or value in (None, ""):
        return TRUE()
    return _member(t.users.where(J.contains_value("props", key, normalize_value(value))), "id", on="external_user_id")


def _feedback_one(t: Tables, wanted: dict) -> Leaf:
    key, value = next(iter(wanted.items()))
    child = lambda cond: _member(t.runs.where(cond), "parent_run_id")
    if key == "comment":
        has = J.has_key("feedback", "comment")
        from_parent = _member(t.runs.where(has), "id", on="parent_run_id")
        return Either(has, [child(has), from_parent])
    thumb = J.get_text("feedback", "thumb")
    if value is None:
        none_below = child(thumb.isin("up", "down"))
        none_below.negate = True
        return Either(thumb.isNull(), [none_below], conjunctive=True)
    return Either(F.coalesce(thumb == value, F.lit(False)), [child(thumb == value)])


@register_check("feedback")
def feedback_leaf(t: Tables, types, **_):
    parts = [_feedback_one(t, json.loads(x) if isinstance(x, str) else x) for x in types]
    return parts[0] if len(parts) == 1 else Either(F.lit(False), parts)


@register_check("custom-events")
def custom_events_leaf(t, customEvents=None, **_):
    cond = F.col("type") == "custom-event"
    return cond & F.col("name").isin(list(customEvents)) if customEvents else cond


@register_check("length")
def length_leaf(t, field, operator, length, **_):
    return COMPARE[operator](F.length(field), F.lit(int(length)))


@register_check("date")
def date_leaf(t, operator, date=None, **_):
    try:
        datetime.fromisoformat(str(date).replace("Z", "+00:00"))
    except ValueError:
        return TRUE()
    return COMPARE[operator](F.col("created_at"), F.lit(str(date)).cast("timestamp"))


@register_check("duration")
def duration_leaf(t, operator, duration, **_):
    return COMPARE[operator](F.col("duration_s"), F.lit(float(duration)))


@register_check("cost")
def cost_leaf(t, operator, cost, **_):
    return COMPARE[operator](F.col("cost"), F.lit(float(cost)))


@register_check("tokens")
def tokens_leaf(t, field, operator, tokens=None, **_):
    if not tokens:
        return TRUE()
    col = F.col("prompt_tokens") + F.col("completion_tokens") if field == "total" else F.col(f"{field}_tokens")
    return COMPARE[operator](col, F.lit(int(tokens)))


@register_check("messages")
def messages_leaf(t: Tables, operator, messages, **_):
    try:
        n = float(messages)
    except (TypeError, ValueError):
        return TRUE()
    hit = t.thread_stats.where(COMPARE[operator](F.col("messages_count"), F.lit(n)))
    if COMPARE_ZERO[operator](0, n):  # threads without messages count as 0
        miss = t.thread_stats.where(~COMPARE[operator](F.col("messages_count"), F.lit(n)))
        return _member(miss, "thread_id", negate=True)
    return _member(hit, "thread_id")


COMPARE_ZERO = {
    "gt": lambda a, b: a > b, "gte": lambda a, b: a >= b, "lt": lambda a, b: a < b,
    "lte": lambda a, b: a <= b, "eq": lambda a, b: a == b, "neq": lambda a, b: a != b,
}


@register_check("search")
def search_leaf(t, query, **_):
    return F.col("input").ilike(f"%{query}%") | F.col("output").ilike(f"%{query}%")


@register_check("string")
def string_leaf(t, fields="any", type="contains", text="", sensitive="false", **_):
    exact = str(sensitive).lower() == "true"
    needle = F.lit(text if exact else text.lower())
    pool = [M.texts(f) for f in _side(fields)]
    fold = lambda x: x if exact else F.lower(x)
    test = {
        "contains": lambda x: fold(x).contains(needle),
        "notcontains": lambda x: fold(x).contains(needle),
        "starts": lambda x: fold(x).startswith(needle),
        "ends": lambda x: fold(x).endswith(needle),
    }[type]
    hit = F.lit(False)
    for p in pool:
        hit = hit | F.exists(p, test)
    return ~hit if type == "notcontains" else hit


@register_check("regex")
def regex_leaf(t, regex, type="contains", field="output", **_):
    has = F.coalesce(M.last_text(field).rlike(regex), F.lit(False))
    return has if type == "contains" else ~has


def regex_match(regex: str, field: str = "output") -> Column:
    """The first match, or empty text."""
    return F.coalesce(F.regexp_extract(M.last_text(field), regex, 0), F.lit(""))


@register_check("json")
def json_leaf(t, field="output", type="valid", **_):
    text = M.last_text("input" if field == "any" else field)
    if type == "contains":
        found = F.regexp_extract_all(text, F.lit(r"\{.*?\}"), F.lit(0))
        return F.coalesce(F.exists(found, lambda m: F.try_parse_json(m).isNotNull()), F.lit(False))
    ok = F.try_parse_json(text).isNotNull()
    return ok if type == "valid" else ~ok


@register_check("rouge")
def rouge_leaf(t, percent, rouge="n", **_):
    return S.rouge(M.last_text("output"), F.col("ideal_output"), rouge) * 100 >= int(percent)


@register_check("similarity")
def similarity_leaf(t, algorithm, percent, **_):
    if algorithm == "cosine":
        score = S.embedding_cosine(F.col("output_embedding"), F.col("ideal_embedding")) * 100
    else:
        score = S.jaccard_percent(M.last_text("output"), F.col("ideal_output"))
    return score >= float(percent)


def _judged(name: str):
    @register_check(name)
    def leaf(t: Tables, expected="true", choices=None, **_):
        """A model-judged check reads the stored verdict of the batch-inference operator."""
        verdict = J.get_text("result", "result")
        cond = verdict.isin(list(choices)) if choices else verdict == str(expected).lower()
        return _member(_results(t, name).where(cond), "run_id")

    return leaf


for _name in ("assertion", "tone", "factualness"):
    _judged(_name)


class _Compiler:
    def __init__(self, df: DataFrame, tables: Tables):
        self.df, self.tables, self.flags = df, tables, []

    def leaf(self, node: dict) -> Leaf:
        fn = CHECKS.get(node["id"])
        return TRUE() if fn is None else fn(self.tables, **node.get("params", {}))

    def flag(self, m: Member) -> Column:
        name = f"_in{len(self.flags)}"
        self.flags.append(name)
        ids = m.ids.select(F.col("_key").alias(f"{name}_k"), F.lit(True).alias(name))
        self.df = self.df.join(ids, F.col(m.on) == F.col(f"{name}_k"), "left").drop(f"{name}_k")
        found = F.coalesce(F.col(name), F.lit(False))
        return ~found if m.negate else found

    def column(self, part: Leaf) -> Column:
        if isinstance(part, Member):
            return self.flag(part)
        if isinstance(part, Either):
            out = part.column
            for m in part.members:
                other = self.column(m)
                out = (out & other) if part.conjunctive else (out | other)
            return out
        return part

    def tree(self, node) -> Column:
        if isinstance(node, dict):
            return self.column(self.leaf(node))
        op, *rest = node
        cols = [self.tree(n) for n in rest]
        if not cols:
            return TRUE()
        out = cols[0]
        for c in cols[1:]:
            out = (out | c) if op == "OR" else (out & c)
        return out

    def semi(self, m: Member) -> None:
        ids = m.ids.withColumnRenamed("_key", "_k")
        self.df = self.df.join(ids, F.col(m.on) == F.col("_k"), "left_anti" if m.negate else "left_semi")

    def run(self, logic) -> DataFrame:
        if not logic:
            return self.df
        op, *rest = logic
        if op != "AND":
            return self.finish(self.tree(logic))
        parts = [self.leaf(node) if isinstance(node, dict) else node for node in rest]
        for part in parts:  # cheap predicates first: they reach the scan
            if isinstance(part, Column):
                self.df = self.df.where(part)
        for part in parts:
            if isinstance(part, Member):
                self.semi(part)
            elif isinstance(part, Either):
                self.finish(self.column(part))
            elif isinstance(part, list):
                self.finish(self.tree(part))
        return self.df

    def finish(self, cond: Column) -> DataFrame:
        self.df = self.df.where(cond).drop(*self.flags)
        self.flags = []
        return self.df


def filter_runs(df: DataFrame, logic, tables: Tables | None = None) -> DataFrame:
    """Rows of ``df`` that satisfy the tree. Unknown leaves restrict nothing."""
    return _Compiler(df, tables or Tables(runs=df)).run(logic)


# leaves answered by enrichment results, and by user properties
ENRICHMENT = ("languages", "pii", "topics", "toxicity", "intents")


def split(logic, ids: tuple[str, ...]):
    """(tree of the named leaves, tree of the rest), both keeping AND/OR nesting."""
    if not logic:
        return ["AND"], ["AND"]
    op, *rest = logic
    inside, outside = [op], [op]
    for node in rest:
        if isinstance(node, dict):
            (inside if node["id"] in ids else outside).append(node)
        else:
            a, b = split(node, ids)
            if len(a) > 1:
                inside.append(a)
            if len(b) > 1:
                outside.append(b)
    return inside, outside


def enrichment_split(logic):
    return split(logic, ENRICHMENT)


def user_props_split(logic):
    return split(logic, ("user-props",))


def run_checks(df: DataFrame, logic, tables: Tables | None = None) -> DataFrame:
    """Adds passed and results: AND stops at the first failure, OR at the first pass."""
    op, *checks = logic
    c = _Compiler(df, tables or Tables(runs=df))
    verdicts = []
    for i, node in enumerate(checks):
        name = node["id"] if isinstance(node, dict) else node[0]
        verdicts.append(F.struct(F.lit(i).alias("pos"), F.lit(name).alias("id"), F.coalesce(c.tree(node), F.lit(False)).alias("passed")))
    every = F.array(*verdicts)
    stop_on = F.lit(op == "OR")
    stops = F.transform(F.filter(every, lambda v: v["passed"] == stop_on), lambda v: v["pos"])
    upto = F.coalesce(F.array_min(stops) + 1, F.lit(len(checks)))
    passed = (F.size(stops) > 0) if op == "OR" else (F.size(stops) == 0)
    out = c.df.withColumn("passed", passed).withColumn(
        "results", F.transform(F.slice(every, F.lit(1), upto), lambda v: F.struct(v["id"].alias("id"), v["passed"].alias("passed")))
    )
    return out.drop(*c.flags)
