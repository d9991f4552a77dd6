"""Tree operators over (id, parent_run_id).

Roots are found by pointer doubling: each round joins the unresolved pointers with the
table of pointers itself, halving the distance, so a tree of depth n needs log2(n)
rounds, whatever n is. Rows that reached a root leave the loop. A round that resolves no
row leaves only rows on or below a cycle: they have no root, and ``cycles`` reports them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .skew import numbered, running_sum


def roots(runs: DataFrame, stop: Column | None = None) -> DataFrame:
    """(id, root_id, depth) for every run whose chain ends.

    ``stop`` marks runs that act as roots even when they have a parent. A parent that is
    not in the table ends the chain as well. Only runs that have children are doubled; then every run asks its parent once.
    """
    is_top = F.col("parent_run_id").isNull()
    if stop is not None:
        is_top = is_top | F.coalesce(stop, F.lit(False))
    edges = cut_lineage(runs.select("id", F.when(~is_top, F.col("parent_run_id")).alias("anc")))
    asked = edges.where("anc is not null").select(F.col("anc").alias("_q")).distinct()
    inner = cut_lineage(edges.join(asked, F.col("id") == F.col("_q"), "left_semi"))
    above = _roots_by_doubling(inner).select(F.col("id").alias("_i"), "root_id", "depth")
    # a parent that is a root answers with itself; one on or below a cycle is there, but has no root
    answers = inner.where("anc is null").select(F.col("id").alias("_p"), F.col("id").alias("root_id"), F.lit(0).alias("depth")).unionAll(
        inner.where("anc is not null").join(above, F.col("id") == F.col("_i"), "left").select(F.col("id").alias("_p"), "root_id", "depth")
    )
    met = edges.join(answers, F.col("anc") == F.col("_p"), "left").where("_p is null or root_id is not null")
    return met.select("id", F.coalesce("root_id", "id").alias("root_id"), F.coalesce(F.col("depth") + 1, F.lit(0)).alias("depth"))


def _roots_by_doubling(edges: DataFrame) -> DataFrame:
    """(id, root_id, depth) from (id, anc)."""
    # a missing parent makes the run a root; a parent without a parent ends the search at once
    parents = edges.select(F.col("id").alias("_p"), F.col("anc").alias("_up"))
    state = cut_lineage(
        edges.join(parents, F.col("anc") == F.col("_p"), "left").select(
            "id", F.coalesce("_p", "id").alias("anc"), F.when(F.col("_p").isNotNull(), 1).otherwise(0).alias("depth"),
            (F.col("_p").isNull() | F.col("_up").isNull()).alias("done"),
        )
    )
    known, before = state.where("done"), None
    while (open_ := state.where("not done").count()) and open_ != before:
        before = open_
        # only unresolved rows ask; whatever is known answers
        asking = state.where("not done")
        answers = known.unionAll(asking).select(F.col("id").alias("_i"), F.col("anc").alias("_a"), F.col("depth").alias("_d"), F.col("done").alias("_done"))
        state = cut_lineage(
            asking.join(answers, F.col("anc") == F.col("_i"), "left").select(
                "id", F.coalesce("_a", "anc").alias("anc"), (F.col("depth") + F.coalesce("_d", F.lit(0))).alias("depth"), F.coalesce("_done", F.lit(True)).alias("done")
            )
        )
        known = known.unionAll(state.where("done"))
    return known.select("id", F.col("anc").alias("root_id"), "depth")


def cycles(runs: DataFrame) -> DataFrame:
    """Runs on or below a cycle: those without a root."""
    return runs.join(roots(runs).select("id"), "id", "left_anti")


def descendants(runs: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """All runs below the given runs (or below every root), themselves included, with root_id and depth.

    For chosen starts, every run finds the nearest start above it by doubling; starts that lie
    below other starts pass their runs on, one round for each level of such nesting.
    """
    if starts is None:
        return runs.join(roots(runs), "id")
    chosen = cut_lineage(starts.select(F.col("id").alias("_s")).distinct())
    marked = runs.select("id", "parent_run_id").join(chosen, F.col("id") == F.col("_s"), "left").withColumn("_start", F.col("_s").isNotNull())
    near = roots(marked, stop=F.col("_start")).join(chosen, F.col("root_id") == F.col("_s"), "left_semi")
    near = cut_lineage(near)
    above = cut_lineage(
        runs.join(chosen, F.col("id") == F.col("_s"), "left_semi").select(F.col("id").alias("_low"), "parent_run_id")
        .join(near.select(F.col("id").alias("_p"), F.col("root_id").alias("_high"), (F.col("depth") + 1).alias("_d")), F.col("parent_run_id") == F.col("_p"))
        .select("_low", "_high", "_d")
    )
    found = level = near
    while not level.isEmpty():
        passed = level.join(above, F.col("root_id") == F.col("_low")).select("id", F.col("_high").alias("root_id"), (F.col("depth") + F.col("_d")).alias("depth"))
        # starts on one cycle pass a run round and back: only new pairs go on
        level = cut_lineage(passed.join(found.select("id", "root_id"), ["id", "root_id"], "left_anti").groupBy("id", "root_id").agg(F.min("depth").alias("depth")))
        found = found.unionByName(level)
    return runs.join(found, "id")


def fold_up(runs: DataFrame, value: Column, name: str, far: bool = False, within: int | None = None) -> DataFrame:
    """(id, name): the first non-null ``value`` on the way up from each run, itself included;
    with ``far`` the last one, i.e. the one nearest the root. With ``within`` at most so many steps up.

    Doubling: every state covers a stretch of ancestors and points at the next one.
    """
    parents = runs.select(F.col("id").alias("_p"))
    state = runs.select("id", F.col("parent_run_id").alias("nxt"), value.alias("v"), F.lit(0).alias("dist"), F.lit(1).alias("span"))
    state = cut_lineage(
        state.join(parents, F.col("nxt") == F.col("_p"), "left").select("id", F.col("_p").alias("nxt"), "v", "dist", "span")
    )
    before, reached = None, 1
    while (open_ := state.where("nxt is not null").count()) and open_ != before and (within is None or reached <= within):
        before, reached = open_, 2 * reached
        ahead = state.select(
            F.col("id").alias("_i"), F.col("nxt").alias("_n"), F.col("v").alias("_v"), F.col("dist").alias("_d"), F.col("span").alias("_s")
        )
        joined = state.join(ahead, F.col("nxt") == F.col("_i"), "left")
        usable = F.col("_v") if within is None else F.when(F.col("span") + F.col("_d") <= within, F.col("_v"))
        take = usable.isNotNull() if far else (F.col("v").isNull() & usable.isNotNull())
        state = cut_lineage(
            joined.select(
                "id",
                F.col("_n").alias("nxt"),
                F.when(take, usable).otherwise(F.col("v")).alias("v"),
                F.when(take, F.col("span") + F.col("_d")).otherwise(F.col("dist")).alias("dist"),
                (F.col("span") + F.coalesce("_s", F.lit(0))).alias("span"),
            )
        )
    return state.select("id", F.col("v").alias(name))


def ancestors_first(runs: DataFrame, hit: Column, value: Column, name: str) -> DataFrame:
    """(id, name): ``value`` of the nearest proper ancestor satisfying ``hit``."""
    found = fold_up(runs, F.when(hit, value), name).where(F.col(name).isNotNull())
    above = found.select(F.col("id").alias("_a"), name)
    return runs.select("id", "parent_run_id").join(above, F.col("parent_run_id") == F.col("_a")).select("id", name)


def subtree_totals(runs: DataFrame) -> DataFrame:
    """Tokens and cost summed over each trace."""
    return runs.join(roots(runs), "id").groupBy("root_id").agg(
        F.sum(F.col("prompt_tokens").cast("long")).alias("prompt_tokens"),
        F.sum(F.col("completion_tokens").cast("long")).alias("completion_tokens"),
        F.sum("cost").alias("cost"),
        F.count(F.lit(1)).alias("runs"),
    )


def attributed_to_agents(runs: DataFrame) -> DataFrame:
    """Runs with the name of the agent or chain whose subtree they belong to.

    A subtree starts at an agent or chain that has no parent or whose parent is a chat.
    """
    chats = runs.where("type = 'chat'").select(F.col("id").alias("_chat"))
    marked = runs.join(chats, F.col("parent_run_id") == F.col("_chat"), "left").withColumn(
        "_seed", F.col("type").isin("agent", "chain") & (F.col("parent_run_id").isNull() | F.col("_chat").isNotNull())
    )
    tops = roots(marked, stop=F.col("_seed"))
    seeds = marked.where("_seed").select(F.col("id").alias("root_id"), F.col("name").alias("agent_name"))
    return runs.join(tops, "id").join(seeds, "root_id")


def inherited_feedback(runs: DataFrame, max_depth: int = 5) -> DataFrame:
    """(id, feedback): own feedback, else the nearest one at most ``max_depth`` levels up."""
    return fold_up(runs, F.col("feedback"), "feedback", within=max_depth)


def node_paths(runs: DataFrame) -> DataFrame:
    """Every node with its root, depth and status (redacted runs become ``filtered``)."""
    return _redacted(runs.join(roots(runs), "id"))


def _redacted(runs: DataFrame) -> DataFrame:
    hidden = F.coalesce(F.col("input") == "__NOT_INGESTED__", F.lit(False)) | F.coalesce(F.col("output") == "__NOT_INGESTED__", F.lit(False))
    return runs.withColumn("status", F.when(hidden, "filtered").otherwise(F.col("status")))


def preorder(runs: DataFrame) -> DataFrame:
    """(id, root_id, depth, place, next_depth) of every run that has a root: its place from 0 in the walk over its trace,
    children by creation time, then id, and the depth of the run after it (null for the last one).

    A run's place is that of its parent, plus one, plus the runs below the siblings before it. What is below a run and what lies
    on the way up are summed by doubling over the runs that have children, in log2(depth) rounds; siblings are summed in ranges. No task
    holds a trace, and neither a hot trace nor a hub of children is one task.
    """
    own = cut_lineage(
        runs.select("id", "parent_run_id", "created_at").join(roots(runs), "id")
        .select("id", "created_at", "root_id", "depth", F.when(F.col("depth") > 0, F.col("parent_run_id")).alias("up"))
    )
    kids = own.where("up IS NOT NULL")
    counts = kids.groupBy(F.col("up").alias("_u")).agg(F.count(F.lit(1)).alias("below"))
    inner = cut_lineage(own.join(counts, F.col("id") == F.col("_u")).select("id", "up", "depth", "below"))
    below = cut_lineage(_below(inner))
    sized = cut_lineage(kids.select("id", "up", "created_at", "root_id", "depth").join(below, "id", "left").withColumn("below", F.coalesce("below", F.lit(0).cast("long"))))
    summed = running_sum(sized, ["up"], ["created_at", "id"], {"upto": F.col("below") + 1})
    whole = below.select(F.col("id").alias("up"), F.col("below").alias("whole"))
    # the first child comes right after its parent; a child that does not end what is below its parent has a sibling after it
    summed = cut_lineage(
        summed.join(whole, "up").select("id", "up", "root_id", "depth", "below", (F.col("upto") - F.col("below")).alias("step"), (F.col("upto") < F.col("whole")).alias("followed"))
    )
    tops = own.where("up IS NULL").join(below, "id", "left").select("id", "root_id", "depth", F.coalesce("below", F.lit(0).cast("long")).alias("below"))
    none = F.lit(None).cast("int")
    path = summed.where("below > 0").select("id", F.col("up").alias("nxt"), "step", F.when(F.col("followed"), F.col("depth")).alias("back")).unionByName(
        tops.where("below > 0").select("id", F.lit(None).cast(own.schema["up"].dataType).alias("nxt"), F.lit(0).cast("long").alias("step"), none.alias("back"))
    )
    placed = _along(path).select(F.col("id").alias("up"), F.col("step").alias("_place"), F.col("back").alias("_back"))
    first = F.when(F.col("below") > 0, F.col("depth") + 1)
    return summed.join(placed, "up").select(
        "id", "root_id", "depth", (F.col("_place") + F.col("step")).alias("place"), F.coalesce(first, F.when(F.col("followed"), F.col("depth")), "_back").alias("next_depth")
    ).unionByName(tops.select("id", "root_id", "depth", F.lit(0).cast("long").alias("place"), first.alias("next_depth")))


def _below(inner: DataFrame) -> DataFrame:
    """(id, below): how many runs are below each, from (id, up, below) with the number of its children.

    Every state counts a stretch of generations and points at the run above that stretch, which takes the count over.
    """
    state = inner.select("id", F.col("up").alias("nxt"), "below")
    while not (going := state.where("nxt IS NOT NULL")).isEmpty():
        gains = going.groupBy(F.col("nxt").alias("_g")).agg(F.sum("below").alias("more"))
        ahead = going.select(F.col("id").alias("_i"), F.col("nxt").alias("_n"))
        state = cut_lineage(
            state.join(gains, F.col("id") == F.col("_g"), "left").join(ahead, F.col("nxt") == F.col("_i"), "left")
            .select("id", F.col("_n").alias("nxt"), (F.col("below") + F.coalesce("more", F.lit(0))).alias("below"))
        )
    return state.select("id", "below")


def _along(path: DataFrame) -> DataFrame:
    """(id, step, back): steps summed up to the root, and the first ``back`` on the way, by doubling over (id, nxt, step, back)."""
    state = cut_lineage(path)
    known, going = state.where("nxt IS NULL"), state.where("nxt IS NOT NULL")
    while not going.isEmpty():
        ahead = known.unionByName(going).select(F.col("id").alias("_i"), F.col("nxt").alias("_n"), F.col("step").alias("_s"), F.col("back").alias("_b"))
        state = cut_lineage(
            going.join(ahead, F.col("nxt") == F.col("_i")).select("id", F.col("_n").alias("nxt"), (F.col("step") + F.col("_s")).alias("step"), F.coalesce("back", "_b").alias("back"))
        )
        known, going = known.unionByName(state.where("nxt IS NULL")), state.where("nxt IS NOT NULL")
    return known.select("id", "step", "back")


def trace_lines(runs: DataFrame, fields: tuple[str, ...] = ("type", "name", "status")) -> DataFrame:
    """(root_id, place, depth, id, line): the nested JSON of every trace, a piece for each run.

    A run is its id, the named fields (null ones as null) and its children. Its line opens it and closes all that ends
    there, which the depth of the next line tells; so the lines of a trace, in the order of their places, are its JSON text,
    whatever its size.
    """
    own = F.to_json(F.struct("id", *fields), {"ignoreNullFields": "false"})
    closed = F.when(F.col("next_depth").isNull(), F.col("depth") + 1).otherwise(F.col("depth") + 1 - F.col("next_depth")).cast("int")
    after = F.when(F.col("next_depth").isNotNull() & (closed > 0), ",").otherwise("")
    line = F.concat(F.expr("left(own, length(own) - 1)"), F.lit(',"children":['), F.repeat(F.lit("]}"), F.greatest(closed, F.lit(0))), after)
    said = _redacted(runs).select("id", own.alias("own"))
    return preorder(runs).join(said, "id").select("root_id", "place", F.col("depth").cast("long").alias("depth"), "id", line.alias("line"))


def transcript(runs: DataFrame) -> DataFrame:
    """Long form (thread_id, position, role, content, tool_calls, created_at): messages of all runs below a thread,
    in run order, input before output. Positions come from a scan in ranges."""
    from ..functions.messages import parse

    below = runs.where("type != 'thread'").join(roots(runs), "id")
    msgs = below.select(F.col("root_id").alias("thread_id"), "created_at", "id", F.lit(0).alias("side"), F.posexplode(parse("input")).alias("pos", "m")).unionAll(
        below.select(F.col("root_id").alias("thread_id"), "created_at", "id", F.lit(1).alias("side"), F.posexplode(parse("output")).alias("pos", "m"))
    )
    out = numbered(msgs, ["thread_id"], ["created_at", "id", "side", "pos"], "position")
    return out.select("thread_id", "position", F.col("m.role").alias("role"), F.col("m.content").alias("content"), F.coalesce("m.tool_calls", "m.toolCalls").alias("tool_calls"), "created_at")
