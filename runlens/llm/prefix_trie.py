"""The trie of conversations by their first turns, rolled up by centroid decomposition.

1. Names. The first d turns of a conversation are named by four running sums of 32 bits each, over terms that hash the
   turn's place, role and text; scans are cut into ranges, so one long conversation is no single task. Equal names are one
   node; a node is (its smallest member, its depth), and its parent (the smallest member of the parent, depth - 1).
2. Weights. A node weighs as many turns as its members go through it, so a subtree's weight R, the turns of its members from
   there on, needs no walk over the trie.
3. Decomposition of the parent-edge forest. In a component of weight W the nodes with 2 R >= W form the path from its top down
   to its centroid. What hangs below the centroid, and the centroid, is totalled, and the total is added to every node of that
   path. Then the centroid goes, and the component falls into its upper part and one part for each child of the centroid, all
   of at most half its weight; so there are at most log2(turns) rounds, however deep or wide the trie is. Which part a
   node is in tells the row of its smallest member one level below the centroid.
4. Components of at most ``SMALL`` turns are rolled up at once, many in one batch.

Rounds work on the conversations that are a node's smallest member; copies of a conversation count from the start and take
no part. Digests of a node's ends are streamed: ids are packed in order, and packs are hashed in order, none is held whole.

Nulls: a null role or text is empty, a null turn comes first, a row without a conversation id belongs to none. Ties in turn are
ordered by role and text; repeated rows are repeated turns. A very long text is hashed and counted where it is read, and moved
once. Extra columns go, whatever their names. Empty tables give no rows, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import numbered, running_sum
from . import common as C

#: Turns of one conversation that a task scans; turns of a component that is rolled up in one batch; ids packed into a row.
RANGE, SMALL, PACK = 20_000, 512, 1_024
_SUMS = [f"s{i}" for i in range(4)]


def ordered_turns(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows (conv, i, x, y, w): the place of every turn from 1, two hashes of role and text, and the words of the text."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = rows.select(F.col(conv_id).cast("long").alias("conv"), F.col(turn).alias("turn"), said(role).alias("role"), said(text).alias("text")).where("conv IS NOT NULL")
    placed = numbered(rows, ["conv"], ["turn", "role", "text"], "i", RANGE)
    words = F.size(F.regexp_extract_all("text", F.lit(C.VISIBLE_WORDS), F.lit(0))).cast("long")
    return placed.select("conv", "i", F.xxhash64("role", "text").alias("x"), F.xxhash64(F.lit(1), "role", "text").alias("y"), words.alias("w"))


def members_of(turns: DataFrame) -> DataFrame:
    """Rows (conv, length) of ordered turns."""
    return turns.groupBy("conv").agg(F.max("i").alias("length"))


def shared_openings(turns: DataFrame, block: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """(turns, members) of conversations that open like the first of their block.

    Conversation c gets the first h = crc32(c) % most turns of conversation c - c % block, all if there are fewer and
    none if that is missing, and then its own turns after its first h."""
    turns = C.cut(turns)
    h = F.crc32(F.col("conv").cast("string")) % most
    own = C.cut(members_of(turns).select("conv", "length", h.alias("h"), (F.col("conv") - F.col("conv") % block).alias("first")))
    firsts = own.select(F.col("conv").alias("_c"), F.col("length").alias("_n"))
    plan = C.cut(
        own.join(firsts, F.col("first") == F.col("_c"), "left").withColumn("taken", F.least("h", F.coalesce("_n", F.lit(0))))
        .select("conv", "first", "taken", (F.col("h") - F.col("taken")).alias("lack"), (F.col("taken") + F.greatest(F.col("length") - F.col("h"), F.lit(0))).alias("length"))
    )
    openings = turns.where((F.col("i") < most) & (F.col("conv") % block == 0)).withColumnRenamed("conv", "_c")
    heads = plan.where("taken > 0").join(openings, (F.col("first") == F.col("_c")) & (F.col("i") <= F.col("taken"))).select("conv", "i", "x", "y", "w")
    # Few conversations miss an opening, so most turns meet no row here.
    tails = turns.where(F.col("i") > h).join(plan.where("lack > 0").select("conv", "lack"), "conv", "left")
    tails = tails.select("conv", (F.col("i") - F.coalesce("lack", F.lit(0))).alias("i"), "x", "y", "w")
    return heads.unionByName(tails), plan.select("conv", "length")


def _named(turns: DataFrame) -> DataFrame:
    """Adds k, g, the name of the conversation up to this turn, and pk, pg, that of the turn before."""
    low, high = (lambda x: F.col(x).bitwiseAND(0xFFFFFFFF)), (lambda x: F.shiftrightunsigned(x, 32))
    terms = turns.withColumn("_a", F.xxhash64("i", "x", "y")).withColumn("_b", F.xxhash64(F.lit(1), "i", "x", "y"))
    terms = terms.select("conv", "i", "w", *[f(x).alias(f"t{n}") for n, (x, f) in enumerate((x, f) for x in ("_a", "_b") for f in (low, high))])
    summed = running_sum(terms, ["conv"], ["i"], {s: F.col(f"t{n}") for n, s in enumerate(_SUMS)}, RANGE)
    k, g = _name(F.col("i"), [F.col(s) for s in _SUMS])
    pk, pg = _name(F.col("i") - 1, [F.col(s) - F.col(f"t{n}") for n, s in enumerate(_SUMS)])
    return summed.select("conv", F.col("i").alias("d"), "w", k.alias("k"), g.alias("g"), pk.alias("pk"), pg.alias("pg"))


def _name(depth: Column, sums: list[Column]) -> tuple[Column, Column]:
    return F.xxhash64(depth.cast("long"), *sums), F.xxhash64(F.lit(1), depth.cast("long"), *sums)


def prefix_trie(turns: DataFrame, members: DataFrame) -> DataFrame:
    """One row per node of the trie of ``turns`` (conv, i, x, y, w), for all ``members`` (conv, length): conv_id, depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    members = C.cut(members.select("conv", F.col("length").cast("long").alias("length")))
    rows = C.cut(_named(turns).join(members, "conv").withColumn("rest", F.col("length") - F.col("d") + 1).drop("length"))
    no_name = [c.alias(n) for c, n in zip(_name(F.lit(0), [F.lit(0).cast("long")] * 4), ("k", "g"), strict=True)]
    root = members.agg(F.min("conv").alias("m"), F.count(F.lit(1)).alias("n"), F.sum(F.col("length") + 1).alias("R")).where("n > 0")
    root = root.select(*no_name, F.lit(0).cast("long").alias("d"), "m", "n", "R", F.lit(0).cast("long").alias("w"), F.lit(None).cast("long").alias("pm"))
    found = C.cut(
        rows.groupBy("k", "g").agg(F.min("d").alias("d"), F.min("conv").alias("m"), F.count(F.lit(1)).alias("n"), F.sum("rest").alias("R"), F.min("w").alias("w"), F.min("pk").alias("pk"), F.min("pg").alias("pg"))
    )
    above = found.select(F.col("k").alias("pk"), F.col("g").alias("pg"), F.col("m").alias("pm")).unionByName(root.select(F.col("k").alias("pk"), F.col("g").alias("pg"), F.col("m").alias("pm")))
    nodes = found.join(above, ["pk", "pg"]).select("k", "g", "d", "m", "n", "R", "w", "pm").unionByName(root.select("k", "g", "d", "m", "n", "R", "w", "pm"))
    nodes = nodes.withColumn("leaf", (F.col("n") == F.col("R")).cast("long")).withColumn("save", (F.col("n") - 1) * F.col("w")).drop("w")
    nodes = C.cut(nodes)
    rolled = _rolled_up(rows, nodes)
    children = nodes.where("pm IS NOT NULL").groupBy(F.col("pm").alias("m"), (F.col("d") - 1).alias("d")).agg(F.count(F.lit(1)).alias("n_children"))
    ends = rows.where("rest = 1").select("k", "g", "conv").unionByName(members.where("length = 0").select(*no_name, "conv"))
    out = nodes.join(rolled, ["m", "d"]).join(children, ["m", "d"], "left").join(_digests(ends), ["k", "g"], "left")
    return out.select(
        F.col("m").alias("conv_id"), F.col("d").alias("depth"), F.col("pm").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def _rolled_up(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(m, d, n_leaves, saved_tokens): sums over every node's subtree, itself included."""
    owners = nodes.select(F.col("m").alias("conv")).distinct()
    paths = rows.select("conv", "d", "k", "g").join(owners, "conv", "left_semi").join(nodes.drop("d", "n"), ["k", "g"])
    top = nodes.where("d = 0").select(F.col("m").alias("conv"), "d", "k", "g", "m", "R", "pm", "leaf", "save")
    least, whole = top.select("m", "R").first() or (None, None)  # the root, of which everything is a part
    root = [F.lit(v).cast("long").alias(n) for n, v in (("cm", least), ("cd", 0), ("W", whole))]
    state = C.cut(paths.select(*top.columns).unionByName(top).select(*root, "conv", "d", "m", "pm", "R", "leaf", "save"))
    of, added = ["cm", "cd"], []
    while True:
        own = state.where("conv = m")
        added.append(_small(own.where(F.col("W") <= SMALL)))
        large, heavy = state.where(F.col("W") > SMALL), F.col("R") * 2 >= F.col("W")
        deepest = F.max_by(F.struct(F.col("m").alias("zm"), F.col("d").alias("zd"), F.col("R").alias("zr")), "d").alias("z")
        centroids = C.cut(large.where("conv = m").where(heavy).groupBy(*of).agg(deepest).select(*of, "z.*"))
        if centroids.isEmpty():
            break
        split = large.join(centroids, of)
        tops = split.where("d = zd + 1 AND pm = zm").select(*of, "conv", F.col("m").alias("tm"), F.col("R").alias("tw"))
        split = C.cut(split.join(tops, [*of, "conv"], "left").withColumn("below", F.col("tm").isNotNull() & (F.col("d") > F.col("zd"))))
        centroid = (F.col("d") == F.col("zd")) & (F.col("m") == F.col("zm"))
        totals = split.where("conv = m").where(F.col("below") | centroid).groupBy(*of).agg(F.sum("leaf").alias("leaf"), F.sum("save").alias("save"))
        added.append(split.where("conv = m").where(heavy).select(*of, "m", "d").join(totals, of).select("m", "d", "leaf", "save"))
        state = split.where(~centroid).select(
            F.when(F.col("below"), F.col("tm")).otherwise(F.col("cm")).alias("cm"), F.when(F.col("below"), F.col("zd") + 1).otherwise(F.col("cd")).alias("cd"),
            F.when(F.col("below"), F.col("tw")).otherwise(F.col("W") - F.col("zr")).alias("W"), "conv", "d", "m", "pm",
            F.when(heavy & ~F.col("below"), F.col("R") - F.col("zr")).otherwise(F.col("R")).alias("R"), "leaf", "save",
        )
    sums = added[0]
    for more in added[1:]:
        sums = sums.unionByName(more)
    return sums.groupBy("m", "d").agg(F.sum("leaf").alias("n_leaves"), F.sum("save").alias("saved_tokens"))


def _small(own: DataFrame) -> DataFrame:
    """Components of at most ``SMALL`` nodes, each with its sums: (m, d, leaf, save)."""
    fields = ["m", "d", "pm", "leaf", "save"]

    @F.arrow_udf("array<struct<m: long, d: long, leaf: long, save: long>>")
    def rolled(column: pa.Array) -> pa.Array:
        off = column.offsets.to_numpy()
        flat = column.values.slice(off[0], off[-1] - off[0])
        m, d, pm, leaf, save = (flat.field(i).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5))
        group = np.repeat(np.arange(len(off) - 1), np.diff(off))
        ids = np.concatenate([np.column_stack([group, d, m]), np.column_stack([group, d - 1, pm])])
        _, code = np.unique(ids, axis=0, return_inverse=True)
        code = code.ravel()
        holder = np.full(len(ids) + 1, -1, np.int64)
        holder[code[: len(m)]] = np.arange(len(m))
        parent = holder[code[len(m) :]]
        order = np.argsort(-d, kind="stable")
        order = order[parent[order] >= 0]
        for level in np.split(order, np.flatnonzero(np.diff(d[order])) + 1):  # the deepest nodes first
            np.add.at(leaf, parent[level], leaf[level])
            np.add.at(save, parent[level], save[level])
        made = pa.StructArray.from_arrays([pa.array(x) for x in (m, d, leaf, save)], ["m", "d", "leaf", "save"])
        return pa.ListArray.from_arrays(pa.array((off - off[0]).astype(np.int32)), made)

    groups = own.groupBy("cm", "cd").agg(F.collect_list(F.struct(*fields)).alias("nodes"))
    return groups.select(F.explode(rolled("nodes")).alias("n")).select("n.*")


def _digests(ends: DataFrame) -> DataFrame:
    """(k, g, sha): SHA-256 of each name's conversation ids, ascending, comma-joined."""

    def runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
        k, g = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cuts = np.flatnonzero((k[1:] != k[:-1]) | (g[1:] != g[:-1])) + 1
        return zip([0, *cuts], [*cuts, len(k)], strict=True)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(2).to_pylist()
            at = [(i, min(i + PACK, b)) for a, b in runs(batch) if b > a for i in range(a, b, PACK)]
            if at:
                first = pa.array([a for a, _ in at])
                yield pa.RecordBatch.from_arrays([*[c.take(first) for c in batch.columns], pa.array([",".join(map(str, ids[a:b])) for a, b in at])], ["k", "g", "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, open_, done = None, None, []

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"k": pa.array([x[0] for x in done], pa.int64()), "g": pa.array([x[1] for x in done], pa.int64()), "sha": pa.array([x[2] for x in done], pa.string())})

        for batch in batches:
            for k, g, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if name == (k, g):
                    open_.update(b",")
                else:
                    if open_:
                        done.append((*name, open_.hexdigest()))
                    name, open_ = (k, g), hashlib.sha256()
                open_.update(ids.encode())
            yield flush()
            done.clear()
        if open_:
            done.append((*name, open_.hexdigest()))
            yield flush()

    by = ["k", "g", "conv"]
    packed = ends.select(*by).repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(pack, "k long, g long, first long, ids string")
    return packed.repartition("k", "g").sortWithinPartitions("k", "g", "first").mapInArrow(digest, "k long, g long, sha string")
