"""Mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame operations only.

1. Targets: sources share ``share`` times all words by weight; none gets more than ``cap`` times its own words, and what is
   cut off is shared again by weight (the level is found in one pass over the sources, sorted by when they fill up).
2. Quotas: the mix has a whole number of blocks of ``block`` words. Sainte-Laguë gives each source its blocks by highest
   quotients, and again each source's blocks to its shards. Almost all seats follow from the common divisor; only the few
   between the rounded seats and the total are ranked.
3. Blocks: in a shard, documents stand in the order of a seeded hash on a line of words that is cut into blocks. Each
   block is taken a whole number of times or once more, the latter at an even pace from a seeded start, so a document's
   words follow from its place on the line alone. A source has as many shards as it has words or rows for, so a source
   with a third of all rows is spread like the rest.

The table of sources is taken to be small (it is sorted as one list); no other step holds a source together.

Nulls: a null text has no words; null sources form one source, sorted last; a null id counts as ''. Ties in the hash are
ordered by size. Repeated documents are taken each on its own. A very long text counts by its words like any other, and blocks may begin and end
inside it. Extra columns go unless kept, whatever their names. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common as C


def apportion(units: DataFrame, group: Sequence[str], key: Sequence[str], weight: str, seats: str) -> DataFrame:
    """``units`` with ``won``: its seats of its group's ``seats`` by highest quotients weight / (2 s - 1). Ties go to the first key."""
    whole = W.partitionBy(*group)
    d = units.withColumn("_w", F.sum(weight).over(whole)).withColumn("_k", F.count(F.lit(1)).over(whole))
    d = d.withColumn("_won", F.when(F.col("_w") > 0, F.floor(F.col(weight) * F.col(seats) / F.col("_w") + 0.5)).otherwise(F.lit(0)).cast("long"))
    d = d.withColumn("_open", F.when(F.col("_w") > 0, F.col(seats) - F.sum("_won").over(whole)).otherwise(F.lit(0)))
    # A unit moves by its share of what the divisor must give way, and one for rounding.
    moves = F.ceil((F.abs("_open") + F.col("_k")) * F.col(weight) / F.col("_w")) + 1
    low = F.when(F.col("_open") > 0, F.col("_won") + 1).otherwise(F.greatest(F.col("_won") - moves + 1, F.lit(1)))
    high = F.when(F.col("_open") > 0, F.col("_won") + moves).otherwise(F.col("_won"))
    contested = (
        d.where("_open <> 0").withColumn("_s", F.explode(F.when(low <= high, F.sequence(low, high)))).withColumn("_q", F.col(weight) / (2 * F.col("_s") - 1))
    )
    up = F.row_number().over(whole.orderBy(F.desc("_q"), *[F.asc_nulls_last(c) for c in key]))
    down = F.row_number().over(whole.orderBy(F.asc("_q"), *[F.desc_nulls_first(c) for c in key]))
    change = (
        contested.withColumn("_r", F.when(F.col("_open") > 0, up).otherwise(down)).where(F.col("_r") <= F.abs("_open"))
        .groupBy(*key).agg(F.sum(F.signum("_open").cast("long")).alias("_change")).select(F.struct(*key).alias("_key"), "_change")
    )
    return d.join(change, F.struct(*key).eqNullSafe(F.col("_key")), "left").withColumn("won", F.col("_won") + F.coalesce("_change", F.lit(0).cast("long"))).drop(
        "_w", "_k", "_won", "_open", "_key", "_change"
    )


def targets(sources: DataFrame, weights: Sequence[int], share: float, cap: int) -> DataFrame:
    """``sources`` (source, size, rows) with weight and target."""
    place = F.row_number().over(W.orderBy(F.asc_nulls_last("source")))
    d = sources.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (place - 1) % len(weights) + 1).cast("long"))
    filling = W.orderBy(F.col("size") * cap / F.col("weight"), F.asc_nulls_last("source"))
    before = filling.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    left = F.sum("size").over(everything) * F.lit(share) - F.coalesce(F.sum("size").over(before), F.lit(0)) * cap
    level = left / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    d = d.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    return d.withColumn("target", F.least((F.col("size") * cap).cast("double"), F.col("level") * F.col("weight"))).drop("level")


def _number(text: Column) -> Column:
    """The first 32 bits of a hex digest."""
    return F.conv(F.substring(text, 1, 8), 16, 10).cast("long")


def mix(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", keep: Sequence[str] = (), weights: Sequence[int] = (5, 2, 1),
    share: float = 1.5, cap: int = 2, block: int = 16, shard_words: int = 1 << 20, shard_rows: int = 1 << 14, seed: str = "mix",
) -> DataFrame:
    """One row per document: doc_id, the kept columns, source, size, source_size, target (of its source), shard, taken."""
    digest = F.md5(F.concat(F.lit(seed + "|"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))))
    sized = C.cut(docs.select(
        F.col(doc_id).alias("id"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(source).alias("source"),
        F.regexp_count(F.coalesce(text, F.lit("")), F.lit(C.VISIBLE_WORDS)).cast("long").alias("size"), digest.alias("digest"),
    ))
    sources = targets(sized.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows")), weights, share, cap)
    sources = sources.withColumn("blocks", F.round(F.sum("target").over(W.partitionBy()) / block).cast("long"))
    shards = F.greatest(F.lit(1), F.ceil(F.col("size") / shard_words), F.ceil(F.col("rows") / shard_rows)).cast("long")
    sources = C.cut(apportion(sources, [], ["source"], "target", "blocks").select(
        F.col("source").alias("of"), F.col("size").alias("source_size"), "target", F.col("won").alias("seats"), shards.alias("shards")
    ))
    placed = sized.join(sources, F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("shard", _number(F.col("digest")) % F.col("shards"))
    units = placed.groupBy("source", "shard").agg(F.sum("size").alias("words"), F.first("seats").alias("seats"))
    length = F.greatest(F.lit(1), F.ceil(F.col("words") / block))
    start = _number(F.md5(F.concat_ws("|", F.lit(seed), F.coalesce("source", F.lit("")), F.col("shard").cast("string"))))
    units = C.cut(apportion(units, ["source"], ["source", "shard"], "words", "seats").select(
        F.col("source").alias("of"), F.col("shard").alias("at"), length.alias("n"), F.least("won", length * cap).alias("won"), (start % length).alias("start")
    ))
    line = W.partitionBy("source", "shard").orderBy("digest", "size").rowsBetween(W.unboundedPreceding, 0)
    rows = placed.join(units, F.struct("source", "shard").eqNullSafe(F.struct("of", "at"))).withColumn("end", F.sum("size").over(line))

    def upto(x: Column) -> Column:
        """Words taken of the first x words of the line."""
        j, extra = F.floor(x / block), F.col("won") % F.col("n")
        once = lambda b: F.floor((b * extra + F.col("start")) / F.col("n"))
        return F.floor(F.col("won") / F.col("n")) * x + once(j) * block + (x % block) * (once(j + 1) - once(j))

    taken = upto(F.col("end")) - upto(F.col("end") - F.col("size"))
    return rows.select(
        F.col("id").alias("doc_id"), *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "source", "size", "source_size", "target", "shard", taken.cast("long").alias("taken")
    )
