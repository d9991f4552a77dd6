"""Skew-safe building blocks: ordered scans over hot keys, bounded collection, exact percentiles.

A key may hold a large share of all rows, and all of them may carry one timestamp. None of
these functions puts such a key into one task: ordered work is cut into ranges of the order
columns with about equally many rows, and the ranges' totals are scanned first. (Skewed joins
are split by adaptive execution, which ``session.configure`` switches on.)
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Rows of a key that one task takes in an ordered scan; a larger key is cut into ranges of about that many.
RANGE_ROWS = 250_000
#: Items of a list that one row carries.
PART_ITEMS = 1_000


def value_chunk(value: Column, per_octave: int = 256) -> Column:
    """Slices of a number by magnitude, in ascending order; each spans about 0.3 % of its values."""
    bin_ = F.signum(value) * (F.floor(F.log2(F.abs(value)) * per_octave) + F.lit(1_200 * per_octave))
    return F.when(value == 0, F.lit(0)).otherwise(bin_).cast("long")


def cut_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int | None = None) -> DataFrame:
    """Adds _k = (keys, c): keys with more than ``rows`` rows are cut into ranges c = 0, 1, … of about ``rows`` rows.

    The cuts are equi-depth: Spark samples (keys, order) of the large keys' rows and deals them by range, so the cuts
    follow the data, whichever values are frequent; rows part wherever any order column differs, so ``order`` should
    end with an id. They are written once, since a second sampling could cut elsewhere. Without a large key no row moves.
    """
    rows = rows or RANGE_ROWS
    own = lambda c: F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], c.cast("int").alias("c"))
    key = lambda: F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])
    large = df.groupBy(key().alias("_large")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > rows)
    large = cut_lineage(large)  # total / rows keys at most
    total = large.agg(F.sum("_n")).first()[0]
    if not total:
        return df.withColumn("_k", own(F.lit(0)))
    large, on = large.select("_large"), key() == F.col("_large")
    dealt = df.join(large, on, "left_semi").repartitionByRange(max(2, -(-total // rows)), *keys, *order).withColumn("_k", own(F.spark_partition_id()))
    return df.join(large, on, "left_anti").withColumn("_k", own(F.lit(0))).unionByName(cut_lineage(dealt))


def _chunked(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column | int | None) -> DataFrame:
    """Adds _k = (keys, chunk), unless an earlier scan left it. A struct compares null fields as equal, and
    one column serves windows and joins, so the rows are shuffled once."""
    if "_k" in df.columns:
        return df
    if not isinstance(chunk, Column):
        return cut_ranges(df, keys, order, chunk)
    return df.withColumn("_k", F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], chunk.alias("c")))


def _across(keys: Sequence[str]):
    """Window over the chunk totals of one key: as many rows as the key has chunks."""
    return W.partitionBy(*[F.col(f"_k.k{i}") for i in range(len(keys))]).orderBy("_k.c")


def _done(df: DataFrame, keep: bool, *scratch: str) -> DataFrame:
    return df.drop(*scratch) if keep else df.drop("_k", *scratch)


def running_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, Column], chunk: Column | int | None = None, keep: bool = False
) -> DataFrame:
    """Inclusive running sums per key in ``order`` (ascending). ``chunk`` is the rows of a range (``cut_ranges``), or a
    column that cuts keys and agrees with the order.

    With ``keep`` the chunk column stays for a following scan over the same keys and chunks, which then
    needs no shuffle of its own.
    """
    d = _chunked(df, keys, order, chunk)
    for name, col in values.items():
        d = d.withColumn(f"_v_{name}", col)
    totals = d.groupBy("_k").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in values])
    before = _across(keys).rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select("_k", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_p_{n}") for n in values])
    local = W.partitionBy("_k").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    for name in values:
        d = d.withColumn(f"_v_{name}", F.sum(f"_v_{name}").over(local))
    joined = d.join(totals, "_k", "left")
    for name in values:
        joined = joined.withColumn(name, F.col(f"_v_{name}") + F.col(f"_p_{name}"))
    return _done(joined, keep, *[f"_{x}_{n}" for x in ("v", "p") for n in values])


def numbered(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "rn", chunk: Column | int | None = None, keep: bool = False
) -> DataFrame:
    """Row number per key, without sorting a whole key in one task."""
    return running_sum(df, keys, order, {name: F.lit(1).cast("long")}, chunk, keep)


def with_neighbours(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    before: dict[str, Column] | None = None,
    after: dict[str, Column] | None = None,
    chunk: Column | int | None = None,
    keep: bool = False,
) -> DataFrame:
    """Values of the previous and of the next row per key, looking across chunk borders; one shuffle for both."""
    d = _chunked(df, keys, order, chunk)
    seq, local = F.struct(*order), W.partitionBy("_k").orderBy(*order)
    sides = [("b", before, F.max_by, F.lag), ("a", after, F.min_by, F.lead)]
    sides = [(tag, cols, edge, step) for tag, cols, edge, step in sides if cols]
    for tag, cols, _, _ in sides:
        d = d.withColumn(f"_nb_{tag}", F.struct(*[c.alias(n) for n, c in cols.items()]))
    edges = d.groupBy("_k").agg(*[edge(f"_nb_{tag}", seq).alias(f"_edge_{tag}") for tag, _, edge, _ in sides])
    edges = edges.select("_k", *[step(f"_edge_{tag}").over(_across(keys)).alias(f"_far_{tag}") for tag, _, _, step in sides])
    for tag, _, _, step in sides:
        d = d.withColumn(f"_near_{tag}", step(f"_nb_{tag}").over(local))
    joined = d.join(edges, "_k", "left")
    for tag, cols, _, _ in sides:
        pick = F.coalesce(F.col(f"_near_{tag}"), F.col(f"_far_{tag}"))
        for n in cols:
            joined = joined.withColumn(n, pick[n])
    return _done(joined, keep, *[f"_{x}_{tag}" for tag, *_ in sides for x in ("nb", "near", "far")])


def with_neighbour(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: dict[str, Column], following: bool = False, chunk: Column | int | None = None, keep: bool = False
) -> DataFrame:
    """``with_neighbours`` in one direction."""
    return with_neighbours(df, keys, order, None if following else cols, cols if following else None, chunk, keep)


def ordered_parts(df: DataFrame, keys: Sequence[str], value: Column, order: Sequence[str], name: str, items: int | None = None, chunk: int | None = None) -> DataFrame:
    """Rows (keys, part, <name>_size, <name>): the ordered values of a key in parts 0, 1, … of ``items`` each.

    No row holds more, however many values a key has, and a large key is numbered in ranges; parts in order, one after
    the other, are the whole list. ``<name>_size`` is the number of items in the part.
    """
    placed = numbered(df, keys, order, "_n", chunk).withColumn("part", F.floor((F.col("_n") - 1) / (items or PART_ITEMS)).cast("long"))
    packed = placed.groupBy(*keys, "part").agg(F.array_sort(F.collect_list(F.struct("_n", value.alias("v")))).alias("_items"))
    return packed.select(*keys, "part", F.size("_items").cast("long").alias(f"{name}_size"), F.transform("_items", lambda x: x["v"]).alias(name))


def beside_parts(df: DataFrame, keys: Sequence[str], *parts: DataFrame) -> DataFrame:
    """``df`` with the columns of ``ordered_parts`` tables, matched by part: a row per part, at least one (part 0)."""
    both = parts[0]
    for more in parts[1:]:
        both = both.join(more, [*keys, "part"], "full")
    return df.join(both, list(keys), "left").withColumn("part", F.coalesce("part", F.lit(0).cast("long")))


def ordered_lists(df: DataFrame, keys: Sequence[str], value: Column, order: Column, name: str) -> DataFrame:
    """One ordered array per key and its ``<name>_size``, in one pass: for what is one JSON value by its format (an
    object of feedback keys, the tool calls of one event). Lists that may be long are ``ordered_parts``.
    """
    items = df.withColumn("_item", F.struct(order.alias("o"), value.alias("v"))).groupBy(*keys).agg(F.array_sort(F.collect_list("_item")).alias("_items"))
    return items.select(*keys, F.size("_items").cast("long").alias(f"{name}_size"), F.transform("_items", lambda x: x["v"]).alias(name))


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, points: Sequence[float]) -> DataFrame:
    """Continuous percentiles, exact, without holding a group's values in one task.

    Values are counted per distinct value, counted again per logarithmic bin, the bin
    holding each rank is found from the bin totals, and only those bins are ranked.
    """
    keys = list(keys)
    v = F.col(value).cast("double")
    counted = (
        df.where(F.col(value).isNotNull())
        .select(*keys, v.alias("_v"), value_chunk(v).alias("_raw"))
        .groupBy(*keys, "_v", "_raw")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    wanted = _wanted_bins(counted.groupBy(*keys, "_raw").agg(F.sum("_n").alias("_bn")), keys, points)
    return _at_ranks(counted.join(wanted, [*keys, "_raw"]), keys)


def _wanted_bins(bins: DataFrame, keys: list[str], points: Sequence[float]) -> DataFrame:
    """Of (keys, _raw, _bn) the bins that hold a rank some point asks for: with _before, _total and _targets (point, rank)."""
    up_to = W.partitionBy(*keys).orderBy("_raw").rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy(*keys)
    pos = F.col("p") * (F.col("_total") - 1)
    return (
        bins.withColumn("_upto", F.sum("_bn").over(up_to))
        .withColumn("_total", F.sum("_bn").over(whole))
        .withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in points])))
        .withColumn("_rank", F.explode(F.array(F.floor(pos), F.ceil(pos))))
        .where((F.col("_rank") >= F.col("_upto") - F.col("_bn")) & (F.col("_rank") < F.col("_upto")))
        .groupBy(*keys, "_raw")
        .agg(
            F.max(F.col("_upto") - F.col("_bn")).alias("_before"),
            F.max("_total").alias("_total"),
            F.collect_set(F.struct("p", "_rank")).alias("_targets"),  # at most 2 per point
        )
    )


def _at_ranks(found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, p, value) from the counted values (_v, _n) of the wanted bins."""
    inside = W.partitionBy(*keys, "_raw").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    ranked = (
        found.withColumn("_end", F.col("_before") + F.sum("_n").over(inside))
        .withColumn("_start", F.col("_end") - F.col("_n"))
        .withColumn("_t", F.explode("_targets"))
        .where((F.col("_t._rank") >= F.col("_start")) & (F.col("_t._rank") < F.col("_end")))
        .select(*keys, F.col("_t.p").alias("p"), "_v", "_total")
    )
    grouped = ranked.groupBy(*keys, "p").agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.max("_total").alias("_total"))
    exact_pos = F.col("p") * (F.col("_total") - 1)
    frac = exact_pos - F.floor(exact_pos)
    return grouped.select(*keys, "p", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * frac).alias("value"))


def sliding_percentiles(df: DataFrame, keys: Sequence[str], ts: str, value: str, points: Sequence[float], minutes: int, slide: int) -> DataFrame:
    """(keys, window_end, p, value): exact percentiles over windows of ``minutes`` every ``slide`` minutes.

    Rows are counted once per pane of ``slide`` minutes, by value and by magnitude bin. A bin's histogram over the windows
    is the running sum of what a pane adds when it comes in and takes away when it leaves: two rows for each pane and bin,
    however long the window. Only the bins that hold a wanted rank are refined, from the panes' counted values, which a
    window finds in the two blocks of panes it touches.
    """
    if minutes % slide:
        raise ValueError("a window is a whole number of slides")
    keys, k = list(keys), minutes // slide
    v, pane = F.col(value).cast("double"), F.floor(F.unix_seconds(ts) / F.lit(slide * 60))
    rows = df.where(F.col(value).isNotNull() & F.col(ts).isNotNull()).select(*keys, pane.alias("_pane"), v.alias("_v"), value_chunk(v).alias("_raw"))
    counted = cut_lineage(rows.groupBy(*keys, "_pane", "_v", "_raw").agg(F.count(F.lit(1)).alias("_n")))
    panes = counted.groupBy(*keys, "_raw", "_pane").agg(F.sum("_n").alias("_d"))
    change = lambda at, d: F.struct(at.alias("at"), d.alias("d"))
    steps = panes.select(*keys, "_raw", F.explode(F.array(change(F.col("_pane") + 1, F.col("_d")), change(F.col("_pane") + 1 + k, -F.col("_d")))).alias("s"))
    steps = steps.groupBy(*keys, "_raw", F.col("s.at").alias("_at")).agg(F.sum("s.d").alias("_d"))
    over = W.partitionBy(*keys, "_raw").orderBy("_at")
    levels = steps.select(*keys, "_raw", "_at", F.lead("_at").over(over).alias("_next"), F.sum("_d").over(over.rowsBetween(W.unboundedPreceding, 0)).alias("_bn"))
    bins = levels.where("_bn > 0").withColumn("_e", F.explode(F.sequence("_at", F.col("_next") - 1))).select(*keys, "_e", "_raw", "_bn")
    wanted = _wanted_bins(bins, [*keys, "_e"], points)
    block = lambda c: F.floor(c / F.lit(k))
    wanted = wanted.withColumn("_block", F.explode(F.array_distinct(F.array(block(F.col("_e") - k), block(F.col("_e") - 1)))))
    met = counted.withColumn("_block", block(F.col("_pane"))).join(wanted, [*keys, "_raw", "_block"]).where((F.col("_pane") >= F.col("_e") - k) & (F.col("_pane") < F.col("_e")))
    found = met.groupBy(*keys, "_e", "_raw", "_v").agg(F.sum("_n").alias("_n"), F.first("_before").alias("_before"), F.first("_total").alias("_total"), F.first("_targets").alias("_targets"))
    out = _at_ranks(found, [*keys, "_e"])
    return out.select(*keys, F.timestamp_seconds(F.col("_e") * (slide * 60)).alias("window_end"), "p", "value")
