"""Ranking, neighbours, latest-per-key and paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .skew import numbered, with_neighbours

# fixed values: list columns one may sort by
SORT_COLUMNS = {
    "created_at": "created_at", "duration": "duration_s", "tokens": "total_tokens", "cost": "cost", "messages": "messages_count",
}


def neighbours(runs: DataFrame, keys: list[str] | None = None, sort: str = "created_at", chunk: Column | int | None = None) -> DataFrame:
    """previous_id and next_id of every run in (sort, id) order, without one big sort per project."""
    keys = keys or ["project_id"]
    own = F.col("id")
    return with_neighbours(runs, keys, [sort, "id"], {"previous_id": own}, {"next_id": own}, chunk)


def item_numbers(items: DataFrame, key: str = "dataset_id", chunk: Column | int | None = None) -> DataFrame:
    """item_index by created_at, id in each dataset."""
    return numbered(items, [key], ["created_at", "id"], "item_index", chunk)


def one_per_user_and_bucket(runs: DataFrame) -> DataFrame:
    """The earliest run of each user in each bucket, by partial aggregation."""
    return runs.groupBy("external_user_id", "date").agg(F.min_by("id", F.struct("created_at", "id")).alias("id"))


def latest_published(versions: DataFrame, key: str = "template_id") -> DataFrame:
    """The newest version that is no draft, per template or slug; max_by combines map-side, no sort."""
    row = F.struct(*versions.columns)
    return versions.where("not is_draft").groupBy(key).agg(F.max_by(row, F.struct("published_at", "id")).alias("_r")).select("_r.*")


def one_per_id(users: DataFrame) -> DataFrame:
    return users.dropDuplicates(["id"])


#: Rows before a page that a bounded top list may hold; a page further on is sought by key.
NEAR = 10_000


def page_of_runs(runs: DataFrame, sort: str = "created_at", ascending: bool = False, page: int = 0, size: int = 50, near: int | None = None, bins: int = 128) -> DataFrame:
    """One page, nulls last, ties by id.

    A near page is a bounded top list. A page further on is sought: the sort key's values are counted in equi-depth bins
    from a sketch, and only the rows of the bins that the page touches go on; where these are still many, they are dealt into ranges
    of value and id, and only the ranges that it touches are sorted. So no page sorts what lies before it.
    """
    d = runs
    if sort == "tokens":
        d = d.withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens"))
    col = SORT_COLUMNS[sort]
    order = F.asc_nulls_last(col) if ascending else F.desc_nulls_last(col)
    first = page * size
    if first + size <= (NEAR if near is None else near):
        return d.orderBy(order, "id").offset(first).limit(size)
    cuts = d.where(F.col(col).isNotNull()).select(F.percentile_approx(col, [i / bins for i in range(1, bins)], 10 * bins).alias("c")).first()["c"] or []
    cuts = sorted(set(cuts))
    place = _bin_of(F.col(col), [F.lit(c).cast(d.schema[col].dataType) for c in cuts])
    place = F.when(F.col(col).isNull(), len(cuts) + 1).otherwise(place if ascending else len(cuts) - place)
    counted = d.groupBy(place.alias("b")).agg(F.count(F.lit(1)).alias("n")).orderBy("b").collect()  # a row per bin
    found, before = _touched(counted, first, size)
    rest = d.where(place.isin([r["b"] for r in found])) if found else d.where("false")
    if sum(r["n"] for r in found) <= (NEAR if near is None else near):
        return rest.orderBy(order, "id").offset(first - before).limit(size)
    # One value may fill a bin: its rows are dealt by range of value and id, and of these ranges the page touches few.
    dealt = cut_lineage(rest.repartitionByRange(bins, order, "id").withColumn("_bin", F.spark_partition_id()))
    ranges = dealt.groupBy(F.col("_bin").alias("b")).agg(F.count(F.lit(1)).alias("n")).orderBy("b").collect()
    found, ahead = _touched(ranges, first - before, size)
    return dealt.where(F.col("_bin").isin([r["b"] for r in found])).drop("_bin").orderBy(order, "id").offset(first - before - ahead).limit(size)


def _bin_of(value: Column, cuts: list[Column], base: int = 0) -> Column:
    """How many of the ascending cuts a value reaches, by halving."""
    if not cuts:
        return F.lit(base)
    half = len(cuts) // 2
    return F.when(value < cuts[half], _bin_of(value, cuts[:half], base)).otherwise(_bin_of(value, cuts[half + 1 :], base + half + 1))


def _touched(counted: list, first: int, size: int) -> tuple[list, int]:
    """(bins that the rows first … first + size fall into, rows before them) of bins in order."""
    at, found, before = 0, [], None
    for r in counted:
        if at < first + size and at + r["n"] > first:
            before = at if before is None else before
            found.append(r)
        at += r["n"]
    return found, before or 0


def filtered_count(runs: DataFrame) -> DataFrame:
    return runs.agg(F.count(F.lit(1)).alias("count"))


def latest_cluster_version(versions: DataFrame) -> DataFrame:
    row = F.struct(*versions.columns)
    return versions.groupBy("evaluator_id").agg(F.max_by(row, F.struct("created_at", "id")).alias("_r")).select("_r.*")
