"""Intent taxonomy: statistics, grouping, coverage, overflow, totals and alias mapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage
from .facets import raw_intents

OTHER = "Other"
FALLBACK_SHARE = 0.85
#: Jaccard similarity of the words of two labels of one group.
SIMILARITY = 0.75


def alias_key(label: Column | str) -> Column:
    c = F.col(label) if isinstance(label, str) else label
    return F.regexp_replace(F.trim(F.lower(c)), r"\s+", " ")


def intent_stats(results: DataFrame) -> DataFrame:
    """(label, occurrences) over input and output results."""
    return raw_intents(results).groupBy("label").agg(F.count(F.lit(1)).alias("occurrences"))


def fingerprint(label: Column) -> Column:
    """Letters and digits, lower case, distinct words in order: spelling variants meet here."""
    words = F.filter(F.split(F.lower(label), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.array_join(F.array_sort(F.array_distinct(words)), " ")


def _shortenings(text: Column) -> Column:
    """The text itself and every text with one character removed: two texts one edit apart share one of them."""
    spots = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)))
    cut = F.transform(spots, lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.length(text))))
    return F.array_distinct(F.concat(F.array(text), F.when(F.length(text) > 3, cut).otherwise(F.array().cast("array<string>"))))


def similar_prints(prints: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(u, v), u < v: distinct fingerprints ``fp`` whose sets of words have a Jaccard similarity of ``similarity`` at least.

    A prefix-filtered self join: words are ordered by rarity, and two sets can only be that alike if they share one of the
    rarest n - ceil(similarity * n) + 1 words of each. Frequent words are at the end of that order, so a word that a third
    of all labels hold joins none but labels made of such words alone. Sizes and positions bound what a pair can share
    before the words themselves are compared.
    """
    sets = cut_lineage(prints.select("fp").where("fp <> ''").distinct().withColumn("words", F.split("fp", " ")).withColumn("n", F.size("words")))
    said = sets.select("fp", "n", F.explode("words").alias("word"))
    known = cut_lineage(said.groupBy("word").agg(F.count(F.lit(1)).alias("f")))
    place = F.row_number().over(W.partitionBy("fp").orderBy("f", "word"))
    first = said.join(known, "word").withColumn("place", place).where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * similarity) + 1)
    first = cut_lineage(first.select("word", "fp", "n", "place"))
    x, y = first.alias("x"), first.alias("y")
    # From this word on, both have at most as many words in common as the one with fewer left.
    most = F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place")) + F.least("x.place", "y.place")
    met = x.join(y, (F.col("x.word") == F.col("y.word")) & (F.col("x.fp") < F.col("y.fp")) & (most >= similarity * (F.col("x.n") + F.col("y.n") - most)))
    asked = met.select(F.col("x.fp").alias("u"), F.col("y.fp").alias("v")).distinct()
    own = lambda name: sets.select(F.col("fp").alias(name), F.col("words").alias(f"{name}_words"))
    shared = F.size(F.array_intersect("u_words", "v_words"))
    return asked.join(own("u"), "u").join(own("v"), "v").where(shared >= similarity * (F.size("u_words") + F.size("v_words") - shared)).select("u", "v")


def grouped_labels(stats: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(label, occurrences, cluster): labels with one fingerprint, with fingerprints that share a shortening (one edit apart), or
    with similar sets of words form a cluster named after its most frequent label.

    Shared keys link fingerprints: a shortening, or a pair of similar ones; the smallest member travels along the links until
    nothing changes. A shared key is reduced to one row per round.
    """
    prints = stats.withColumn("fp", fingerprint(F.col("label")))
    nodes = cut_lineage(prints.select("fp").distinct().withColumn("comp", F.col("fp")))
    pairs = cut_lineage(similar_prints(nodes, similarity))
    key = F.concat(F.lit("\u0000"), "u", F.lit("\u0000"), "v").alias("k")
    links = nodes.select("fp", F.explode(_shortenings(F.col("fp"))).alias("k"))
    links = cut_lineage(links.unionByName(pairs.select(F.col("u").alias("fp"), key)).unionByName(pairs.select(F.col("v").alias("fp"), key)))
    changed = True
    while changed:
        least = links.join(nodes, "fp").groupBy("k").agg(F.min("comp").alias("low"))
        best = links.join(least, "k").groupBy("fp").agg(F.min("low").alias("low"))
        moved = nodes.join(best, "fp").select("fp", F.least("comp", "low").alias("next"), "comp")
        # jump: the component of my component
        jump = moved.select(F.col("fp").alias("_f"), F.col("next").alias("_n"))
        after = cut_lineage(
            moved.join(jump, F.col("next") == F.col("_f"), "left").select("fp", F.least(F.coalesce("_n", "next"), "next").alias("next"), "comp")
        )
        changed = not after.where("next != comp").isEmpty()
        nodes = after.select("fp", F.col("next").alias("comp"))
    named = prints.join(nodes, "fp")
    names = named.groupBy("comp").agg(F.max_by("label", F.struct("occurrences", "label")).alias("cluster"))
    return named.join(names, "comp").select("label", "occurrences", "cluster")


def title_case(label: Column) -> Column:
    return F.initcap(F.regexp_replace(F.trim(label), r"[\s_-]+", " "))


def with_coverage(stats: DataFrame, groups: DataFrame) -> DataFrame:
    """(label, occurrences, cluster): every label has a cluster; the unmapped go to Other."""
    known = groups.select(alias_key("label").alias("_k"), "cluster").groupBy("_k").agg(F.min("cluster").alias("cluster"))
    s = stats.withColumn("_k", alias_key("label"))
    mapped = s.join(known, "_k").select("label", "occurrences", "cluster")
    missing = s.join(known, "_k", "left_anti").select("label", "occurrences", F.lit(OTHER).alias("cluster"))
    return mapped.unionByName(missing)


def _totals(groups: DataFrame) -> DataFrame:
    return groups.groupBy("cluster").agg(F.sum("occurrences").alias("total"))


def with_overflow(groups: DataFrame, max_intents: int) -> DataFrame:
    """The largest N clusters stay, the rest becomes Other; when nothing else is left or Other holds more
    than 85 %, the N most frequent labels stand alone beside Other. Top lists are bounded top-k jobs."""
    n = max(1, max_intents)
    is_other = F.lower("cluster") == "other"
    top = _totals(groups.where(~is_other)).orderBy(F.desc("total"), "cluster").limit(n).select("cluster", F.lit(True).alias("_kept"))
    kept = groups.join(top, "cluster", "left").withColumn("cluster", F.when(F.col("_kept"), F.col("cluster")).otherwise(F.lit(OTHER))).drop("_kept")
    shares = kept.agg(
        F.coalesce(F.sum(F.when(F.col("cluster") == OTHER, F.col("occurrences"))), F.lit(0)).alias("other"), F.sum("occurrences").alias("all"),
        F.count(F.when(F.col("cluster") != OTHER, 1)).alias("named"),
    ).select(((F.col("named") == 0) | (F.col("other") / F.col("all") > FALLBACK_SHARE)).alias("_fallback"))
    best = groups.orderBy(F.desc("occurrences"), "label").limit(n).select("label", title_case(F.col("label")).alias("_own"))
    both = kept.join(best, "label", "left").withColumn("_fallback", shares.scalar())
    return both.select("label", "occurrences", F.when(F.col("_fallback"), F.coalesce("_own", F.lit(OTHER))).otherwise(F.col("cluster")).alias("cluster"))


def clusters(groups: DataFrame, max_intents: int) -> DataFrame:
    """(cluster, total, sort_order): at most N + 1 rows reach the ordering window."""
    sums = _totals(groups).orderBy(F.desc("total"), "cluster").limit(max(1, max_intents) + 1)
    return sums.withColumn("sort_order", F.row_number().over(W.partitionBy(F.lit(1)).orderBy(F.desc("total"), "cluster")))


def taxonomy(results: DataFrame, max_intents: int) -> tuple[DataFrame, DataFrame]:
    """(clusters, aliases) of an evaluator's results."""
    stats = intent_stats(results)
    groups = with_overflow(with_coverage(stats, grouped_labels(stats)), max_intents)
    return clusters(groups, max_intents), groups.select(F.col("label").alias("alias"), F.col("cluster").alias("label"))


def map_labels(results: DataFrame, aliases: DataFrame, ordered: DataFrame, max_intents: int) -> DataFrame:
    """(run_id, label, canonical, is_other) for every detected intent."""
    known = aliases.select(alias_key("alias").alias("_k"), F.col("label").alias("canonical")).groupBy("_k").agg(F.min("canonical").alias("canonical"))
    rank = ordered.select(F.col("cluster").alias("canonical"), "sort_order")
    found = raw_intents(results).withColumn("_k", alias_key("label"))
    out = found.join(known, "_k", "left").join(rank, "canonical", "left")
    return out.select("run_id", "label", F.coalesce("canonical", "label").alias("canonical"), F.coalesce(F.col("sort_order") > max_intents, F.lit(False)).alias("is_other"))
