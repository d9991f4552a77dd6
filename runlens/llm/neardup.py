"""Near-duplicates by many universal hash minima with banding, signature verification and exact verification, joined into
components by alternating large-star and small-star.

* Rows with the same shingle set form one class; only classes are compared, so copies are never paired.
* A class whose shingles are mostly its own (no other class in any of its buckets has them) can reach no similarity with
  anything and is set aside.
* Every other class meets the most central class of each of its buckets, the one with the smallest share of own shingles.
  Classes of buckets that still hold several components afterwards are joined by their rarest common shingles (an exact
  prefix filter); there, every class outside a shingle's largest component meets those of other components. So each
  pair that shares a bucket is tested, connected or ruled out; no bucket is capped.
* A pair passes when two bits of each minimum disagree seldom enough (five standard deviations of slack; a longer
  signature where a bucket is still mixed), the shingles that it can share at most allow the similarity, and the full
  sets confirm it.

A pair at the threshold shares no band with a probability below 1e-6 (``bands``).

Nulls: null or wordless texts have an empty set and are linked with nothing. Rows with a null id take part and get the
smallest id of their component, or null where it has none. Rows that share an id are linked, whatever their texts. Ids are
integers from 0 to 2**62. Ties: the smallest id names a component; of several rows with that id the one with the least text hash
is chosen. Very long texts are hashed whole, a slice of shingles at a time. Extra columns go, whatever their names. Empty
tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as C

#: Stand-ins for null ids start here.
NAMELESS = 1 << 62
_PLANES = 2
#: Minima of the longer signature that classes get whose buckets hold several components.
LONG = 1024


def bands(similarity: float, rows: int = 5, missed: float = 1e-6) -> int:
    """Bands of ``rows`` minima so that a pair at the threshold shares none with probability ``missed`` at most."""
    return math.ceil(math.log(missed) / math.log1p(-(similarity**rows)))


def _sets(words: C.Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle codes in ascending order per row, how many per row); fewer than k words are one shingle."""
    at, code = words.runs(k)
    n = len(words.offsets) - 1
    bounds = np.searchsorted(words.row[at], np.arange(n + 1))
    short = np.diff(words.first)
    parts, sizes = [], np.zeros(n, np.int64)
    for r in range(n):
        own = code[bounds[r] : bounds[r + 1]]
        if not len(own) and short[r]:
            with np.errstate(over="ignore"):
                own = np.array([short[r]], np.uint64)
                for c in words.code[words.first[r] : words.first[r + 1]]:
                    own = C.mix(own * C._BASE + c)
        if len(own) > 1:
            own = np.sort(own)
            own = own[np.concatenate(([True], own[1:] != own[:-1]))]
        parts.append(own)
        sizes[r] = len(own)
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), sizes


def _sketches(docs: DataFrame, doc_id: str, text: str, k: int, n_bands: int, rows: int) -> DataFrame:
    schema = "id long, h long, n long, k1 long, k2 long, bands array<long>, " + ", ".join(f"{p}{i} long" for p in "ab"[:_PLANES] for i in range(_words(n_bands * rows)))
    names = [x.split()[0] for x in schema.split(", ")]
    h = F.xxhash64(text)
    identity = F.coalesce(F.col(doc_id).cast("long"), F.lit(NAMELESS) + F.abs(h % (1 << 61)))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draw = np.random.default_rng(97).integers(1, 2**64, (2, n_bands * rows), dtype=np.uint64)
        draw[0] |= np.uint64(1)
        for batch in batches:
            for first, data, offsets in C.slices(batch.column(2), 400_000):
                codes, n = _sets(C.Words(data, offsets, C.VISIBLE), k)
                full = np.flatnonzero(n)
                at = (np.cumsum(n) - n)[full]
                least = np.zeros((n_bands * rows, len(full)), np.uint64)
                keys, sums = np.zeros((n_bands, len(full)), np.uint64), np.zeros((2, len(n)), np.uint64)
                planes = np.zeros((_PLANES, _words(n_bands * rows), len(n)), np.uint64)
                if len(full):
                    with np.errstate(over="ignore"):
                        for i in range(n_bands * rows):
                            least[i] = np.minimum.reduceat(codes * draw[0, i] + draw[1, i], at)
                        for i in range(n_bands):
                            keys[i] = np.uint64(i)
                            for j in range(rows):
                                keys[i] = C.mix(keys[i] * C._BASE + least[i * rows + j])
                        for i in range(2):
                            sums[i, full] = np.add.reduceat(C.mix(codes + draw[1, i]), at)
                        mixed = C.mix(least)
                    for i in range(n_bands * rows):
                        for p in range(_PLANES):
                            planes[p, i // 64, full] |= ((mixed[i] >> np.uint64(p)) & np.uint64(1)) << np.uint64(i % 64)
                listed = C.lists(C.signed(np.ascontiguousarray(keys.T).ravel()), np.where(n > 0, n_bands, 0))
                held = [c.slice(first, len(n)) for c in batch.columns[:2]]
                flat = [pa.array(C.signed(x)) for x in (*sums, *planes.reshape(-1, len(n)))]
                yield pa.RecordBatch.from_arrays([*held, pa.array(n), *flat[:2], listed, *flat[2:]], names)

    return docs.select(identity.alias("id"), h.alias("h"), F.col(text).alias("text")).mapInArrow(sketch, schema)


def _words(minima: int) -> int:
    return -(-minima // 64)


def _long_signatures(sets: DataFrame) -> DataFrame:
    """Rows (c, planes of ``LONG`` minima) from full sets."""
    names = ["c", *[f"{p}{i}" for p in "ab"[:_PLANES] for i in range(_words(LONG))]]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draw = np.random.default_rng(101).integers(1, 2**64, (2, LONG), dtype=np.uint64)
        draw[0] |= np.uint64(1)
        for batch in batches:
            off = batch.column(1).offsets.to_numpy()
            values = batch.column(1).values.to_numpy().view(np.uint64)
            planes = np.zeros((_PLANES, _words(LONG), len(batch)), np.uint64)
            for r in range(len(batch)):
                least = np.full(LONG, 0xFFFFFFFFFFFFFFFF, np.uint64)
                for at in range(off[r], off[r + 1], 512):
                    some = values[at : min(at + 512, off[r + 1])]
                    np.minimum(least, (some[None, :] * draw[0][:, None] + draw[1][:, None]).min(axis=1), out=least)
                mixed = C.mix(least)
                for p in range(_PLANES):
                    bits = ((mixed >> np.uint64(p)) & np.uint64(1)).reshape(-1, 64)
                    planes[p, :, r] = (bits << np.arange(64, dtype=np.uint64)[None, :]).sum(axis=1, dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(C.signed(np.ascontiguousarray(x))) for x in planes.reshape(-1, len(batch))]], names)

    return sets.mapInArrow(sign, ", ".join(f"{n} long" for n in names))


def _full_sets(docs: DataFrame, doc_id: str, text: str, wanted: DataFrame, k: int) -> DataFrame:
    """Rows (c, codes) for the wanted classes (c, and id and hash of a row of theirs), from the whole texts. A filter of fixed size lets the wanted texts and
    a few others through, so no text is shuffled."""
    h = F.xxhash64(text)
    identity = F.coalesce(F.col(doc_id).cast("long"), F.lit(NAMELESS) + F.abs(h % (1 << 61)))
    both = F.xxhash64("rep", "h")
    packed = C.code_filter(wanted.select(both))
    source = docs.select(identity.alias("rep"), h.alias("h"), F.col(text).alias("text")).select("rep", "h", both.alias("p"), "text")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = C.unpacked(packed)
        for batch in batches:
            batch = batch.filter(pa.array(C.may_hold(bits, batch.column(2).to_numpy().view(np.uint64))))
            for first, data, offsets in C.slices(batch.column(3)):
                codes, n = _sets(C.Words(data, offsets, C.VISIBLE), k)
                held = [c.slice(first, len(n)) for c in batch.columns[:2]]
                yield pa.RecordBatch.from_arrays([*held, C.lists(C.signed(codes), n)], ["rep", "h", "codes"])

    built = source.mapInArrow(build, "rep long, h long, codes array<long>")
    return built.join(wanted, ["rep", "h"]).dropDuplicates(["c"]).select("c", "codes")


def _alike(percent: int, minima: int):
    """Condition on x and y: what they can share at most allows the similarity, and few enough minima disagree."""
    j = percent / 100
    off = (1 - j) * (1 - 0.5**_PLANES)
    slack = math.ceil(minima * off + 5 * math.sqrt(minima * off * (1 - off)))
    parts = []
    for i in range(_words(minima)):
        differ = F.lit(0).cast("long")
        for p in "ab"[:_PLANES]:
            differ = differ.bitwiseOR(F.col(f"x.{p}{i}").bitwiseXOR(F.col(f"y.{p}{i}")))
        parts.append(F.bit_count(differ))
    apart = parts[0]
    for p in parts[1:]:
        apart = apart + p
    most = F.least("x.r", "y.r")
    return (most * 100 >= (F.col("x.n") + F.col("y.n") - most) * percent) & (apart <= slack)


def components(edges: DataFrame) -> DataFrame:
    """Rows (c, component) for every end of ``edges`` (u, v): alternating large-star and small-star until all are stars.

    An edge leads from its larger end u to its smaller end v throughout, so edges that are stars already take no round."""

    def stars(e: DataFrame) -> bool:
        """Whether every end has a single smaller neighbour, which has none."""
        ends = e.select(F.col("u").alias("c"), F.lit(1).alias("leaf")).unionByName(e.select(F.col("v").alias("c"), F.lit(0).alias("leaf")))
        other = ends.groupBy("c").agg(F.sum("leaf").alias("n"), F.min("leaf").alias("least")).where("n > 1 OR (n = 1 AND least = 0)")
        return other.agg(F.count(F.lit(1))).first()[0] == 0

    def star(e: DataFrame, large: bool) -> DataFrame:
        back = e.select(F.col("v").alias("u"), F.col("u").alias("v"))
        side, far = (e.unionByName(back), back) if large else (e, e)
        least = side.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = far.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        if not large:
            out = out.unionByName(least.select("u", F.col("m").alias("v")))
        return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    edges = C.cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while not stars(edges):
        edges = C.cut(star(C.cut(star(edges, True)), False))
    ends = edges.select(F.col("u").alias("c"), F.col("v").alias("component"))
    return ends.unionByName(edges.select(F.col("v").alias("c"), F.col("v").alias("component"))).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = 0.8, shingle: int = 5, rows: int = 5) -> DataFrame:
    """One row per document: id, text_hash (xxhash64 of the text), n_shingles, component_id, kept, links (confirmed
    links of its class) and ``chosen``: whether the row has the id and text that stand for its component."""
    percent = round(similarity * 100)
    n_bands = bands(similarity, rows)
    planes = [f"{p}{i}" for p in "ab"[:_PLANES] for i in range(_words(n_bands * rows))]
    each = C.cut(_sketches(docs, doc_id, text, shingle, n_bands, rows))
    of_class = ["k1", "k2", "n"]
    classes = C.cut(
        each.where("n > 0").groupBy(*of_class).agg(F.min(F.struct("id", "h")).alias("r"), *[F.first(x).alias(x) for x in ("bands", *planes)])
        .select(F.col("r.id").alias("c"), F.col("r.id").alias("rep"), F.col("r.h").alias("h"), *of_class, "bands", *planes)
    )
    # A class is named by its least id. Where one id has several texts, several classes may claim it: those get names of their
    # own, below zero. Classes that share an id are linked.
    claimed = C.cut(classes.groupBy("c").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("c"))
    if not claimed.isEmpty():
        again = classes.join(claimed, "c", "left_semi").withColumn("c", -F.abs(F.xxhash64("k1", "k2", "n") % NAMELESS) - 1)
        classes = C.cut(classes.join(claimed, "c", "left_anti").unionByName(again))
    one = F.struct(*of_class)
    apart = each.where("n > 0").groupBy("id").agg(F.min(one).alias("lo"), F.max(one).alias("hi")).where("lo <> hi").select("id")
    named = each.where("n > 0").join(C.cut(apart), "id").select("id", *of_class).distinct().join(classes.select("c", *of_class), of_class).select("id", "c")
    named = C.cut(named)
    same_id = named.join(named.groupBy("id").agg(F.min("c").alias("v")), "id").select(F.col("c").alias("u"), "v").where("u <> v").distinct()
    members = classes.select("c", F.explode("bands").alias("key"))
    # Sides of joins on a bucket or a shingle are tables: two plain shuffles, which skew handling can split.
    several = C.cut(members.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("key"))
    shared = C.cut(members.join(several, "key"))
    wanted = classes.select("c", "rep", "h").join(shared.select("c").distinct(), "c")
    sets = C.cut(_full_sets(docs, doc_id, text, wanted, shingle))
    # r: shingles that some other class in question has too. What has too few of them can't be linked with anything.
    alone = sets.select("c", F.explode("codes").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("m"), F.min("c").alias("c")).where("m = 1")
    alone = alone.groupBy("c").agg(F.count(F.lit(1)).alias("alone"))
    signs = C.cut(
        classes.join(sets.select("c"), "c", "left_semi").join(alone, "c", "left").withColumn("r", F.col("n") - F.coalesce("alone", F.lit(0)))
        .where(F.col("r") * 100 >= F.col("n") * percent).select("c", "n", "r", *planes)
    )
    shared = C.cut(shared.join(signs.select("c", (1 - F.col("r") / F.col("n")).alias("own")), "c"))
    pivots = C.cut(shared.groupBy("key").agg(F.min(F.struct("own", "c")).alias("p"), F.count(F.lit(1)).alias("m")).where("m > 1").select("key", F.col("p.c").alias("p")))

    # Pairs are tables before they meet the full sets, so no plan holds both joins.
    def confirmed(pairs: DataFrame) -> DataFrame:
        pairs = C.cut(pairs)
        both = F.size(F.array_intersect("x.codes", "y.codes"))
        return C.cut(
            pairs.join(sets.alias("x"), F.col("u") == F.col("x.c")).join(sets.alias("y"), F.col("v") == F.col("y.c"))
            .where(both * 100 >= (F.size("x.codes") + F.size("y.codes") - both) * percent).select("u", "v")
        )

    asked = shared.join(pivots, "key").where("c <> p")
    asked = asked.select(F.least("p", "c").alias("u"), F.greatest("p", "c").alias("v")).distinct()
    asked = asked.join(signs.alias("x"), F.col("u") == F.col("x.c")).join(signs.alias("y"), F.col("v") == F.col("y.c"))
    first = confirmed(asked.where(_alike(percent, n_bands * rows)).select("u", "v"))
    named = components(first)
    placed = C.cut(shared.join(named, "c", "left").select("key", "c", F.coalesce("component", "c").alias("g")))
    mixed = C.cut(placed.groupBy("key").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo < hi").select("key"))
    unsure = C.cut(placed.join(mixed, "key").select("c", "g").distinct())
    # What such a class can share with another one are the shingles that several of them have, and of those it must share
    # ceil(n * similarity). So two of them can only be alike if they share one of their first few in order of rarity.
    told = C.cut(sets.join(unsure, "c").join(signs.select("c", "n"), "c").select("c", "g", "n", F.explode("codes").alias("key")))
    common = C.cut(told.groupBy("key").agg(F.count(F.lit(1)).alias("f")).where("f > 1"))
    by_rarity, whole = W.partitionBy("c").orderBy("f", "key"), W.partitionBy("c")
    first_few = F.row_number().over(by_rarity) <= F.count(F.lit(1)).over(whole) - F.ceil(F.col("n") * percent / 100) + 1
    # A pair may share many of them; where both have few, it meets at the least one only.
    few = F.collect_list("key").over(whole)
    open_ = told.join(common, "key").withColumn("first", first_few).where("first").withColumn("few", few)
    open_ = C.cut(open_.select("key", "c", "g", F.when(F.size("few") <= 64, F.col("few")).alias("few")))
    largest = C.cut(open_.groupBy("key", "g").agg(F.count(F.lit(1)).alias("m")).groupBy("key").agg(F.max_by("g", F.struct("m", "g")).alias("main")))
    longer = C.cut(_long_signatures(sets.join(open_.select("c").distinct(), "c", "left_semi")))
    signed = C.cut(open_.join(largest, "key").join(signs.select("c", "n", "r"), "c").join(longer, "c"))
    x, y = signed.where("g <> main").alias("x"), signed.alias("y")
    # Of a pair of two such classes one order is enough: outside the main component the smaller one asks.
    once = (F.col("y.g") == F.col("x.main")) | (F.col("x.c") < F.col("y.c"))
    here = F.coalesce(F.array_min(F.array_intersect("x.few", "y.few")) == F.col("x.key"), F.lit(True))
    more = (
        x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.g") != F.col("y.g")) & once & _alike(percent, LONG) & here)
        .select(F.least("x.c", "y.c").alias("u"), F.greatest("x.c", "y.c").alias("v")).distinct()
    )
    more = confirmed(more)
    links = C.cut(first.unionByName(more).distinct())
    # The components so far stand for the links they came from.
    named = components(named.select(F.col("c").alias("u"), F.col("component").alias("v")).unionByName(more).unionByName(same_id))
    of = C.cut(classes.select("c", "rep", "h", *of_class).join(named, "c", "left").withColumn("component", F.coalesce("component", "c")))
    # The least id of a component whose name is none.
    least = of.where("component < 0").groupBy("component").agg(F.min("rep").alias("least"))
    of = of.join(least, "component", "left").withColumn("component", F.coalesce("least", "component")).drop("least")
    ends = links.select(F.col("u").alias("c")).unionByName(links.select(F.col("v").alias("c"))).groupBy("c").agg(F.count(F.lit(1)).alias("links"))
    # The row that stands for a component: of its id's rows that with the least hash.
    stands = of.where("component = rep").groupBy("component").agg(F.min("h").alias("_h"))
    chosen = of.join(ends, "c", "left").join(stands, "component", "left").select(
        *of_class, "component", F.coalesce("links", F.lit(0).cast("long")).alias("links"), F.when((F.col("component") == F.col("rep")) & (F.col("h") == F.col("_h")), F.struct(F.col("rep").alias("c"), "h")).alias("r"),
    )
    component = F.coalesce("component", "id")
    real = lambda x: F.when(x < NAMELESS, x)
    return each.select("id", "h", *of_class).join(chosen, of_class, "left").select(
        real(F.col("id")).alias("id"), F.col("h").alias("text_hash"), F.col("n").alias("n_shingles"), real(component).alias("component_id"),
        (component == F.col("id")).alias("kept"), F.coalesce("links", F.lit(0).cast("long")).alias("links"),
        ((F.col("n") == 0) | F.coalesce(F.struct("id", "h") == F.struct(F.col("r.c"), F.col("r.h")), F.lit(False))).alias("chosen"),
    )
