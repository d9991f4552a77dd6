"""The corpus pipeline: toxicity, quality, near-duplicates, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs. All
but the last return the columns of docs; the last one returns the mix, a row per document that is left.

Rows are told apart by id (any integer type) and text, so null and repeated ids pass through, as do extra columns, whatever
their names. Of equal texts the row with the least id stays; a row that occurs several times as a whole stays once. Very long
texts are worked on whole. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.llm import common as C
from runlens.llm import decontam, mixing, neardup, quality, toxicity
from runlens.session import configure

#: Some stages have no SQL form (trained models); tests hold the pipeline against its operators and plain versions.
ORACLE_SQL = None


def _rows(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """The rows of docs whose (doc_id, text) is (left_semi) or isn't (left_anti) among keys (_id, _hash).

    A filter of fixed size tells which rows may be; only those meet the keys, so no other text is shuffled."""
    packed = C.code_filter(keys.select(F.xxhash64(F.col("_id").cast("long"), "_hash")))

    @F.arrow_udf("boolean")
    def maybe(code: pa.Array) -> pa.Array:
        return pa.array(C.may_hold(C.unpacked(packed), code.to_numpy().view(np.uint64)))

    asked = maybe(F.xxhash64(F.col("doc_id").cast("long"), F.xxhash64("text")))
    i, h = C.fresh(docs, "_id"), C.fresh(docs, "_hash")
    own = keys.select(F.col("_id").cast("long").alias(i), F.col("_hash").alias(h))
    met = docs.where(asked).join(own, F.col("doc_id").cast("long").eqNullSafe(F.col(i)) & (F.xxhash64("text") == F.col(h)), how)
    return met if how == "left_semi" else met.unionByName(docs.where(~asked))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain calls toxic go."""
    chain = toxicity.train(docs, C.table(configure(spark), sf_dir, "labels"))
    out = C.fresh(docs, "toxicity")
    return toxicity.toxicity(docs, chain, out=out).where(F.col(out)["toxic"] < 0.5).select(*docs.columns)


def drop_bad(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field calls bad go."""
    field = quality.train(docs, C.table(configure(spark), sf_dir, "labels"))
    score = C.fresh(docs, "score")
    return quality.quality(docs, field, score=score).where(F.col(score) >= 0.5).select(*docs.columns)


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays (similarity 0.8 over five-word shingles), that with the least id."""
    configure(spark)
    found = neardup.near_duplicates(docs.select("doc_id", "text")).select(F.col("id").alias("_id"), F.col("text_hash").alias("_hash"), "chosen", "n_shingles")
    found = C.cut(found)
    left = _rows(docs, C.cut(found.where(~F.col("chosen")).select("_id", "_hash").distinct()), "left_anti")
    # A chosen row that occurs several times as a whole stays once.
    again = C.cut(found.where("chosen AND n_shingles > 0").groupBy("_id", "_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_id", "_hash"))
    if again.isEmpty():
        return left
    return _rows(left, again, "left_anti").unionByName(_rows(left, again, "left_semi").dropDuplicates(["doc_id", "text"]))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten words in a row of a benchmark item, or a whole shorter item, go."""
    known = docs.select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_hash"), "text")
    found = decontam.contamination(known, C.table(configure(spark), sf_dir, "benchmark"), keep=("_id", "_hash"))
    return _rows(docs, C.cut(found.where("contaminated").select("_id", "_hash").distinct()), "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of every document that is left."""
    configure(spark)
    return mixing.mix(docs, keep=("lang",))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_bad),
    ("near_duplicates", keep_one),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = C.table(configure(spark), sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = C.cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
