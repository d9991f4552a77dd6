"""Incremental sinks and streaming jobs that reuse the batch operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..session import cut_lineage


def _writer(stream: DataFrame, checkpoint: str, every: str | None):
    w = stream.writeStream.option("checkpointLocation", checkpoint)
    return w.trigger(processingTime=every) if every else w.trigger(availableNow=True)


def replicate(stream: DataFrame, path: str, checkpoint: str, ts: str = "created_at", every: str | None = None) -> StreamingQuery:
    """Append a stream to Parquet partitioned by project and date; exactly once through the file sink's log."""
    dated = stream.withColumn("date", F.to_date(ts))
    return _writer(dated, checkpoint, every).format("parquet").outputMode("append").partitionBy("project_id", "date").option("path", path).start()


def replicate_changes(
    stream: DataFrame, path: str, checkpoint: str, key: str = "id", version: str = "updated_at", deleted: str = "is_deleted", buckets: int = 64, every: str | None = None
) -> StreamingQuery:
    """Keep a table at ``path`` like a changing source: rows of ``stream`` are changes, the latest ``version`` of a key wins (of
    equal ones a deletion, then the later batch), whatever order they come in.

    The table is partitioned into buckets of the key's hash. A batch is reduced to one row per key, and only the buckets it touches
    are read and written again, as a new generation beside the old one; ``current`` reads the newest generation of every
    bucket. A deletion stays as a tombstone, so an older change that comes later can't undo it. A retried batch writes the
    same generation.
    """
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")

    def work(batch: DataFrame, batch_id: int) -> None:
        new = cut_lineage(batch.withColumn("_bucket", bucket).withColumn("_batch", F.lit(batch_id).cast("long")))
        spark, touched = batch.sparkSession, [r[0] for r in new.select("_bucket").distinct().collect()]  # at most ``buckets``
        if not touched:
            return
        old = _generation(spark, path, batch_id, touched)
        both = new if old is None else new.unionByName(old.select(*new.columns))
        row = F.struct(*[c for c in new.columns if c not in (key, "_bucket")])
        order = F.struct(F.col(version), F.coalesce(F.col(deleted), F.lit(False)), F.col("_batch"), F.xxhash64(*[c for c in batch.columns]))
        merged = both.groupBy(key, "_bucket").agg(F.max_by(row, order).alias("_r")).select(key, "_bucket", "_r.*")
        merged.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/generation={batch_id}")
        _drop_replaced(spark, path, batch_id, touched)

    return per_batch(stream, checkpoint, work, every)


def _folders(spark, path: str) -> dict[tuple[int, int], str]:
    """(generation, bucket) → folder."""
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = {}
    for g in fs.listStatus(top) if fs.exists(top) else ():
        if g.getPath().getName().startswith("generation="):
            for b in fs.listStatus(g.getPath()):
                if b.getPath().getName().startswith("_bucket="):
                    found[int(g.getPath().getName()[11:]), int(b.getPath().getName()[8:])] = b.getPath().toString()
    return found


def _generation(spark, path: str, before: int | None, buckets: list[int] | None) -> DataFrame | None:
    """The newest generation of the buckets, of those before a batch."""
    newest: dict[int, tuple[int, str]] = {}
    for (g, b), folder in _folders(spark, path).items():
        if (before is None or g < before) and (buckets is None or b in buckets) and newest.get(b, (-1, ""))[0] < g:
            newest[b] = g, folder
    if not newest:
        return None
    return spark.read.option("basePath", path).parquet(*[folder for _, folder in newest.values()]).drop("generation")


def _drop_replaced(spark, path: str, batch_id: int, touched: list[int]) -> None:
    """Deletes generations of the touched buckets that two later ones have replaced: readers may still be at the last one, and
    a retried batch reads the one before its own."""
    folders, conf = _folders(spark, path), spark.sparkContext._jsc.hadoopConfiguration()
    for b in touched:
        for g in sorted(g for g, x in folders if x == b)[:-2]:
            gone = spark._jvm.org.apache.hadoop.fs.Path(folders[g, b])
            gone.getFileSystem(conf).delete(gone, True)


def current(spark, path: str, deleted: str = "is_deleted") -> DataFrame:
    """The replicated table as it stands, without deleted rows."""
    found = _generation(spark, path, None, None)
    if found is None:
        raise FileNotFoundError(path)
    return found.where(~F.coalesce(F.col(deleted), F.lit(False))).drop("_bucket", "_batch")


def per_batch(stream: DataFrame, checkpoint: str, work: Callable[[DataFrame, int], None], every: str | None = None) -> StreamingQuery:
    return _writer(stream, checkpoint, every).foreachBatch(work).start()


def versioned_write(df: DataFrame, path: str, batch_id: int, keys: list[str] | None = None) -> None:
    """Idempotent batch output: a retried batch overwrites its own folder."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*keys) if keys else w).parquet(f"{path}/batch={batch_id}")


def metadata_key_job(stream: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Distinct metadata keys per batch; readers take ``distinct`` over the batches."""
    from ..operators.facets import metadata_keys

    return per_batch(stream, checkpoint, lambda df, i: versioned_write(metadata_keys(df), path, i), every)


def evaluator_job(
    stream: DataFrame, results_path: str, checkpoint: str, score: Callable[[DataFrame], DataFrame], todo: Callable[[DataFrame], DataFrame], every: str | None = None
) -> StreamingQuery:
    """Each micro-batch of runs is filtered to the backlog and scored; results are appended idempotently."""
    return per_batch(stream, checkpoint, lambda df, i: versioned_write(score(todo(df)), results_path, i), every)


def windowed_metric_stream(runs: DataFrame, keys: list[str], minutes: int, late: str = "10 minutes") -> DataFrame:
    """Per-minute sums with a watermark; the trailing sum is taken downstream by ``alerts.trailing`` sums."""
    flagged = runs.withWatermark("created_at", late)
    return flagged.groupBy(*keys, F.window("created_at", f"{minutes} minutes", "1 minute").alias("w")).agg(
        F.count(F.lit(1)).alias("runs"), F.sum(F.when(F.col("error").isNotNull(), 1).otherwise(0)).alias("errors"), F.sum("cost").alias("cost")
    ).select(*keys, F.col("w.end").alias("window_end"), "runs", "errors", "cost")
