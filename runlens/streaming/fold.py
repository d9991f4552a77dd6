"""Streaming run fold by micro-batches.

Every batch is added to an event log in the shared folder (``streaming.log``), and the runs it touches are folded again by
the batch operator from all their events so far, of which only the buckets of those runs are read. So a late start does not replace a finished run, a late end or
feedback finds its run however long it took, and the first of several starts wins, as in the batch fold. An
end without a start stays in the log and gives no row until its start comes. Work stays inside the JVM, and a
retried batch overwrites its own folders.
(``streaming.stateful`` holds the per-key state variant.)
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.fold import fold_feedback, fold_runs, with_feedback
from ..session import cut_lineage
from .log import EventLog
from .sinks import per_batch, versioned_write


def fold_job(events: DataFrame, out_path: str, log_path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Writes the current row of every run a batch touches below ``out_path``; the latest batch wins."""

    def work(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        log = EventLog(spark, log_path, "run_id", batch.schema)
        log.append(batch, batch_id)
        # the join deals events by run, as both folds need them: nothing is written or shuffled between
        touched = log.events_of(cut_lineage(log.batch(batch_id).select("run_id").distinct()), batch_id + 1)
        versioned_write(with_feedback(fold_runs(touched), fold_feedback(touched)), out_path, batch_id)

    return per_batch(events, checkpoint, work, every)


def latest_rows(rows: DataFrame, key: str = "id") -> DataFrame:
    """The row of the last batch per key."""
    cols = [c for c in rows.columns if c not in (key, "batch")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*cols), "batch").alias("_r")).select(key, "_r.*")
