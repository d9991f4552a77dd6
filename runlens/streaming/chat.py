"""Streaming chat reconciliation.

Every micro-batch goes through the batch operator, which splits busy threads over tasks;
between batches only one small row per thread is carried, as a versioned table in the
given shared folder. A retried batch reads the same version and overwrites its own output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from ..operators.chat import exchange_messages, thread_state
from .sinks import per_batch, versioned_write


def state_before(spark, path: str, batch_id: int) -> DataFrame | None:
    """The state table the previous batch wrote; None before the first batch."""
    if batch_id == 0:
        return None
    try:
        return spark.read.parquet(f"{path}/batch={batch_id - 1}")
    except AnalysisException as e:
        raise RuntimeError(f"state of batch {batch_id - 1} is missing under {path}") from e


def chat_job(messages: DataFrame, out_path: str, state_path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Writes the tagged messages of each batch below ``out_path``; messages of a thread must arrive in
    time order across batches, inside a batch any order will do."""

    def work(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = state_before(spark, state_path, batch_id)
        versioned_write(exchange_messages(batch, carried=before), out_path, batch_id)
        written = spark.read.parquet(f"{out_path}/batch={batch_id}")
        versioned_write(thread_state(written, before), state_path, batch_id)

    return per_batch(messages, checkpoint, work, every)
