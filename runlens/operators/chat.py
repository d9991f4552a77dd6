"""Chat reconciliation: thread messages → exchanges (chat runs).

One exchange is a run of input messages followed by output messages. What a message does
depends only on the message before it: an exchange opens with the first message, a retry,
anything after a custom event, a role that is neither input nor output, or an input after
an output. So the fold is a chunked look-back and a chunked running count; no task ever
holds a thread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .skew import beside_parts, ordered_parts, running_sum, with_neighbour

OUTPUT_ROLES = ("assistant", "tool", "bot")
INPUT_ROLES = ("user", "system")


def side_of(role: Column) -> Column:
    return F.when(role.isin(*OUTPUT_ROLES), "output").when(role.isin(*INPUT_ROLES), "input")


def exchange_messages(messages: DataFrame, carried: DataFrame | None = None) -> DataFrame:
    """Adds exchange (1, 2, … per thread), input_group, side and previous_id to every message.

    ``messages`` has thread_id, id, timestamp, role, content, is_retry and is_custom (both optional).
    ``carried`` is the ``thread_state`` of earlier messages; with it a later batch goes on where the
    last one stopped.
    """
    d = messages
    for c in ("is_retry", "is_custom"):
        if c not in d.columns:
            d = d.withColumn(c, F.lit(False))
    d = d.withColumn("side", F.when(~F.col("is_custom"), side_of(F.col("role"))))
    order = ["timestamp", "id"]
    d = with_neighbour(
        d, ["thread_id"], order,
        {"previous_id": F.col("id"), "_pside": F.coalesce("side", F.lit("other")), "_pcustom": F.col("is_custom")}, keep=True,
    )
    if carried is not None:
        before = carried.select(
            "thread_id", F.col("last_id").alias("_lid"), F.col("last_side").alias("_lside"), F.col("last_custom").alias("_lcustom"),
            F.col("exchange").alias("_e0"), F.col("input_group").alias("_g0"),
        )
        opening = F.col("previous_id").isNull()
        d = d.join(before, "thread_id", "left")
        for now, old in (("_pside", "_lside"), ("_pcustom", "_lcustom"), ("previous_id", "_lid")):
            d = d.withColumn(now, F.when(opening, F.col(old)).otherwise(F.col(now)))
    first = F.col("previous_id").isNull()
    opens = (
        first | F.col("is_custom") | F.col("is_retry") | F.coalesce(F.col("_pcustom"), F.lit(False)) | F.col("side").isNull()
        | ((F.col("side") == "input") & (F.col("_pside") == "output"))
    )
    inherits = F.col("is_retry") & ~F.col("is_custom") & (F.coalesce("side", F.lit("other")) != "input") & ~first
    d = d.withColumn("_open", opens.cast("long")).withColumn("inherits", inherits)
    d = running_sum(
        d, ["thread_id"], order,
        {"exchange": F.col("_open"), "input_group": F.when(F.col("inherits"), 0).otherwise(F.col("_open")).cast("long")},
    )
    if carried is not None:
        for c, start in (("exchange", "_e0"), ("input_group", "_g0")):
            d = d.withColumn(c, F.col(c) + F.coalesce(start, F.lit(0)))
        d = d.drop("_lid", "_lside", "_lcustom", "_e0", "_g0")
    return d.drop("_open", "_pside", "_pcustom")


def thread_state(tagged: DataFrame, carried: DataFrame | None = None) -> DataFrame:
    """What a later batch needs of each thread: last message, its side, and the counters. One row per thread."""
    seq = F.struct("timestamp", "id")
    last = tagged.groupBy("thread_id").agg(
        F.max_by(F.struct(F.col("id").alias("last_id"), F.coalesce("side", F.lit("other")).alias("last_side"), F.col("is_custom").alias("last_custom")), seq).alias("l"),
        F.max("exchange").alias("exchange"), F.max("input_group").alias("input_group"),
    ).select("thread_id", "l.*", "exchange", "input_group")
    if carried is None:
        return last
    return carried.join(last.select("thread_id"), "thread_id", "left_anti").unionByName(last)


def exchanges(tagged: DataFrame) -> DataFrame:
    """One row per exchange: id is the last message received, created_at the first, ended_at the last."""
    seq = F.struct("timestamp", "id")
    optional = [F.max_by(c, F.when(F.col(c).isNotNull(), seq)).alias(c) for c in ("tags", "metadata", "user_id", "feedback") if c in tagged.columns]
    return tagged.groupBy("thread_id", "exchange").agg(
        F.max_by("id", seq).alias("id"), F.min("timestamp").alias("created_at"), F.max("timestamp").alias("ended_at"),
        F.max(F.when(F.col("is_custom"), F.lit("custom-event")).otherwise(F.lit("chat"))).alias("type"),
        F.max("input_group").alias("input_group"), F.max("inherits").alias("inherits"),
        F.min_by(F.when(F.col("is_retry") & ~F.col("is_custom"), F.col("previous_id")), seq).alias("sibling_run_id"),
        F.sum(F.when(F.col("side") == "input", 1).otherwise(0)).alias("own_inputs"),
        F.sum(F.when(F.col("side") == "output", 1).otherwise(0)).alias("outputs"),
        *optional,
    ).withColumnRenamed("thread_id", "parent_run_id")


def chat_messages(tagged: DataFrame) -> DataFrame:
    """Long form of the arrays: (thread_id, exchange, side, timestamp, id, role, content).

    A retry that brings no input takes over the inputs of the exchanges it repeats; those rows
    are added by joining on the input group, which holds one exchange and its retries.
    """
    cols = ("thread_id", "exchange", "side", "timestamp", "id", "role", "content")
    own = tagged.where("side is not null").select(*cols)
    takers = tagged.where("inherits").select("thread_id", "input_group", F.col("exchange").alias("_to")).distinct()
    given = tagged.where("side = 'input'").select("thread_id", "input_group", *cols[1:])
    taken = given.join(takers, ["thread_id", "input_group"]).where(F.col("exchange") < F.col("_to"))
    # exchanges opened later in the same group come from a retry; all are repeats of the first
    taken = taken.withColumn("exchange", F.col("_to")).select(*cols)
    return own.unionByName(taken)


def chat_runs(messages: DataFrame) -> DataFrame:
    """Exchanges with their input and output messages in parts: an exchange with more messages on a side than a part
    holds has a row per part. ``chat_messages`` has the same messages as rows."""
    tagged = cut_lineage(exchange_messages(messages))
    long = chat_messages(tagged).withColumnRenamed("thread_id", "parent_run_id")
    item, order = F.struct("role", "content"), ["timestamp", "id"]
    keys = ["parent_run_id", "exchange"]
    ins = ordered_parts(long.where("side = 'input'"), keys, item, order, "input")
    outs = ordered_parts(long.where("side = 'output'"), keys, item, order, "output")
    return beside_parts(exchanges(tagged), keys, ins, outs).drop("input_group", "own_inputs")


def thread_runs(messages: DataFrame) -> DataFrame:
    """The parent thread of every message: its input is the last message, its user and tags the latest."""
    seq = F.struct("timestamp", "id")
    optional = [F.max_by(c, seq).alias(c) for c in ("user_id", "thread_tags") if c in messages.columns]
    return messages.groupBy(F.col("thread_id").alias("id")).agg(
        F.min("timestamp").alias("created_at"), F.max_by(F.to_json(F.struct("role", "content")), seq).alias("input"), *optional
    ).withColumn("type", F.lit("thread"))
