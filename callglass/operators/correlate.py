"""Which reply belongs to which call, by conversation and time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callglass.operators.blocks import ROWS, evenly, last_before


def replies_to_calls(calls: DataFrame, replies: DataFrame, block: str | None = None, rows: int = ROWS) -> DataFrame:
    """Adds ``reply_id`` and ``candidate_replies`` to every call.

    A reply belongs to the last call of its conversation that started at or before
    it, provided that call had completed. So each reply has one call at most. A call
    with several replies is ambiguous and keeps a null ``reply_id``.

    One pass over the union of both sides, in order of conversation and time and cut
    into blocks of about ``rows`` rows: no range join, and a conversation of any length,
    in an hour or a year, spreads over its blocks. With ``block``, a unit of time, blocks are
    stretches of time instead; that needs no ordering of all rows, and suits calls spread
    evenly in time.
    """
    starts = calls.where(F.col("conversation_id").isNotNull()).select(
        "conversation_id", F.col("started_at").alias("at"), F.lit(0).alias("kind"),
        F.struct("id", "completed_at").alias("call"), F.col("id").alias("ref"),
    )
    said = replies.select(
        "conversation_id", F.col("created_at").alias("at"), F.lit(1).alias("kind"),
        F.lit(None).cast(starts.schema["call"].dataType).alias("call"), F.col("reply_id").alias("ref"),
    )
    order = ["at", "kind", "ref"]
    both = starts.unionByName(said)
    if block is None:
        both = evenly(both, [F.col(c) for c in ("conversation_id", *order)], rows).withColumnRenamed("_block", "part")
        line = last_before(both, ["conversation_id"], order, "call", F.col("part"), "latest")
    else:
        line = last_before(both, ["conversation_id"], order, "call", F.date_trunc(block, "at"), "latest")
    found = (
        line.where((F.col("kind") == 1) & (F.col("at") >= F.col("latest.completed_at")))
        .groupBy(F.col("latest.id").alias("id"))
        .agg(F.count(F.lit(1)).alias("candidate_replies"), F.min("ref").alias("_only"))
    )
    return (
        calls.join(found, "id", "left")
        .withColumn("reply_id", F.when(F.col("candidate_replies") == 1, F.col("_only")))
        .withColumn("candidate_replies", F.coalesce("candidate_replies", F.lit(0)))
        .drop("_only")
    )
