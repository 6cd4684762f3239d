"""Bounded retention of streams and tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Numbers per block when looking for the cut-off.
BLOCK = 65_536


def newest(rows: DataFrame, keep: int, order: str = "delivery_id", block: int = BLOCK) -> DataFrame:
    """The ``keep`` rows with the highest ``order`` (a unique whole number).

    Rows are counted per block of numbers; the newest blocks, at most ``keep`` of
    them, show where the cut lies. Only the block that holds the cut is ranked, so
    no task ever gathers ``keep`` rows from every partition.
    """
    blocks = rows.select(F.floor(F.col(order) / F.lit(block)).alias("block")).groupBy("block").agg(
        F.count(F.lit(1)).alias("n")
    )
    top = blocks.orderBy(F.desc("block")).limit(keep)
    newer = F.coalesce(F.sum("n").over(W.orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cut = top.withColumn("newer", newer).where(F.col("newer") < keep).agg(
        F.min(F.struct("block", (F.lit(keep) - F.col("newer")).alias("want"))).alias("at")
    )
    at = cut.scalar()
    first = at["block"] * F.lit(block)
    above = rows.where(F.col(order) >= first + F.lit(block))
    rank = F.row_number().over(W.orderBy(F.desc(order)))
    edge = rows.where((F.col(order) >= first) & (F.col(order) < first + F.lit(block))).withColumn("_rank", rank)
    return above.unionByName(edge.where(F.col("_rank") <= at["want"]).drop("_rank"))


def younger_than(rows: DataFrame, time: str, as_of: datetime | str, days: int) -> DataFrame:
    """Rows of the last ``days`` days."""
    return rows.where(F.col(time) >= F.lit(str(as_of)).cast("timestamp") - F.expr(f"interval {int(days)} days"))
