"""Ordered computations within a key that may hold a large share of all rows.

A window partitioned by such a key would run in one task. Here each key is cut
into blocks along its order; the windows run per (key, block), and only one
summary row per block is windowed per key.

A block may be a stretch of time or of numbers, which is cheap but as uneven as the data.
``evenly`` cuts blocks of equal numbers of rows instead, at any order and however many rows
share a moment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from callglass.session import scratch_path

#: Rows in a block of ``evenly``.
ROWS = 500_000


def evenly(df: DataFrame, order: list[Column], rows: int = ROWS) -> DataFrame:
    """``df`` with ``_block`` and ``_inside``: its block in ``order`` and its place there, from 1 on.

    Ranges of ``order`` hold about ``rows`` rows each; ties beyond a block's size must be
    broken by a further column of ``order``. Range borders are sampled, so the result is
    written to the shared scratch folder: read twice, it is the same twice.
    """
    spark = df.sparkSession
    parts = max(1, -(-df.count() // rows))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    number = F.monotonically_increasing_id()  # the partition, then the row within it
    path = scratch_path(spark, "blocks")
    cut = ranged.withColumns({"_block": F.shiftright(number, 33), "_inside": number.bitwiseAND(F.lit((1 << 33) - 1)) + F.lit(1)})
    cut.write.parquet(path)
    return spark.read.schema(cut.schema).parquet(path)


def even_positions(df: DataFrame, order: list[Column], name: str = "position", rows: int = ROWS) -> DataFrame:
    """1-based row number in ``order`` over all rows: counts per block, summed over the blocks before."""
    cut = evenly(df, order, rows)
    before = F.sum("_n").over(W.orderBy("_block").rowsBetween(W.unboundedPreceding, -1))
    counts = cut.groupBy("_block").agg(F.count(F.lit(1)).alias("_n"))  # one row per block
    offsets = counts.select("_block", F.coalesce(before, F.lit(0)).alias("_before"))
    return cut.join(F.broadcast(offsets), "_block").withColumn(name, F.col("_before") + F.col("_inside")).drop("_block", "_inside", "_before")


def positions(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    block: Column,
    name: str = "position",
    descending_blocks: bool = False,
    start: DataFrame | None = None,
) -> DataFrame:
    """1-based row number within ``keys``, equal to a plain ``row_number``.

    ``block`` must not change direction along ``order``: with whole numbers it is
    the number divided by a block length, with times the truncated time. ``start``
    (``keys`` and a column ``start``) is added to the numbers of its key; it is joined
    to the block summaries, so the rows themselves never gather by key.
    """
    df = df.withColumn("_block", block)
    by_block = F.col("_block").desc() if descending_blocks else F.col("_block").asc()
    before = W.partitionBy(*keys).orderBy(by_block).rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        df.groupBy(*keys, "_block")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    if start is not None:
        offsets = offsets.join(start, keys, "left").select(
            *keys, "_block", (F.col("_before") + F.coalesce("start", F.lit(0))).alias("_before")
        )
    inside = F.row_number().over(W.partitionBy(*keys, "_block").orderBy(*order))
    return (
        df.withColumn("_inside", inside)
        .join(offsets, [*keys, "_block"])
        .withColumn(name, F.col("_before") + F.col("_inside"))
        .drop("_block", "_inside", "_before")
    )


def last_before(
    df: DataFrame, keys: list[str], order: list[str], value: str, block: Column, name: str
) -> DataFrame:
    """Last non-null ``value`` at or before each row within ``keys``, in ``order``."""
    df = df.withColumn("_block", block)
    inside = W.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    earlier = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    has = F.col(value).isNotNull()
    carried = (
        df.groupBy(*keys, "_block")
        .agg(F.max(F.when(has, F.struct(*order, value))).alias("_last"))
        .select(*keys, "_block", F.last(F.col(f"_last.{value}"), ignorenulls=True).over(earlier).alias("_carried"))
        .where(F.col("_carried").isNotNull())
    )
    return (
        df.withColumn("_own", F.last(value, ignorenulls=True).over(inside))
        .join(carried, [*keys, "_block"], "left")
        .withColumn(name, F.coalesce("_own", "_carried"))
        .drop("_block", "_own", "_carried")
    )
