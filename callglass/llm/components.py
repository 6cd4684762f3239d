"""Connected components of links, by rounds of two star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callglass.session import scratch_path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared scratch folder and read back: cuts the lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def least_neighbour(links: DataFrame) -> DataFrame:
    """``links`` (u, v) with ``m``, the least of u and its neighbours."""
    least = links.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return links.join(least, "u")


def connected(links: DataFrame) -> DataFrame:
    """``node`` and ``component``, the smallest node that links (``a``, ``b``) reach.

    Each round hangs larger neighbours, then smaller ones, below the least. It ends when
    only stars are left; the number of rounds grows with the logarithm of the longest path.
    Minima are combined before they travel, and joins split a node with very many links.
    """
    now = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    now = stored(now, "links")
    while not stars(now):
        both = now.union(now.select("v", "u"))
        large = least_neighbour(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = least_neighbour(large)
        now = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        now = stored(now, "links")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())


def stars(links: DataFrame) -> bool:
    """Whether each node is either a centre or hangs below one centre; every link (u, v) has v < u."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("centre")).union(links.select("v", F.lit(0), F.lit(1)))
    by = ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("centre").alias("centre"))
    return by.where("below > 1 or below = 1 and centre = 1").limit(1).count() == 0
