"""Small helpers over DataFrames."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def built_once(build):
    """Keeps what a function of plain arguments builds, per application.

    Columns name their inputs only, so they serve any frame. Long ones take thousands
    of calls into the JVM to put together, which every micro-batch would pay again.
    """
    kept: dict = {}

    @wraps(build)
    def get(*args):
        key = (SparkSession.active().sparkContext.applicationId, *args)
        if key not in kept:
            kept[key] = build(*args)
        return kept[key]

    return get


def once(**columns: Column) -> Column:
    """The generator behind ``compute_once``, as one column to select."""
    return F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))


def compute_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds costly columns so that they are evaluated once per row.

    A filter on a plain projected column moves below the projection and takes a copy
    of its expression along; chained, such copies multiply. Columns that come out of
    a generator stay where they are. The generator yields one row per row.
    """
    return df.select("*", once(**columns))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Spreads a scan of few parts over all cores, before heavy work per row.

    A small table in one row group is one task otherwise. A scan that already has a
    part per core, as any large table has, is returned as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.isStreaming or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys)
