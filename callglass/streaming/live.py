"""Live views: counts that follow the log at once, rollups that close with the watermark, the chunk stream.

``keep_counts`` stores for each micro-batch what it adds to every minute: sparse histograms of
the measured values, which add up. Open minutes show at once, a call of any lateness is
added to its own minute, and percentiles are exact, all without reading the log again.
``rollup`` is the plain form with a watermark; there the log stays the truth for later rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from callglass.operators import chunks as K, metrics

COUNTS = "bucket timestamp, provider string, model string, latency_ms int, ttft_ms int, _by_latency boolean, _n long, _errors long, _cancels long, _in long, _out long, batch long"


def write_counts(calls: DataFrame, path: str, batch_id: int) -> None:
    """What one batch adds. A batch that runs again replaces its own rows."""
    rows = metrics.minute_counts(calls).withColumn("batch", F.lit(batch_id).cast("long"))
    rows.select(*[c.split()[0] for c in COUNTS.split(", ")]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def keep_counts(calls: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Follows a stream of calls; without ``every`` it takes what is there and stops."""
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return (
        calls.writeStream.foreachBatch(lambda df, n: write_counts(df, path, n))
        .option("checkpointLocation", checkpoint).trigger(**trigger).start()
    )


def counts(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """The counts of all batches, from the minute ``since`` on."""
    rows = spark.read.schema(COUNTS).parquet(path)
    return rows if since is None else rows.where(F.col("bucket") >= F.date_trunc("minute", metrics.as_timestamp(since)))


def summary(spark: SparkSession, path: str, since: str | None = None, interval: str = "minute") -> DataFrame:
    """Totals, series and providers as they are now."""
    return metrics.parts_from_counts(counts(spark, path, since), interval)


def rollup(calls: DataFrame, interval: str = "1 minute", lateness: str = "10 minutes") -> DataFrame:
    """Counts and sums per bucket of ``completed_at``, never of the landing time.

    Percentiles do not merge across buckets and are left to the log.
    """
    status = F.col("status")
    return (
        calls.withWatermark("completed_at", lateness)
        .groupBy(F.window("completed_at", interval))
        .agg(
            F.count(F.lit(1)).alias("requests"),
            F.count_if(status == "error").alias("errors"),
            F.count_if(status == "cancelled").alias("cancellations"),
            F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"),
            F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
        )
        .select(F.col("window.start").alias("bucket"), "requests", "errors", "cancellations", "input_tokens", "output_tokens")
    )


def late_calls(calls: DataFrame, closed: DataFrame, interval: str = "minute") -> DataFrame:
    """Calls of the log that a closed live bucket lacks, counted per bucket."""
    real = calls.groupBy(F.date_trunc(interval, "completed_at").alias("bucket")).agg(F.count(F.lit(1)).alias("in_log"))
    both = closed.select("bucket", "requests").join(real, "bucket")
    return both.select("bucket", (F.col("in_log") - F.col("requests")).alias("late")).where("late > 0")


def fold_stream(chunks: DataFrame, gap: str = "2 minutes", lateness: str = "1 minute", run: int = K.RUN) -> DataFrame:
    """First level of the chunk fold on a stream, emitted when a run has been quiet for ``gap``.

    State is bounded by ``run`` chunks per key. A call that pauses longer comes out as
    several rows of one run, which the second level puts back in order.
    """
    watched = chunks.withWatermark("emitted_at", lateness)
    return K.fold_runs(watched, run, F.session_window("emitted_at", gap).alias("session")).drop("session")


def to_table(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends closed rows to Parquet files, exactly once, with what is there now."""
    return (
        rows.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )
