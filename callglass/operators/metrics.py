"""Dashboard aggregates over the call log, bucketed on ``completed_at``.

Percentiles are exact. A group may hold a large share of all rows, so rows are
first counted per (group, measured value), which combines map-side and spreads
one group over all reducers; the percentile then runs over those counts. The
last step sees one row per distinct millisecond value of a group, not one per call.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callglass import schema as S
from callglass.functions import measures as M


def as_timestamp(moment: datetime | str | Column) -> Column:
    return moment if isinstance(moment, Column) else F.lit(str(moment)).cast("timestamp")


def since(calls: DataFrame, moment: datetime | str) -> DataFrame:
    """Calls that ended at ``moment`` or later; prunes date partitions where there are any."""
    start = as_timestamp(moment)
    if "completed_date" in calls.columns:
        calls = calls.where(F.col("completed_date") >= start.cast("date"))
    return calls.where(F.col("completed_at") >= start)


def window_start(as_of: datetime | str, minutes: int = S.DEFAULT_WINDOW_MINUTES) -> Column:
    """Start of the window of ``minutes`` that ends at ``as_of``."""
    if not 1 <= minutes <= S.MAX_WINDOW_MINUTES:
        raise ValueError(f"window must be 1 to {S.MAX_WINDOW_MINUTES} minutes, not {minutes}")
    return as_timestamp(as_of) - F.expr(f"interval {int(minutes)} minutes")


def last_minutes(calls: DataFrame, as_of: datetime | str, minutes: int = S.DEFAULT_WINDOW_MINUTES) -> DataFrame:
    return since(calls, window_start(as_of, minutes))


def _counts(calls: DataFrame, keys: list[str]) -> DataFrame:
    """One row per (keys, latency) and one per (keys, ttft), with the counters beside the former."""
    status = F.col("status")
    return (
        calls.select(
            *keys, "latency_ms", "ttft_ms", "input_tokens", "output_tokens",
            (status == "error").cast("int").alias("_e"), (status == "cancelled").cast("int").alias("_c"),
        )
        .groupingSets([[*keys, "latency_ms"], [*keys, "ttft_ms"]], *keys, "latency_ms", "ttft_ms")
        .agg(
            (F.grouping_id() == 1).alias("_by_latency"),
            F.count(F.lit(1)).alias("_n"),
            F.sum("_e").alias("_errors"),
            F.sum("_c").alias("_cancels"),
            F.sum("input_tokens").alias("_in"),
            F.sum("output_tokens").alias("_out"),
        )
    )


def _measures() -> list[Column]:
    """Aggregates over the rows of ``_counts``."""
    main = F.col("_by_latency")

    def total(name: str, alias: str) -> Column:
        return F.coalesce(F.sum(F.when(main, F.col(name))), F.lit(0)).alias(alias)

    shares = F.array(F.lit(0.5), F.lit(0.95))
    latency = F.percentile(F.when(main, F.col("latency_ms")), shares, F.col("_n"))
    ttft = F.percentile(F.when(~main, F.col("ttft_ms")), shares, F.col("_n"))
    return [
        total("_n", "requests"),
        total("_errors", "errors"),
        total("_cancels", "cancellations"),
        total("_in", "input_tokens"),
        total("_out", "output_tokens"),
        latency.alias("_latency"),
        ttft.alias("_ttft"),
    ]


def _finish(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    values = {
        "p50_latency_ms": M.to_whole(F.col("_latency")[0]),
        "p95_latency_ms": M.to_whole(F.col("_latency")[1]),
        "p50_ttft_ms": M.to_whole(F.col("_ttft")[0]),
        "p95_ttft_ms": M.to_whole(F.col("_ttft")[1]),
        "error_rate": M.rate(F.col("errors"), F.col("requests")),
        "successes": F.col("requests") - F.col("errors") - F.col("cancellations"),
    }
    return df.select(*keys, *[values.get(c, F.col(c)).alias(c) for c in columns])


TOTALS = ["requests", "errors", "cancellations", "error_rate", "p50_latency_ms", "p95_latency_ms",
          "p95_ttft_ms", "input_tokens", "output_tokens"]
SERIES = ["requests", "errors", "cancellations", "successes", "p50_latency_ms", "p95_latency_ms", "p50_ttft_ms"]
BREAKDOWN = ["requests", "errors", "cancellations", "p50_latency_ms", "p95_latency_ms", "p95_ttft_ms",
             "input_tokens", "output_tokens"]


def totals(calls: DataFrame) -> DataFrame:
    """One row; zeros and nulls when there are no calls."""
    return _finish(_counts(calls, []).agg(*_measures()), [], TOTALS)


def check_interval(interval: str, allowed: tuple[str, ...] = S.INTERVALS) -> str:
    if interval not in allowed:
        raise ValueError(f"unsupported interval: {interval!r}")
    return interval


def time_series(calls: DataFrame, interval: str = "minute") -> DataFrame:
    """One row per non-empty bucket, oldest first."""
    check_interval(interval)
    calls = calls.withColumn("bucket", F.date_trunc(interval, "completed_at"))
    out = _counts(calls, ["bucket"]).groupBy("bucket").agg(*_measures())
    return _finish(out, ["bucket"], SERIES).orderBy("bucket")


def by_provider(calls: DataFrame) -> DataFrame:
    """One row per provider and model, busiest first."""
    keys = ["provider", "model"]
    out = _counts(calls, keys).groupBy(*keys).agg(*_measures())
    return _finish(out, keys, BREAKDOWN).orderBy(F.desc("requests"), *keys)


def by_provider_and_total(calls: DataFrame) -> DataFrame:
    """The breakdown and the totals (null provider and model) from one scan."""
    keys = ["provider", "model"]
    out = (
        _counts(calls, keys)
        .groupingSets([keys, []], *keys)
        .agg(F.grouping_id().alias("_level"), *_measures())
        .withColumn("is_total", F.col("_level") > 0)
    )
    return _finish(out, ["is_total", *keys], BREAKDOWN)


def window_presets(calls: DataFrame, as_of: datetime | str, presets: tuple = S.WINDOW_PRESETS) -> DataFrame:
    """Totals of every preset window in one job; a window without calls shows zeros."""
    rows = ", ".join(f"('{p}', {int(m)}, '{i}')" for p, m, i in presets)
    shown = calls.sparkSession.sql(f"select * from values {rows} as t(preset, minutes, interval)")
    options = F.array(*[F.struct(F.lit(p).alias("preset"), window_start(as_of, m).alias("start")) for p, m, _ in presets])
    longest = max(m for _, m, _ in presets)
    tagged = (
        last_minutes(calls, as_of, longest)
        .withColumn("_in_windows", F.filter(options, lambda o: F.col("completed_at") >= o["start"]))
        .withColumn("preset", F.explode(F.col("_in_windows.preset")))
    )
    found = _finish(_counts(tagged, ["preset"]).groupBy("preset").agg(*_measures()), ["preset"], TOTALS)
    zero = ["requests", "errors", "cancellations", "input_tokens", "output_tokens", "error_rate"]
    return shown.join(found, "preset", "left").fillna(0, subset=zero)


def health(calls: DataFrame, raw_state: DataFrame, as_of: datetime | str) -> DataFrame:
    """Is the pipeline moving? One row over the whole tables, no window.

    Each side is reduced to one row, then both are folded into one.
    """
    log_side = calls.agg(F.max("ingested_at").alias("last_ingested_at"), F.count(F.lit(1)).alias("logs_total"))
    status = F.col("processing_status")
    raw_side = raw_state.agg(
        F.count(F.lit(1)).alias("raw_events_total"),
        F.count_if(status == "pending").alias("raw_events_pending"),
        F.count_if(status == "failed").alias("raw_events_failed"),
    )
    both = log_side.unionByName(raw_side, allowMissingColumns=True)
    one = both.agg(*[F.max(c).alias(c) for c in both.columns])
    lag = (F.unix_micros(as_timestamp(as_of)) - F.unix_micros("last_ingested_at")) / F.lit(1e6)
    one = one.withColumn("lag_seconds", lag)
    stalled = F.coalesce(F.col("lag_seconds") > S.STALLED_AFTER_SECONDS, F.lit(False))
    return one.withColumn("is_stalled", stalled).withColumn("tone", ingestion_tone())


def ingestion_tone(lag: str = "lag_seconds") -> Column:
    return (
        F.when(F.col(lag).isNull(), "idle").when(F.col(lag) > S.STALLED_AFTER_SECONDS, "critical").otherwise("good")
    )


def alerts(totals_row: DataFrame, health_row: DataFrame) -> DataFrame:
    """The tiles that carry a tone: error rate, pipeline, failed events."""
    critical = lambda cond: F.when(cond, "critical").otherwise("neutral")
    rate = totals_row.select(
        F.lit("error_rate").alias("alert"),
        F.col("error_rate").cast("double").alias("value"),
        critical(F.col("error_rate") > S.CRITICAL_ERROR_RATE).alias("tone"),
    )
    rows = F.array(
        F.struct(F.lit("ingestion_lag").alias("alert"), F.col("lag_seconds").alias("value"), F.col("tone")),
        F.struct(
            F.lit("failed_events").alias("alert"),
            F.col("raw_events_failed").cast("double").alias("value"),
            critical(F.col("raw_events_failed") > 0).alias("tone"),
        ),
    )
    return rate.unionByName(health_row.select(F.inline(rows)))


@dataclass(frozen=True)
class Summary:
    """What one dashboard refresh shows."""

    window_minutes: int
    interval: str
    totals: DataFrame
    series: DataFrame
    providers: DataFrame
    ingestion: DataFrame


def summary(
    calls: DataFrame,
    raw_state: DataFrame,
    as_of: datetime | str,
    window_minutes: int = S.DEFAULT_WINDOW_MINUTES,
    interval: str = "minute",
) -> Summary:
    check_interval(interval, S.DASHBOARD_INTERVALS)
    window = last_minutes(calls, as_of, window_minutes)
    return Summary(
        window_minutes, interval, totals(window), time_series(window, interval), by_provider(window),
        health(calls, raw_state, as_of),
    )


#: Parts of a summary, and the measures each row of it has.
PARTS = ["requests", "errors", "cancellations", "successes", "error_rate", "p50_latency_ms", "p95_latency_ms", "p50_ttft_ms", "p95_ttft_ms",
         "input_tokens", "output_tokens"]


def summary_parts(calls: DataFrame, as_of: datetime | str, window_minutes: int = S.DEFAULT_WINDOW_MINUTES, interval: str = "minute") -> DataFrame:
    """Totals, series and providers of a window from one scan of it.

    ``part`` is ``total``, ``series`` (with ``bucket``) or ``provider`` (with ``provider`` and
    ``model``). The scan counts calls per measured value for buckets and for providers;
    the counts of the providers serve the total too. An empty window has a total of zeros.
    """
    check_interval(interval, S.DASHBOARD_INTERVALS)
    window = last_minutes(calls, as_of, window_minutes).withColumn("bucket", F.date_trunc(interval, "completed_at"))
    status, model = F.col("status"), ["provider", "model"]
    sets = [[*keys, m] for keys in (["bucket"], model) for m in ("latency_ms", "ttft_ms")]
    counted = (
        window.select(
            "bucket", *model, "latency_ms", "ttft_ms", "input_tokens", "output_tokens",
            (status == "error").cast("int").alias("_e"), (status == "cancelled").cast("int").alias("_c"),
        )
        .groupingSets(sets, "bucket", *model, "latency_ms", "ttft_ms")
        .agg(
            (F.grouping("ttft_ms") == 1).alias("_by_latency"), (F.grouping("bucket") == 0).alias("_in_time"), F.count(F.lit(1)).alias("_n"),
            F.sum("_e").alias("_errors"), F.sum("_c").alias("_cancels"), F.sum("input_tokens").alias("_in"), F.sum("output_tokens").alias("_out"),
        )
    )
    zero = calls.sparkSession.range(1).select(
        F.lit(None).cast("timestamp").alias("bucket"), *[F.lit(None).cast("string").alias(c) for c in model],
        *[F.lit(None).cast("int").alias(m) for m in ("latency_ms", "ttft_ms")], F.lit(True).alias("_by_latency"), F.lit(False).alias("_in_time"),
        *[F.lit(0).cast("long").alias(c) for c in ("_n", "_errors", "_cancels", "_in", "_out")], F.array(F.lit("total")).alias("_parts"),
    )
    parts = F.when(F.col("_in_time"), F.array(F.lit("series"))).otherwise(F.array(F.lit("provider"), F.lit("total")))
    rows = counted.withColumn("_parts", parts).unionByName(zero).withColumn("part", F.explode("_parts"))
    for c in model:
        rows = rows.withColumn(c, F.when(F.col("part") == "provider", F.col(c)))
    keys = ["part", "bucket", *model]
    return _finish(rows.groupBy(*keys).agg(*_measures()), keys, PARTS)


COUNT_KEYS = ["bucket", "provider", "model"]
_SUMS = ["_n", "_errors", "_cancels", "_in", "_out"]


def minute_counts(calls: DataFrame) -> DataFrame:
    """Sparse histograms: calls per minute, provider, model and measured value, with the counters beside them.

    Such rows of several batches merge by adding up, and hold all that exact percentiles need.
    """
    return _counts(calls.withColumn("bucket", F.date_trunc("minute", "completed_at")), COUNT_KEYS)


def merged_counts(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of several batches as one row per ``keys`` and value; combines map-side."""
    return counts.groupBy(*keys, "_by_latency", "latency_ms", "ttft_ms").agg(*[F.sum(c).alias(c) for c in _SUMS])


def parts_from_counts(counts: DataFrame, interval: str = "minute") -> DataFrame:
    """``summary_parts`` of the minutes in ``counts``, without the calls themselves."""
    check_interval(interval, S.DASHBOARD_INTERVALS)
    rows = counts.withColumn("part", F.explode(F.array(*map(F.lit, ("total", "series", "provider")))))
    rows = rows.withColumn("bucket", F.when(F.col("part") == "series", F.date_trunc(interval, "bucket")))
    for c in ("provider", "model"):
        rows = rows.withColumn(c, F.when(F.col("part") == "provider", F.col(c)))
    keys = ["part", *COUNT_KEYS]
    return _finish(merged_counts(rows, keys).groupBy(*keys).agg(*_measures()), keys, PARTS)


def providers(calls: DataFrame) -> DataFrame:
    return calls.select("provider").distinct().orderBy("provider")


def retryable_by_provider(calls: DataFrame) -> DataFrame:
    """Failures a retry could have saved, per provider."""
    failed = F.col("status") == "error"
    return calls.groupBy("provider").agg(
        F.count_if(failed).alias("errors"), F.count_if(failed & M.retryable()).alias("retryable_errors")
    )


def reasoning_tokens(calls: DataFrame, metadata: str = "raw_metadata") -> DataFrame:
    """How the output tokens split into reasoning and the rest, per provider."""
    spent = F.try_variant_get(F.col(metadata), "$.reasoning_tokens", "int")
    return (
        calls.select("provider", "output_tokens", spent.alias("_r"))
        .groupBy("provider")
        .agg(
            F.count("_r").alias("calls_with_reasoning"),
            F.coalesce(F.sum("_r"), F.lit(0)).alias("reasoning_tokens"),
            F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
        )
    )
