"""Columns over one call, and the rounding rules shared by the aggregates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from callglass import schema as S


def to_whole(value: Column) -> Column:
    """Interpolated percentile to an integer, half to even.

    Six digits first: the interpolation may miss an exact .5 by float noise.
    """
    return F.rint(F.round(value, 6)).cast("int")


def rate(part: Column, whole: Column) -> Column:
    """Share rounded to four digits, half to even; 0.0 of nothing."""
    return F.bround(F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0)), 4)


def total_tokens(inp: str = "input_tokens", out: str = "output_tokens") -> Column:
    """Sum of both counts; null only when both are."""
    i, o = F.col(inp).cast("long"), F.col(out).cast("long")
    return F.coalesce(i + o, i, o)


def tokens_per_second(out: str = "output_tokens", latency: str = "latency_ms", ttft: str = "ttft_ms") -> Column:
    """Output tokens per second after the first token; null where it means nothing."""
    span = (F.col(latency) - F.col(ttft)) / F.lit(1000.0)
    return F.when((F.col(out) > 0) & (span > 0.05), F.col(out) / span)


def ingest_lag_ms(completed: str = "completed_at", ingested: str = "ingested_at") -> Column:
    """Milliseconds from the end of the call to its landing."""
    return F.unix_millis(ingested) - F.unix_millis(completed)


def shown_lag_ms(completed: str = "completed_at", ingested: str = "ingested_at") -> Column:
    """The lag as displayed: a clock that runs behind shows 0."""
    return F.greatest(F.lit(0).cast("long"), ingest_lag_ms(completed, ingested))


def retryable(error_type: str = "error_type") -> Column:
    return F.coalesce(F.col(error_type).isin(*S.RETRYABLE_ERRORS), F.lit(False))


def classify_end(end_kind: str, vendor_error: str, error_class: str, message: str) -> Column:
    """Status, error type and message of a finished call as one struct.

    ``end_kind`` is ``completed``, ``cancelled`` (a cancel or a closed stream),
    ``provider_error`` or any other word for an unexpected failure.
    """
    kind = F.col(end_kind)
    failed = F.lit("error")
    cls = F.col(error_class)
    by_vendor = F.coalesce(F.when(F.col(vendor_error) != "", F.col(vendor_error)), cls)
    by_class = F.coalesce(F.when(F.col(message) != "", F.col(message)), cls)
    none = F.lit(None).cast("string")
    row = lambda s, t, m: F.struct(s.alias("status"), t.alias("error_type"), m.alias("error_message"))
    return (
        F.when(kind == "completed", row(F.lit("success"), none, none))
        .when(kind == "cancelled", row(F.lit("cancelled"), none, F.lit(S.CANCELLED_MESSAGE)))
        .when(kind == "provider_error", row(failed, by_vendor, F.col(message)))
        .otherwise(row(failed, cls, by_class))
    )
