"""The log browser: filters, newest-first pages, exports, triage."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from callglass import schema as S
from callglass.operators.blocks import ROWS, even_positions
from callglass.operators.metrics import as_timestamp

ERROR_COLUMNS = ["id", "provider", "model", "status", "started_at", "latency_ms", "ttft_ms", "error_type",
                 "error_message", "input_preview", "output_preview"]
CALL_COLUMNS = ["id", "conversation_id", "message_id", "provider", "model", "status", "streamed", "started_at",
                "completed_at", "ingested_at", "latency_ms", "ttft_ms", "input_tokens", "output_tokens",
                "finish_reason", "error_type", "error_message", "input_preview", "output_preview"]


@dataclass(frozen=True)
class Cursor:
    started_at: datetime
    id: str


def matching(
    calls: DataFrame,
    provider: str | None = None,
    model: str | None = None,
    status: str | None = None,
    conversation_id: str | None = None,
    started_since: datetime | str | None = None,
) -> DataFrame:
    """Calls that meet every given condition."""
    if status is not None and status not in S.CALL_STATUSES:
        raise ValueError(f"unknown status: {status!r}")
    equal = {"provider": provider, "model": model, "status": status, "conversation_id": conversation_id}
    for column, value in equal.items():
        if value is not None:
            calls = calls.where(F.col(column) == value)
    if started_since is not None:
        since = as_timestamp(started_since)
        calls = calls.where(F.col("started_at") >= since)
        if "completed_date" in calls.columns:  # a call ends after it starts, so no earlier day can hold one
            calls = calls.where(F.col("completed_date") >= F.to_date(since))
    return calls


def before(started_at: datetime | str, call_id: str | None = None) -> Column:
    """Rows after the cursor in newest-first order.

    The leading ``<=`` is implied by the rest, and is what reaches the Parquet scan.
    """
    bound = as_timestamp(started_at)
    if call_id is None:
        return F.col("started_at") < bound
    return (F.col("started_at") <= bound) & ((F.col("started_at") < bound) | (F.col("id") < F.lit(call_id)))


def newest(calls: DataFrame, limit: int = S.DEFAULT_PAGE) -> DataFrame:
    if not 1 <= limit <= S.MAX_PAGE:
        raise ValueError(f"limit must be 1 to {S.MAX_PAGE}, not {limit}")
    return calls.orderBy(F.desc("started_at"), F.desc("id")).limit(limit)


def full_rows(calls: DataFrame) -> DataFrame:
    """Every field of a call; absent metadata shows as an empty object."""
    return calls.select(*CALL_COLUMNS, F.coalesce("raw_metadata", F.parse_json(F.lit("{}"))).alias("raw_metadata"))


def page(calls: DataFrame, limit: int = S.DEFAULT_PAGE, cursor: Cursor | None = None, **filters) -> DataFrame:
    """One page, newest first."""
    calls = matching(calls, **filters)
    if cursor is not None:
        calls = calls.where(before(cursor.started_at, cursor.id))
    return newest(calls, limit)


def fetch_page(
    calls: DataFrame, limit: int = S.DEFAULT_PAGE, cursor: Cursor | None = None, **filters
) -> tuple[list[Row], Cursor | None]:
    """The rows of one page and the cursor of the next; no cursor after a short page."""
    rows = page(calls, limit, cursor, **filters).collect()
    last = rows[-1] if len(rows) == limit else None
    return rows, Cursor(last["started_at"], last["id"]) if last else None


def export_pages(calls: DataFrame, limit: int = S.DEFAULT_PAGE, rows: int = ROWS) -> DataFrame:
    """All pages at once: what following cursors to the end yields, with the page number.

    Numbered in blocks of about ``rows`` calls, also where all started at one moment, then
    one range-partitioned sort.
    """
    newest_first = [F.desc("started_at"), F.desc("id")]
    numbered = even_positions(calls, newest_first, "_no", rows)
    return numbered.withColumn("page_no", F.ceil(F.col("_no") / F.lit(limit)).cast("long")).drop("_no").orderBy(*newest_first)


def recent_errors(calls: DataFrame, limit: int = S.DEFAULT_PAGE) -> DataFrame:
    return newest(matching(calls, status="error").select(*ERROR_COLUMNS), limit)


def failed_events(raw_state: DataFrame, limit: int = 100) -> DataFrame:
    """Latest failed raw events, for triage."""
    failed = raw_state.where(F.col("processing_status") == "failed")
    return failed.orderBy(F.desc("received_at"), F.desc("id")).limit(limit)


def by_id(rows: DataFrame, row_id: str) -> DataFrame:
    return rows.where(F.col("id") == row_id)


def require(rows: DataFrame, row_id: str) -> Row:
    """The one row with this id; raises when there is none."""
    found = by_id(rows, row_id).head()
    if found is None:
        raise LookupError(f"not found: {row_id}")
    return found
