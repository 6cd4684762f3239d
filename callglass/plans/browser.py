"""Log browser queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from callglass.functions import measures as M
from callglass.operators import browse
from callglass.plans.dashboard import raw_state_of
from callglass.plans.registry import Query
from callglass.sources.given import Given, with_views

CALL = ", ".join(c for c in browse.CALL_COLUMNS if c not in ("input_preview", "output_preview", "message_id"))
META = "coalesce(raw_metadata_json, '{}') as raw_metadata"
ERROR = ", ".join(c for c in browse.ERROR_COLUMNS if c not in ("input_preview", "output_preview"))


def stored(g: Given):
    """Call rows with the columns the fixtures leave out."""
    none = F.lit(None).cast("string")
    return g.calls_with_metadata.withColumn("input_preview", none).withColumn("output_preview", none)


def tied(g: Given):
    """Many calls on one instant, to put the tie-break to the test."""
    return stored(g).withColumn("started_at", F.date_trunc("hour", "started_at"))


def shown(df):
    kept = df.drop("input_preview", "output_preview", "message_id")
    return kept.withColumn("raw_metadata", F.to_json("raw_metadata"))


def page_two(g: Given):
    """The page after the first, whose last row is the cursor."""
    _, cursor = browse.fetch_page(tied(g).select("id", "started_at"), 25)
    return shown(browse.full_rows(browse.page(tied(g), 25, cursor)))


def page_sql(where: str, limit: int, offset: int = 0, tie: bool = True) -> str:
    started = "date_trunc('hour', started_at)" if tie else "started_at"
    return with_views("fx_logs", sql=f""", t as (select * replace ({started} as started_at) from fx_logs)
select {CALL}, {META} from t where {where} order by started_at desc, id desc limit {limit} offset {offset}""")


def derived(g: Given):
    return g.logs.select(
        "id",
        F.round(M.tokens_per_second(), 6).alias("tokens_per_second"),
        M.total_tokens().alias("total_tokens"),
        M.ingest_lag_ms().alias("ingest_lag_ms"),
        M.shown_lag_ms().alias("shown_lag_ms"),
    )


QUERIES = [
    Query("logs_page_1", lambda g: shown(browse.full_rows(browse.page(tied(g), 25))), page_sql("true", 25)),
    Query("logs_page_2", page_two, page_sql("true", 25, 25)),
    Query(
        "logs_filtered",
        lambda g: shown(browse.full_rows(browse.page(
            stored(g), 200, browse.Cursor(datetime(2024, 1, 25, 12, 0), "ffffffff"), provider="groq",
            status="success", started_since="2024-01-10 00:00:00",
        ))),
        page_sql("""provider = 'groq' and status = 'success' and started_at >= timestamp '2024-01-10 00:00:00'
  and (started_at, id) < (timestamp '2024-01-25 12:00:00', 'ffffffff')""", 200, tie=False),
    ),
    Query(
        "recent_errors",
        lambda g: browse.recent_errors(stored(g), 25).drop("input_preview", "output_preview"),
        with_views("fx_logs", sql=f"select {ERROR} from fx_logs where status = 'error' order by started_at desc, id desc limit 25"),
    ),
    Query(
        "failed_triage",
        lambda g: browse.failed_events(
            raw_state_of(g).withColumn("received_at", F.timestamp_micros(F.col("delivery_id") * 1_000_000)), 100
        ).select("id", "received_at", "event_type", "processing_status", "processing_error"),
        with_views("fx_deliveries", sql="""select id, make_timestamp(min(delivery_id) * 1000000) as received_at,
  'inference.completed' as event_type, 'failed' as processing_status, any_value(problem) as processing_error
from fx_deliveries where reason = 'schema_validation_failed' group by id order by received_at desc, id desc limit 100"""),
    ),
    Query(
        "call_derived",
        derived,
        with_views("fx_logs", sql="""select id,
  case when output_tokens > 0 and (latency_ms - ttft_ms) / 1000.0 > 0.05
       then round(cast(output_tokens as double) / (cast(latency_ms - ttft_ms as double) / 1000.0), 6) end as tokens_per_second,
  cast(case when input_tokens is null and output_tokens is null then null
       else coalesce(input_tokens, 0) + coalesce(output_tokens, 0) end as bigint) as total_tokens,
  epoch_ms(ingested_at) - epoch_ms(completed_at) as ingest_lag_ms,
  greatest(0, epoch_ms(ingested_at) - epoch_ms(completed_at)) as shown_lag_ms
from fx_logs"""),
    ),
    Query(
        "page_export",
        lambda g: browse.export_pages(tied(g).select("id", "started_at", "provider", "status"), 200),
        with_views("fx_logs", sql="""select id, date_trunc('hour', started_at) as started_at, provider, status,
  cast(ceil(row_number() over (order by date_trunc('hour', started_at) desc, id desc) / 200) as bigint) as page_no from fx_logs"""),
    ),
    Query(
        "log_by_id",
        lambda g: shown(browse.full_rows(browse.by_id(stored(g), "00000000-0000-4000-8000-000000000042"))),
        with_views("fx_logs", sql=f"select {CALL}, {META} from fx_logs where id = '00000000-0000-4000-8000-000000000042'"),
    ),
]
