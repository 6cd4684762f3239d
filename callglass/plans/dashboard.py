"""Dashboard queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from callglass.operators import ingest, metrics
from callglass.plans.registry import AS_OF, NEVER, SINCE, START, Query
from callglass.sources.given import Given, with_views

COUNTS = """count(*) as requests,
  count(*) filter (where status = 'error') as errors,
  count(*) filter (where status = 'cancelled') as cancellations"""


def pct(column: str, share: float, alias: str) -> str:
    return f"cast(round(quantile_cont({column}, {share}), 6) as integer) as {alias}"


TOKENS = """cast(coalesce(sum(input_tokens), 0) as bigint) as input_tokens,
  cast(coalesce(sum(output_tokens), 0) as bigint) as output_tokens"""
RATE = """cast(coalesce(round_even(count(*) filter (where status = 'error') / nullif(count(*), 0), 4), 0) as double) as error_rate"""
TOTALS = f"""{COUNTS}, {RATE}, {pct('latency_ms', 0.5, 'p50_latency_ms')}, {pct('latency_ms', 0.95, 'p95_latency_ms')},
  {pct('ttft_ms', 0.95, 'p95_ttft_ms')}, {TOKENS}"""
BREAKDOWN = f"""{COUNTS}, {pct('latency_ms', 0.5, 'p50_latency_ms')}, {pct('latency_ms', 0.95, 'p95_latency_ms')},
  {pct('ttft_ms', 0.95, 'p95_ttft_ms')}, {TOKENS}"""
SERIES = f"""{COUNTS}, count(*) filter (where status = 'success') as successes, {pct('latency_ms', 0.5, 'p50_latency_ms')},
  {pct('latency_ms', 0.95, 'p95_latency_ms')}, {pct('ttft_ms', 0.5, 'p50_ttft_ms')}"""


def totals_sql(since: str) -> str:
    return with_views("fx_logs", sql=f"select {TOTALS} from fx_logs where completed_at >= timestamp '{since}'")


def series_sql(interval: str) -> str:
    return with_views("fx_logs", sql=f"""select date_trunc('{interval}', completed_at) as bucket, {SERIES}
from fx_logs where completed_at >= timestamp '{START}' group by 1""")


def raw_state_of(g: Given):
    return ingest.state_of(ingest.check(g.envelopes))


def health_of(g: Given):
    return metrics.health(g.logs, raw_state_of(g), AS_OF)


HEALTH_CTE = f"""
attempts as (select id, arg_max(case when reason is null then 'processed' else 'failed' end, delivery_id) as st
  from fx_deliveries where coalesce(reason, '') not in ('malformed_json', 'missing_or_invalid_id') group by id),
health as (select (select max(ingested_at) from fx_logs) as last_ingested_at, (select count(*) from fx_logs) as logs_total,
  (select count(*) from attempts) as raw_events_total, cast(0 as bigint) as raw_events_pending,
  (select count(*) from attempts where st = 'failed') as raw_events_failed),
health2 as (select *, (epoch_us(timestamp '{AS_OF}') - epoch_us(last_ingested_at)) / 1e6 as lag_seconds from health),
health3 as (select *, coalesce(lag_seconds > 120, false) as is_stalled,
  case when lag_seconds is null then 'idle' when lag_seconds > 120 then 'critical' else 'good' end as tone from health2)
"""


def summary_alerts(g: Given):
    s = metrics.summary(g.logs, raw_state_of(g), AS_OF, metrics.S.MAX_WINDOW_MINUTES, "hour")
    return metrics.alerts(s.totals, s.ingestion)


def summary_parts(g: Given):
    """All four parts of a refresh in one result."""
    health = health_of(g).withColumn("part", F.lit("ingestion"))
    return metrics.summary_parts(g.logs, AS_OF, metrics.S.MAX_WINDOW_MINUTES, "hour").unionByName(health, allowMissingColumns=True)


PARTS = f"""{COUNTS}, count(*) filter (where status = 'success') as successes, {RATE}, {pct('latency_ms', 0.5, 'p50_latency_ms')},
  {pct('latency_ms', 0.95, 'p95_latency_ms')}, {pct('ttft_ms', 0.5, 'p50_ttft_ms')}, {pct('ttft_ms', 0.95, 'p95_ttft_ms')}, {TOKENS}"""


def window_presets_sql() -> str:
    return with_views("fx_logs", sql=f"""
select preset, minutes, interval, requests, errors, cancellations, error_rate, p50_latency_ms, p95_latency_ms, p95_ttft_ms,
  input_tokens, output_tokens
from (values ('15m', 15, 'minute'), ('1h', 60, 'minute'), ('24h', 1440, 'hour'), ('7d', 10080, 'hour')) p(preset, minutes, interval),
lateral (select {TOTALS} from fx_logs where completed_at >= timestamp '{AS_OF}' - p.minutes * interval '1 minute') t""")


QUERIES = [
    Query("totals", lambda g: metrics.totals(metrics.since(g.logs, START)), totals_sql(START)),
    Query("totals_window", lambda g: metrics.totals(metrics.since(g.logs, SINCE)), totals_sql(SINCE)),
    Query("totals_empty", lambda g: metrics.totals(metrics.since(g.logs, NEVER)), totals_sql(NEVER)),
    *[
        Query(
            f"series_{i}",
            lambda g, i=i: metrics.time_series(metrics.since(g.logs, START), i),
            series_sql(i),
        )
        for i in ("minute", "hour", "day")
    ],
    Query(
        "by_provider",
        lambda g: metrics.by_provider(metrics.since(g.logs, START)),
        with_views("fx_logs", sql=f"select provider, model, {BREAKDOWN} from fx_logs where completed_at >= timestamp '{START}' group by 1, 2"),
    ),
    Query(
        "by_provider_and_total",
        lambda g: metrics.by_provider_and_total(metrics.since(g.logs, START)),
        with_views("fx_logs", sql=f"""select grouping(provider) = 1 as is_total, provider, model, {BREAKDOWN} from fx_logs
where completed_at >= timestamp '{START}' group by grouping sets ((provider, model), ())"""),
    ),
    Query("window_presets", lambda g: metrics.window_presets(g.logs, AS_OF), window_presets_sql()),
    Query("health", health_of, with_views("fx_deliveries", sql=f", {HEALTH_CTE} select * from health3")),
    Query(
        "summary_alerts",
        summary_alerts,
        with_views("fx_deliveries", sql=f""", {HEALTH_CTE}, t as (select {RATE} from fx_logs
  where completed_at >= timestamp '{AS_OF}' - interval '10080 minutes')
select 'error_rate' as alert, error_rate as value, case when error_rate > 0.05 then 'critical' else 'neutral' end as tone from t
union all select 'ingestion_lag', lag_seconds, tone from health3
union all select 'failed_events', cast(raw_events_failed as double),
  case when raw_events_failed > 0 then 'critical' else 'neutral' end from health3"""),
    ),
    Query(
        "summary_parts",
        summary_parts,
        with_views("fx_deliveries", sql=f""", {HEALTH_CTE},
w as (select *, date_trunc('hour', completed_at) as hour from fx_logs where completed_at >= timestamp '{AS_OF}' - interval '10080 minutes')
select 'total' as part, {PARTS} from w
union all by name select 'series' as part, hour as bucket, {PARTS} from w group by hour
union all by name select 'provider' as part, provider, model, {PARTS} from w group by provider, model
union all by name select 'ingestion' as part, * from health3"""),
    ),
    Query("providers_distinct", lambda g: metrics.providers(g.logs), with_views("fx_logs", sql="select distinct provider from fx_logs")),
    Query(
        "retryable_by_provider",
        lambda g: metrics.retryable_by_provider(g.logs),
        with_views("fx_logs", sql="""select provider, count(*) filter (where status = 'error') as errors,
  count(*) filter (where status = 'error' and error_type in ('RateLimitError', 'InternalServerError', 'APIConnectionError')) as retryable_errors
from fx_logs group by 1"""),
    ),
    Query(
        "reasoning_tokens",
        lambda g: metrics.reasoning_tokens(g.calls_with_metadata),
        with_views("fx_logs", sql="""select provider,
  count(*) filter (where status = 'success' and k % 8 = 0) as calls_with_reasoning,
  cast(coalesce(sum(k % 30) filter (where status = 'success' and k % 8 = 0), 0) as bigint) as reasoning_tokens,
  cast(coalesce(sum(output_tokens), 0) as bigint) as output_tokens
from fx_logs group by 1"""),
    ),
]
