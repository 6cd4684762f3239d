from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from callglass.functions import measures as M
from callglass.operators import metrics

NOW = datetime(2024, 3, 1, 12, 0)
SHAPE = ("provider string, model string, status string, completed_at timestamp, ingested_at timestamp, latency_ms int, "
         "ttft_ms int, input_tokens int, output_tokens int, error_type string")


def call(provider="mock", status="success", ago=10, latency=200, ttft=None, tokens=(10, 40), ingested=None, model="mock", error=None):
    done = NOW - timedelta(seconds=ago)
    return (provider, model, status, done, ingested or done, latency, ttft, *tokens, error)


def frame(spark, *calls):
    return spark.createDataFrame(list(calls), SHAPE)


def test_buckets_follow_the_end_of_the_call(spark):
    late = [call(ago=1200 + i, ingested=NOW) for i in range(3)]
    rows = metrics.time_series(frame(spark, *late, call(ago=5)), "minute").collect()
    assert [(r.bucket, r.requests) for r in rows] == [
        (datetime(2024, 3, 1, 11, 39), 2), (datetime(2024, 3, 1, 11, 40), 1), (datetime(2024, 3, 1, 11, 59), 1)
    ]


def test_percentiles_skip_nulls(spark):
    row = metrics.totals(frame(spark, call(latency=100), call(latency=300), call(latency=None))).first()
    assert row.requests == 3 and row.p50_latency_ms == 200


@pytest.mark.parametrize("values, whole", [((2, 3), 2), ((3, 4), 4), ((1, 2), 2), ((7,), 7)])
def test_percentile_rounds_half_to_even(spark, values, whole):
    assert metrics.totals(frame(spark, *[call(latency=v) for v in values])).first().p50_latency_ms == whole


def test_empty_window(spark):
    row = metrics.totals(frame(spark)).first().asDict()
    assert row == {"requests": 0, "errors": 0, "cancellations": 0, "error_rate": 0.0, "p50_latency_ms": None,
                   "p95_latency_ms": None, "p95_ttft_ms": None, "input_tokens": 0, "output_tokens": 0}
    assert metrics.time_series(frame(spark)).count() == 0 and metrics.by_provider(frame(spark)).count() == 0


def test_cancellations_are_not_errors(spark):
    rows = [call(status="error", tokens=(None, None)), call(status="cancelled", tokens=(None, None)), call(), call()]
    row = metrics.totals(frame(spark, *rows)).first()
    assert (row.errors, row.cancellations, row.error_rate, row.input_tokens) == (1, 1, 0.25, 20)


def test_rate_rounds_half_to_even(spark):
    df = spark.createDataFrame([(1, 32), (0, 0), (2, 3)], "a int, b int")
    assert [r[0] for r in df.select(M.rate(F.col("a"), F.col("b"))).collect()] == [0.0312, 0.0, 0.6667]


def test_window_is_inclusive(spark):
    df = frame(spark, call(ago=3600), call(ago=3601))
    assert metrics.last_minutes(df, NOW, 60).count() == 1
    for minutes in (0, 10081):
        with pytest.raises(ValueError):
            metrics.last_minutes(df, NOW, minutes)


def test_breakdown_is_busiest_first(spark):
    df = frame(spark, call("b"), call("a"), call("a"), call("a", model="m2", status="cancelled"))
    assert [(r.provider, r.model, r.requests) for r in metrics.by_provider(df).collect()] == [
        ("a", "mock", 2), ("a", "m2", 1), ("b", "mock", 1)
    ]


def test_unknown_interval(spark):
    with pytest.raises(ValueError):
        metrics.time_series(frame(spark), "week; drop table")
    with pytest.raises(ValueError):
        metrics.summary(frame(spark), frame(spark), NOW, 60, "second")


def raw(spark, *statuses):
    return spark.createDataFrame([(s,) for s in statuses], "processing_status string")


@pytest.mark.parametrize("ago, stalled, tone", [(121, True, "critical"), (120, False, "good")])
def test_health(spark, ago, stalled, tone):
    row = metrics.health(frame(spark, call(ago=ago)), raw(spark, "pending", "failed", "processed"), NOW).first()
    assert (row.lag_seconds, row.is_stalled, row.tone) == (float(ago), stalled, tone)
    assert (row.logs_total, row.raw_events_total, row.raw_events_pending, row.raw_events_failed) == (1, 3, 1, 1)


def test_nothing_yet_is_idle_not_stalled(spark):
    row = metrics.health(frame(spark), raw(spark), NOW).first()
    assert (row.lag_seconds, row.is_stalled, row.tone, row.raw_events_failed) == (None, False, "idle", 0)


def test_summary_and_alerts(spark):
    df = frame(spark, *[call()] * 9, call(status="error", error="RateLimitError"))
    s = metrics.summary(df, raw(spark, "failed"), NOW)
    assert s.series.count() == 1 and s.providers.count() == 1
    tones = {r.alert: r.tone for r in metrics.alerts(s.totals, s.ingestion).collect()}
    assert tones == {"error_rate": "critical", "ingestion_lag": "good", "failed_events": "critical"}


def test_hot_group_matches_plain_percentiles(spark):
    rows = spark.range(30_000).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("p"), F.col("id") % 50)).alias("provider"),
        F.lit("m").alias("model"), F.lit("success").alias("status"), F.lit(NOW).alias("completed_at"),
        (F.col("id") * 7919 % 1013).cast("int").alias("latency_ms"), F.lit(None).cast("int").alias("ttft_ms"),
        F.lit(1).alias("input_tokens"), F.lit(2).alias("output_tokens"),
    )
    got = {r.provider: (r.requests, r.p50_latency_ms, r.p95_latency_ms, r.input_tokens) for r in metrics.by_provider(rows).collect()}
    plain = rows.groupBy("provider").agg(F.count(F.lit(1)), F.percentile("latency_ms", [0.5, 0.95]))
    assert got == {r[0]: (r[1], round(r[2][0]), round(r[2][1]), r[1]) for r in plain.collect()}


@pytest.mark.parametrize("out, latency, ttft, speed", [
    (100, 1200, 200, 100.0), (0, 1200, 200, None), (None, 1200, 200, None), (10, None, 200, None),
    (10, 1200, None, None), (10, 250, 200, None), (10, 251, 200, 10 / 0.051)])
def test_tokens_per_second(spark, out, latency, ttft, speed):
    df = spark.createDataFrame([(out, latency, ttft)], "output_tokens int, latency_ms int, ttft_ms int")
    got = df.select(M.tokens_per_second()).first()[0]
    assert got == speed if speed is None else got == pytest.approx(speed)


def test_total_tokens_and_lag(spark):
    df = spark.createDataFrame([(None, None), (1, None), (None, 2), (1, 2)], "input_tokens int, output_tokens int")
    assert [r[0] for r in df.select(M.total_tokens()).collect()] == [None, 1, 2, 3]
    times = spark.createDataFrame([(NOW, NOW - timedelta(seconds=1)), (NOW, NOW + timedelta(seconds=2))], "completed_at timestamp, ingested_at timestamp")
    assert [tuple(r) for r in times.select(M.ingest_lag_ms(), M.shown_lag_ms()).collect()] == [(-1000, 0), (2000, 2000)]


def test_classified_ends(spark):
    rows = [("completed", None, None, None), ("cancelled", "X", "Y", "z"), ("provider_error", "RateLimitError", "ProviderError", "slow"),
            ("provider_error", None, "ProviderError", "down"), ("other", None, "ValueError", ""), ("other", None, "ValueError", "bad")]
    df = spark.createDataFrame(rows, "k string, v string, c string, m string")
    assert [tuple(r[0]) for r in df.select(M.classify_end("k", "v", "c", "m")).collect()] == [
        ("success", None, None), ("cancelled", None, "Cancelled by client"), ("error", "RateLimitError", "slow"),
        ("error", "ProviderError", "down"), ("error", "ValueError", "ValueError"), ("error", "ValueError", "bad")]
