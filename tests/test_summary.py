from datetime import datetime

import pytest
from pyspark.sql import functions as F

from callglass.operators import events, metrics
from callglass.plans.folding import finished, named


def plain(df, columns):
    return sorted([tuple(r[c] for c in columns) for r in df.collect()], key=str)


def test_parts_equal_the_separate_queries(given):
    as_of, minutes = "2024-01-30 12:00:00", 10_080
    window = metrics.last_minutes(given.logs, as_of, minutes)
    parts = metrics.summary_parts(given.logs, as_of, minutes, "hour")
    assert parts._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    parts = parts.cache()
    assert plain(parts.where("part = 'total'"), metrics.TOTALS) == plain(metrics.totals(window), metrics.TOTALS)
    assert plain(parts.where("part = 'series'"), ["bucket", *metrics.SERIES]) == plain(metrics.time_series(window, "hour"), ["bucket", *metrics.SERIES])
    keys = ["provider", "model", *metrics.BREAKDOWN]
    assert plain(parts.where("part = 'provider'"), keys) == plain(metrics.by_provider(window), keys)
    with pytest.raises(ValueError):
        metrics.summary_parts(given.logs, as_of, minutes, "second")


def test_an_empty_window_has_a_total_of_zeros(given):
    (row,) = metrics.summary_parts(given.logs, "2030-01-01 00:00:00", 60).collect()
    assert (row.part, row.requests, row.errors, row.error_rate, row.p50_latency_ms, row.input_tokens) == ("total", 0, 0, 0, None, 0)


def test_an_event_carries_the_question_redacted(spark, given):
    at = datetime(2024, 1, 1)
    calls = given.calls.limit(0)
    made = spark.createDataFrame([("5-1", "c", 1, True, "completed", at, at), ("5-3", "c", 3, True, "provider_error", at, at), ("6-0", "d", 0, False, "cancelled", at, at)],
                                 calls.schema)
    text = made.withColumns({"text": F.lit("mail me@example.com"), "ttft_ms": F.lit(1), "latency_ms": F.lit(2), "input_tokens": F.lit(3),
                             "output_tokens": F.lit(4), "finish_reason": F.lit("stop"), "metadata_json": F.lit("{}")})
    said = spark.createDataFrame([("c", 0, "user", "first " + "x" * 600), ("c", 1, "assistant", "no"), ("c", 2, "user", "card 4111 1111 1111 1111"), ("c", 4, "user", "later")],
                                 "conversation_id string, seq int, role string, content string")
    got = {r.id[-4:]: r for r in events.finished_events(named(text), said).collect()}
    assert got["5001"].input_preview == ("first " + "x" * 600)[:500] + "…" and got["5003"].input_preview == "card [REDACTED_CARD]"
    assert got["6000"].input_preview is None and {r.output_preview for r in got.values()} == {"mail [REDACTED_EMAIL]"}
    assert [(got[k].status, got[k].error_type) for k in ("5001", "5003", "6000")] == [("success", None), ("error", "APIConnectionError"), ("cancelled", None)]
    assert all(r.raw_metadata is None and r.message_id is None for r in got.values())
    plain_text = events.finished_events(named(text), said, redacted=False).where("output_preview = 'mail me@example.com'")
    assert plain_text.count() == 3


def test_every_given_call_has_its_event(given):
    rows = events.finished_events(named(finished(given)), given.messages)
    assert rows.count() == given.calls.count() and rows.select("id").distinct().count() == given.calls.count()
