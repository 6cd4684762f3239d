import json
from datetime import datetime

import pytest
from conftest import ID, checked, event
from pyspark.sql import functions as F

from callglass.operators import contract, ingest

BAD = [
    (event(drop=["model"]), "model:missing"),
    (event(drop=["status"]), "status:missing"),
    (event(drop=["started_at"]), "started_at:missing"),
    (event(provider=""), "provider:length"),
    (event(provider="p" * 65), "provider:length"),
    (event(model="m" * 129), "model:length"),
    (event(provider=5), "provider:not_text"),
    (event(provider=None), "provider:null"),
    (event(status="ERROR"), "status:unknown"),
    (event(latency_ms=-1), "latency_ms:negative"),
    (event(ttft_ms=-1), "ttft_ms:negative"),
    (event(input_tokens="many"), "input_tokens:not_an_integer"),
    (event(output_tokens=1.5), "output_tokens:not_an_integer"),
    (event(output_tokens=2**31), "output_tokens:out_of_range"),
    (event(completed_at="2023-12-31T23:59:59Z"), "completed_at:before_start"),
    (event(completed_at="yesterday"), "completed_at:not_a_time"),
    (event(completed_at="2024-02-30T00:00:00Z"), "completed_at:not_a_time"),
    (event(completed_at="2024-01-02T00:00:00"), "timestamp_zone_mismatch"),
    (event(status="error"), "error_message:missing"),
    (event(status="error", error_message=""), "error_message:missing"),
    (event(error_type="e" * 129), "error_type:length"),
    (event(finish_reason="f" * 65), "finish_reason:length"),
    (event(conversation_id="c1"), "conversation_id:not_a_uuid"),
    (event(message_id=7), "message_id:not_a_uuid"),
    (event(streamed="maybe"), "streamed:not_a_flag"),
    (event(streamed=None), "streamed:null"),
    (event(schema_version=None), "schema_version:null"),
    (event(schema_version="one"), "schema_version:not_an_integer"),
    (event(event_type="other"), "event_type:unknown"),
    (event(event_type=None), "event_type:null"),
    (event(raw_metadata=[1]), "raw_metadata:not_an_object"),
    (event(latency_seconds=1.2), "latency_seconds:unknown_key"),
]

GOOD = [
    (event(), {"schema_version": 1, "streamed": False, "latency_ms": None, "conversation_id": None}),
    (event(latency_ms="5", ttft_ms=5.0, input_tokens=" 1_000 ", output_tokens="7.00"),
     {"latency_ms": 5, "ttft_ms": 5, "input_tokens": 1000, "output_tokens": 7}),
    (event(streamed="Yes"), {"streamed": True}),
    (event(streamed=0), {"streamed": False}),
    (event(streamed=1.0, schema_version="2"), {"streamed": True, "schema_version": 2}),
    (event(started_at=1704067200, completed_at=1704067200500.0), {"completed_at": datetime(2024, 1, 1, 0, 0, 0, 500000)}),
    (event(started_at="1704067200"), {"started_at": datetime(2024, 1, 1)}),
    (event(started_at="2024-01-01 02:00+02:00"), {"started_at": datetime(2024, 1, 1)}),
    (event(started_at="2024-01-01", completed_at="2024-01-01T00:00:00.1234567"),
     {"started_at": datetime(2024, 1, 1), "completed_at": datetime(2024, 1, 1, 0, 0, 0, 123456)}),
    (event(completed_at="2024-01-01T05:30:01+0530"), {"completed_at": datetime(2024, 1, 1, 0, 0, 1)}),
    (event(status="error", error_message="x", error_type=None), {"status": "error"}),
    (event(status="cancelled"), {"status": "cancelled"}),
    (event(conversation_id="{" + (ID % 3).upper() + "}"), {"conversation_id": ID % 3}),
    (event(raw_metadata={"a": {"b": [1]}}), {"status": "success"}),
    (event(raw_metadata=None, latency_ms=None, error_type=None), {"latency_ms": None}),
    (event(input_preview="", output_preview="höß"), {"output_preview": "höß"}),
]


@pytest.fixture(scope="module")
def bad_rows(spark):
    return {r.delivery_id: r for r in checked(spark, [e for e, _ in BAD]).select("delivery_id", "problems", "reason").collect()}


@pytest.fixture(scope="module")
def good_rows(spark):
    rows = checked(spark, [e for e, _ in GOOD]).select("delivery_id", "problems", "reason", "event").collect()
    return {r.delivery_id: r for r in rows}


@pytest.mark.parametrize("n", range(len(BAD)), ids=[p for _, p in BAD])
def test_problem_is_named(bad_rows, n):
    assert bad_rows[n].problems == [BAD[n][1]]
    assert bad_rows[n].reason == "schema_validation_failed"


@pytest.mark.parametrize("n", range(len(GOOD)))
def test_lenient_reading(good_rows, n):
    row = good_rows[n]
    assert row.problems == [] and row.reason is None
    for key, value in GOOD[n][1].items():
        assert row.event[key] == value


def test_all_problems_are_kept(spark):
    row = checked(spark, [event(drop=["model"], latency_ms=-1, extra=1)]).first()
    assert row.problems == ["model:missing", "latency_ms:negative", "extra:unknown_key"]


@pytest.mark.parametrize(
    "data, reason",
    [
        ("{", "malformed_json"), (None, "malformed_json"), ("", "malformed_json"), ("[1]", "missing_or_invalid_id"),
        ('"text"', "missing_or_invalid_id"), ("5", "missing_or_invalid_id"), ("null", "missing_or_invalid_id"),
        ('{"id": 5}', "missing_or_invalid_id"), ('{"id": null}', "missing_or_invalid_id"),
        ('{"id": "not-a-uuid"}', "missing_or_invalid_id"), ("{}", "missing_or_invalid_id"),
        (json.dumps({"id": ID % 1}), "schema_validation_failed"),
    ],
)
def test_dead_letter_reason(spark, data, reason):
    assert checked(spark, [data]).first().reason == reason


@pytest.mark.parametrize("spelling", ["{%s}", "urn:uuid:%s", "uuid:%s", "%s"])
def test_uuid_spellings_are_one_id(spark, spelling):
    for text in (ID % 9, (ID % 9).replace("-", ""), (ID % 9).upper()):
        body = event(id=spelling % text)
        if spelling.startswith("u") and text.isupper():
            continue
        assert checked(spark, [body]).first().id == ID % 9


def test_last_of_a_repeated_key_counts(spark):
    data = json.dumps(event())[:-1] + ', "latency_ms": 1, "latency_ms": 2}'
    row = checked(spark, [data]).first()
    assert row.reason is None and row.event.latency_ms == 2


def test_plain_and_lenient_reading_agree(spark):
    plain = event(latency_ms=5, streamed=True, raw_metadata={"a": 1}, conversation_id=ID % 4, event_type="inference.completed")
    slow = {**plain, "latency_ms": "5", "raw_metadata": {"a": 1}}
    a, b = checked(spark, [plain, slow]).select(F.struct("event.*").alias("e")).select(
        F.to_json("e.raw_metadata").alias("m"), *[f"e.{c}" for c in ("id", "latency_ms", "streamed", "started_at", "completed_at", "conversation_id")]
    ).collect()
    assert a == b


def test_event_type_of_raw_rows(spark):
    types = checked(spark, [event(), event(event_type="other"), event(event_type=None), event(event_type=3)])
    assert [r[0] for r in types.orderBy("delivery_id").select(contract.event_type()).collect()] == [
        "inference.completed", "other", "None", "3"
    ]


def test_rows_have_no_event_type(spark):
    rows = ingest.log_rows(checked(spark, [event(event_type="inference.completed")]))
    assert "event_type" not in rows.columns and rows.count() == 1


def test_round_trip_through_json(given):
    calls = given.calls_with_metadata
    back = contract.to_rows(ingest.check(contract.publish(calls).select(F.col("k").alias("delivery_id"), "data")))
    cols = ["id", "started_at", "completed_at", "latency_ms", "error_message", "streamed"]
    assert back.select(*cols).exceptAll(calls.select(*cols)).count() == 0
    assert back.count() == calls.count()


def test_one_reading_per_version(spark):
    docs = spark.createDataFrame([(1, 5, None), (2, None, 6), (3, 7, 8)], "schema_version int, a int, b int")
    out = contract.by_version(docs, {1: {"x": F.col("a")}, 2: {"x": F.col("b"), "y": F.col("b") + 1}})
    assert sorted(map(tuple, out.collect())) == [(1, 5, None), (2, 6, 7)]
