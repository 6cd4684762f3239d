import json
import random

import pytest
from conftest import ID, checked, deliveries, event
from pyspark.sql import functions as F

from callglass.operators import audit, ingest
from callglass.sources import envelopes, retention, tables
from callglass.sources.tables import Store
from callglass.streaming import ingest as streaming
from callglass.streaming import live

EVENTS = [
    event(), event(), event(id=ID % 2), "{broken", event(id="nope"), event(id=ID % 3, status="ERROR"),
    event(id=ID % 3), event(id=ID % 4), event(id=ID % 4, latency_ms=-1), event(id="urn:uuid:" + ID % 2),
]


def contents(store):
    order = {"raw": "delivery_id", "logs": "id", "attempts": "delivery_id", "dead_letters": "delivery_id", "outcomes": "received"}
    skip = {"received_at", "processed_at", "ingested_at", "raw_metadata"}
    return {
        name: [tuple(r) for r in store.read(name).drop(*skip).orderBy("batch_id", key).collect()] for name, key in order.items()
    }


def state(store):
    return {r.id: (r.processing_status, r.processing_error, json.loads(r.payload)["status"]) for r in store.raw_state().collect()}


def test_outcomes(spark):
    rows = checked(spark, EVENTS)
    assert ingest.outcome_counts(rows).first().asDict() == {"received": 9, "inserted": 4, "duplicates": 2, "rejected": 3}
    assert ingest.outcome_counts(checked(spark, [])).first().asDict() == {"received": 0, "inserted": 0, "duplicates": 0, "rejected": 0}
    one_pass, joined = ingest.state_of(rows), ingest.raw_state(ingest.raw_rows(rows), ingest.attempts(rows), ["delivery_id"])
    assert sorted(one_pass.collect()) == sorted(joined.select(*one_pass.columns).collect())


def test_first_payload_and_last_status(spark, tmp_path):
    store = Store(spark, str(tmp_path)).create()
    streaming.write_batch(store, deliveries(spark, EVENTS), 0)
    assert state(store) == {
        ID % 1: ("processed", None, "success"), ID % 2: ("processed", None, "success"),
        ID % 3: ("processed", None, "ERROR"), ID % 4: ("failed", "latency_ms:negative", "success")}
    assert store.read("logs").count() == 4
    assert {r.reason: r["count"] for r in store.read("dead_letters").groupBy("reason").count().collect()} == {
        "malformed_json": 1, "missing_or_invalid_id": 1, "schema_validation_failed": 2}


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path)).create()
    streaming.write_batch(store, deliveries(spark, EVENTS[:4]), 0)
    streaming.write_batch(store, deliveries(spark, EVENTS[4:]), 1)
    before = contents(store)
    streaming.write_batch(store, deliveries(spark, EVENTS[4:]), 1)
    assert contents(store) == before
    assert [tuple(r)[:4] for r in store.read("outcomes").orderBy("batch_id").collect()] == [(3, 2, 1, 0), (6, 2, 1, 3)]


@pytest.mark.parametrize("fails_at", ["dead_letters", "logs", "attempts", "outcomes"])
def test_a_crash_between_writes_is_repaired(spark, tmp_path, fails_at):
    good = Store(spark, str(tmp_path / "good")).create()
    streaming.write_batch(good, deliveries(spark, EVENTS), 0)

    class Breaking(Store):
        def write(self, name, rows, batch_id):
            if name == fails_at:
                raise RuntimeError("lost")
            super().write(name, rows, batch_id)

    root = str(tmp_path / "bad")
    with pytest.raises(RuntimeError):
        streaming.write_batch(Breaking(spark, root).create(), deliveries(spark, EVENTS), 0)
    again = Store(spark, root)
    streaming.write_batch(again, deliveries(spark, EVENTS), 0)
    assert contents(again) == contents(good)


def test_order_of_arrival_within_a_batch_does_not_matter(spark):
    rows = deliveries(spark, EVENTS).collect()
    random.Random(3).shuffle(rows)
    mixed = spark.createDataFrame(rows, "delivery_id long, data string").repartition(4)
    a, b = ingest.land(checked(spark, EVENTS)), ingest.land(ingest.check(mixed))
    for name in ("raw", "attempts", "dead_letters", "outcomes"):
        assert sorted(getattr(a, name).collect()) == sorted(getattr(b, name).collect())
    assert sorted(a.logs.drop("raw_metadata").collect(), key=str) == sorted(b.logs.drop("raw_metadata").collect(), key=str)


def test_the_stream_takes_each_file_once(spark, tmp_path):
    source, root, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    store = Store(spark, root)
    for part in (EVENTS[:5], EVENTS[5:]):
        deliveries(spark, part).coalesce(1).write.mode("append").parquet(source)
        streaming.start(envelopes.file_stream(spark, source, files_per_batch=1), store, checkpoint, None).awaitTermination()
    counts = store.read("outcomes").agg(*[F.sum(c) for c in ("received", "inserted", "duplicates", "rejected")]).first()
    assert tuple(counts) == (9, 4, 2, 3)
    assert store.read("logs").count() == 4 and store.read("outcomes").count() >= 2
    streaming.start(envelopes.file_stream(spark, source), store, checkpoint, None).awaitTermination()
    assert store.read("attempts").count() == 8


def test_replay_after_a_fix(spark, tmp_path):
    store = Store(spark, str(tmp_path)).create()
    events = [event(), event(id=ID % 5, status="SUCCESS"), event(id=ID % 6, latency_ms=-5)]
    streaming.write_batch(store, deliveries(spark, events), 0)
    fix = lambda data: F.regexp_replace(data, "SUCCESS", "success")
    for batch in (1, 2):
        streaming.replay_failed(store, batch, fix)
    assert store.read("logs").count() == 2 and store.read("raw").count() == 3
    assert {k: v[0] for k, v in state(store).items()} == {ID % 1: "processed", ID % 5: "processed", ID % 6: "failed"}


def test_publish_and_read_back(spark, given, tmp_path):
    calls = given.calls_with_metadata.withColumnRenamed("k", "delivery_id").limit(50)
    envelopes.publish_to_files(calls, str(tmp_path / "e"), "json")
    back = ingest.check(spark.read.schema("delivery_id long, data string").json(str(tmp_path / "e")))
    assert ingest.outcome_counts(back).first().inserted == 50
    with pytest.raises(ValueError):
        envelopes.file_stream(spark, str(tmp_path), "xml")


def test_hot_id_is_ranked_before_the_shuffle(spark):
    df = ingest.first_per_id(spark.range(100).select((F.col("id") % 2).cast("string").alias("id"), F.col("id").alias("delivery_id")))
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in text and "Partial" in text
    assert sorted(tuple(r) for r in df.collect()) == [("0", 0), ("1", 1)]


@pytest.mark.parametrize("keep", [1, 7, 64, 100, 999, 1000, 5000])
def test_newest_rows(spark, keep):
    rows = spark.range(1000).select((F.col("id") * 3).alias("delivery_id"))
    got = sorted(r[0] for r in retention.newest(rows, keep, block=50).collect())
    assert got == [i * 3 for i in range(1000)][-keep:]
    assert retention.newest(rows.limit(0), keep).count() == 0


def test_sorted_copy(spark, given, tmp_path):
    logs = given.logs.withColumn("completed_date", F.to_date("completed_at"))
    tables.rewrite_sorted(logs, str(tmp_path / "copy"))
    copy = spark.read.parquet(str(tmp_path / "copy"))
    assert copy.count() == 1000
    from callglass.operators import metrics
    text = metrics.since(copy, "2024-01-20 00:00:00")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(completed_date" in text and "GreaterThanOrEqual(completed_at" in text


def test_live_rollup_and_late_calls(spark, given, tmp_path):
    logs = given.logs.select("completed_at", "status", "input_tokens", "output_tokens")
    for i, half in enumerate((logs.where("completed_at < '2024-01-15'"), logs.where("completed_at >= '2024-01-15'"))):
        half.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(logs.schema).parquet(str(tmp_path / "in"))
        live.to_table(live.rollup(source, "1 hour"), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    closed = spark.read.parquet(str(tmp_path / "out"))
    real = {r.bucket: r.n for r in logs.groupBy(F.date_trunc("hour", "completed_at").alias("bucket")).agg(F.count("*").alias("n")).collect()}
    got = {r.bucket: r.requests for r in closed.collect()}
    assert got and all(real[b] == n for b, n in got.items()) and len(real) - len(got) <= 2
    assert live.late_calls(logs, closed, "hour").count() == 0
    one_more = logs.unionByName(logs.where("completed_at < '2024-01-02'").limit(1))
    assert [r.late for r in live.late_calls(one_more, closed, "hour").collect()] == [1]


def test_audits(spark, given):
    broken = given.logs.limit(10).withColumn("latency_ms", F.lit(-1)).withColumn("status", F.lit("ERROR"))
    found = {r.rule: r.violations for r in audit.violations(broken, audit.CALL_RULES).collect() if r.violations}
    assert found == {"latency_ms_non_negative": 10, "status_domain": 10}
    long = spark.createDataFrame([("c", 0, "user", "x" * 32_000), ("c", 0, "user", "x" * 32_001), ("c", 1, "bot", "")],
                                 "conversation_id string, seq int, role string, content string")
    long = long.withColumn("created_at", F.current_timestamp())
    found = {r.rule: r.violations for r in audit.violations(long, audit.MESSAGE_RULES).collect() if r.violations}
    assert found == {"role_domain": 1, "content_length": 2}
    assert [tuple(r) for r in audit.repeated_keys(long, ["conversation_id", "seq"]).collect()] == [("c", 0, 2)]


def test_a_repeat_under_a_stricter_contract_leaves_no_old_row(spark, tmp_path):
    from callglass.sources.tables import Store
    from callglass.streaming import ingest as streaming

    store = Store(spark, str(tmp_path / "store")).create()
    sent = deliveries(spark, [event(), event(id=ID % 2)])
    streaming.write_batch(store, sent, 0)
    assert store.read("logs").count() == 2
    strict = lambda rows: ingest.check(rows.withColumn("data", F.regexp_replace("data", '"success"', '"SUCCESS"')))
    streaming.write_batch(store, sent, 0, strict)
    assert store.read("logs").count() == 0 and store.read("outcomes").select("inserted", "rejected").collect() == [(0, 2)]
    assert store.read("dead_letters").count() == 2
    state = store.raw_state().collect()
    assert {r.processing_status for r in state} == {"failed"} and all(r.processed_at for r in state)


def test_a_batch_without_its_mark_is_not_shown(spark, tmp_path):
    from callglass.session import delete_path
    from callglass.sources.tables import Store
    from callglass.streaming import ingest as streaming

    store = Store(spark, str(tmp_path / "store")).create()
    streaming.write_batch(store, deliveries(spark, [event()]), 0)
    streaming.write_batch(store, deliveries(spark, [event(), event(id=ID % 2)]), 1)
    assert store.read("logs").count() == 2 and [r.duplicates for r in store.read("outcomes").orderBy("batch_id").collect()] == [0, 1]
    delete_path(spark, f"{store.path('outcomes')}/batch_id=1")
    assert store.read("logs").count() == 1 and store.read("raw").count() == 1


def test_a_page_since_a_time_reads_late_days_only(spark, tmp_path):
    from callglass.operators import browse
    from callglass.sources.tables import Store
    from callglass.streaming import ingest as streaming

    store = Store(spark, str(tmp_path / "store")).create()
    streaming.write_batch(store, deliveries(spark, [event()]), 0)
    logs = spark.read.parquet(store.path("logs"))
    plan = browse.matching(logs, started_since="2024-01-01 00:00:00")._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "completed_date" in filters and browse.matching(logs, started_since="2024-01-01 00:00:00").count() == 1
