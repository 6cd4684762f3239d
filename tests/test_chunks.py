import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from callglass.operators import chunks as K
from callglass.schema import CHUNK

T0 = datetime(2024, 1, 1)


def stream(spark, *rows):
    data = [(c, n, T0 + timedelta(milliseconds=n * 40), t, i, o, r, m) for c, n, t, i, o, r, m in rows]
    return spark.createDataFrame(data, CHUNK)


def calls(spark, *ids, end="completed", streamed=True):
    rows = [(c, T0 - timedelta(microseconds=100_900), T0 + timedelta(seconds=1), end, streamed) for c in ids]
    return spark.createDataFrame(rows, "call_id string, started_at timestamp, ended_at timestamp, end_kind string, streamed boolean")


def fold(spark, chunks, *ids, run=K.RUN, **kw):
    done = K.finish(calls(spark, *ids, **kw), K.fold_calls(K.fold_runs(chunks, run)), K.fold_metadata(chunks))
    return {r.call_id: r for r in done.collect()}


def test_split_usage_merges_per_field(spark):
    c = stream(spark, ("a", 0, "", 11, None, None, '{"id":"x","n":1}'), ("a", 1, "Hel", None, None, None, None),
               ("a", 2, "lo", None, None, "", None), ("a", 3, "", None, 7, "stop", '{"n":2,"r":1.5}'))
    r = fold(spark, c, "a")["a"]
    assert (r.text, r.input_tokens, r.output_tokens, r.finish_reason, r.chunks) == ("Hello", 11, 7, "stop", 4)
    assert (r.ttft_ms, r.latency_ms) == (140, 1100) and json.loads(r.metadata_json) == {"id": "x", "n": 2, "r": 1.5}
    assert (r.usage_object_input, r.usage_object_output) == (None, 7)


def test_last_usage_and_reason_stand(spark):
    c = stream(spark, ("a", 0, "x", 5, 1, "length", None), ("a", 1, "y", 5, 2, None, None), ("a", 2, "z", None, 3, "", None))
    r = fold(spark, c, "a")["a"]
    assert (r.text, r.input_tokens, r.output_tokens, r.finish_reason) == ("xyz", 5, 3, "length")


def test_no_chunks_keep_a_row(spark):
    r = fold(spark, stream(spark), "a", end="provider_error")["a"]
    assert (r.text, r.chunks, r.ttft_ms, r.latency_ms, r.metadata_json, r.input_tokens) == ("", 0, None, 1100, None, None)


def test_a_call_with_many_chunks_spans_runs(spark):
    n = 5000
    c = spark.range(n).select(
        F.lit("hot").alias("call_id"), F.col("id").alias("chunk_no"), F.lit(T0).alias("emitted_at"),
        F.concat((F.col("id") % 10).cast("string")).alias("delta_text"), F.lit(None).cast("int").alias("input_tokens"),
        F.col("id").cast("int").alias("output_tokens"), F.lit(None).cast("string").alias("finish_reason"),
        F.lit(None).cast("string").alias("metadata_json"))
    runs = K.fold_runs(c, 64)
    assert runs.agg(F.max("chunks")).first()[0] == 64
    r = K.fold_calls(runs).first()
    assert r.text == "".join(str(i % 10) for i in range(n)) and r.output_tokens == n - 1 and r.chunks == n
    assert "".join(x.text for x in runs.orderBy("run").collect()) == r.text


def test_vendor_events(spark):
    lines = [
        {"type": "message_start", "message": {"id": "m1", "usage": {"input_tokens": 3}}},
        {"type": "ping"},
        {"type": "content_block_delta", "delta": {"type": "text_delta", "text": "Hi"}},
        {"type": "content_block_delta", "delta": {"type": "thinking_delta", "thinking": "hm"}},
        {"type": "content_block_delta", "delta": {"type": "text_delta", "text": ""}},
        {"type": "message_delta", "delta": {"stop_reason": "end_turn"}, "usage": {"output_tokens": 9}},
        {"id": "c1", "choices": [{"delta": {"role": "assistant", "content": ""}}]},
        {"id": "c1", "choices": [{"delta": {"content": "Yo"}, "finish_reason": None}], "usage": None},
        {"id": "c1", "choices": [{"delta": {"content": "!"}}], "usage": {"prompt_tokens": 4, "completion_tokens": 1}},
        {"id": "c1", "choices": [{"delta": {}, "finish_reason": "stop"}]},
        {"id": "c1", "choices": [], "usage": {"prompt_tokens": 4, "completion_tokens": 2, "completion_tokens_details": {"reasoning_tokens": 1}}},
    ]
    df = spark.createDataFrame([("c", i, T0, json.dumps(x)) for i, x in enumerate(lines)],
                               "call_id string, chunk_no long, emitted_at timestamp, line string")
    got = [(r.chunk_no, r.delta_text, r.input_tokens, r.output_tokens, r.finish_reason, r.metadata_json) for r in K.normalise(df).orderBy("chunk_no").collect()]
    assert got == [
        (0, "", 3, None, None, '{"provider_request_id":"m1"}'), (2, "Hi", None, None, None, None), (4, "", None, None, None, None),
        (5, "", None, 9, "end_turn", None), (7, "Yo", None, None, None, None), (8, "!", 4, 1, None, '{"provider_request_id":"c1"}'),
        (9, "", None, None, "stop", None), (10, "", 4, 2, None, '{"provider_request_id":"c1","reasoning_tokens":1}')]


def test_messages_left_by_calls(spark):
    c = stream(spark, ("a", 0, " part\n", None, None, None, None), ("blank", 0, " \n", None, None, None, None))

    def left(end, streamed=True):
        done = K.finish(calls(spark, "a", "blank", "none", end=end, streamed=streamed), K.fold_calls(K.fold_runs(c)))
        return {r.call_id: r.content for r in K.reply_messages(done).collect()}

    assert left("completed") == {"a": " part\n", "blank": " \n", "none": ""}
    assert left("cancelled") == {"a": "part"} and left("provider_error") == {"a": "part"}
    assert left("unexpected") == {} and left("provider_error", streamed=False) == {}


def test_a_call_with_an_open_run_is_not_shown(spark):
    c = stream(spark, *[("a", i, str(i), None, None, None, '{"n":%d}' % i if i in (0, 9) else None) for i in range(10)],
               *[("b", i, "x", None, None, None, None) for i in range(6)])
    runs = K.fold_runs(c, 4)
    ended = calls(spark, "a", "b").withColumn("ended_at", F.when(F.col("call_id") == "a", F.lit(T0 + timedelta(milliseconds=360))).otherwise(F.lit(T0)))
    whole = {r.call_id: r for r in K.whole_calls(runs, ended).collect()}
    assert whole["a"].text == "0123456789" and whole["a"].ttft_ms == 100 and json.loads(whole["a"].metadata_json) == {"n": 9}
    # The last run of a is open; b has a gap; both stay out.
    assert set(r.call_id for r in K.whole_calls(runs.where("call_id = 'b' or run < 2"), ended).collect()) == {"b"}
    assert "b" not in {r.call_id for r in K.whole_calls(runs.where("call_id = 'a' or run > 0"), ended).collect()}
    late = ended.withColumn("ended_at", F.lit(T0 + timedelta(hours=1)))
    assert K.whole_calls(runs, late).count() == 0
