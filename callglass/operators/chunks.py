"""Stream chunks of a call: reading vendor events, folding them into one row.

The fold has two levels. Chunks are first folded per (call, run of ``RUN`` chunk
numbers), so a call with very many chunks spreads over many tasks. The call-level
fold then sees one row per run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callglass.functions import text as X
from callglass.functions.frames import compute_once

#: Chunks per run.
RUN = 1024

_LATEST = ("input_tokens", "output_tokens", "finish_reason")


def normalise(lines: DataFrame, line: str = "line") -> DataFrame:
    """Captured vendor events as chunks; events that carry nothing are dropped.

    ``lines`` has ``call_id``, ``chunk_no``, ``emitted_at`` and the event as JSON text.
    Typed events (``message_start``, ``content_block_delta``, ``message_delta``) and
    choice-list events are told apart by their keys. An event with both usage and text
    counts for both.
    """
    get = lambda key, kind: F.try_variant_get("_d", f"$.{key}", kind)
    doc = compute_once(lines, _d=F.try_parse_json(line))
    parts = compute_once(
        doc,
        type=get("type", "string"),
        id=get("id", "string"),
        delta=get("delta", "struct<type string, text string, stop_reason string>"),
        message=get("message", "struct<id string, usage struct<input_tokens int>>"),
        usage=get("usage", "struct<prompt_tokens int, completion_tokens int, output_tokens int, "
                           "completion_tokens_details struct<reasoning_tokens int>>"),
        choice=get("choices[0]", "struct<delta struct<content string>, finish_reason string>"),
    )
    typed, start = F.col("type").isNotNull(), F.col("type") == "message_start"
    end, text = F.col("type") == "message_delta", F.col("type") == "content_block_delta"
    told = compute_once(
        parts,
        _delta=F.when(typed, F.when(text & (F.col("delta.type") == "text_delta"), F.col("delta.text"))).otherwise(
            F.col("choice.delta.content")
        ),
        _usage=F.when(typed, start | end).otherwise(F.col("usage").isNotNull()),
        input_tokens=F.when(typed, F.when(start, F.col("message.usage.input_tokens"))).otherwise(
            F.col("usage.prompt_tokens")
        ),
        output_tokens=F.when(typed, F.when(end, F.col("usage.output_tokens"))).otherwise(
            F.col("usage.completion_tokens")
        ),
        finish_reason=F.when(typed, F.when(end, F.col("delta.stop_reason"))).otherwise(F.col("choice.finish_reason")),
        _request=F.when(typed, F.when(start, F.col("message.id"))).otherwise(
            F.when(F.col("usage").isNotNull(), F.col("id"))
        ),
        _reasoning=F.when(~typed, F.col("usage.completion_tokens_details.reasoning_tokens")),
    )
    has_text = F.when(typed, F.col("_delta").isNotNull()).otherwise(F.length("_delta") > 0)
    kept = F.col("_usage") | F.coalesce(has_text, F.lit(False)) | F.col("finish_reason").isNotNull()
    metadata = F.to_json(
        F.struct(F.col("_request").alias("provider_request_id"), F.col("_reasoning").alias("reasoning_tokens"))
    )
    return told.where(kept).select(
        "call_id", "chunk_no", "emitted_at", F.coalesce("_delta", F.lit("")).alias("delta_text"),
        "input_tokens", "output_tokens", "finish_reason",
        F.when(F.col("_request").isNotNull() | F.col("_reasoning").isNotNull(), metadata).alias("metadata_json"),
    )


def _run_measures() -> list[Column]:
    ordered = F.array_sort(F.collect_list(F.when(F.length("delta_text") > 0, F.struct("chunk_no", "delta_text"))))
    has_usage = F.col("input_tokens").isNotNull() | F.col("output_tokens").isNotNull()
    latest = [
        F.max(F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.struct("chunk_no", c))).alias(c)
        for c in _LATEST
    ]
    return [
        F.min("chunk_no").alias("first_chunk"),
        F.count(F.lit(1)).alias("chunks"),
        F.array_join(F.transform(ordered, lambda c: c["delta_text"]), "").alias("text"),
        F.min(F.when(F.length("delta_text") > 0, F.col("emitted_at"))).alias("first_text_at"),
        F.max("emitted_at").alias("last_at"),
        F.max("chunk_no").alias("last_chunk"),
        F.collect_list(F.when(F.col("metadata_json").isNotNull(), F.struct("chunk_no", "metadata_json"))).alias("metadata"),
        F.max(F.when(has_usage, F.struct("chunk_no", "input_tokens", "output_tokens"))).alias("whole_usage"),
        *latest,
    ]


def run_of(chunk_no: str = "chunk_no", run: int = RUN) -> Column:
    return F.floor(F.col(chunk_no) / F.lit(run)).cast("long")


def fold_runs(chunks: DataFrame, run: int = RUN, *also: Column) -> DataFrame:
    """First level: one row per call and run of chunk numbers, at most ``run`` chunks each.

    ``also`` adds grouping columns, as the session window of the streaming form.
    """
    return chunks.groupBy("call_id", run_of(run=run).alias("run"), *also).agg(*_run_measures())


def fold_calls(runs: DataFrame) -> DataFrame:
    """Second level: one row per call, each field from the last chunk that carried it.

    The text is the call's whole text; it is one value, as long as the call made it.
    ``fold_runs`` has the same text in rows of bounded size.
    """
    ordered = F.array_sort(F.collect_list(F.struct("run", "first_chunk", "text")))
    text = F.array_join(F.transform(ordered, lambda r: r["text"]), "")
    return (
        runs.groupBy("call_id")
        .agg(
            F.sum("chunks").alias("chunks"),
            text.alias("text"),
            F.min("first_text_at").alias("first_text_at"),
            F.max("last_at").alias("last_at"),
            F.max("last_chunk").alias("last_chunk"),
            *[F.max(c)[c].alias(c) for c in _LATEST],
            F.max("whole_usage").alias("_whole"),
        )
        .withColumn("usage_object_input", F.col("_whole.input_tokens"))
        .withColumn("usage_object_output", F.col("_whole.output_tokens"))
        .drop("_whole")
    )


def fold_metadata(chunks: DataFrame) -> DataFrame:
    """Merged metadata of each call as JSON text, keys in order; a later chunk's key wins."""
    told = chunks.where(F.col("metadata_json").isNotNull()).select(
        "call_id", "chunk_no", F.try_parse_json("metadata_json").alias("_d")
    )
    spark = chunks.sparkSession
    entries = told.lateralJoin(spark.tvf.variant_explode(F.col("_d").outer())).select(
        "call_id", "chunk_no", "key", F.to_json("value").alias("value")
    )
    merged = entries.groupBy("call_id", "key").agg(F.max(F.struct("chunk_no", "value")).alias("_last"))
    pair = F.concat(F.to_json(F.col("key").cast("variant")), F.lit(":"), F.col("_last.value"))
    pairs = F.array_sort(F.collect_list(F.struct("key", pair.alias("pair"))))
    body = F.array_join(F.transform(pairs, lambda p: p["pair"]), ",")
    return merged.groupBy("call_id").agg(F.concat(F.lit("{"), body, F.lit("}")).alias("metadata_json"))


def finish(calls: DataFrame, folded: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """Call rows from the calls' list and their folded chunks; a call without chunks keeps a row.

    ``calls`` has ``call_id``, ``started_at`` and ``ended_at``. Durations are whole
    milliseconds, cut down. No chunks give an empty text.
    """
    out = calls.join(folded, "call_id", "left")
    if metadata is not None:
        out = out.join(metadata, "call_id", "left")
    whole_ms = lambda a, b: F.floor((F.unix_micros(b) - F.unix_micros(a)) / F.lit(1000)).cast("int")
    return (
        out.withColumn("text", F.when(F.col("chunks").isNull(), "").otherwise(F.col("text")))
        .withColumn("chunks", F.coalesce("chunks", F.lit(0)))
        .withColumn("ttft_ms", whole_ms(F.col("started_at"), F.col("first_text_at")))
        .withColumn("latency_ms", whole_ms(F.col("started_at"), F.col("ended_at")))
        .drop("first_text_at", "last_at", "last_chunk")
    )


def metadata_rows(runs: DataFrame) -> DataFrame:
    """The metadata that the chunks of folded runs carried, as ``fold_metadata`` takes it."""
    return runs.select("call_id", F.explode("metadata").alias("_m")).select("call_id", "_m.chunk_no", "_m.metadata_json")


def whole_calls(runs: DataFrame, calls: DataFrame) -> DataFrame:
    """Folded calls of which every chunk is among ``runs``, the closed runs of a chunk stream.

    A run closes when the stream's clock has passed its last chunk; so the clock has passed
    the end of every call that ended before the last chunk of any closed run. Such a call
    can get no more chunks. It is whole if its chunks are numbered without a gap. Others
    stay out until later.
    """
    passed = runs.agg(F.max("last_at").alias("_passed"))
    ended = calls.join(F.broadcast(passed), F.col("ended_at") <= F.col("_passed")).drop("_passed")
    folded = fold_calls(runs).where(F.col("chunks") == F.col("last_chunk") + 1)
    done = finish(ended.join(folded.select("call_id"), "call_id", "left_semi"), folded, fold_metadata(metadata_rows(runs)))
    return done


def reply_messages(finished: DataFrame) -> DataFrame:
    """The assistant message each finished call leaves, if any.

    A success keeps its text. A streamed call that was cancelled or failed at the
    provider keeps what was shown, stripped, unless nothing is left. Any other leaves none.
    """
    shown = F.col("streamed") & F.col("end_kind").isin("cancelled", "provider_error")
    partial = X.strip(F.col("text"))
    content = F.when(F.col("end_kind") == "completed", F.col("text")).when(shown & (partial != ""), partial)
    return finished.withColumn("content", content).where(F.col("content").isNotNull())
