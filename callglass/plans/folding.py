"""Chunk queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from callglass.functions import text as X
from callglass.functions.measures import classify_end
from callglass.operators import chunks as K, contract, conversations as C, events as E, ingest
from callglass.plans.registry import Query
from callglass.plans.texts import cut_sql, redacted_sql
from callglass.sources.given import Given, with_views


def finished(g: Given):
    return K.finish(g.calls, K.fold_calls(K.fold_runs(g.chunks)), K.fold_metadata(g.chunks))


def outcome(df):
    """Status of each folded call from how it ended."""
    df = df.withColumn("vendor_error", F.lit("APIConnectionError")).withColumn("error_class", F.lit("ProviderError"))
    df = df.withColumn("message", F.lit("upstream failure"))
    return df.select("*", F.inline(F.array(classify_end("end_kind", "vendor_error", "error_class", "message"))))


def reply_rows(g: Given):
    return K.reply_messages(finished(g)).select("call_id", "conversation_id", "content")


def numbered_replies(g: Given):
    """The replies as messages, numbered on from the user's side of each conversation."""
    users = g.messages.where("role = 'user'")
    arrivals = K.reply_messages(finished(g)).select("conversation_id", F.col("turn").alias("arrival_no"), "call_id")
    return C.append(users, arrivals).select("conversation_id", "call_id", "seq")


def named(df):
    """Folded calls with what their wrapper knows besides: id, provider, model and the failure."""
    conv, turn = F.split("call_id", "-")[0].cast("long"), F.col("turn")
    return df.withColumns({
        "id": F.concat(F.lit("00000000-0000-4000-a000-"), F.lpad((conv * 1000 + turn).cast("string"), 12, "0")),
        "provider": F.lit("mock"), "model": F.concat(F.lit("model-"), (turn % 3).cast("string")), "vendor_error": F.lit("APIConnectionError"),
        "error_class": F.lit("ProviderError"), "message": F.lit("upstream failure"),
    })


def built_events(g: Given):
    """Events of finished calls, published and read back through the contract."""
    sent = contract.publish(E.finished_events(named(finished(g)), g.messages))
    rows = contract.to_rows(ingest.check(sent.select(F.xxhash64("id").alias("delivery_id"), "data")))
    return rows.select(*EVENT, F.to_json("raw_metadata").alias("raw_metadata"))


EVENT = ["id", "schema_version", "conversation_id", "message_id", "provider", "model", "status", "streamed", "started_at", "completed_at", "latency_ms",
         "ttft_ms", "input_tokens", "output_tokens", "input_preview", "output_preview", "error_type", "error_message", "finish_reason"]

FOLD = """f as (select call_id, string_agg(delta_text, '' order by chunk_no) as text, count(*) as chunks,
  min(emitted_at) filter (where delta_text <> '') as first_text_at,
  arg_max(input_tokens, chunk_no) filter (where input_tokens is not null) as input_tokens,
  arg_max(output_tokens, chunk_no) filter (where output_tokens is not null) as output_tokens,
  arg_max(finish_reason, chunk_no) filter (where finish_reason is not null) as finish_reason,
  any_value(turn) as turn_no, max(chunk_no) > any_value(n) as closed from fx_chunks group by 1)"""
FINISHED = f"""{FOLD}, done as (select c.*, coalesce(f.text, '') as text, coalesce(chunks, 0) as chunks,
  cast(floor((epoch_us(first_text_at) - epoch_us(started_at)) / 1000.0) as integer) as ttft_ms,
  cast(floor((epoch_us(ended_at) - epoch_us(started_at)) / 1000.0) as integer) as latency_ms,
  input_tokens, output_tokens, finish_reason,
  case when f.call_id is null then null when closed
    then concat('{{"provider_request_id":"req_', c.call_id, '","reasoning_tokens":', turn_no, ',"stage":"end"}}')
    else concat('{{"provider_request_id":"req_', c.call_id, '","stage":"start"}}') end as metadata_json
  from fx_calls c left join f on c.call_id = f.call_id)"""
STRIPPED = r"regexp_replace(text, '^[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+|[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+$', '', 'g')"
REPLIES = f"""replies as (select * from (select call_id, conversation_id, turn, case when end_kind = 'completed' then text
  when streamed and end_kind in ('cancelled', 'provider_error') then nullif({STRIPPED}, '') end as content from done) r where content is not null)"""

CHUNK_COLUMNS = "call_id, chunk_no, emitted_at, delta_text, input_tokens, output_tokens, finish_reason, metadata_json"
NORMALISED = """
select call_id, chunk_no, emitted_at, delta_text,
  case when conv_id % 2 = 0 then input_tokens when chunk_no > n then cast(turn + 11 as integer) end as input_tokens,
  output_tokens, finish_reason,
  case when conv_id % 2 = 0 and chunk_no = 0 then concat('{"provider_request_id":"req_', call_id, '"}')
       when conv_id % 2 = 1 and chunk_no > n then concat('{"provider_request_id":"req_', call_id, '","reasoning_tokens":', turn, '}') end as metadata_json
from fx_chunks where conv_id % 2 = 0 or chunk_no > 0"""

QUERIES = [
    Query(
        "folded_calls",
        lambda g: finished(g).select("call_id", "text", "chunks", "ttft_ms", "latency_ms", "input_tokens", "output_tokens",
                                     "finish_reason", "metadata_json"),
        with_views("fx_calls", "fx_chunks", sql=f", {FINISHED} select call_id, text, chunks, ttft_ms, latency_ms, input_tokens, output_tokens, finish_reason, metadata_json from done"),
    ),
    Query(
        "folded_runs",
        lambda g: K.fold_runs(g.chunks, 4).select("call_id", "run", "first_chunk", "chunks", "text"),
        with_views("fx_chunks", sql="""select call_id, chunk_no // 4 as run, min(chunk_no) as first_chunk, count(*) as chunks,
  string_agg(delta_text, '' order by chunk_no) as text from fx_chunks group by 1, 2"""),
    ),
    Query(
        "folded_outcomes",
        lambda g: outcome(finished(g)).select("call_id", "status", "error_type", "error_message", "streamed", "ttft_ms",
                                              X.preview(F.col("text"), 80).alias("output_preview")),
        with_views("fx_calls", "fx_chunks", sql=f""", {FINISHED}
select call_id, case end_kind when 'completed' then 'success' when 'cancelled' then 'cancelled' else 'error' end as status,
  case end_kind when 'provider_error' then 'APIConnectionError' when 'unexpected' then 'ProviderError' end as error_type,
  case end_kind when 'completed' then null when 'cancelled' then 'Cancelled by client' else 'upstream failure' end as error_message,
  streamed, ttft_ms, case when length(text) > 80 then concat(substr(text, 1, 80), '…') else text end as output_preview from done"""),
    ),
    Query(
        "built_events",
        built_events,
        with_views("fx_calls", "fx_chunks", "fx_messages", sql=f""", {FINISHED},
u as (select c.call_id, arg_max(m.content, m.seq) as said from fx_calls c
  left join fx_messages m on m.conversation_id = c.conversation_id and m.role = 'user' and m.seq < c.turn group by 1)
select concat('00000000-0000-4000-a000-', lpad(cast(cast(split_part(call_id, '-', 1) as bigint) * 1000 + turn as varchar), 12, '0')) as id,
  1 as schema_version, conversation_id, cast(null as varchar) as message_id, 'mock' as provider, concat('model-', turn % 3) as model,
  case end_kind when 'completed' then 'success' when 'cancelled' then 'cancelled' else 'error' end as status, streamed, started_at, ended_at as completed_at,
  latency_ms, ttft_ms, input_tokens, output_tokens, {redacted_sql(cut_sql("said"))} as input_preview, {redacted_sql(cut_sql("text"))} as output_preview,
  case end_kind when 'provider_error' then 'APIConnectionError' when 'unexpected' then 'ProviderError' end as error_type,
  case end_kind when 'completed' then null when 'cancelled' then 'Cancelled by client' else 'upstream failure' end as error_message,
  finish_reason, metadata_json as raw_metadata
from done join u using (call_id)"""),
    ),
    Query(
        "normalised_chunks",
        lambda g: K.normalise(g.vendor_lines),
        with_views("fx_chunks", sql=NORMALISED),
    ),
    Query(
        "folded_usage_objects",
        lambda g: K.fold_calls(K.fold_runs(K.normalise(g.vendor_lines))).select(
            "call_id", "input_tokens", "output_tokens",
            F.col("usage_object_input").alias("object_input"), F.col("usage_object_output").alias("object_output")),
        with_views("fx_chunks", sql=f""", v as ({NORMALISED}),
u as (select * from v where input_tokens is not null or output_tokens is not null),
o as (select call_id, arg_max({{'i': input_tokens, 'o': output_tokens}}, chunk_no) as last from u group by 1),
p as (select call_id, arg_max(input_tokens, chunk_no) filter (where input_tokens is not null) as input_tokens,
  arg_max(output_tokens, chunk_no) filter (where output_tokens is not null) as output_tokens from v group by 1)
select call_id, input_tokens, output_tokens, last.i as object_input, last.o as object_output from p left join o using (call_id)"""),
    ),
    Query(
        "replies_from_folds",
        reply_rows,
        with_views("fx_calls", "fx_chunks", sql=f", {FINISHED}, {REPLIES} select call_id, conversation_id, content from replies"),
    ),
    Query(
        "numbered_replies",
        numbered_replies,
        with_views("fx_calls", "fx_chunks", "fx_messages", sql=f""", {FINISHED}, {REPLIES},
n as (select conversation_id, max(seq) + 1 as next_seq from fx_messages where role = 'user' group by 1)
select r.conversation_id, call_id, cast(coalesce(next_seq, 0) + row_number() over (partition by r.conversation_id order by turn) - 1 as integer) as seq
from replies r left join n using (conversation_id)"""),
    ),
]
