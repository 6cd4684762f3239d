"""The log tables, derived from the given Parquet tables.

``Given`` builds them as DataFrames; the ``*_SQL`` texts say the same for the SQL
check, as common table expressions. Every row of ``events``, ``conversations`` and
``documents`` is used, so all of it grows with the input.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callglass.functions.frames import compute_once, spread
from callglass.operators import contract
from callglass.session import configure

#: Runs in Spark and in DuckDB alike; ``{events}`` is the table.
LOGS_SQL = """
select concat('00000000-0000-4000-8000-', lpad(cast(event_id as varchar(20)), 12, '0')) as id,
  1 as schema_version,
  case when event_id % 10 = 9 then null
       else concat('00000000-0000-4000-9000-', lpad(cast(user_id % 120 as varchar(20)), 12, '0')) end as conversation_id,
  cast(null as varchar(36)) as message_id,
  case user_id % 6 when 0 then 'mock' when 1 then 'anthropic' when 2 then 'openai'
       when 3 then 'groq' when 4 then 'gemini' else 'ollama' end as provider,
  concat('model-', cast(user_id % 3 as varchar(20))) as model,
  status, event_id % 2 = 0 as streamed,
  completed_at - lat * interval '1 millisecond' as started_at,
  completed_at,
  completed_at + (event_id % 20000) * interval '1 millisecond' as ingested_at,
  case when status = 'error' and event_id % 5 = 0 then null else lat end as latency_ms,
  case when event_id % 4 = 0 or (status = 'error' and event_id % 3 = 0) then null
       else cast(floor(value * 2) as int) end as ttft_ms,
  case when status <> 'success' then null else cast(event_id % 97 + 1 as int) end as input_tokens,
  case when status <> 'success' then null else cast(event_id % 389 + 1 as int) end as output_tokens,
  case status when 'error' then case event_id % 3 when 0 then 'RateLimitError'
       when 1 then 'APIConnectionError' else 'BadRequestError' end else null end as error_type,
  case status when 'error' then 'upstream failure' when 'cancelled' then 'Cancelled by client' else null end as error_message,
  case status when 'success' then 'stop' else null end as finish_reason,
  case when status = 'success' then concat('{{"provider_request_id":"req_', cast(event_id as varchar(20)), '"',
       case when event_id % 8 = 0 then concat(',"reasoning_tokens":', cast(event_id % 30 as varchar(20))) else '' end, '}}')
       else null end as raw_metadata_json,
  event_id as k
from (select event_id, user_id, value, cast(ts as timestamp) as completed_at,
        case event_type when 'error' then 'error' when 'signup' then 'cancelled' else 'success' end as status,
        cast(floor(value * 10) as int) as lat
      from {events}) b
"""

MESSAGES_SQL = """
select concat('00000000-0000-4000-9000-', lpad(cast(conv_id as varchar(20)), 12, '0')) as conversation_id,
  cast(turn as int) as seq, role, text as content,
  timestamp '2024-01-01 00:00:00' + (conv_id * 60000 + turn * 10000) * interval '1 millisecond' as created_at
from {conversations}
"""

#: Replies written after successful calls.
REPLIES_SQL = """
select conversation_id, concat('reply-', substr(id, 25)) as reply_id,
  completed_at + (k % 5000) * interval '1 millisecond' as created_at
from {fx_logs} where status = 'success' and conversation_id is not null
"""

#: One call per assistant turn, and one that failed before any chunk per system turn.
CALLS_SQL = """
select concat(cast(conv_id as varchar(20)), '-', cast(turn as varchar(20))) as call_id,
  concat('00000000-0000-4000-9000-', lpad(cast(conv_id as varchar(20)), 12, '0')) as conversation_id,
  turn, turn % 3 <> 0 as streamed,
  case when role = 'system' then 'provider_error' when turn % 4 <> 3 then 'completed'
       when conv_id % 3 = 0 then 'cancelled' when conv_id % 3 = 1 then 'provider_error' else 'unexpected' end as end_kind,
  timestamp '2024-01-01 00:00:00' + (conv_id * 60000 + turn * 10000 - 250) * interval '1 millisecond' as started_at,
  timestamp '2024-01-01 00:00:00' + (conv_id * 60000 + turn * 10000 + 9000) * interval '1 millisecond' as ended_at
from {conversations} where role in ('assistant', 'system')
"""

# DuckDB only: what the decoders must find, by the rule the fixtures were made with.
DELIVERIES_SQL = """
select unnest(case when k % 7 = 0 then [2 * k, 2 * k + 1] else [2 * k] end) as delivery_id,
  case when k % 50 = 1 then 'malformed_json'
       when k % 50 in (2, 3) then 'missing_or_invalid_id'
       when k % 50 in (4, 5, 8) or (k % 50 = 6 and latency_ms is not null) then 'schema_validation_failed'
       else null end as reason,
  case when k % 50 = 4 then 'model:missing; status:missing; started_at:missing; completed_at:missing'
       when k % 50 = 5 then 'status:unknown'
       when k % 50 = 6 and latency_ms is not null then 'latency_ms:negative'
       when k % 50 = 8 then 'latency_seconds:unknown_key' end as problem,
  l.*
from fx_logs l
"""

CHUNKS_SQL = """
select call_id, chunk_no, base + chunk_no * interval '40 milliseconds' as emitted_at,
  case when chunk_no between 1 and n then substr(text, (chunk_no - 1) * 100 + 1, 100) else '' end as delta_text,
  case when chunk_no = 0 then cast(turn + 11 as int) end as input_tokens,
  case when chunk_no > n then cast(length(text) as int) end as output_tokens,
  case when chunk_no > n then 'stop' end as finish_reason,
  case when chunk_no = 0 then concat('{"provider_request_id":"req_', call_id, '","stage":"start"}')
       when chunk_no > n then concat('{"stage":"end","reasoning_tokens":', turn, '}') end as metadata_json,
  conv_id, turn, n
from (select conv_id, turn, text, concat(conv_id, '-', turn) as call_id,
        timestamp '2024-01-01 00:00:00' + (conv_id * 60000 + turn * 10000) * interval '1 millisecond' as base,
        cast(ceil(length(text) / 100) as bigint) as n,
        unnest(range(0, cast(ceil(length(text) / 100) as bigint) + case when turn % 4 <> 3 then 2 else 1 end)) as chunk_no
      from conversations where role = 'assistant') c
"""


def with_views(*names: str, sql: str) -> str:
    """``sql`` for DuckDB with the named derived tables in front."""
    texts = {
        "fx_logs": LOGS_SQL.format(events="events"),
        "fx_messages": MESSAGES_SQL.format(conversations="conversations"),
        "fx_replies": REPLIES_SQL.format(fx_logs="fx_logs"),
        "fx_calls": CALLS_SQL.format(conversations="conversations"),
        "fx_deliveries": DELIVERIES_SQL,
        "fx_chunks": CHUNKS_SQL,
    }
    needs = {"fx_replies": ["fx_logs"], "fx_deliveries": ["fx_logs"]}
    wanted: list[str] = []
    for name in names:
        for n in [*needs.get(name, []), name]:
            if n not in wanted:
                wanted.append(n)
    return "with " + ",\n".join(f"{n} as ({texts[n]})" for n in wanted) + "\n" + sql


class Given:
    """Derived tables of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = configure(spark)
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def logs(self) -> DataFrame:
        return logs_from(self.table("events"))

    @cached_property
    def calls_with_metadata(self) -> DataFrame:
        return self.logs.withColumn("raw_metadata", F.try_parse_json("raw_metadata_json"))

    @cached_property
    def messages(self) -> DataFrame:
        return self.spark.sql(MESSAGES_SQL, conversations=self.table("conversations"))

    @cached_property
    def conversations(self) -> DataFrame:
        """Conversation rows as they are before titles are derived."""
        return self.messages.groupBy("conversation_id").agg(
            F.lit(None).cast("string").alias("title"),
            F.lit("active").alias("status"),
            F.min("created_at").alias("created_at"),
            F.min("created_at").alias("updated_at"),
        )

    @cached_property
    def replies(self) -> DataFrame:
        return self.spark.sql(REPLIES_SQL, fx_logs=self.logs)

    @cached_property
    def calls(self) -> DataFrame:
        return self.spark.sql(CALLS_SQL, conversations=self.table("conversations"))

    @cached_property
    def envelopes(self) -> DataFrame:
        return envelopes_from(logs_from(spread(self.table("events"), "event_id")))

    @cached_property
    def documents(self) -> DataFrame:
        return spread(self.table("documents").select("doc_id", "text", "lang"), "doc_id")

    @cached_property
    def chunks(self) -> DataFrame:
        return chunks_from(self.table("conversations"))

    @cached_property
    def vendor_lines(self) -> DataFrame:
        return vendor_lines_from(self.chunks)


def logs_from(events: DataFrame) -> DataFrame:
    """Call rows from an ``events`` frame, which may be a stream."""
    return events.sparkSession.sql(LOGS_SQL, events=events)


def envelopes_from(logs: DataFrame) -> DataFrame:
    """Deliveries, good and bad; every seventh event is delivered twice.

    Class by ``k % 50``: 1 broken JSON, 2 no object, 3 bad id, 4 missing fields,
    5 unknown status, 6 negative latency, 7 another spelling of the id, 8 unknown key.
    """
    cls = F.col("k") % 50
    bent = (
        logs.withColumn("raw_metadata", F.try_parse_json("raw_metadata_json"))
        .withColumn("id", F.when(cls == 7, F.upper(F.regexp_replace("id", "-", ""))).otherwise(F.col("id")))
        .withColumn("status", F.when(cls == 5, "ERROR").otherwise(F.col("status")))
        .withColumn("latency_ms", F.when((cls == 6) & F.col("latency_ms").isNotNull(), -1).otherwise(F.col("latency_ms")))
    )
    good = compute_once(bent, data=contract.publish_json(bent))
    data = (
        F.when(cls == 1, '{"id": broken')
        .when(cls == 2, "[1, 2]")
        .when(cls == 3, F.concat(F.lit('{"id":"not-a-uuid-'), F.col("k"), F.lit('"}')))
        .when(cls == 4, F.concat(F.lit('{"id":"'), F.col("id"), F.lit('","provider":"mock"}')))
        .when(cls == 8, F.concat(F.lit('{"latency_seconds":1.2,'), F.substring(F.col("data"), F.lit(2), F.length("data"))))
        .otherwise(F.col("data"))
    )
    twice = F.when(F.col("k") % 7 == 0, F.array(F.col("k") * 2, F.col("k") * 2 + 1)).otherwise(F.array(F.col("k") * 2))
    return compute_once(good, sent=data).select(
        F.explode(twice).alias("delivery_id"), F.col("sent").alias("data")
    )


def chunks_from(conversations: DataFrame) -> DataFrame:
    """Chunks of one call per assistant turn: usage first, text in slices of 100, a closing chunk.

    Calls with ``turn % 4 = 3`` have no closing chunk.
    """
    n, no, turn = F.col("n"), F.col("chunk_no"), F.col("turn")
    calls = conversations.where("role = 'assistant'").select(
        "conv_id", "turn", "text",
        F.concat(F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string")).alias("call_id"),
        F.expr("timestamp '2024-01-01 00:00:00' + (conv_id * 60000 + turn * 10000) * interval '1 millisecond'").alias("base"),
        F.ceil(F.length("text") / F.lit(100)).cast("long").alias("n"),
    )
    last = F.when(turn % 4 != 3, n + 1).otherwise(n)
    numbered = calls.withColumn("chunk_no", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    closing = no > n
    return numbered.select(
        "call_id", "chunk_no",
        F.expr("base + chunk_no * interval '40 milliseconds'").alias("emitted_at"),
        F.when(no.between(1, n), F.substring(F.col("text"), ((no - 1) * 100 + 1).cast("int"), F.lit(100))).otherwise("").alias("delta_text"),
        F.when(no == 0, (turn + 11).cast("int")).alias("input_tokens"),
        F.when(closing, F.length("text")).alias("output_tokens"),
        F.when(closing, "stop").alias("finish_reason"),
        F.when(no == 0, F.concat(F.lit('{"provider_request_id":"req_'), F.col("call_id"), F.lit('","stage":"start"}')))
        .when(closing, F.concat(F.lit('{"stage":"end","reasoning_tokens":'), turn, F.lit("}")))
        .alias("metadata_json"),
        "conv_id", "turn", "n",
    )


def vendor_lines_from(chunks: DataFrame) -> DataFrame:
    """The chunks as captured vendor events: typed events in even conversations, choice lists in odd ones."""
    request = F.concat(F.lit("req_"), F.col("call_id"))
    closing = F.col("chunk_no") > F.col("n")

    def line(**fields) -> F.Column:
        return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]))

    s = lambda **f: F.struct(*[c.alias(k) for k, c in f.items()])
    typed = (
        F.when(F.col("chunk_no") == 0, line(type=F.lit("message_start"),
                                             message=s(id=request, usage=s(input_tokens=F.col("input_tokens")))))
        .when(closing, line(type=F.lit("message_delta"), delta=s(stop_reason=F.col("finish_reason")),
                            usage=s(output_tokens=F.col("output_tokens"))))
        .otherwise(line(type=F.lit("content_block_delta"), delta=s(type=F.lit("text_delta"), text=F.col("delta_text"))))
    )
    choice = (
        F.when(F.col("chunk_no") == 0, line(id=request, choices=F.array(s(delta=s(role=F.lit("assistant"))))))
        .when(closing, line(id=request, choices=F.array(s(delta=s(content=F.lit("")), finish_reason=F.col("finish_reason"))),
                            usage=s(prompt_tokens=(F.col("turn") + 11).cast("int"), completion_tokens=F.col("output_tokens"),
                                    completion_tokens_details=s(reasoning_tokens=F.col("turn")))))
        .otherwise(line(id=request, choices=F.array(s(delta=s(content=F.col("delta_text"))))))
    )
    return chunks.select(
        "call_id", "chunk_no", "emitted_at", F.when(F.col("conv_id") % 2 == 0, typed).otherwise(choice).alias("line")
    )
