"""Conversation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from callglass.operators import catalog, conversations as C, correlate
from callglass.plans.registry import Query
from callglass.plans.texts import RE2_SPACE, TITLE
from callglass.sources.given import Given, with_views

#: Conversations whose last activity lies before this moment are taken as deleted.
IDLE_BEFORE = "2024-01-01 00:45:00"
WINDOW_CHARS = 1000

SUMMARY = f"""summaries as (select conversation_id, arg_min({TITLE}, seq) filter (where role = 'user') as title, 'active' as status,
  min(created_at) as created_at, max(created_at) as updated_at from fx_messages group by 1)"""
WINDOW = """win as (select * from (select *, row_number() over w as rn,
    sum(length(content)) over (partition by conversation_id order by seq desc rows unbounded preceding) as used
  from fx_messages window w as (partition by conversation_id order by seq desc)) x
  where rn <= {m} and (rn = 1 or used <= {c}))"""


def idle(g: Given):
    last = g.messages.groupBy("conversation_id").agg(F.max("created_at").alias("last"))
    return last.where(F.col("last") < F.lit(IDLE_BEFORE).cast("timestamp"))


IDLE = f"""idle as (select conversation_id from fx_messages group by 1 having max(created_at) < timestamp '{IDLE_BEFORE}')"""


def appended(g: Given):
    """The replies that arrive later, numbered on from what each conversation holds."""
    arrivals = g.logs.where("conversation_id is not null and status = 'success'").select(
        "conversation_id", F.col("k").alias("arrival_no")
    )
    return C.append(g.messages, arrivals.withColumn("kept_no", F.col("arrival_no"))).select(
        "conversation_id", F.col("kept_no").alias("arrival_no"), "seq"
    )


def status_changes(g: Given):
    """Each call's outcome as a status event of its conversation."""
    changes = g.logs.where("conversation_id is not null").select(
        "conversation_id",
        F.when(F.col("status") == "cancelled", "cancelled").otherwise("active").alias("status"),
        F.col("completed_at").alias("changed_at"),
    )
    return C.with_status_changes(C.summaries(g.messages, g.conversations), changes).select(
        "conversation_id", "status", "updated_at"
    )


def prompts(g: Given):
    window = C.prompt_window(g.messages, 6, WINDOW_CHARS)
    return C.assemble_prompts(window, F.lit("Be brief."))


def budgets(g: Given):
    asked = g.logs.select("id", "provider", F.when(F.col("k") % 3 > 0, (F.col("k") * 7 % 9000).cast("int")).alias("requested_tokens"))
    return catalog.clamp_budgets(asked, catalog.default_catalog(g.spark))


def resolved(g: Given):
    """Requests with and without a provider and a model, some for what is not served."""
    k = F.col("k")
    asked = g.logs.select(
        "id",
        F.when(k % 5 == 0, None).when(k % 5 == 1, "").otherwise(F.col("provider")).alias("provider"),
        F.when(k % 3 == 0, None).when(k % 3 == 1, "mock-slow").otherwise(F.col("model")).alias("model"),
    )
    known = catalog.default_catalog(g.spark, ("mock", "groq", "gemini"))
    return catalog.resolve_models(asked, known).select("id", "resolved_provider", "resolved_model", "problem")


QUERIES = [
    Query("next_seq", lambda g: C.next_seq(g.messages),
          with_views("fx_messages", sql="select conversation_id, max(seq) + 1 as next_seq from fx_messages group by 1")),
    Query(
        "appended_messages",
        appended,
        with_views("fx_logs", "fx_messages", sql=""", n as (select conversation_id, max(seq) + 1 as next_seq from fx_messages group by 1)
select l.conversation_id, k as arrival_no,
  cast(coalesce(next_seq, 0) + row_number() over (partition by l.conversation_id order by k) - 1 as integer) as seq
from fx_logs l left join n using (conversation_id) where l.conversation_id is not null and status = 'success'"""),
    ),
    Query(
        "transcripts",
        lambda g: C.transcripts(C.summaries(g.messages, g.conversations), g.messages),
        with_views("fx_messages", sql=f", {SUMMARY} select m.*, title, status from fx_messages m join summaries using (conversation_id)"),
    ),
    Query(
        "one_transcript",
        lambda g: C.transcript(g.messages, "00000000-0000-4000-9000-000000000003"),
        with_views("fx_messages", sql="select * from fx_messages where conversation_id = '00000000-0000-4000-9000-000000000003'"),
    ),
    Query(
        "conversation_list",
        lambda g: C.listing(C.summaries(g.messages, g.conversations), 50, 10),
        with_views("fx_messages", sql=f", {SUMMARY} select * from summaries order by updated_at desc, conversation_id desc limit 50 offset 10"),
    ),
    Query("conversation_count", lambda g: C.count(g.conversations),
          "select count(distinct conv_id) as total from conversations"),
    Query(
        "status_changes",
        status_changes,
        with_views("fx_logs", "fx_messages", sql=f""", {SUMMARY},
c as (select conversation_id, arg_max(case when status = 'cancelled' then 'cancelled' else 'active' end, completed_at) as st,
  max(completed_at) as last_at from fx_logs where conversation_id is not null group by 1)
select conversation_id, coalesce(st, status) as status, greatest(updated_at, last_at) as updated_at
from summaries left join c using (conversation_id)"""),
    ),
    Query(
        "after_delete_messages",
        lambda g: C.delete_messages(g.messages, idle(g)),
        with_views("fx_messages", sql=f", {IDLE} select * from fx_messages where conversation_id not in (select conversation_id from idle)"),
    ),
    Query(
        "after_delete_logs",
        lambda g: C.detach_logs(g.logs, idle(g)).select("id", "conversation_id", "message_id", "status"),
        with_views("fx_logs", "fx_messages", sql=f""", {IDLE} select id,
  case when conversation_id in (select conversation_id from idle) then null else conversation_id end as conversation_id,
  message_id, status from fx_logs"""),
    ),
    Query(
        "conversation_logs",
        lambda g: C.logs_by_conversation(g.logs, g.conversations).select("conversation_id", "id", "started_at", "status"),
        with_views("fx_logs", "fx_messages", sql="""select conversation_id, id, started_at, status from fx_logs
where conversation_id in (select conversation_id from fx_messages)"""),
    ),
    Query(
        "prompt_window",
        lambda g: C.prompt_window(g.messages, 4, WINDOW_CHARS),
        with_views("fx_messages", sql=f", {WINDOW.format(m=4, c=WINDOW_CHARS)} select conversation_id, seq, role, content, created_at from win"),
    ),
    Query(
        "prompt_window_per_turn",
        lambda g: C.prompt_window_per_turn(g.messages, 4, WINDOW_CHARS),
        with_views("fx_messages", sql=f""", o as (select conversation_id, seq, role, length(content) as chars,
  row_number() over (partition by conversation_id order by seq) as pos from fx_messages),
pairs as (select u.conversation_id, u.seq as turn_seq, m.seq, m.role, m.chars,
    sum(m.chars) over (partition by u.conversation_id, u.seq order by m.seq desc rows unbounded preceding) as used,
    row_number() over (partition by u.conversation_id, u.seq order by m.seq desc) as rn
  from o u join o m on m.conversation_id = u.conversation_id and m.pos <= u.pos and m.pos > u.pos - 4 where u.role = 'user')
select conversation_id, turn_seq as seq, cast(count(*) as integer) as sent_messages, cast(sum(chars) as bigint) as sent_chars,
  min(seq) as first_seq, cast(count(*) filter (where role = 'user') as integer) as user_turns,
  cast(greatest(count(*) - 1, 0) as integer) as prior_messages
from pairs where rn = 1 or used <= {WINDOW_CHARS} group by 1, 2"""),
    ),
    Query(
        "latest_user_text",
        lambda g: C.latest_user_text(C.prompt_window(g.messages, 4, WINDOW_CHARS)),
        with_views("fx_messages", sql=f""", {WINDOW.format(m=4, c=WINDOW_CHARS)}
select conversation_id, arg_max(content, seq) filter (where role = 'user') as latest_user_text from win group by 1"""),
    ),
    Query(
        "assembled_prompts",
        lambda g: prompts(g).select("conversation_id", "system", F.posexplode("turns").alias("turn_no", "turn")).select(
            "conversation_id", "system", "turn_no", "turn.role", "turn.content"
        ),
        with_views("fx_messages", sql=f""", {WINDOW.format(m=6, c=WINDOW_CHARS)},
s as (select conversation_id, string_agg(content, chr(10) || chr(10) order by seq) as parts from win where role = 'system' group by 1)
select w.conversation_id, concat_ws(chr(10) || chr(10), 'Be brief.', parts) as system,
  cast(row_number() over (partition by w.conversation_id order by seq) - 1 as integer) as turn_no, role, content
from win w left join s using (conversation_id) where role <> 'system'"""),
    ),
    Query(
        "input_estimates",
        lambda g: C.input_estimates(C.prompt_window(g.messages, 4, WINDOW_CHARS)),
        with_views("fx_messages", sql=f""", {WINDOW.format(m=4, c=WINDOW_CHARS)}
select conversation_id, cast(sum(len(list_filter(regexp_split_to_array(content, '{RE2_SPACE}+'), lambda w: w <> ''))) as bigint) as input_tokens
from win group by 1"""),
    ),
    Query(
        "log_reply_asof",
        lambda g: correlate.replies_to_calls(g.logs, g.replies).select("id", "reply_id", "candidate_replies"),
        with_views("fx_replies", sql=""", r as (select reply_id, c.id, c.completed_at, r.created_at from fx_replies r
  asof join (select conversation_id, started_at, completed_at, id from
    (select *, row_number() over (partition by conversation_id, started_at order by id desc) as rn from fx_logs where conversation_id is not null) d where rn = 1) c
  on r.conversation_id = c.conversation_id and c.started_at <= r.created_at),
m as (select id, count(*) as n, min(reply_id) as only_id from r where created_at >= completed_at group by 1)
select l.id, case when n = 1 then only_id end as reply_id, coalesce(n, 0) as candidate_replies from fx_logs l left join m using (id)"""),
    ),
    Query(
        "capped_budgets",
        budgets,
        with_views("fx_logs", sql="""select id, provider, cast(case when k % 3 > 0 then k * 7 % 9000 end as integer) as requested_tokens,
  cast(least(coalesce(case when k % 3 > 0 then k * 7 % 9000 end, 16000), case when provider = 'groq' then 4096 else 1000000 end) as integer) as granted_tokens
from fx_logs"""),
    ),
    Query(
        "resolved_models",
        resolved,
        with_views("fx_logs", sql=""", a as (select id, case when k % 5 < 2 then 'mock' else provider end as p,
  case k % 3 when 0 then null when 1 then 'mock-slow' else model end as m from fx_logs),
b as (select id, p, case when p in ('mock', 'groq', 'gemini') then
  coalesce(m, case p when 'mock' then 'mock' when 'groq' then 'openai/gpt-oss-20b' else 'gemini-flash-latest' end) end as m from a)
select id, p as resolved_provider, m as resolved_model,
  case when m is null then 'provider_not_configured'
       when p = 'mock' and m not in ('mock', 'mock-slow', 'mock-error', 'mock-instant', 'mock-cancel') then 'model_not_supported' end as problem
from b"""),
    ),
]
