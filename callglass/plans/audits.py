"""Table audit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from callglass.operators import audit, ingest
from callglass.plans.ingestion import USABLE, checked, landed_state
from callglass.plans.registry import Query
from callglass.sources.given import Given, with_views


def damaged(g: Given):
    """The log with a few rules broken on purpose: units, order and spelling."""
    k = F.col("k")
    return (
        g.logs.withColumn("latency_ms", F.when(k % 101 == 0, -1).otherwise(F.col("latency_ms")))
        .withColumn("started_at", F.when(k % 211 == 0, F.col("completed_at") + F.expr("interval 1 second")).otherwise(F.col("started_at")))
        .withColumn("status", F.when(k % 307 == 0, F.upper("status")).otherwise(F.col("status")))
        .withColumn("provider", F.when(k % 401 == 0, F.repeat("provider", 20)).otherwise(F.col("provider")))
        .withColumn("ingested_at", F.when(k % 503 == 0, None).otherwise(F.col("ingested_at")))
    )


def answered(g: Given):
    """The log with the message that each call left, as it is once replies are known."""
    told = (F.col("status") == "success") & F.col("conversation_id").isNotNull()
    return g.logs.withColumn("message_id", F.when(told, F.concat(F.lit("reply-"), F.substring("id", 25, 12))))


def odd_conversations(g: Given):
    """Conversations, some with a status in capitals."""
    return g.conversations.withColumn("status", F.when(F.col("conversation_id").endswith("7"), F.upper("status")).otherwise(F.col("status")))


def odd_states(g: Given):
    """Raw events with their state, some of them in a state that does not exist."""
    return landed_state(g).withColumn("processing_status", F.when(F.col("delivery_id") % 11 == 0, "done").otherwise(F.col("processing_status")))


def zero(rules, *but: str) -> str:
    return ", ".join(repr(r) for r in rules if r not in but)


ZERO = [r for r in audit.CALL_RULES if r not in (
    "latency_ms_non_negative", "completed_after_started", "status_domain", "provider_length", "ingested_at_not_null")]

QUERIES = [
    Query(
        "audit_checks",
        lambda g: audit.violations(damaged(g), audit.CALL_RULES),
        with_views("fx_logs", sql=f"""select 'latency_ms_non_negative' as rule, count(*) filter (where k % 101 = 0) as violations from fx_logs
union all select 'completed_after_started', count(*) filter (where k % 211 = 0) from fx_logs
union all select 'status_domain', count(*) filter (where k % 307 = 0) from fx_logs
union all select 'provider_length', count(*) filter (where k % 401 = 0 and length(provider) * 20 > 64) from fx_logs
union all select 'ingested_at_not_null', count(*) filter (where k % 503 = 0) from fx_logs
union all select unnest([{', '.join(repr(z) for z in ZERO)}]), 0"""),
    ),
    Query(
        "audit_messages",
        lambda g: audit.violations(g.messages, audit.MESSAGE_RULES),
        with_views("fx_messages", sql="""select 'role_domain' as rule, count(*) filter (where role not in ('user', 'assistant', 'system')) as violations from fx_messages
union all select 'content_length', count(*) filter (where length(content) not between 1 and 32000) from fx_messages
union all select unnest(['conversation_id_not_null', 'seq_not_null', 'content_not_null', 'role_not_null', 'created_at_not_null']), 0"""),
    ),
    Query(
        "audit_conversations",
        lambda g: audit.violations(odd_conversations(g), audit.CONVERSATION_RULES),
        with_views("fx_messages", sql=f"""select 'status_domain' as rule, count(distinct conversation_id) as violations
from fx_messages where conversation_id like '%7'
union all select unnest([{zero(audit.CONVERSATION_RULES, "status_domain")}]), 0"""),
    ),
    Query(
        "audit_raw",
        lambda g: audit.violations(odd_states(g), audit.RAW_RULES),
        with_views("fx_deliveries", sql=f"""select 'processing_status_domain' as rule, count(*) as violations
from (select id, min(delivery_id) as d from fx_deliveries where {USABLE} group by id) r where d % 11 = 0
union all select unnest([{zero(audit.RAW_RULES, "processing_status_domain")}]), 0"""),
    ),
    Query(
        "audit_dead_letters",
        lambda g: audit.violations(ingest.dead_letters(checked(g)).withColumn("reason", F.when(F.col("delivery_id") % 13 > 0, F.col("reason"))), audit.DEAD_LETTER_RULES),
        with_views("fx_deliveries", sql=f"""select 'reason_not_null' as rule, count(*) as violations
from fx_deliveries where reason is not null and delivery_id % 13 = 0
union all select unnest([{zero(audit.DEAD_LETTER_RULES, "reason_not_null")}]), 0"""),
    ),
    Query(
        "audit_primary_key",
        lambda g: audit.repeated_keys(checked(g).where("id is not null").select("id"), ["id"]),
        with_views("fx_deliveries", sql=f"select id, count(*) as occurrences from fx_deliveries where {USABLE} group by id having count(*) > 1"),
    ),
    Query(
        "audit_message_refs",
        lambda g: audit.dangling(g.messages, "conversation_id", g.conversations.where(~F.col("conversation_id").endswith("3")), "conversation_id"),
        with_views("fx_messages", sql="""select conversation_id, count(*) as "rows" from fx_messages where conversation_id like '%3' group by 1"""),
    ),
    Query(
        "audit_keys",
        lambda g: audit.repeated_keys(g.logs.select("conversation_id", F.date_trunc("hour", "started_at").alias("hour"))
                                      .where("conversation_id is not null"), ["conversation_id", "hour"]),
        with_views("fx_logs", sql="""select conversation_id, date_trunc('hour', started_at) as hour, count(*) as occurrences
from fx_logs where conversation_id is not null group by 1, 2 having count(*) > 1"""),
    ),
    Query(
        "audit_message_keys",
        lambda g: audit.repeated_keys(g.messages, ["conversation_id", "seq"]),
        with_views("fx_messages", sql="select conversation_id, seq, count(*) as occurrences from fx_messages group by 1, 2 having count(*) > 1"),
    ),
    Query(
        "audit_repeated_messages",
        lambda g: audit.repeated_keys(g.messages.withColumn("seq", F.floor(F.col("seq") / 3).cast("int")), ["conversation_id", "seq"]),
        with_views("fx_messages", sql="""select conversation_id, cast(floor(seq / 3) as integer) as seq, count(*) as occurrences
from fx_messages group by 1, 2 having count(*) > 1"""),
    ),
    Query(
        "audit_call_messages",
        lambda g: audit.dangling(answered(g), "message_id", g.replies.where(~F.col("reply_id").endswith("3")), "reply_id"),
        with_views("fx_replies", sql="""select reply_id as message_id, count(*) as "rows" from fx_replies where reply_id like '%3' group by 1"""),
    ),
    Query(
        "audit_refs",
        lambda g: audit.dangling(g.logs, "conversation_id", g.conversations, "conversation_id"),
        with_views("fx_logs", "fx_messages", sql="""select conversation_id, count(*) as "rows" from fx_logs
where conversation_id is not null and conversation_id not in (select conversation_id from fx_messages) group by 1"""),
    ),
]
