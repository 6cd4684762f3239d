"""Ingestion queries over the derived deliveries."""

from __future__ import annotations

from pyspark.sql import functions as F

from callglass import schema as S
from callglass.operators import contract, ingest
from callglass.plans.dashboard import raw_state_of
from callglass.plans.registry import Query
from callglass.sources import retention
from callglass.sources.given import Given, with_views

ROW = """id, schema_version, conversation_id, provider, model, status, streamed, started_at, completed_at, latency_ms, ttft_ms,
  input_tokens, output_tokens, error_type, error_message, finish_reason"""
ROW_COLUMNS = [c.strip() for c in ROW.split(",")]
USABLE = "coalesce(reason, '') not in ('malformed_json', 'missing_or_invalid_id')"


def checked(g: Given):
    return ingest.check(g.envelopes)


def outcomes(g: Given):
    return ingest.outcome_counts(checked(g))


def landed_state(g: Given):
    """The two landing tables joined, as the stored form is read."""
    c = checked(g)
    return ingest.raw_state(ingest.raw_rows(c), ingest.attempts(c), ["delivery_id"])


def rows(logs):
    return logs.select(*ROW_COLUMNS, F.to_json("raw_metadata").alias("raw_metadata"))


def replayed(g: Given):
    """Failed events again, with the status spelt as the contract wants it."""
    failed = raw_state_of(g).where("processing_status = 'failed'")
    repair = lambda data: F.regexp_replace(data, '"status":"ERROR"', '"status":"error"')
    done = ingest.log_rows(checked(g))
    again = ingest.log_rows(ingest.replay(failed, repair))
    return rows(ingest.not_stored(again, ingest.already_stored(done, again)))


def earlier(g: Given):
    """Half of the log, as if stored before: the calls that did not stream."""
    return g.logs.where(~F.col("streamed"))


def versioned(g: Given):
    """Two shapes of one event: the second calls its latency ``duration_ms`` and nests the tokens."""
    old = F.to_json(F.struct(F.lit(1).alias("schema_version"), "id", "provider", "latency_ms", "input_tokens", "output_tokens"))
    usage = F.struct(F.col("input_tokens").alias("in"), F.col("output_tokens").alias("out")).alias("usage")
    new = F.to_json(F.struct(F.lit(2).alias("schema_version"), "id", "provider", F.col("latency_ms").alias("duration_ms"), usage))
    lines = g.logs.select(F.when(F.col("streamed"), new).otherwise(old).alias("data"))
    docs = lines.select(F.try_parse_json("data").alias("d"))
    docs = docs.withColumn("schema_version", F.try_variant_get("d", "$.schema_version", "int"))
    get = lambda path, kind="int": F.try_variant_get("d", path, kind)
    common = {"id": get("$.id", "string"), "provider": get("$.provider", "string")}
    return contract.by_version(docs, {
        1: {**common, "latency_ms": get("$.latency_ms"), "input_tokens": get("$.input_tokens"), "output_tokens": get("$.output_tokens")},
        2: {**common, "latency_ms": get("$.duration_ms"), "input_tokens": get("$.usage.in"), "output_tokens": get("$.usage.out")},
    })


def published_back(g: Given):
    """Calls published as JSON and read back through the contract."""
    sent = contract.publish(g.calls_with_metadata).select(F.col("k").alias("delivery_id"), "data")
    return rows(contract.to_rows(ingest.check(sent)))


def ended(g: Given):
    """How each call ended, as its wrapper sees it, classified back into status and error."""
    from callglass.functions.measures import classify_end

    m = F.col("k") % 4
    kind = (
        F.when(F.col("status") == "success", "completed").when(F.col("status") == "cancelled", "cancelled")
        .when(m < 2, "provider_error").otherwise("unexpected")
    )
    seen = g.logs.select(
        "id", kind.alias("end_kind"),
        F.when(m == 0, F.col("error_type")).alias("vendor_error"),
        F.when(m < 2, "ProviderError").otherwise("ValueError").alias("error_class"),
        F.when(m == 3, "").otherwise(F.col("error_message")).alias("message"),
    )
    return seen.select("id", "end_kind", F.inline(F.array(classify_end("end_kind", "vendor_error", "error_class", "message"))))


QUERIES = [
    Query(
        "decode_classes",
        lambda g: checked(g).groupBy(F.coalesce("reason", F.lit("valid")).alias("class")).agg(F.count(F.lit(1)).alias("deliveries")),
        with_views("fx_deliveries", sql="select coalesce(reason, 'valid') as class, count(*) as deliveries from fx_deliveries group by 1"),
    ),
    Query(
        "validation_reasons",
        lambda g: checked(g).select(F.explode("problems").alias("problem")).groupBy("problem").agg(F.count(F.lit(1)).alias("deliveries")),
        with_views("fx_deliveries", sql="""select problem, count(*) as deliveries from
  (select unnest(string_split(problem, '; ')) as problem from fx_deliveries where problem is not null) p group by 1"""),
    ),
    Query(
        "unknown_keys",
        lambda g: contract.unknown_keys(contract.decode(g.envelopes)),
        with_views("fx_deliveries", sql="select 'latency_seconds' as key, count(*) as documents from fx_deliveries where k % 50 = 8"),
    ),
    Query(
        "dead_letters",
        lambda g: ingest.dead_letters(checked(g)).select("delivery_id", "reason"),
        with_views("fx_deliveries", sql="select delivery_id, reason from fx_deliveries where reason is not null"),
    ),
    Query(
        "batch_outcomes",
        outcomes,
        with_views("fx_deliveries", sql="""select count(*) filter (where coalesce(reason, '') <> 'malformed_json') as received,
  count(distinct id) filter (where reason is null) as inserted,
  count(*) filter (where reason is null) - count(distinct id) filter (where reason is null) as duplicates,
  count(*) filter (where reason in ('missing_or_invalid_id', 'schema_validation_failed')) as rejected
from fx_deliveries"""),
    ),
    Query(
        "ingested_logs",
        lambda g: rows(ingest.log_rows(checked(g))),
        with_views("fx_deliveries", sql=f"""select {ROW}, raw_metadata_json as raw_metadata from fx_logs
where id in (select id from fx_deliveries where reason is null)"""),
    ),
    Query(
        "raw_state",
        lambda g: landed_state(g).select("id", "event_type", "delivery_id", "processing_status", "processing_error"),
        with_views("fx_deliveries", sql=f"""select id, 'inference.completed' as event_type, min(delivery_id) as delivery_id,
  arg_max(case when reason is null then 'processed' else 'failed' end, delivery_id) as processing_status,
  any_value(problem) as processing_error from fx_deliveries where {USABLE} group by id"""),
    ),
    Query(
        "replayed_logs",
        replayed,
        with_views("fx_logs", sql=f"select {ROW}, raw_metadata_json as raw_metadata from (select * replace ('error' as status) from fx_logs where k % 50 = 5 and status <> 'success') r"),
    ),
    Query("published_envelopes", published_back, with_views("fx_logs", sql=f"select {ROW}, raw_metadata_json as raw_metadata from fx_logs")),
    Query(
        "stored_duplicates",
        lambda g: ingest.already_stored(earlier(g), ingest.log_rows(checked(g))),
        with_views("fx_deliveries", sql="select distinct id from fx_deliveries where reason is null and not streamed"),
    ),
    Query(
        "new_deliveries",
        lambda g: (lambda new: ingest.not_stored(new, ingest.already_stored(earlier(g), new)))(
            ingest.log_rows(checked(g))
        ).select("id", "delivery_id"),
        with_views("fx_deliveries", sql="select id, min(delivery_id) as delivery_id from fx_deliveries where reason is null and streamed group by id"),
    ),
    Query(
        "retained_newest",
        lambda g: retention.newest(g.envelopes, S.DEAD_LETTER_KEEP, "delivery_id").select("delivery_id"),
        with_views("fx_deliveries", sql="select delivery_id from fx_deliveries order by delivery_id desc limit 10000"),
    ),
    Query(
        "retained_since",
        lambda g: retention.younger_than(g.logs, "ingested_at", "2024-01-31 00:00:00", 14).select("id", "ingested_at"),
        with_views("fx_logs", sql="select id, ingested_at from fx_logs where ingested_at >= timestamp '2024-01-31 00:00:00' - interval '14 days'"),
    ),
    Query(
        "versioned_union",
        versioned,
        with_views("fx_logs", sql="select case when streamed then 2 else 1 end as schema_version, id, provider, latency_ms, input_tokens, output_tokens from fx_logs"),
    ),
    Query(
        "classified_outcomes",
        ended,
        with_views("fx_logs", sql="""select id,
  case status when 'success' then 'completed' when 'cancelled' then 'cancelled'
       else case when k % 4 < 2 then 'provider_error' else 'unexpected' end end as end_kind,
  status,
  case when status = 'error' then case k % 4 when 0 then error_type when 1 then 'ProviderError' else 'ValueError' end end as error_type,
  case status when 'cancelled' then 'Cancelled by client' when 'error' then case when k % 4 = 3 then 'ValueError' else error_message end end as error_message
from fx_logs"""),
    ),
]
