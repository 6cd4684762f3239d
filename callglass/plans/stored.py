"""Queries over the tables that the ingestion stream has filled: several batches, pruned reading, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callglass.operators import browse
from callglass.plans.browser import CALL
from callglass.plans.ingestion import USABLE
from callglass.plans.registry import Query
from callglass.plans.streams import shared_store, store
from callglass.session import scratch_path
from callglass.sources import envelopes, pages
from callglass.sources.given import Given, with_views
from callglass.sources.tables import Store
from callglass.streaming import ingest as streaming_ingest

CONVERSATION = "00000000-0000-4000-9000-000000000007"
CALL_ID = "00000000-0000-4000-8000-000000000042"
#: Columns of a stored call that its event fixes; the landing time is the clock's.
SHOWN = [c.strip() for c in CALL.split(",") if c.strip() != "ingested_at"]
VALID = "id in (select id from fx_deliveries where reason is null)"
DEAD_KEEP = 500


def in_batches(g: Given) -> DataFrame:
    """Counts per batch when deliveries come in four files: two of first deliveries, two of second ones."""
    path = scratch_path(g.spark, "batches")
    rows = g.envelopes.withColumn("file", F.col("delivery_id") % 2 * 2 + F.floor(F.col("delivery_id") / 2) % 2)
    rows.write.partitionBy("file").parquet(f"{path}/split")
    split = g.spark.read.schema("delivery_id long, data string, file long").parquet(f"{path}/split")
    for file in range(4):  # one file after the other, as they arrive
        split.where(F.col("file") == file).drop("file").coalesce(1).write.mode("append").parquet(f"{path}/in")
    target = Store(g.spark, f"{path}/tables")
    source = envelopes.file_stream(g.spark, f"{path}/in", files_per_batch=1)
    streaming_ingest.start(source, target, f"{path}/checkpoint", every=None).awaitTermination()
    counts = lambda name: target.read(name).groupBy("batch_id").agg(F.count(F.lit(1)).alias(f"{name}_rows"))
    told = target.read("outcomes").select("batch_id", "received", "inserted", "duplicates", "rejected")
    both = told.join(counts("raw"), "batch_id", "left").join(counts("logs"), "batch_id", "left")
    return both.fillna(0, ["raw_rows", "logs_rows"])


def stored_page(g: Given) -> DataFrame:
    """The second page of 50, found by the bounds of the manifests."""
    kept = shared_store(g)
    first = pages.page(kept, 50).select("started_at", "id").collect()
    return pages.page(kept, 50, browse.Cursor(first[-1]["started_at"], first[-1]["id"])).select(*SHOWN)


def stored_filtered(g: Given) -> DataFrame:
    return pages.page(shared_store(g), 40, provider="groq", status="cancelled").select(*SHOWN)


def retained(g: Given) -> DataFrame:
    """Dead letters after two runs of retention, the second of which finds nothing to do."""
    kept = store(g)
    for _ in range(2):
        pages.keep_newest_dead_letters(kept, DEAD_KEEP)
    return kept.read("dead_letters").select("delivery_id", "reason")


def retained_days(g: Given) -> DataFrame:
    """The log after days older than a week have been dropped."""
    kept = store(g)
    pages.drop_days_before(kept, "2024-01-31 00:00:00", 7)
    return kept.read("logs").select("id", "completed_at")


def page_sql(where: str, limit: int, offset: int = 0) -> str:
    return with_views("fx_deliveries", sql=f"""select {', '.join(SHOWN)} from fx_logs where {VALID} and {where}
order by started_at desc, id desc limit {limit} offset {offset}""")


QUERIES = [
    Query(
        "stored_in_batches",
        in_batches,
        with_views("fx_deliveries", sql=f""", d as (select *, delivery_id % 2 * 2 + k % 2 as batch_id, reason is null as valid, {USABLE} as usable from fx_deliveries),
first as (select id, min(batch_id) filter (where usable) as raw_batch, min(batch_id) filter (where valid) as log_batch from d group by id)
select batch_id, count(*) filter (where coalesce(reason, '') <> 'malformed_json') as received,
  count(distinct d.id) filter (where valid and log_batch = batch_id) as inserted,
  count(*) filter (where valid) - count(distinct d.id) filter (where valid and log_batch = batch_id) as duplicates,
  count(*) filter (where reason in ('missing_or_invalid_id', 'schema_validation_failed')) as rejected,
  count(distinct d.id) filter (where usable and raw_batch = batch_id) as raw_rows,
  count(distinct d.id) filter (where valid and log_batch = batch_id) as logs_rows
from d join first on d.id = first.id group by 1"""),
    ),
    Query("stored_page", stored_page, page_sql("true", 50, 50)),
    Query("stored_filtered", stored_filtered, page_sql("provider = 'groq' and status = 'cancelled'", 40)),
    Query(
        "stored_errors",
        lambda g: pages.recent_errors(shared_store(g), 100).select("id", "provider", "model", "status", "started_at", "error_type"),
        with_views("fx_deliveries", sql=f"""select id, provider, model, status, started_at, error_type from fx_logs
where {VALID} and status = 'error' order by started_at desc, id desc limit 100"""),
    ),
    Query(
        "stored_conversation",
        lambda g: pages.of_conversation(shared_store(g), CONVERSATION).select(*SHOWN),
        with_views("fx_deliveries", sql=f"select {', '.join(SHOWN)} from fx_logs where {VALID} and conversation_id = '{CONVERSATION}'"),
    ),
    Query(
        "stored_call",
        lambda g: pages.by_id(shared_store(g), CALL_ID).select(*SHOWN),
        with_views("fx_deliveries", sql=f"select {', '.join(SHOWN)} from fx_logs where {VALID} and id = '{CALL_ID}'"),
    ),
    Query(
        "retained_dead_letters",
        retained,
        with_views("fx_deliveries", sql=f"select delivery_id, reason from fx_deliveries where reason is not null order by delivery_id desc limit {DEAD_KEEP}"),
    ),
    Query(
        "retained_days",
        retained_days,
        with_views("fx_deliveries", sql=f"select id, completed_at from fx_logs where {VALID} and completed_at >= timestamp '2024-01-24 00:00:00'"),
    ),
]
