"""Queries that run a stream over the given tables and read back what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callglass.operators import chunks as K
from callglass.plans.dashboard import PARTS
from callglass.plans.folding import FINISHED
from callglass.plans.ingestion import ROW, ROW_COLUMNS, USABLE
from callglass.plans.registry import SINCE, Query
from callglass.session import scratch_path
from callglass.sources import given
from callglass.sources.given import Given, with_views
from callglass.sources.tables import Store
from callglass.streaming import ingest as streaming_ingest
from callglass.streaming import live


def stream_of(g: Given, name: str) -> DataFrame:
    """A given table as a stream of its files."""
    shape = g.table(name).schema
    return g.spark.readStream.schema(shape).parquet(f"{g.folder}/{name}.parq[u]et")


def run(g: Given, rows: DataFrame, name: str) -> DataFrame:
    """Runs a stream to its end and returns the table it filled."""
    path = scratch_path(g.spark, name)
    live.to_table(rows, f"{path}/rows", f"{path}/checkpoint").awaitTermination()
    return g.spark.read.schema(rows.schema).parquet(f"{path}/rows")


def rollup(g: Given) -> DataFrame:
    return run(g, live.rollup(given.logs_from(stream_of(g, "events"))), "rollup")


def live_summary(g: Given) -> DataFrame:
    """The live view after calls came in three batches, the later two of which reach back to the first minute."""
    path = scratch_path(g.spark, "live")
    events = g.table("events")
    for third in range(3):
        events.where(F.col("event_id") % 3 == third).coalesce(1).write.mode("append").parquet(f"{path}/in")
    source = g.spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    live.keep_counts(given.logs_from(source), f"{path}/counts", f"{path}/checkpoint").awaitTermination()
    return live.summary(g.spark, f"{path}/counts", SINCE, "hour")


def folds(g: Given) -> DataFrame:
    """Calls all of whose runs (of four chunks) have closed, folded to the end from the stream's rows."""
    runs = run(g, live.fold_stream(given.chunks_from(stream_of(g, "conversations")), run=4), "runs")
    return K.whole_calls(runs, g.calls).select(
        "call_id", "text", "chunks", "ttft_ms", "latency_ms", "input_tokens", "output_tokens", "finish_reason", "metadata_json"
    )


def store(g: Given) -> Store:
    """The tables after the ingestion stream has taken all deliveries."""
    path = scratch_path(g.spark, "ingest")
    target = Store(g.spark, f"{path}/tables")
    deliveries = given.envelopes_from(given.logs_from(stream_of(g, "events")))
    streaming_ingest.start(deliveries, target, f"{path}/checkpoint", every=None).awaitTermination()
    return target


#: Filled stores by data folder and application; queries that only read may share one.
_stores: dict[tuple[str, str], Store] = {}


def shared_store(g: Given) -> Store:
    key = (g.spark.sparkContext.applicationId, g.folder)
    if key not in _stores:
        _stores[key] = store(g)
    return _stores[key]


def stored_logs(g: Given) -> DataFrame:
    return store(g).read("logs").select(*ROW_COLUMNS, F.to_json("raw_metadata").alias("raw_metadata"))


def stored_state(g: Given) -> DataFrame:
    return store(g).raw_state().select("id", "event_type", "delivery_id", "processing_status", "processing_error")


QUERIES = [
    Query(
        "live_minute_rollup",
        rollup,
        with_views("fx_logs", sql="""select date_trunc('minute', completed_at) as bucket, count(*) as requests,
  count(*) filter (where status = 'error') as errors, count(*) filter (where status = 'cancelled') as cancellations,
  cast(coalesce(sum(input_tokens), 0) as bigint) as input_tokens, cast(coalesce(sum(output_tokens), 0) as bigint) as output_tokens
from fx_logs group by 1
having date_trunc('minute', completed_at) + interval '1 minute' <= (select max(completed_at) from fx_logs) - interval '10 minutes'"""),
    ),
    Query(
        "live_summary",
        live_summary,
        with_views("fx_logs", sql=f""", w as (select *, date_trunc('hour', completed_at) as hour from fx_logs where completed_at >= timestamp '{SINCE}')
select 'total' as part, {PARTS} from w
union all by name select 'series' as part, hour as bucket, {PARTS} from w group by hour
union all by name select 'provider' as part, provider, model, {PARTS} from w group by provider, model"""),
    ),
    Query(
        "streamed_folds",
        folds,
        with_views("fx_calls", "fx_chunks", sql=f""", {FINISHED},
r as (select call_id, chunk_no // 4 as run, max(emitted_at) as last_at from fx_chunks group by 1, 2),
closed as (select max(last_at) as passed from r
  where last_at + interval '2 minutes' <= date_trunc('milliseconds', (select max(last_at) from r)) - interval '1 minute')
select call_id, text, chunks, ttft_ms, latency_ms, input_tokens, output_tokens, finish_reason, metadata_json
from done, closed where chunks > 0 and ended_at <= passed"""),
    ),
    Query(
        "stored_logs",
        stored_logs,
        with_views("fx_deliveries", sql=f"""select {ROW}, raw_metadata_json as raw_metadata from fx_logs
where id in (select id from fx_deliveries where reason is null)"""),
    ),
    Query(
        "stored_state",
        stored_state,
        with_views("fx_deliveries", sql=f"""select id, 'inference.completed' as event_type, min(delivery_id) as delivery_id,
  arg_max(case when reason is null then 'processed' else 'failed' end, delivery_id) as processing_status,
  any_value(problem) as processing_error from fx_deliveries where {USABLE} group by id"""),
    ),
]
