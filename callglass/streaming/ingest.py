"""The ingestion stream: deliveries in, tables out, each call once.

Which ids are stored already is the stream's own keyed state: ``dropDuplicates`` on (id, what
it is stored as) in the state store. Spark keeps it in RocksDB beside the checkpoint, by
version: a batch that runs again starts from the state before it. So a batch costs what it
brings, however long the history. Batches that the state has not seen (replays, another
stream's) are found once when a stream starts, and only they are searched for ids.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from callglass.functions.frames import spread
from callglass.operators import ingest
from callglass.session import broadcast_if_small, configure, delete_path, scratch_path
from callglass.sources import tables
from callglass.sources.tables import Store

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Seconds between a failed batch and the next try.
PAUSE = 1.0


#: Off while an ingestion stream is planned, so that both branches of ``with_new_keys`` need the same columns.
PRUNING = "spark.sql.optimizer.expression.nestedPruning.enabled"


def with_new_keys(envelopes: DataFrame, check_with=ingest.check) -> DataFrame:
    """Judged deliveries of a stream, and beside them a row for each key the stream has not had before.

    A key is an id with the table it goes to: ``raw`` for every usable id, ``logs`` for an
    id with a valid event. The keys pass through the keyed state; deliveries do not. Both
    branches read one shuffle of the judged deliveries, so each is checked once. An earlier
    shuffle of the plain deliveries spreads a batch of few files over all cores.
    """
    cores = envelopes.sparkSession.sparkContext.defaultParallelism
    sent = envelopes.select("delivery_id", "data").repartition(cores, "delivery_id")
    judged = ingest.judged(check_with(sent))
    rows = judged.select(F.struct(*judged.columns).alias("row")).repartition(cores, "row.delivery_id")
    usable, valid = F.col("row.id").isNotNull(), F.col("row.reason").isNull()
    targets = F.when(usable & valid, F.array(F.lit("raw"), F.lit("logs"))).when(usable, F.array(F.lit("raw")))
    # The outer explode keeps the filter above the shuffle, which would be done twice if it differed.
    keys = rows.select(F.col("row.id").alias("id"), F.explode_outer(targets).alias("target")).where(F.col("target").isNotNull())
    none = F.lit(None).cast("string")
    kind = judged.select(F.struct(*judged.columns).alias("row")).schema["row"].dataType
    new = keys.dropDuplicates(["id", "target"]).select(F.lit(None).cast(kind).alias("row"), "id", "target")
    return rows.select("row", none.alias("id"), none.alias("target")).unionByName(new)


def known_ids(store: Store, ids: DataFrame, batch_id: int, fresh: DataFrame | None, unknown: list[int]) -> DataFrame:
    """Which ids of a batch are stored: ``in_raw``, ``in_logs``.

    Without ``fresh``, the new keys of the keyed state, all batches before this one are
    searched; with it, only the ``unknown`` batches.
    """
    if fresh is None:
        return ingest.stored_ids(store.read("raw", batch_id), store.read("logs", batch_id), broadcast_if_small(ids))
    new = fresh.groupBy("id").agg(F.bool_or(F.col("target") == "raw").alias("_raw"), F.bool_or(F.col("target") == "logs").alias("_logs"))
    flag = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    known = ids.join(new, "id", "left").select("id", flag("_raw").alias("in_raw"), flag("_logs").alias("in_logs"))
    if unknown:
        among = F.col("batch_id").isin(unknown)
        found = ingest.stored_ids(store.read("raw").where(among), store.read("logs").where(among), broadcast_if_small(ids))
        known = known.unionByName(found).groupBy("id").agg(F.bool_or("in_raw").alias("in_raw"), F.bool_or("in_logs").alias("in_logs"))
    return known


def write_batch(store: Store, envelopes: DataFrame, batch_id: int, check_with=ingest.check) -> None:
    """One batch of deliveries that no keyed state has seen; all stored ids are searched for its own.

    Running it again replaces what it wrote before.
    """
    staged = scratch_path(store.spark, "batch")
    store.clear(batch_id)
    try:
        rows = staged_table(ingest.judged(check_with(spread(envelopes, "delivery_id"))), f"{staged}/judged")
        write_judged(store, rows, batch_id, staged)
    finally:
        delete_path(store.spark, staged)


def write_keyed(store: Store, rows: DataFrame, batch_id: int, unknown: list[int], state: str) -> None:
    """One micro-batch of ``with_new_keys``. Its rows are written out, so that the state is brought forward once.

    The checkpoint moves on after the last write, so a crash anywhere leads to a repeat,
    which replaces what was written.
    """
    staged = scratch_path(store.spark, "batch")
    store.clear(batch_id)
    try:
        rows = staged_table(rows, f"{staged}/judged")
        fresh = rows.where(F.col("target").isNotNull()).select("id", "target")
        write_judged(store, rows.where(F.col("target").isNull()).select("row.*"), batch_id, staged, fresh, unknown, state)
    finally:
        delete_path(store.spark, staged)


def write_judged(
    store: Store, judged: DataFrame, batch_id: int, staged: str, fresh: DataFrame | None = None, unknown: list[int] | None = None,
    state: str | None = None,
) -> None:
    """Fills the tables from a batch that lies in the shared scratch folder.

    Each write reads it from there: plans are short, and a lost executor costs no second check.
    """
    spark = store.spark
    now = F.lit(spark.sql("select current_timestamp()").first()[0])
    ids = judged.where(F.col("id").isNotNull()).select("id").distinct()
    known = staged_table(known_ids(store, ids, batch_id, fresh, unknown or []), f"{staged}/known")
    landing = ingest.land(judged, known.where("in_raw").select("id"), known.where("in_logs").select("id"))
    ended = judged.where(F.col("reason").isNull()).select(F.to_date("event.completed_at").alias("day")).distinct()
    days = sorted(r["day"].isoformat() for r in ended.collect())  # days of one batch
    store.intend(batch_id, days)
    store.write("raw", landing.raw.withColumn("received_at", now), batch_id)
    store.write("dead_letters", landing.dead_letters, batch_id)
    store.write("logs", landing.logs.withColumn("ingested_at", now).withColumn("completed_date", F.to_date("completed_at")), batch_id)
    store.write("attempts", landing.attempts.withColumn("processed_at", now), batch_id)
    added = store.written(batch_id, days)
    store.write("places", tables.places_of(added, batch_id), batch_id)
    dead = F.struct(F.min("delivery_id").alias("least"), F.max("delivery_id").alias("greatest"), F.count(F.lit(1)).alias("rows"))
    zones = tables.zones_of(added).agg(F.collect_list(F.struct(*tables.ZONE.fieldNames())).alias("zones"))
    rows = [landing.outcomes, landing.dead_letters.agg(dead.alias("dead")), zones]  # one row each, folded into one
    both = rows[0].unionByName(rows[1], allowMissingColumns=True).unionByName(rows[2], allowMissingColumns=True)
    one = both.agg(*[F.first(c, ignorenulls=True).alias(c) for c in both.columns])
    store.write("outcomes", one.withColumn("state", F.lit(state).cast("string")).withColumn("ingested_at", F.when(F.size("zones") > 0, now)), batch_id)


def staged_table(df: DataFrame, path: str) -> DataFrame:
    """A frame of this batch, written below the shared scratch folder and read back."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def start(
    envelopes: DataFrame, store: Store, checkpoint: str, every: str | None = "2 seconds", check_with=ingest.check
) -> StreamingQuery:
    """Starts ingestion; without ``every`` it handles what is there and stops.

    The checkpoint names the keyed state. Several streams may fill one store one after the
    other, each with its own checkpoint.
    """
    spark = configure(store.spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    store.create()
    base, unknown = store.first_batch_of(checkpoint), store.batches_unknown_to(checkpoint)
    trigger = {"processingTime": every} if every else {"availableNow": True}
    pruning = spark.conf.get(PRUNING)
    spark.conf.set(PRUNING, "false")  # a stream keeps the settings it was started under
    try:
        return (
            with_new_keys(envelopes, check_with)
            .writeStream.foreachBatch(lambda df, n: write_keyed(store, df, base + n, unknown, checkpoint))
            .outputMode("append")
            .option("checkpointLocation", checkpoint)
            .trigger(**trigger)
            .start()
        )
    finally:
        spark.conf.set(PRUNING, pruning)


def supervise(begin: Callable[[], StreamingQuery], tries: int | None = None, pause: float = PAUSE) -> int:
    """Runs a stream to its end, starting it again after a failed batch; returns how often it failed.

    ``begin`` starts the query on its checkpoint, so nothing is lost or repeated. A batch that
    ends well sets the count of failures in a row back. More than ``tries`` of them in a row
    raise the last failure; without ``tries`` it goes on.
    """
    failed, in_a_row, done = 0, 0, None
    while True:
        query = begin()
        try:
            query.awaitTermination()
            return failed
        except Exception:  # noqa: BLE001 - the query tells what went wrong; whatever it was, the batch is tried again
            progress = query.lastProgress
            batch = progress["batchId"] if progress else None
            in_a_row = 1 if batch is not None and batch != done else in_a_row + 1
            done, failed = batch if batch is not None else done, failed + 1
            if tries is not None and in_a_row > tries:
                raise
            time.sleep(pause)


def replay_failed(store: Store, batch_id: int | None = None, repair=None, check_with=ingest.check) -> None:
    """Runs failed raw events through a fixed contract, as a batch of its own.

    Without ``batch_id`` it gets the next number for replays; a given one must be above every
    batch so far and of no stream. Streams are stopped meanwhile; what a replay stores they find when they
    start again. The failed events are written out first, so that the batch does not read
    the tables it fills. All stored ids are searched for those of the batch.
    """
    batch_id = store.next_replay() if batch_id is None else batch_id
    path = f"{store.root}/replay-{batch_id}"
    failed = store.raw_state(batch_id).where(F.col("processing_status") == "failed")
    failed.select("delivery_id", "payload").write.mode("overwrite").parquet(path)
    rows = store.spark.read.schema("delivery_id long, payload string").parquet(path)
    write_batch(store, rows, batch_id, lambda again: ingest.replay(again, repair, check_with))
    delete_path(store.spark, path)
