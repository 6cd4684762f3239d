"""Reading the stored log without reading all of it: newest pages, one call, one conversation, retention.

The manifests of the batches tell how calls lie in time; from them the bounds of a page are
found before the log is opened. A secondary index tells for a key which days and batches
hold it, and joins with the log so that Spark prunes its partitions at run time.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from callglass import schema as S
from callglass.operators import browse
from callglass.operators.browse import Cursor
from callglass.operators.metrics import as_timestamp
from callglass.session import broadcast_if_small, delete_exactly
from callglass.sources import retention
from callglass.sources.tables import BUCKETS, COMPACTED, PLACES, Store, bucket_of

#: How much further back each further look for a filtered page goes.
FURTHER = 8


def zones(store: Store) -> DataFrame:
    """Calls per day of ending and hour of starting, over all complete batches. At most a row per day and hour."""
    told = store.read("outcomes").select(F.inline("zones"))
    floor = store.floors().get("logs")
    if floor is not None:
        told = told.where(F.col("day") >= F.lit(floor).cast("date"))
    return told.groupBy("day", "hour").agg(
        F.min("least").alias("least"), F.max("greatest").alias("greatest"), F.sum("rows").alias("rows"), F.sum("errors").alias("errors"))


def bounds(store: Store, rows: int, cursor: Cursor | None = None, count: str = "rows") -> tuple[datetime | None, date | None, date | None]:
    """Start, first and last day among which the ``rows`` newest calls after the cursor lie.

    Zones that lie wholly before the cursor are added up from the newest on, until they
    hold enough; what started before all of those cannot be on the page. No start if there
    are fewer in all, no days if there is nothing.
    """
    own = zones(store).where(F.col(count) > 0)
    whole = own
    if cursor is not None:
        own, whole = own.where(F.col("least") <= as_timestamp(cursor.started_at)), own.where(F.col("greatest") < as_timestamp(cursor.started_at))
    so_far = F.sum(count).over(W.orderBy(F.desc("least"), F.desc("day"), F.desc("hour")).rowsBetween(W.unboundedPreceding, 0))
    start = whole.withColumn("so_far", so_far).where(F.col("so_far") >= rows).agg(F.max("least")).first()[0]
    if start is not None:
        own = own.where(F.col("greatest") >= F.lit(start))
    return start, *own.agg(F.min("day"), F.max("day")).first()


def within(store: Store, start: datetime | None, first: date | None, last: date | None) -> DataFrame:
    """The log between these bounds; the days are partitions of it."""
    logs = store.read("logs")
    if first is None:
        return logs.where(F.lit(False))
    logs = logs.where(F.col("completed_date").between(F.lit(first), F.lit(last)))
    return logs if start is None else logs.where(F.col("started_at") >= F.lit(start))


def page(store: Store, limit: int = S.DEFAULT_PAGE, cursor: Cursor | None = None, **filters) -> DataFrame:
    """One page of the stored log, newest first; reads only days that can hold it.

    The zones count calls and failed calls. For other filters they tell too little, so ever
    more of the log is searched until the page is full or nothing is left.
    """
    filters = {k: v for k, v in filters.items() if v is not None}
    count, told = ("errors", filters == {"status": "error"}) if filters.get("status") == "error" else ("rows", not filters)
    rows = limit
    while True:
        start, first, last = bounds(store, rows, cursor, count)
        found = browse.page(within(store, start, first, last), limit, cursor, **filters)
        if told or start is None or found.select("id").count() >= limit:
            return found
        rows *= FURTHER


def recent_errors(store: Store, limit: int = S.DEFAULT_PAGE) -> DataFrame:
    return page(store, limit, status="error").select(*browse.ERROR_COLUMNS)


def places(store: Store, kind: str, key: str) -> DataFrame:
    """Days and batches that hold a key: reads one bucket of the index."""
    rows = store.spark.read.schema(PLACES).parquet(store.path("places"))
    held = (F.col("bucket") == bucket_of(F.lit(key))) & (F.col("kind") == kind) & (F.col("key") == F.lit(key))
    return rows.where(held).select("completed_date", F.col("batch").alias("batch_id")).distinct()


def held_by(store: Store, kind: str, key: str) -> DataFrame:
    """Calls with this ``id`` or ``conversation_id``; the index prunes the log's partitions at run time."""
    where = broadcast_if_small(places(store, kind, key))
    logs = store.read("logs")
    return logs.join(where, ["completed_date", "batch_id"]).where(F.col(kind) == F.lit(key)).select(*logs.columns)


def by_id(store: Store, call_id: str) -> DataFrame:
    return held_by(store, "id", call_id)


def of_conversation(store: Store, conversation_id: str) -> DataFrame:
    """Calls of a conversation, oldest first."""
    return held_by(store, "conversation_id", conversation_id).orderBy("started_at", "id")


def compact_places(store: Store) -> int:
    """Puts the index rows of all complete batches into one folder per bucket; returns how many folders they were in.

    The new rows are whole before the old ones go. A crash in between leaves rows twice,
    which readers take once. Not to be run while a stream writes to the store.
    """
    rows = store.spark.read.schema(PLACES).parquet(store.path("places"))
    complete = store.read("outcomes").select(F.col("batch_id").alias("batch")).distinct()
    old = sorted(r[0] for r in rows.select("batch_id").distinct().collect())
    if len(old) > 1:
        kept = rows.join(complete, "batch", "left_semi").select("kind", "key", "completed_date", "batch", "bucket").distinct()
        store.write("places", kept, max(COMPACTED, old[-1] + 1))
        delete_exactly(store.spark, [f"{store.path('places')}/bucket={b}/batch_id={n}" for b in range(BUCKETS) for n in old])
    return len(old)


def keep_newest_dead_letters(store: Store, keep: int = S.DEAD_LETTER_KEEP) -> int | None:
    """Keeps exactly the ``keep`` newest dead letters; returns the floor, None if nothing goes.

    Dead letters of one delivery number stay or go together.

    The manifests show from where on there are enough, so only that end of the table is
    read. One rename raises the floor, from then on readers see ``keep`` rows. Batches that
    lie wholly below are deleted after it; a crash before or in between changes nothing
    that readers see, and the next run deletes what is left.
    """
    spans = store.read("outcomes").select("batch_id", "dead.*").where("rows > 0")
    so_far = F.sum("rows").over(W.orderBy(F.desc("least"), F.desc("batch_id")).rowsBetween(W.unboundedPreceding, 0))
    least = spans.withColumn("so_far", so_far).where(F.col("so_far") >= keep).agg(F.max("least")).first()[0]
    if least is None:
        return None
    edge = store.read("dead_letters").where(F.col("delivery_id") >= least).select("delivery_id")
    floor = retention.newest(edge, keep).agg(F.min("delivery_id")).first()[0]
    if floor is None:
        return None
    if floor > (store.floors().get("dead_letters") or floor - 1):
        store.raise_floor("dead_letters", floor)
    gone = [r[0] for r in spans.where(F.col("greatest") < floor).select("batch_id").collect()]
    reasons = (S.REASON_MALFORMED, S.REASON_NO_ID, S.REASON_INVALID)
    delete_exactly(store.spark, [f"{store.path('dead_letters')}/reason={r}/batch_id={b}" for b in gone for r in reasons])
    return floor


def drop_days_before(store: Store, as_of: datetime | str, days: int) -> list[date]:
    """Keeps the calls that ended in the last ``days`` days; returns the days that were deleted.

    The floor goes up first, with one rename; then whole day partitions are deleted.
    """
    moment = as_of if isinstance(as_of, datetime) else datetime.fromisoformat(str(as_of))
    floor = (moment - timedelta(days=days)).date()
    old = zones_before(store, floor)
    store.raise_floor("logs", floor.isoformat())
    delete_exactly(store.spark, [f"{store.path('logs')}/completed_date={d.isoformat()}" for d in old])
    return old


def zones_before(store: Store, floor: date) -> list[date]:
    """Days below ``floor`` that some batch filled; one row per day."""
    told = store.read("outcomes").select(F.inline("zones")).where(F.col("day") < F.lit(floor))
    return sorted(r[0] for r in told.select("day").distinct().collect())
