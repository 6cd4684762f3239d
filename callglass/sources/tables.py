"""The stored tables: layout, batch-wise writes that can be repeated, reads.

Every micro-batch owns its ``batch_id`` partitions. It clears them before it writes, so a
batch that runs again, even under another contract, leaves what it wrote last and nothing
else. ``outcomes`` is cleared first and written last: a batch whose row is there is
complete, and readers see complete batches only. Reading with ``before_batch`` gives what
was there when the batch first ran.

The row in ``outcomes`` is also the batch's manifest: which keyed state knew its ids, how its
calls lie in time (``zones``), and between which delivery numbers its dead letters are. The
days a batch is about to fill are noted before they are filled (``intents``), so that
clearing it lists no folder. ``places`` tells for each call and conversation which days and
batches hold it. ``floors`` holds below what each table has been dropped; the newest file counts,
and readers apply it, so a retention run takes effect with one rename.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callglass import schema as S
from callglass.operators import ingest
from callglass.session import delete_exactly, exist, names_in, read_text, write_text

_BATCH = T.StructField("batch_id", T.LongType())

RAW = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("delivery_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("payload", T.StringType()),
        T.StructField("received_at", T.TimestampType()),
        _BATCH,
    ]
)
LOGS = T.StructType([*S.LOG.fields, T.StructField("completed_date", T.DateType()), _BATCH])
ATTEMPTS = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("delivery_id", T.LongType()),
        T.StructField("processing_status", T.StringType()),
        T.StructField("processing_error", T.StringType()),
        T.StructField("processed_at", T.TimestampType()),
        _BATCH,
    ]
)
DEAD_LETTERS = T.StructType(
    [
        T.StructField("delivery_id", T.LongType()),
        T.StructField("data", T.StringType()),
        T.StructField("reason", T.StringType()),
        _BATCH,
    ]
)
#: Calls of one day that started in one hour. A batch has a row for each that it holds.
ZONE = T.StructType(
    [
        T.StructField("day", T.DateType()),
        T.StructField("hour", T.TimestampType()),
        T.StructField("least", T.TimestampType()),
        T.StructField("greatest", T.TimestampType()),
        T.StructField("rows", T.LongType()),
        T.StructField("errors", T.LongType()),
    ]
)
SPAN = T.StructType([T.StructField(c, T.LongType()) for c in ("least", "greatest", "rows")])
OUTCOMES = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("received", "inserted", "duplicates", "rejected")]
    + [
        T.StructField("state", T.StringType()), T.StructField("zones", T.ArrayType(ZONE)), T.StructField("dead", SPAN),
        T.StructField("ingested_at", T.TimestampType()), _BATCH,
    ]
)
#: ``key`` is an id or a conversation, by ``kind``; ``batch`` holds it on that day. The bucket is the key's hash.
PLACES = T.StructType(
    [
        T.StructField("kind", T.StringType()), T.StructField("key", T.StringType()), T.StructField("completed_date", T.DateType()),
        T.StructField("batch", T.LongType()), T.StructField("bucket", T.IntegerType()), _BATCH,
    ]
)
BUCKETS = 16

#: Bloom filters in the files let a lookup by id or conversation skip most row groups; their size follows the rows.
BLOOM = {
    name: {"parquet.bloom.filter.adaptive.enabled": "true"} | {f"parquet.bloom.filter.enabled#{c}": "true" for c in columns}
    for name, columns in {"logs": ("id", "conversation_id"), "places": ("key",)}.items()
}


@dataclass(frozen=True)
class Table:
    name: str
    schema: T.StructType
    partitions: tuple[str, ...]


TABLES = {
    t.name: t
    for t in (
        Table("raw", RAW, ("batch_id",)),
        Table("logs", LOGS, ("completed_date", "batch_id")),
        Table("attempts", ATTEMPTS, ("batch_id",)),
        Table("dead_letters", DEAD_LETTERS, ("reason", "batch_id")),
        Table("places", PLACES, ("bucket", "batch_id")),
        Table("outcomes", OUTCOMES, ("batch_id",)),
    )
}
#: What a floor of a table bounds from below.
FLOORED = {"dead_letters": "delivery_id", "logs": "completed_date"}
#: Batches of the streams of one store: so many numbers for each, replays above all of them, and compactions of the index.
ROOM, REPLAYS, COMPACTED = 1 << 40, 1 << 60, 1 << 61


def bucket_of(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def places_of(logs: DataFrame, batch_id: int) -> DataFrame:
    """Days of each call and conversation, once per key and day."""
    keys = F.inline(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("key")) for c in ("id", "conversation_id")]))
    rows = logs.select("completed_date", keys).where(F.col("key").isNotNull()).distinct()
    return rows.withColumns({"bucket": bucket_of(F.col("key")), "batch": F.lit(batch_id).cast("long")})


def zones_of(logs: DataFrame) -> DataFrame:
    """How calls lie in time, per day of ending and hour of starting; combines map-side."""
    return logs.groupBy(F.col("completed_date").alias("day"), F.date_trunc("hour", "started_at").alias("hour")).agg(
        F.min("started_at").alias("least"), F.max("started_at").alias("greatest"), F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("status") == "error").alias("errors"),
    )


class Store:
    """The tables below one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def create(self) -> "Store":
        """Writes each absent table empty, so that the first reads find it."""
        for table in TABLES.values():
            empty = self.spark.createDataFrame([], table.schema)
            empty.write.mode("ignore").partitionBy(*table.partitions).parquet(self.path(table.name))
        return self

    def read(self, name: str, before_batch: int | None = None) -> DataFrame:
        """Rows of complete batches above the table's floor; batches before the one that runs are complete."""
        df = self.spark.read.schema(TABLES[name].schema).parquet(self.path(name))
        floor = self.floors().get(name)
        if floor is not None:
            column = FLOORED[name]
            df = df.where(F.col(column) >= F.lit(floor).cast(TABLES[name].schema[column].dataType))
        if before_batch is not None:
            return df.where(F.col("batch_id") < before_batch)
        if name == "outcomes":
            return df
        complete = self.read("outcomes").select("batch_id").distinct()
        return df.join(complete, "batch_id", "left_semi").select(*df.columns)

    def floors(self) -> dict[str, object]:
        """What each table has been dropped below, by the newest file."""
        names = names_in(self.spark, self.path("floors"))
        return json.loads(read_text(self.spark, f"{self.path('floors')}/{names[-1]}") or "{}") if names else {}

    def raise_floor(self, name: str, floor: object) -> None:
        """From one rename on, readers no longer see rows of ``name`` below ``floor``."""
        number = len(names_in(self.spark, self.path("floors")))
        write_text(self.spark, f"{self.path('floors')}/{number:012d}", json.dumps({**self.floors(), name: floor}))

    def intend(self, batch_id: int, days: list[str]) -> None:
        """Notes the days that the batch is about to fill."""
        write_text(self.spark, f"{self.path('intents')}/{batch_id}", "\n".join(days))

    def written(self, batch_id: int, days: list[str]) -> DataFrame:
        """What a batch has just written to the log, among these days; opens the batch's own folders only."""
        folders = exist(self.spark, [f"{self.path('logs')}/completed_date={d}/batch_id={batch_id}" for d in days])
        if not folders:
            return self.spark.createDataFrame([], LOGS)
        return self.spark.read.schema(LOGS).option("basePath", self.path("logs")).parquet(*folders)

    def clear(self, batch_id: int) -> None:
        """Removes what an earlier run of this batch left, its mark of completion first."""
        days = (read_text(self.spark, f"{self.path('intents')}/{batch_id}") or "").split()
        above = {
            "outcomes": [""], "raw": [""], "attempts": [""], "places": [f"bucket={b}/" for b in range(BUCKETS)],
            "dead_letters": [f"reason={r}/" for r in (S.REASON_MALFORMED, S.REASON_NO_ID, S.REASON_INVALID)],
            "logs": [f"completed_date={d}/" for d in days],
        }
        delete_exactly(self.spark, [f"{self.path(name)}/{a}batch_id={batch_id}" for name, folders in above.items() for a in folders])

    def write(self, name: str, rows: DataFrame, batch_id: int) -> None:
        """Replaces this batch's part of a table.

        Rows are spread by AQE within each partition value, so a day or reason that holds
        most of a batch is written by several tasks.
        """
        table = TABLES[name]
        rows = rows.withColumn("batch_id", F.lit(batch_id).cast("long")).select(*table.schema.fieldNames())
        (
            rows.hint("rebalance", *table.partitions)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .options(**BLOOM.get(name, {}))
            .partitionBy(*table.partitions)
            .parquet(self.path(name))
        )

    def raw_state(self, before_batch: int | None = None) -> DataFrame:
        """Raw events with the outcome of their latest attempt."""
        raw = self.read("raw", before_batch).drop("batch_id")
        return ingest.raw_state(raw, self.read("attempts", before_batch), ["processed_at", "batch_id", "delivery_id"])

    def first_batch_of(self, state: str) -> int:
        """The number that the batches of a keyed state start from, so that no two streams share one."""
        folder = self.path("states")
        known = names_in(self.spark, folder)
        for name in known:
            if read_text(self.spark, f"{folder}/{name}") == state:
                return int(name) * ROOM
        write_text(self.spark, f"{folder}/{len(known):06d}", state)
        return len(known) * ROOM

    def next_replay(self) -> int:
        """A batch number above those of all streams and of all earlier replays."""
        last = self.read("outcomes").agg(F.max("batch_id")).first()[0]
        return max(REPLAYS, (last or 0) + 1)

    def batches_unknown_to(self, state: str) -> list[int]:
        """Complete batches whose ids this keyed state has not seen: replays and those of other streams."""
        other = self.read("outcomes").where(~F.col("state").eqNullSafe(state))
        return sorted(r[0] for r in other.select("batch_id").distinct().collect())


def rewrite_sorted(logs: DataFrame, target: str, max_records_per_file: int = 5_000_000) -> None:
    """A compacted copy of the log for the dashboard and the browser.

    One folder per day; files are ranges of (day, provider, model, start), so the row-group
    statistics prune by provider, model and time. Ranges split a busy day or provider
    over several files. The source stays untouched; readers move to the new path.
    """
    order = ["completed_date", "provider", "model", "started_at"]
    (
        logs.repartitionByRange(*order, "id")
        .sortWithinPartitions(*order)
        .write.mode("errorifexists")
        .option("maxRecordsPerFile", max_records_per_file)
        .options(**BLOOM["logs"])
        .partitionBy("completed_date")
        .parquet(target)
    )
