"""Where deliveries come from and go to: files, or Kafka where its connector is present."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callglass import schema as S
from callglass.operators import contract

FORMATS = ("parquet", "json", "orc")


def file_stream(
    spark: SparkSession, path: str, file_format: str = "parquet", files_per_batch: int = 100, schema=S.ENVELOPE
) -> DataFrame:
    """Deliveries from the files of a folder, from the first one on, a bounded number per batch."""
    if file_format not in FORMATS:
        raise ValueError(f"unsupported format: {file_format!r}")
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return reader.format(file_format).load(path)


def kafka_stream(spark: SparkSession, servers: str, topic: str, offsets_per_batch: int = 1_000_000) -> DataFrame:
    """Deliveries of a topic. Needs Spark's Kafka connector on the class path.

    The delivery number orders by offset, then partition; redelivered events of one id
    share a partition when the id is the message key.
    """
    rows = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
        .option("maxOffsetsPerTrigger", offsets_per_batch)
        .load()
    )
    number = F.col("offset") * 100_000 + F.col("partition")
    return rows.select(number.alias("delivery_id"), F.col("value").cast("string").alias("data"))


def publish_to_files(calls: DataFrame, path: str, file_format: str = "parquet", delivery: str = "delivery_id") -> None:
    """Appends calls as deliveries; ``delivery`` names their number."""
    sent = contract.publish(calls).select(F.col(delivery).cast("long").alias("delivery_id"), "data")
    sent.write.mode("append").format(file_format).save(path)


def publish_stream(calls: DataFrame, path: str, checkpoint: str, delivery: str = "delivery_id"):
    """A streaming query that publishes calls as they come."""
    sent = contract.publish(calls).select(F.col(delivery).cast("long").alias("delivery_id"), "data")
    return sent.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
