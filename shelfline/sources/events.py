"""Message streams: raw product events (``message_id`` and ``raw`` JSON text per delivery) and stock requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfline.schemas import RAW_EVENTS, STOCK_REQUESTS


def read_product_events(spark: SparkSession, path: str, max_files_per_trigger: int = 1000) -> DataFrame:
    """Stream of message files; the trigger bound limits what one micro-batch admits."""
    return (
        spark.readStream.schema(RAW_EVENTS)
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .parquet(path)
    )


def read_stock_requests(spark: SparkSession, path: str, max_files_per_trigger: int = 100) -> DataFrame:
    """Stream of stock requests, admitting few enough files that one product's share of a micro-batch fits a task."""
    return (
        spark.readStream.schema(STOCK_REQUESTS)
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .parquet(path)
    )


def read_product_events_kafka(
    spark: SparkSession, servers: str, topic: str, max_offsets_per_trigger: int = 10_000_000
) -> DataFrame:
    """The same stream from a Kafka topic; needs the public Kafka connector on the class path.

    A message is known by its ``message_id`` header, else by its place in the
    topic. The record key names the product, so it does not tell messages apart.
    """
    messages = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("maxOffsetsPerTrigger", max_offsets_per_trigger)
        .option("includeHeaders", "true")
        .load()
    )
    position = F.concat_ws("-", "topic", "partition", "offset")
    named = F.get(F.filter(F.coalesce("headers", F.array()), lambda header: header["key"] == "message_id"), F.lit(0))["value"]
    return messages.select(
        F.coalesce(named.cast("string"), position).alias("message_id"),
        F.col("value").cast("string").alias("raw"),
    )
