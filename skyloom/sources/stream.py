"""Streams of (topic, value) messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

MESSAGE = "topic STRING, key STRING, value STRING"


def message_files(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Stream of message files (JSON lines); ``files_per_batch`` bounds a micro-batch."""
    reader = spark.readStream.schema(MESSAGE).format("json")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def message_topic(spark: SparkSession, servers: str, pattern: str, rows_per_batch: int | None = None) -> DataFrame:
    """Stream of a Kafka topic pattern; needs Spark's Kafka package on the class path."""
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribePattern", pattern)
    )
    if rows_per_batch:
        reader = reader.option("maxOffsetsPerTrigger", rows_per_batch)
    return reader.load().selectExpr(
        "topic", "cast(key AS string) AS key", "cast(value AS string) AS value"
    )
