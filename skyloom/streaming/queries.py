"""Continuous ingest and windows over a stream of (topic, value) messages."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skyloom.functions.messages import encode_event, topic
from skyloom.operators.ingest import accepted, decode_messages, judge, observed_progress
from skyloom.operators.windows import edge_windows, macroarea_windows, measured_events
from skyloom.params import MEASURES, TOPIC_TEMPLATE, Measure, WindowSizes
from skyloom.plans.tables import new_path


def ingest(messages: DataFrame, topology: DataFrame, template: str = TOPIC_TEMPLATE) -> DataFrame:
    """Decoded and judged events with running accept/reject counts; stateless."""
    return observed_progress(judge(decode_messages(messages, template), topology))


def deduplicated(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Drop repeated deliveries of an event id, on a stream those within the watermark delay.

    Optional: without it every delivery counts. The delay must cover the longest
    redelivery gap and at least the allowed lateness.
    """
    if not events.isStreaming:
        return events.dropDuplicates(["event_id"])
    return events.withWatermark("observed_at", delay).dropDuplicatesWithinWatermark(["event_id"])


def edge_window_stream(
    events: DataFrame,
    sizes: WindowSizes = WindowSizes(),
    measures: tuple[Measure, ...] = MEASURES,
    watermarked: bool = False,
) -> DataFrame:
    """Edge windows of accepted events; rows later than the allowed lateness are dropped.

    ``watermarked`` says that the events carry a watermark already, as those of
    :func:`deduplicated` do; its delay then takes the place of the lateness.
    """
    if not watermarked:
        events = events.withWatermark("observed_at", sizes.lateness)
    return edge_windows(measured_events(events, measures), sizes, measures)


def macroarea_window_stream(
    edge_rows: DataFrame, sizes: WindowSizes = WindowSizes(), measures: tuple[Measure, ...] = MEASURES
) -> DataFrame:
    return macroarea_windows(edge_rows, sizes, measures)


def closing_messages(topology: DataFrame, at, template: str = TOPIC_TEMPLATE) -> DataFrame:
    """One message far enough in the future to close every open window of a finished trace.

    ``at`` is its event time; its own window stays open and is never emitted.
    """
    one = topology.limit(1).select(
        F.lit(1).alias("schema_version"), F.lit("end-of-trace").alias("event_id"), "sensor_id",
        F.lit("").alias("location_id"), F.lit(0).cast("bigint").alias("sequence"),
        F.lit(at).alias("observed_at"), F.lit(at).alias("emitted_at"),
        F.create_map(F.lit("closing"), F.lit("1")).alias("measurements"), "edge_id",
    )
    return one.select(
        topic(F.col("edge_id"), F.col("sensor_id"), template).alias("topic"),
        F.col("sensor_id").alias("key"), encode_event().alias("value"),
    )


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_settings(spark: SparkSession, partitions: int | None = None):
    """Session settings for stateful queries started inside the block.

    A query keeps the settings it was started with. State lives in RocksDB, off
    the heap, so that it may outgrow executor memory; it is split into one
    partition per core unless ``partitions`` says otherwise, as the adaptive
    planner cannot merge state partitions later.
    """
    wanted = {
        "spark.sql.shuffle.partitions": str(partitions or spark.sparkContext.defaultParallelism),
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    }
    before = {key: spark.conf.get(key, None) for key in wanted}
    try:
        for key, value in wanted.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def start(df: DataFrame, path: str, checkpoint: str, partition_by: list[str] | None = None) -> StreamingQuery:
    """Write an append stream as parquet, exactly once; processes what is there, then stops."""
    writer = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return writer.trigger(availableNow=True).start(path)


def run_to_table(spark: SparkSession, df: DataFrame, label: str, partitions: int | None = None) -> DataFrame:
    """Run a stream over all available input into the shared folder and read the result."""
    path = new_path(spark, label)
    with state_settings(spark, partitions):
        query = start(df, path, f"{path}-checkpoint")
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    return spark.read.schema(df.schema).parquet(path)
