"""Streams that write several tables in one commit per micro-batch, late rows among them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from skyloom.functions import stats
from skyloom.operators.ingest import rejected
from skyloom.operators.windows import measured_events, merged_edge_windows, sensor_windows
from skyloom.params import MEASURES, TOPIC_TEMPLATE, Measure, WindowSizes
from skyloom.sources.commits import CommitLog
from skyloom.sources.sinks import event_envelope, query_of, unpublishable

# of a batch and the high mark of all batches before it (microseconds, or None), the tables to write and its own high mark
Split = Callable[[DataFrame, int | None], tuple[dict[str, DataFrame], int | None]]


def write_together(spark: SparkSession, folder: str, split: Split, every: int = 20, keep_seconds: float = 86_400):
    """A ``foreachBatch`` function: all tables of ``split`` are written, then one commit makes them visible together.

    A batch that failed before its commit leaves files that no reader sees and that a later clean-up removes; when it is
    repeated, each table has its rows once. The batch is kept while its tables are written; what is lost is read again.
    """
    own, log = uuid.uuid4().hex, CommitLog(spark, folder, latest=False, every=every, keep_seconds=keep_seconds)

    def apply(batch: DataFrame, batch_id: int) -> None:
        query, lines = query_of(batch) or own, log.lines()
        last, high = lines.agg(F.max(F.when(F.col("query_id") == query, F.col("batch_id"))), F.max("high")).first()
        if last is not None and batch_id <= last:
            return
        held, path, entries = batch.persist(StorageLevel.MEMORY_AND_DISK), log.new_data(), []
        try:
            tables, own_high = split(held, high)
            for name, df in tables.items():
                seen = Observation(name)
                df.observe(seen, F.count("*").alias("rows")).write.parquet(f"{path}/{name}")
                entries.append((name, f"{path}/{name}", seen.get["rows"]))
            log.commit(query, batch_id, entries, own_high)
        finally:
            held.unpersist()

    return apply


def committed(spark: SparkSession, folder: str, name: str) -> DataFrame | None:
    """All rows of a table that :func:`write_together` has committed; None before the first commit."""
    paths = CommitLog(spark, folder, latest=False).paths(name)
    return spark.read.parquet(*paths) if paths else None


def progress(spark: SparkSession, folder: str) -> DataFrame:
    """(query_id, batch_id, name, rows) per batch and table, committed with the rows themselves."""
    return CommitLog(spark, folder, latest=False).lines().filter("name IS NOT NULL").select("query_id", "batch_id", "name", "rows")


def with_lateness(events: DataFrame, high: int | None, sizes: WindowSizes = WindowSizes()) -> DataFrame:
    """Add ``window_end``, ``watermark`` and ``late``: is the row's edge window closed by the watermark of the batches before?

    The watermark is the latest event time so far less the allowed lateness; without any, no row is late. A window is closed when
    the watermark has reached its end, as for Spark's own aggregations.
    """
    size = sizes.edge_seconds * 1_000_000
    mark = F.lit(None if high is None else high - sizes.lateness_seconds * 1_000_000).cast("bigint")
    time = F.unix_micros("observed_at")
    end = time - F.pmod(time, F.lit(size)) + size
    return events.withColumns({
        "window_end": F.timestamp_micros(end), "watermark": F.timestamp_micros(mark), "late": F.coalesce(end <= mark, F.lit(False))})


def split_late(sizes: WindowSizes = WindowSizes(), measures: tuple[Measure, ...] = MEASURES) -> Split:
    """Judged events to ``late`` (with reason and lag), ``rejected``, and ``parts``: mergeable summaries per sensor and window.

    Every accepted event is in exactly one of parts and late. Parts are small: a hot edge shrinks to one row per sensor and window
    before anything is shuffled.
    """
    def split(judged: DataFrame, high: int | None) -> tuple[dict[str, DataFrame], int | None]:
        good = with_lateness(judged.filter("reject_reason IS NULL").drop("reject_reason", "receiving_edge"), high, sizes)
        top = good.agg(F.max(F.unix_micros("observed_at"))).first()[0]
        late = good.filter("late").withColumns({
            "reason": F.lit("window closed"), "lag_seconds": (F.unix_micros("watermark") - F.unix_micros("observed_at")) / F.lit(1e6)})
        parts = sensor_windows(measured_events(good.filter("NOT late").drop("late", "window_end", "watermark"), measures), sizes, measures)
        tables = {"parts": parts, "late": late.drop("late", "measurements"), "rejected": rejected(judged).drop("measurements")}
        return tables, max((x for x in (top, high) if x is not None), default=None)

    return split


def windows_from(parts: DataFrame, measures: tuple[Measure, ...] = MEASURES) -> DataFrame:
    """Edge windows of all parts: those of one sensor and window are merged first, so a sensor counts once."""
    names = [m.name for m in measures]
    counters = ["input_events", "missing_values", "invalid_values"]
    once = parts.groupBy("window", "edge_id", "macroarea_id", "sensor_id").agg(
        *[F.sum(c).alias(c) for c in counters], *[a for n in names for a in stats.merge(n)])
    return merged_edge_windows(once, measures)


def reconciled(spark: SparkSession, folder: str) -> DataFrame:
    """One row: accepted = windowed + late, with the events that were rejected; windowed is counted from the windows."""
    parts, late, bad = (committed(spark, folder, n) for n in ("parts", "late", "rejected"))
    return windows_from(parts).agg(F.coalesce(F.sum("input_events"), F.lit(0)).alias("windowed")).select(
        "windowed", late.agg(F.count("*")).scalar().alias("late"), bad.agg(F.count("*")).scalar().alias("rejected"))


def split_routes(template: str = TOPIC_TEMPLATE) -> Split:
    """Events to publish: ``envelopes`` (topic, key, value), ``rejects`` with their reason, and ``counts`` per edge."""
    def split(events: DataFrame, high: int | None) -> tuple[dict[str, DataFrame], int | None]:
        counts = events.groupBy("edge_id").agg(F.count("*").alias("events"), F.count_if(F.coalesce(F.trim("sensor_id"), F.lit("")) != "").alias("with_sensor"))
        return {"envelopes": event_envelope(events, template), "rejects": unpublishable(events).drop("measurements"), "counts": counts}, None

    return split


def run_batches(stream: DataFrame, apply, checkpoint: str) -> None:
    """Run a stream through a ``foreachBatch`` function over what is there, then stop."""
    query = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
