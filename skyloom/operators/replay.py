"""From an ordered trace to routed, numbered, scheduled events."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.functions.messages import event_id
from skyloom.params import REPLAY_SPEEDUP, SCHEMA_VERSION
from skyloom.plans.joins import lookup_join
from skyloom.plans.numbering import against_previous, number_rows


def route(records: DataFrame, topology: DataFrame) -> DataFrame:
    """Add ``edge_id`` and ``macroarea_id``; both NULL for an unknown sensor."""
    return lookup_join(records, topology.select("sensor_id", "edge_id", "macroarea_id"), "sensor_id", "left")


def require_routes(routed: DataFrame) -> DataFrame:
    """The routed records; the job fails at a record whose sensor is unknown."""
    ok = F.when(F.col("edge_id").isNotNull(), True).otherwise(
        F.raise_error(F.concat(F.lit("sensor not in the topology: "), F.col("sensor_id"))).cast("boolean")
    )
    return routed.filter(ok)


def unknown_sensors(records: DataFrame, topology: DataFrame) -> DataFrame:
    """Records whose sensor is not in the topology."""
    return lookup_join(records, topology.select("sensor_id"), "sensor_id", "left_anti")


def sensor_events(
    routed: DataFrame,
    tie: list[str],
    emitted_at: Column | None = None,
) -> DataFrame:
    """Events with a per-sensor sequence in (event_time, tie) order.

    ``tie`` names the columns that order rows of one sensor with equal times:
    the place in the file, or a content hash where that is not known.
    Records without a route must have been taken out or accepted knowingly.
    """
    return numbered_events(number_rows(routed, ["sensor_id"], ["event_time", *tie], "sequence"), emitted_at)


def numbered_events(numbered: DataFrame, emitted_at: Column | None = None) -> DataFrame:
    """Events of routed records that have their ``sequence``."""
    return numbered.select(
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        event_id(F.col("sensor_id"), F.col("event_time"), F.col("sequence")).alias("event_id"),
        "sensor_id", "location_id", "sequence",
        F.col("event_time").alias("observed_at"),
        (F.current_timestamp() if emitted_at is None else emitted_at).alias("emitted_at"),
        "measurements", "edge_id", "macroarea_id",
    )


def replay_schedule(events: DataFrame, start: datetime, speedup: float = REPLAY_SPEEDUP) -> DataFrame:
    """Add ``deadline``: start + (t - first t) / speedup. Equal times get equal deadlines."""
    if speedup <= 0:
        raise ValueError("the replay speed-up must be positive")
    first = events.agg(F.min("observed_at")).scalar()
    since = F.unix_micros("observed_at") - F.unix_micros(first)
    offset = F.floor(since / F.lit(float(speedup)))
    return events.withColumn("deadline", F.timestamp_micros(F.unix_micros(F.lit(start)) + offset))


def order_violations(trace: DataFrame, time: str, block: list[Column], row: Column) -> DataFrame:
    """Rows whose time lies before that of the row just before them in stored order."""
    audited = against_previous(trace, time, block, row)
    return audited.filter(F.col(time) < F.col(f"previous_{time}"))


def edge_changes(events: DataFrame) -> DataFrame:
    """Sensors seen on more than one edge, with the number of edges."""
    return (
        events.groupBy("sensor_id").agg(F.count_distinct("edge_id").alias("edges")).filter("edges > 1")
    )


def edge_change_events(events: DataFrame, tie: list[str]) -> DataFrame:
    """The first event of each sensor on every edge other than that of its first event.

    Events are in (observed_at, tie) order; those without a sensor, an edge or a time take no part.
    """
    whole = events.filter("sensor_id IS NOT NULL AND edge_id IS NOT NULL AND observed_at IS NOT NULL")
    first = F.min(F.struct(*dict.fromkeys(["observed_at", *tie, "event_id", "sequence", "edge_id"]))).alias("first")
    per_edge = whole.groupBy("sensor_id", F.col("edge_id").alias("_edge")).agg(first)
    home = per_edge.groupBy("sensor_id").agg(F.min("first").alias("home"), F.count("*").alias("edges")).filter("edges > 1")
    return per_edge.join(home, "sensor_id").filter("first.edge_id <> home.edge_id").select(
        "sensor_id", F.col("home.edge_id").alias("home_edge"), F.col("first.edge_id").alias("edge_id"), "first.event_id", "first.sequence", "first.observed_at")


def first_events(events: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The first ``n`` events in ``order``; 0 means all.

    Each partition gives its own first ``n``, so only those are shuffled; they are then cut by row number, so that the kept
    ones never meet in one task. Rows equal in ``order`` are cut anywhere among them.
    """
    if n < 0:
        raise ValueError("the number of events must not be negative")
    if n == 0:
        return events
    # the lower 33 bits are the place in the sorted partition
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    own = events.sortWithinPartitions(*order).withColumn("_place", place).filter(F.col("_place") < n).drop("_place")
    return number_rows(own, [], order, "_seq").filter(F.col("_seq") <= n).drop("_seq")
