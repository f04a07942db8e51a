"""Event-time windows per edge and per macroarea; the same functions serve batch and stream.

Every window is built in two groupings: first per sensor (or edge) inside the
window, then per window. The first one shrinks hot edges before the second
shuffle, and turns the distinct count into a plain count, which a stream can do
without collecting a set.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.functions import stats
from skyloom.functions.measures import with_measures
from skyloom.params import MEASURES, SCHEMA_VERSION, Measure, WindowSizes


def measured_events(events: DataFrame, measures: tuple[Measure, ...] = MEASURES) -> DataFrame:
    """Add one double per measure (NULL unless valid) and the event's quality counters."""
    return with_measures(events, {m.name: F.col("measurements")[m.name] for m in measures}, measures)


def quality_counters(measured_rows: DataFrame, keys: list[str]) -> DataFrame:
    return measured_rows.groupBy(*keys).agg(
        F.count("*").alias("input_events"),
        F.sum("missing_values").alias("missing_values"),
        F.sum("invalid_values").alias("invalid_values"),
    )


def edge_windows(
    measured_rows: DataFrame,
    sizes: WindowSizes = WindowSizes(),
    measures: tuple[Measure, ...] = MEASURES,
) -> DataFrame:
    """Tumbling windows per (edge, macroarea), aligned to the epoch.

    On a stream, set the watermark on ``observed_at`` first. The ``window``
    column is kept for :func:`macroarea_windows`.
    """
    return merged_edge_windows(sensor_windows(measured_rows, sizes, measures), measures)


def sensor_windows(
    measured_rows: DataFrame,
    sizes: WindowSizes = WindowSizes(),
    measures: tuple[Measure, ...] = MEASURES,
) -> DataFrame:
    """The first grouping: summaries per sensor and edge window."""
    return measured_rows.groupBy(
        F.window("observed_at", sizes.edge), "edge_id", "macroarea_id", "sensor_id"
    ).agg(
        F.count("*").alias("input_events"),
        F.sum("missing_values").alias("missing_values"),
        F.sum("invalid_values").alias("invalid_values"),
        *[a for m in measures for a in stats.summarize(m.name, F.col(m.name))],
    )


def merged_edge_windows(per_sensor: DataFrame, measures: tuple[Measure, ...] = MEASURES) -> DataFrame:
    """The second grouping: windows from rows of which each sensor has one per window."""
    names = [m.name for m in measures]
    counters = ["input_events", "missing_values", "invalid_values"]
    merged = per_sensor.groupBy("window", "edge_id", "macroarea_id").agg(
        F.count("*").alias("sensor_count"),
        *[F.sum(c).alias(c) for c in counters],
        *[a for n in names for a in stats.merge(n)],
    )
    start = F.col("window.start")
    return merged.select(
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        F.concat_ws(":", "edge_id", F.unix_seconds(start).cast("string")).alias("window_id"),
        "edge_id", "macroarea_id", "window",
        start.alias("window_start"), F.col("window.end").alias("window_end"),
        "input_events", "sensor_count", "missing_values", "invalid_values",
        *[f"{n}_{f}" for n in names for f in stats.FIELDS],
    )


def macroarea_windows(
    edge_rows: DataFrame,
    sizes: WindowSizes = WindowSizes(),
    measures: tuple[Measure, ...] = MEASURES,
) -> DataFrame:
    """Merge edge windows into longer windows per macroarea."""
    names = [m.name for m in measures]
    per_edge = edge_rows.groupBy(
        F.window(F.window_time("window"), sizes.macro).alias("window"), "macroarea_id", "edge_id"
    ).agg(F.sum("input_events").alias("input_events"), *[a for n in names for a in stats.merge(n)])
    merged = per_edge.groupBy("window", "macroarea_id").agg(
        F.count("*").alias("edge_count"),
        F.sum("input_events").alias("input_events"),
        *[a for n in names for a in stats.merge(n)],
    )
    start = F.col("window.start")
    return merged.select(
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        F.concat_ws(":", "macroarea_id", F.unix_seconds(start).cast("string")).alias("window_id"),
        "macroarea_id", "window",
        start.alias("window_start"), F.col("window.end").alias("window_end"),
        "edge_count", "input_events",
        *[f"{n}_{f}" for n in names for f in stats.FIELDS],
    )


def metric_stats(
    measured_rows: DataFrame, keys: list[str], measures: tuple[Measure, ...] = MEASURES
) -> DataFrame:
    """Summary of every measure per group."""
    return measured_rows.groupBy(*keys).agg(*[a for m in measures for a in stats.summarize(m.name, F.col(m.name))])


def merged_stats(
    summaries: DataFrame, keys: list[str], measures: tuple[Measure, ...] = MEASURES
) -> DataFrame:
    """Merge summaries per coarser group and add mean and population standard deviation."""
    merged = summaries.groupBy(*keys).agg(*[a for m in measures for a in stats.merge(m.name)])
    return merged.withColumns({
        **{f"{m.name}_mean": stats.mean(m.name) for m in measures},
        **{f"{m.name}_std": stats.population_std(m.name) for m in measures},
    })
