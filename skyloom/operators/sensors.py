"""From observations to one row per sensor, and the geographic population."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.functions.clean import in_box, mask, observation_flags, strip, valid_sensor_id
from skyloom.functions.geo import project_europe_km
from skyloom.params import EUROPE, BoundingBox, TimeWindow, TraceColumns


def in_window_rows(raw: DataFrame, window: TimeWindow, cols: TraceColumns = TraceColumns()) -> DataFrame:
    """Flagged rows inside the window; invalid sensor ids and coordinates are still there."""
    return observation_flags(raw, window, cols).filter("in_window")


def sensor_stats(raw: DataFrame, window: TimeWindow, cols: TraceColumns = TraceColumns()) -> DataFrame:
    """Per sensor: rows, rows with usable coordinates, mean position, rows per day.

    Rows without usable coordinates count in ``rows`` only. The daily rate is
    over the configured window, whatever span was observed.
    """
    ok = F.col("coord_ok")
    return (
        in_window_rows(raw, window, cols)
        .filter("sensor_ok")
        .groupBy(strip(F.col(cols.sensor_id)).alias("sensor_id"))
        .agg(
            F.count("*").alias("rows"),
            F.count(mask(ok, F.col("lat_num"))).alias("coordinate_rows"),
            F.sum(mask(ok, F.col("lat_num"))).alias("lat_sum"),
            F.sum(mask(ok, F.col("lon_num"))).alias("lon_sum"),
        )
        .transform(_with_position, window)
    )


def stats_from(by_sensor: DataFrame, window: TimeWindow) -> DataFrame:
    """The same table from a per-sensor scan (``quality.scan_by_sensor``)."""
    rows = by_sensor.filter(valid_sensor_id(F.col("sensor_id")) & (F.col("retained_rows") > 0))
    return rows.select(
        "sensor_id", F.col("retained_rows").alias("rows"), "coordinate_rows", "lat_sum", "lon_sum"
    ).transform(_with_position, window)


def _with_position(sums: DataFrame, window: TimeWindow) -> DataFrame:
    return sums.withColumns({
        "lat": F.try_divide("lat_sum", "coordinate_rows"),
        "lon": F.try_divide("lon_sum", "coordinate_rows"),
        "rows_per_day": F.col("rows") / F.lit(window.days),
    })


def located_sensors(stats: DataFrame) -> DataFrame:
    return stats.filter("coordinate_rows > 0 AND lat IS NOT NULL AND lon IS NOT NULL")


def population_in(located: DataFrame, box: BoundingBox = EUROPE) -> DataFrame:
    """Located sensors inside the box."""
    return located.filter(in_box(F.col("lat"), F.col("lon"), box))


def projected(population: DataFrame) -> DataFrame:
    """Add the metric coordinates ``x_km`` and ``y_km``."""
    x, y = project_europe_km(F.col("lat"), F.col("lon"))
    return population.withColumns({"x_km": x, "y_km": y})


def location_summary(stats: DataFrame) -> DataFrame:
    """One row: sensors in total, without a position, and with one."""
    located = F.count_if(
        (F.col("coordinate_rows") > 0) & F.col("lat").isNotNull() & F.col("lon").isNotNull()
    )
    return stats.agg(F.count("*").alias("total_sensors"), located.alias("located_sensors")).select(
        "total_sensors",
        (F.col("total_sensors") - F.col("located_sensors")).alias("unlocated_sensors"),
        "located_sensors",
    )


def population_summary(population: DataFrame) -> DataFrame:
    """One row: size, extent, and load of a population."""
    return population.agg(
        F.count("*").alias("sensors"),
        F.min("lat").alias("lat_min"), F.max("lat").alias("lat_max"),
        F.min("lon").alias("lon_min"), F.max("lon").alias("lon_max"),
        F.sum("rows").alias("rows"), F.sum("rows_per_day").alias("rows_per_day"),
    )


def unique_sensors(raw: DataFrame, window: TimeWindow, cols: TraceColumns = TraceColumns()) -> DataFrame:
    """One row: distinct sensors with a valid id inside the window."""
    rows = in_window_rows(raw, window, cols).filter("sensor_ok")
    return rows.agg(F.count_distinct(strip(F.col(cols.sensor_id))).alias("unique_sensors"))
