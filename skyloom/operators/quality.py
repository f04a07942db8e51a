"""Quality report of a scan: one pass over the raw rows, then views on its small result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.functions.clean import mask, null_like, observation_flags, strip
from skyloom.functions.rates import days_between, percent
from skyloom.params import TimeWindow, TraceColumns

COUNTS = (
    "raw_rows", "retained_rows", "invalid_timestamp_rows", "outside_time_window_rows",
    "invalid_sensor_id_rows", "invalid_coordinate_rows",
)
VALID = "valid:"
BOUNDS = (
    "observed_timestamp_min", "observed_timestamp_max", "retained_timestamp_min", "retained_timestamp_max",
)
from skyloom.sources.observations import BAD_ROW


def _counts(columns: list[str]) -> list[Column]:
    """Aggregates of the report; they mean the same per sensor and over all rows."""
    t, inside = F.col("event_time"), F.col("in_window")
    return [
        F.count("*").alias("raw_rows"),
        F.count_if(inside).alias("retained_rows"),
        F.count_if(t.isNull()).alias("invalid_timestamp_rows"),
        F.count_if(t.isNotNull() & ~inside).alias("outside_time_window_rows"),
        F.count_if(inside & ~F.col("sensor_ok")).alias("invalid_sensor_id_rows"),
        F.count_if(inside & ~F.col("coord_ok")).alias("invalid_coordinate_rows"),
        F.min(t).alias("observed_timestamp_min"),
        F.max(t).alias("observed_timestamp_max"),
        F.min(F.when(inside, t)).alias("retained_timestamp_min"),
        F.max(F.when(inside, t)).alias("retained_timestamp_max"),
        *[F.count_if(inside & ~null_like(F.col(f"`{c}`"))).alias(f"{VALID}{c}") for c in columns],
    ]


def scan_profile(
    raw: DataFrame,
    window: TimeWindow,
    columns: list[str] | None = None,
    cols: TraceColumns = TraceColumns(),
) -> DataFrame:
    """One row: row counts, time bounds, and the valid values of every profiled column.

    Sensor and coordinate counts, and the column counts, are over in-window rows;
    a row with a bad sensor id still counts for coordinates and columns.
    ``columns`` defaults to all of the scan; pass ``[]`` to read only what the
    counts need.
    """
    columns = [c for c in raw.columns if c != BAD_ROW] if columns is None else columns
    return observation_flags(raw, window, cols).agg(*_counts(columns))


def scan_by_sensor(
    raw: DataFrame,
    window: TimeWindow,
    columns: list[str] | None = None,
    cols: TraceColumns = TraceColumns(),
) -> DataFrame:
    """The report and the position sums per sensor id, bad ids included, in one pass.

    Both the profile (:func:`profile_from`) and the sensor table
    (``sensors.stats_from``) follow from it, so the raw rows are read once.
    Materialize it: it has one row per sensor.
    """
    columns = [c for c in raw.columns if c != BAD_ROW] if columns is None else columns
    ok = F.col("in_window") & F.col("coord_ok")
    return (
        observation_flags(raw, window, cols)
        .groupBy(strip(F.col(cols.sensor_id)).alias("sensor_id"))
        .agg(
            *_counts(columns),
            F.count(mask(ok, F.col("lat_num"))).alias("coordinate_rows"),
            F.sum(mask(ok, F.col("lat_num"))).alias("lat_sum"),
            F.sum(mask(ok, F.col("lon_num"))).alias("lon_sum"),
        )
    )


def profile_from(by_sensor: DataFrame) -> DataFrame:
    """The one-row profile of a per-sensor scan."""
    valid = [c for c in by_sensor.columns if c.startswith(VALID)]
    return by_sensor.agg(
        *[F.coalesce(F.sum(f"`{c}`"), F.lit(0)).alias(c) for c in [*COUNTS, *valid]],
        *[(F.min if c.endswith("min") else F.max)(c).alias(c) for c in BOUNDS],
    )


def scan_quality(profile: DataFrame) -> DataFrame:
    return profile.select(*COUNTS)


def timestamp_bounds(profile: DataFrame) -> DataFrame:
    return profile.select(*BOUNDS)


def column_quality(profile: DataFrame) -> DataFrame:
    """Rows (column, valid_rows, all_null)."""
    names = [c for c in profile.columns if c.startswith(VALID)]
    renamed = profile.select(*[F.col(f"`{c}`").alias(c.removeprefix(VALID)) for c in names])
    return renamed.unpivot([], renamed.columns, "column", "valid_rows").withColumn(
        "all_null", F.col("valid_rows") == 0
    )


def active_columns(profile: DataFrame) -> list[str]:
    """Columns with at least one valid value, in scan order; collects the one profile row."""
    row = profile.first()
    return [c.removeprefix(VALID) for c in profile.columns if c.startswith(VALID) and row[c] > 0]


def dataset_summary(
    profile: DataFrame, sensors: DataFrame, window: TimeWindow, footprint: DataFrame | None = None
) -> DataFrame:
    """One row: counts, bounds, configured and observed days, distinct sensors, file size."""
    extra = {
        "configured_days": F.lit(window.days),
        "observed_days": days_between(F.col("retained_timestamp_min"), F.col("retained_timestamp_max")),
        "unique_sensors": sensors.agg(F.count("*")).scalar(),
    }
    if footprint is not None:
        extra["file_gb"] = footprint.select(F.col("bytes") / F.lit(1e9)).scalar()
    return profile.select(*COUNTS, *BOUNDS, *[c.alias(n) for n, c in extra.items()])


def reduction_summary(
    profile: DataFrame,
    sensors: DataFrame,
    located: DataFrame,
    population: DataFrame,
    workload: DataFrame,
    footprint: DataFrame | None = None,
) -> DataFrame:
    """One row: what remains from file to workload, in sensors, rows, and estimated bytes."""
    count = F.count("*")
    window_rows, raw = F.col("window_rows"), F.col("physical_rows")
    base = profile.select(
        sensors.agg(count).scalar().alias("total_sensors"),
        located.agg(count).scalar().alias("located_sensors"),
        population.agg(count).scalar().alias("european_sensors"),
        workload.agg(count).scalar().alias("workload_sensors"),
        F.col("raw_rows").alias("physical_rows"),
        F.col("retained_rows").alias("window_rows"),
        workload.agg(F.sum("rows")).scalar().alias("workload_rows"),
    ).withColumn("workload_rows_pct", percent(F.col("workload_rows"), window_rows))
    base = base.withColumn("row_reduction_pct", 100 - F.col("workload_rows_pct"))
    if footprint is None:
        return base
    gb = footprint.select(F.col("bytes") / F.lit(1e9)).scalar()
    return base.withColumn("physical_gb", gb).withColumns({
        "window_gb": F.try_divide(F.col("physical_gb") * window_rows, raw),
        "workload_gb": F.try_divide(F.col("physical_gb") * F.col("workload_rows"), raw),
    })
