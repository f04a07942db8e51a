"""The offline analysis from raw observations to zones, workload, result tables, and replay trace."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from skyloom.operators import clustering, quality, sensors, workload
from skyloom.operators.sweep import sweep_zones
from skyloom.params import (
    EUROPE, TARGET_EVENTS_PER_SECOND, WORKLOAD_SENSORS, BoundingBox, KSweep, TimeWindow, TraceColumns,
)
from skyloom.plans import invariants
from skyloom.plans.tables import materialize
from skyloom.sources import sinks
from skyloom.sources.observations import whole_rows


@dataclass(frozen=True)
class Analysis:
    """Frames of one run; all but the small report rows are written tables."""

    profile: DataFrame
    population: DataFrame
    topology: DataFrame
    workload: DataFrame
    tables: dict[str, DataFrame]
    trace: DataFrame
    k: int


def analyse(
    raw: DataFrame,
    window: TimeWindow,
    out: str,
    box: BoundingBox = EUROPE,
    sweep: KSweep = KSweep(),
    size: int = WORKLOAD_SENSORS,
    target: float = TARGET_EVENTS_PER_SECOND,
    cols: TraceColumns = TraceColumns(),
    silhouette: str = "exact",
) -> Analysis:
    """Run every step, export all tables at once below ``<out>/tables`` (``sinks.exported`` reads them) and write the trace to ``<out>/trace``.

    The raw observations are read twice: for the per-sensor scan, and for the
    trace, whose rows and columns depend on it. The rows of the trace are written
    before they are sorted, as a sort reads them twice. Whatever is used more than
    once in between has one row per sensor and is written once. A row of the wrong width stops the run. ``silhouette``: see ``sweep_zones``.
    """
    spark, raw = raw.sparkSession, whole_rows(raw, strict=True)
    by_sensor = materialize(quality.scan_by_sensor(raw, window, cols=cols), "by-sensor")
    profile = materialize(quality.profile_from(by_sensor), "profile")
    if profile.first()["retained_rows"] == 0:
        raise ValueError("no observation lies in the time window")
    stats = sensors.stats_from(by_sensor, window)
    population = materialize(
        sensors.projected(sensors.population_in(sensors.located_sensors(stats), box)), "population"
    )
    filled = ["lat", "lon", "rows", "rows_per_day", "x_km", "y_km"]
    invariants.require(invariants.violations(population, {
        "unique sensor": invariants.unique(population, ["sensor_id"]),
        "no missing value": invariants.no_nulls(filled),
    }))

    metrics, fitted = sweep_zones(population, sweep, silhouette)
    metrics = materialize(metrics, "k-metrics")
    k = clustering.best_k(metrics).first()["k"]
    topology, centers = clustering.edge_topology(population, k, sweep.restarts, sweep.seed, fitted[k])
    topology = materialize(topology, "topology")
    invariants.require(invariants.violations(topology, {
        "topology size": invariants.rows_are(population.count()),
        "unique sensor": invariants.unique(topology, ["sensor_id"]),
        "zone and distance": invariants.no_nulls(["edge_id", "edge_cluster", "distance_to_edge_km", "macroarea_id"]),
    }))
    centroids = clustering.centroid_table(spark, centers)

    quotas = materialize(workload.balanced_quotas(workload.population_by_edge(topology), size), "quotas")
    invariants.require(invariants.violations(quotas, {
        "quotas add up": invariants.sum_is("sensor_quota", size),
        "quota within population": invariants.none_where("sensor_quota > population_sensors"),
        "one row per edge": invariants.unique(quotas, ["edge_id"]),
    }))
    chosen = materialize(workload.stratified_sample(topology, quotas, size, sweep.seed), "workload")
    shares = materialize(workload.workload_shares(quotas, chosen, size), "shares")
    invariants.require(invariants.violations(chosen, {
        "workload size": invariants.rows_are(size),
        "unique sensor": invariants.unique(chosen, ["sensor_id"]),
        "edge and macroarea": invariants.no_nulls(["edge_id", "macroarea_id"]),
    }))
    invariants.require(workload.quota_mismatches(shares))
    invariants.require(workload.assignment_mismatches(chosen, topology))

    tables = {
        "edge_k_metrics": metrics,
        "edge_population_summary": clustering.edge_population_summary(topology, centroids),
        "edge_centroids": centroids,
        "europe_topology": topology,
        "workload_by_edge": shares,
        "workload_edge_summary": workload.workload_edge_summary(chosen, target),
        "kmeans_topology": chosen,
        "replay_load_scenarios": workload.replay_scenarios(chosen),
    }
    sinks.export_set(tables, f"{out}/tables")

    rows = materialize(workload.workload_rows(raw, chosen, window, quality.active_columns(profile), cols), "trace-rows")
    trace = sinks.write_trace(rows, f"{out}/trace", "event_time", cols.sensor_id)
    written, expected = trace.first()["rows"], chosen.agg({"rows": "sum"}).first()[0]
    if written != expected:
        raise ValueError(f"the trace has {written} rows, expected {expected}")
    return Analysis(profile, population, topology, chosen, tables, trace, k)
