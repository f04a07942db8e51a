"""Balanced, reproducible workloads drawn from a zone topology, and their load."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyloom.functions.clean import in_window, with_time, strip
from skyloom.functions.rates import per_second, percent
from skyloom.params import (
    REPLAY_FACTORS, SEED, TARGET_EVENTS_PER_SECOND, WORKLOAD_SENSORS, TimeWindow, TraceColumns,
)
from skyloom.plans.joins import lookup_join

KEYS = ["edge_cluster", "edge_id"]


def population_by_edge(topology: DataFrame) -> DataFrame:
    return topology.groupBy(*KEYS).agg(F.count_distinct("sensor_id").alias("population_sensors"))


def balanced_quotas(population: DataFrame, size: int = WORKLOAD_SENSORS) -> DataFrame:
    """Add ``sensor_quota``: an equal share per edge, the remainder to the biggest edges.

    ``population`` has one row per edge. Impossible requests are errors; they
    are found from one row of totals before anything is ranked, and bound the
    number of edges by ``size``.
    """
    totals = population.agg(
        F.count("*").alias("edges"), F.sum("population_sensors").alias("sensors"),
        F.min("population_sensors").alias("smallest"),
    ).first()
    edges, sensors = totals["edges"], totals["sensors"] or 0
    if edges == 0:
        raise ValueError("there is no edge to draw from")
    if edges > size:
        raise ValueError(f"{edges} edges cannot be represented by {size} sensors")
    if size > sensors:
        raise ValueError("the workload is bigger than the population")
    base, remainder = divmod(size, edges)
    if totals["smallest"] < base:
        raise ValueError("an edge has fewer sensors than the base quota")
    if population.filter(F.col("population_sensors") > base).count() < remainder:
        raise ValueError("the remaining sensors cannot be distributed")
    # edges that can take one more come first, biggest first; at most `size` rows
    w = W.orderBy(F.desc("population_sensors"), "edge_cluster")
    extra = (F.row_number().over(w) <= remainder).cast("bigint")
    return population.withColumn("sensor_quota", F.lit(base).cast("bigint") + extra)


def sample_order(seed: int = SEED) -> Column:
    """A reproducible pseudo-random order of sensors that no partitioning can change."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), "sensor_id"))


def stratified_sample(topology: DataFrame, quotas: DataFrame, size: int, seed: int = SEED) -> DataFrame:
    """Exactly ``sensor_quota`` sensors of every edge, without replacement.

    No quota exceeds ``size``, so the first rank cut is a constant: Spark applies
    it before the shuffle, and an edge with most sensors sends few rows.
    """
    w = W.partitionBy("edge_id").orderBy(sample_order(seed), "sensor_id")
    ranked = topology.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= size)
    return (
        ranked.join(quotas.select("edge_id", "sensor_quota"), "edge_id")
        .filter(F.col("_rank") <= F.col("sensor_quota"))
        .drop("_rank", "sensor_quota")
    )


def workload_shares(quotas: DataFrame, workload: DataFrame, size: int) -> DataFrame:
    """Population share against workload share per edge."""
    chosen = workload.groupBy("edge_id").agg(F.count_distinct("sensor_id").alias("selected_sensors"))
    total = quotas.agg(F.sum("population_sensors")).scalar()
    return (
        quotas.join(chosen, "edge_id", "left")
        .withColumns({
            "population_share_pct": percent(F.col("population_sensors"), total),
            "workload_share_pct": percent(F.col("selected_sensors"), F.lit(size)),
        })
        .select(
            "edge_id", "population_sensors", "population_share_pct", "sensor_quota", "selected_sensors",
            "workload_share_pct", "edge_cluster",
        )
    )


def quota_mismatches(shares: DataFrame) -> DataFrame:
    """Edges whose selected sensors differ from the quota; empty when all agree."""
    return shares.filter(~F.col("selected_sensors").eqNullSafe(F.col("sensor_quota")))


def assignment_mismatches(workload: DataFrame, population: DataFrame) -> DataFrame:
    """Workload sensors that are on another edge in the population; empty when consistent."""
    mine = workload.select("sensor_id", F.col("edge_id").alias("edge_id_workload"))
    theirs = population.select("sensor_id", F.col("edge_id").alias("edge_id_population"))
    return mine.join(theirs, "sensor_id").filter("edge_id_workload <> edge_id_population")


def workload_edge_summary(workload: DataFrame, target: float = TARGET_EVENTS_PER_SECOND) -> DataFrame:
    """Per edge: sensors, rows, natural rate, share of the load, and share of the target rate."""
    total = workload.agg(per_second(F.sum("rows_per_day"))).scalar()
    return (
        workload.groupBy(*KEYS).agg(
            F.count_distinct("sensor_id").alias("sensors"),
            F.sum("rows").alias("rows"),
            F.sum("rows_per_day").alias("rows_per_day"),
        )
        .withColumn("natural_events_per_second", per_second(F.col("rows_per_day")))
        .withColumn("load_share_pct", percent(F.col("natural_events_per_second"), total))
        .withColumn("target_events_per_second", F.col("load_share_pct") * F.lit(float(target)) / 100)
    )


def natural_rate(workload: DataFrame, target: float = TARGET_EVENTS_PER_SECOND) -> DataFrame:
    """One row: natural events per second and the replay factor that reaches the target."""
    rate = workload.agg(per_second(F.sum("rows_per_day")).alias("natural_events_per_second"))
    return rate.withColumn(
        "required_replay_factor", F.try_divide(F.lit(float(target)), F.col("natural_events_per_second"))
    )


def replay_scenarios(workload: DataFrame, factors: tuple[int, ...] = REPLAY_FACTORS) -> DataFrame:
    """Total rate under each replay factor."""
    return natural_rate(workload).select(
        F.explode(F.array(*[F.lit(f) for f in factors])).alias("replay_factor"), "natural_events_per_second"
    ).select(
        "replay_factor", (F.col("natural_events_per_second") * F.col("replay_factor")).alias("total_events_per_second")
    )


def workload_rows(
    raw: DataFrame, selected: DataFrame, window: TimeWindow, columns: list[str], cols: TraceColumns = TraceColumns()
) -> DataFrame:
    """Raw rows of the selected sensors inside the window, active columns only.

    Values pass through as the text they were read as. ``event_time`` is added
    for ordering the output.
    """
    timed = with_time(raw, cols.timestamp).withColumn("_id", strip(F.col(cols.sensor_id)))
    rows = timed.filter(in_window(F.col("event_time"), window))
    chosen = selected.select(F.col("sensor_id").alias("_id")).distinct()
    return lookup_join(rows, chosen, "_id", "left_semi").select(*columns, "event_time")
