"""The search for the number of zones."""

from __future__ import annotations

from pyspark.sql import DataFrame

from skyloom.operators.clustering import assignments_per_k, k_metrics, silhouette_squared, zone_list
from skyloom.operators.kmeans import Center, fit_kmeans
from skyloom.operators.pairwise import silhouette_exact
from skyloom.params import KSweep
from skyloom.plans.tables import materialize


def sweep_zones(population: DataFrame, sweep: KSweep, silhouette: str = "exact") -> tuple[DataFrame, dict[int, list[Center]]]:
    """The metrics row of every candidate k, and the fitted centers; ``population`` should be materialized.

    ``silhouette``: "exact" compares all pairs of sensors, in blocks; its work grows with their square.
    "squared" is linear and on squared distances, the choice for millions of sensors; its values differ.
    """
    if silhouette not in ("exact", "squared"):
        raise ValueError(f"unknown silhouette {silhouette!r}")
    fitted = fit_kmeans(population, sweep)
    assigned = materialize(assignments_per_k(population, fitted), "assignments")
    if silhouette == "exact":
        scores = silhouette_exact(assigned)
    else:
        values = [(k, silhouette_squared(assigned.filter(assigned["k"] == k))) for k in fitted]
        scores = population.sparkSession.createDataFrame(values, "k INT, silhouette DOUBLE")
    return k_metrics(assigned, zone_list(population.sparkSession, fitted), scores), fitted


def sweep_metrics(population: DataFrame, sweep: KSweep, silhouette: str = "exact") -> DataFrame:
    return sweep_zones(population, sweep, silhouette)[0]
