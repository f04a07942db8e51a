"""Questions about the sensor -> edge -> macroarea table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def edges(topology: DataFrame) -> DataFrame:
    """One row per edge with its sensor count."""
    return topology.groupBy("edge_id", "macroarea_id").agg(F.count("*").alias("sensor_count"))


def topology_counts(topology: DataFrame) -> DataFrame:
    """One row: sensors, edges, macroareas."""
    per_edge = edges(topology)
    return per_edge.agg(
        F.coalesce(F.sum("sensor_count"), F.lit(0)).alias("sensors"),
        F.count_distinct("edge_id").alias("edges"),
        F.count_distinct("macroarea_id").alias("macroareas"),
    )


def edge_ids(topology: DataFrame) -> DataFrame:
    return topology.select("edge_id").distinct().orderBy("edge_id")


def macroareas(topology: DataFrame) -> DataFrame:
    return topology.select("macroarea_id").distinct()


def edge_lookup(topology: DataFrame, edge_id: str) -> DataFrame:
    """The row of one edge; empty when unknown."""
    return edges(topology.filter(F.col("edge_id") == edge_id))


def require_edge(topology: DataFrame, edge_id: str) -> dict:
    """The row of one edge as a dict; an unknown edge is an error."""
    row = edge_lookup(topology, edge_id).first()
    if row is None:
        raise ValueError(f"edge {edge_id!r} is not in the topology")
    return row.asDict()


def uncovered_edges(topology: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Edges without a deployment endpoint; empty when all are covered."""
    return edges(topology).join(endpoints.select("edge_id"), "edge_id", "left_anti")
