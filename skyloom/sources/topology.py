"""The sensor -> edge -> macroarea table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.functions.clean import strip, to_number
from skyloom.plans.invariants import require
from skyloom.sources.observations import scan_text_table, whole_rows

COLUMNS = ["sensor_id", "macroarea_id", "edge_id", "lat", "lon"]


def parse_assignments(raw: DataFrame) -> DataFrame:
    """Trimmed and typed topology rows with ``reject_reason``; the first failing rule is named."""
    text = {c: strip(F.col(c).cast("string")) for c in COLUMNS}
    reason = F.when(F.lit(False), F.lit(""))
    for c in COLUMNS:
        reason = reason.when(F.coalesce(text[c], F.lit("")) == "", f"empty {c}")
    lat, lon = to_number(text["lat"]), to_number(text["lon"])
    reason = reason.when(~F.coalesce(lat.between(-90, 90), F.lit(False)), "invalid lat")
    reason = reason.when(~F.coalesce(lon.between(-180, 180), F.lit(False)), "invalid lon")
    return raw.select(
        text["sensor_id"].alias("sensor_id"), text["macroarea_id"].alias("macroarea_id"),
        text["edge_id"].alias("edge_id"), lat.alias("lat"), lon.alias("lon"),
        reason.alias("reject_reason"),
    )


def topology_conflicts(topology: DataFrame) -> DataFrame:
    """Rows (rule, id, found): sensors listed twice, edges in more than one macroarea."""
    doubled = topology.groupBy("sensor_id").agg(F.count("*").alias("found")).filter("found > 1")
    split = topology.groupBy("edge_id").agg(F.count_distinct("macroarea_id").alias("found")).filter("found > 1")
    return doubled.select(F.lit("duplicate sensor").alias("rule"), F.col("sensor_id").alias("id"), "found").unionByName(
        split.select(F.lit("edge in several macroareas").alias("rule"), F.col("edge_id").alias("id"), "found")
    )


def load_topology(spark: SparkSession, path: str) -> DataFrame:
    """Checked topology; any bad row, conflict, or an empty file is an error."""
    parsed = parse_assignments(whole_rows(scan_text_table(spark, path, COLUMNS, separator=","), strict=True))
    require(parsed.filter("reject_reason IS NOT NULL").select("sensor_id", "edge_id", "reject_reason"))
    topology = parsed.drop("reject_reason")
    require(topology_conflicts(topology))
    if topology.isEmpty():
        raise ValueError("the topology contains no sensor assignments")
    return topology
