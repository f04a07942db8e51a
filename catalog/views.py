"""Telemetry views over the given tables: user -> sensor, nation -> edge, region -> macroarea.

Defects are planted by row number, so that every rule of the library meets both
good and bad rows. No row of the source tables is left out, except that
customers with a negative balance have no topology entry (unknown sensors).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.functions.messages import EVENT_SCHEMA
from skyloom.params import TimeWindow
from skyloom.sources.observations import good_records, trace_records
from skyloom.operators.replay import route
from skyloom.operators.sensors import located_sensors, population_in, projected, sensor_stats

WINDOW = TimeWindow.of("2024-01-05", "2024-01-25")
EMITTED_AT = "2024-02-01 00:00:00"
CLOSED_AT = "2024-02-03 00:00:00"


# Given schemas of the tables in use; saves a footer read per scan.
SCHEMAS = {
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw observations, all text except the row number ``event_id``."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id",
        "CASE WHEN event_id % 101 = 0 THEN ' ' ELSE cast(user_id AS STRING) END AS sensor_id",
        "cast(user_id % 40 AS STRING) AS location",
        """CASE WHEN event_id % 97 = 0 THEN 'junk'
                WHEN event_id % 3 = 0 THEN concat('\\'', replace(cast(ts AS STRING), ' ', 'T'), '\\'')
                ELSE replace(cast(ts AS STRING), ' ', 'T') END AS timestamp""",
        """CASE WHEN event_id % 53 = 0 THEN 'abc' WHEN event_id % 59 = 0 THEN '0.0'
                ELSE cast(cast(30000 + user_id * 37 % 450 * 100 + event_id % 7 AS DOUBLE) / 1000D AS STRING)
                END AS lat""",
        """CASE WHEN event_id % 59 = 0 THEN '0.0'
                ELSE cast(cast(-30000 + user_id * 53 % 800 * 100 + event_id % 5 AS DOUBLE) / 1000D AS STRING)
                END AS lon""",
        """CASE WHEN event_id % 89 = 0 THEN '' WHEN event_id % 83 = 0 THEN 'nan'
                ELSE cast(value AS STRING) END AS temperature""",
        "cast(cast(event_id % 120 AS DOUBLE) AS STRING) AS humidity",
        """CASE WHEN event_id % 2 = 0 THEN cast(cast(95000 + event_id % 9000 AS DOUBLE) AS STRING)
                ELSE cast(cast(950 + event_id % 90 AS DOUBLE) AS STRING) END AS pressure""",
        "cast(NULL AS STRING) AS altitude",
    )


def topo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per sensor, but for those of customers in debt; sensors without events too."""
    customer = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation")
    return (
        customer.filter("c_acctbal >= 0").join(nation, customer["c_nationkey"] == nation["n_nationkey"])
        .selectExpr(
            "cast(c_custkey AS STRING) AS sensor_id",
            "concat('m', cast(n_regionkey AS STRING)) AS macroarea_id",
            "concat('edge-m', cast(n_regionkey AS STRING), '-', cast(n_nationkey AS STRING)) AS edge_id",
            "cast(300 + c_custkey * 37 % 450 AS DOUBLE) / 10D AS lat",
            "cast(-300 + c_custkey * 53 % 800 AS DOUBLE) / 10D AS lon",
        )
    )


def topo_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A topology file as text with planted defects, one row per customer."""
    customer = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation")
    return customer.join(nation, customer["c_nationkey"] == nation["n_nationkey"]).selectExpr(
        "CASE WHEN c_custkey % 31 = 0 THEN ' ' ELSE cast(c_custkey AS STRING) END AS sensor_id",
        "CASE WHEN c_custkey % 37 = 0 THEN '' ELSE concat('m', cast(n_regionkey AS STRING)) END AS macroarea_id",
        "CASE WHEN c_custkey % 41 = 0 THEN NULL ELSE concat('edge-', cast(n_nationkey AS STRING)) END AS edge_id",
        """CASE WHEN c_custkey % 43 = 0 THEN 'north' WHEN c_custkey % 47 = 0 THEN '90.5'
                ELSE cast(cast(300 + c_custkey * 37 % 450 AS DOUBLE) / 10D AS STRING) END AS lat""",
        """CASE WHEN c_custkey % 53 = 0 THEN '5d'
                ELSE cast(cast(-300 + c_custkey * 53 % 800 AS DOUBLE) / 10D AS STRING) END AS lon""",
    )


def topo_conflicting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The topology plus one row per supplier under another macroarea."""
    extra = table(spark, sf_dir, "supplier").selectExpr(
        "cast(s_suppkey AS STRING) AS sensor_id",
        "concat('m', cast(s_suppkey % 5 AS STRING)) AS macroarea_id",
        "concat('edge-m', cast(s_suppkey % 5 AS STRING), '-', cast(s_nationkey AS STRING)) AS edge_id",
    )
    return topo(spark, sf_dir).select("sensor_id", "macroarea_id", "edge_id").unionByName(extra)


def endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deployment endpoints: the edges of nations that have a supplier with a positive balance above 9000."""
    nation, supplier = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    rich = supplier.filter("s_acctbal > 9000").select(F.col("s_nationkey").alias("n_nationkey"))
    return nation.join(rich, "n_nationkey", "left_semi").selectExpr(
        "concat('edge-m', cast(n_regionkey AS STRING), '-', cast(n_nationkey AS STRING)) AS edge_id",
        "concat('mqtt://10.0.', cast(n_regionkey AS STRING), '.', cast(n_nationkey AS STRING), ':1883') AS url",
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good trace records with their row number."""
    return good_records(trace_records(obs(spark, sf_dir), keep=("event_id",)))


def routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of known sensors with edge and macroarea."""
    return route(records(spark, sf_dir), topo(spark, sf_dir)).filter("edge_id IS NOT NULL")


def inbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arriving events, one per observation, with a planted defect for every ingest rule.

    ``sequence`` holds the row number; ``receiving_edge`` is the edge that got the event.
    """
    raw = trace_records(obs(spark, sf_dir), keep=("event_id",))
    wired = route(raw, topo(spark, sf_dir))
    n = F.col("event_id")
    edge = F.when(n % 61 == 0, "edge-m9-9").otherwise(F.coalesce("edge_id", F.lit("edge-m0-0")))
    empty = F.from_json(F.lit("{}"), EVENT_SCHEMA["measurements"].dataType)
    return wired.select(
        F.when(n % 71 == 0, 2).otherwise(1).alias("schema_version"),
        F.when(n % 73 == 0, " ").otherwise(F.concat(F.lit("e"), n.cast("string"))).alias("event_id"),
        "sensor_id", "location_id",
        n.alias("sequence"),
        F.when(n % 79 != 0, F.col("event_time")).alias("observed_at"),
        F.lit(EMITTED_AT).cast("timestamp").alias("emitted_at"),
        F.when(n % 67 == 0, empty).otherwise(F.col("measurements")).alias("measurements"),
        edge.alias("receiving_edge"),
    )


def population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projected sensors of the European box."""
    return projected(population_in(located_sensors(sensor_stats(obs(spark, sf_dir), WINDOW))))


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed zone centroids: per nation, the rounded mean position of its topology sensors."""
    placed = projected(topo(spark, sf_dir))
    return placed.groupBy("edge_id").agg(
        F.round(F.avg("x_km"), 3).alias("centroid_x_km"), F.round(F.avg("y_km"), 3).alias("centroid_y_km")
    )
