"""Zones over the projected population: labels, topology, metrics, and the choice of k."""

from __future__ import annotations

from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyloom.functions.geo import euclidean, nearest
from skyloom.functions.rates import edge_label, per_second, percent
from skyloom.operators.kmeans import Center, fit_kmeans
from skyloom.params import KSweep
from skyloom.plans.quantiles import exact_quantile


# -- labels -----------------------------------------------------------------

def stable_centers(centers: list[Center]) -> list[Center]:
    """Ids renumbered from west to east, then south to north."""
    ordered = sorted(centers, key=lambda c: (c[1], c[2]))
    return [(i, x, y) for i, (_, x, y) in enumerate(ordered)]


def centroid_table(spark, centers: list[Center]) -> DataFrame:
    """(edge_cluster, edge_id, centroid_x_km, centroid_y_km) of fitted centers."""
    df = spark.createDataFrame(centers, "edge_cluster INT, centroid_x_km DOUBLE, centroid_y_km DOUBLE")
    return df.withColumn("edge_id", edge_label(F.col("edge_cluster"))).select(
        "edge_cluster", "edge_id", "centroid_x_km", "centroid_y_km"
    )


def stable_labels(centroids: DataFrame) -> DataFrame:
    """Add ``edge_cluster`` (0-based) to a centroid table, ordered by x, then y.

    A centroid table has one row per zone, so one task ranks it.
    """
    w = W.orderBy("centroid_x_km", "centroid_y_km")
    return centroids.withColumn("edge_cluster", (F.row_number().over(w) - 1).cast("int"))


# -- assignment --------------------------------------------------------------

def _center_array(zones: DataFrame):
    """The zone table as one array value; its length is the number of zones."""
    struct = F.struct(F.col("edge_cluster").alias("cluster"), F.col("centroid_x_km").alias("x"), F.col("centroid_y_km").alias("y"))
    return zones.agg(F.sort_array(F.collect_list(struct))).scalar()


def assign_edges(population: DataFrame, zones: DataFrame, macroarea_id: str = "none") -> DataFrame:
    """Topology of a population: nearest zone of a centroid table, its label, and the distance to it."""
    near = nearest(F.col("x_km"), F.col("y_km"), F.col("_centers"))
    return (
        population.withColumn("_centers", _center_array(zones)).withColumn("_near", near)
        .withColumns({
            "edge_cluster": F.col("_near.cluster").cast("int"),
            "distance_to_edge_km": F.col("_near.distance"),
            "macroarea_id": F.lit(macroarea_id),
        })
        .drop("_near", "_centers")
        .withColumn("edge_id", edge_label(F.col("edge_cluster")))
    )


def edge_topology(
    population: DataFrame, k: int, restarts: int = 20, seed: int = 42, fitted: list[Center] | None = None,
) -> tuple[DataFrame, list[Center]]:
    """Assign with the chosen k; returns the topology and its stable centers.

    ``fitted`` are the centers of a sweep for this k; without them they are fitted here.
    """
    centers = stable_centers(fitted or fit_kmeans(population, KSweep(k, k, restarts, seed))[k])
    return assign_edges(population, centroid_table(population.sparkSession, centers)), centers


# -- summaries ---------------------------------------------------------------

def edge_population_summary(topology: DataFrame, centroids: DataFrame) -> DataFrame:
    """Per zone: sensors, load, share of load, distances, and the centroid."""
    keys = ["edge_cluster", "edge_id"]
    base = topology.groupBy(*keys).agg(
        F.count_distinct("sensor_id").alias("sensors"),
        F.sum("rows").alias("rows"),
        F.sum("rows_per_day").alias("rows_per_day"),
        F.avg("distance_to_edge_km").alias("mean_distance_km"),
        F.max("distance_to_edge_km").alias("max_radius_km"),
    ).withColumn("natural_events_per_second", per_second(F.col("rows_per_day")))
    p95 = exact_quantile(topology, keys, "distance_to_edge_km", 0.95, "p95_distance_km")
    total = topology.agg(per_second(F.sum("rows_per_day"))).scalar()
    return (
        base.join(p95, keys)
        .join(centroids.select(*keys, "centroid_x_km", "centroid_y_km"), keys, "left")
        .withColumn("load_share_pct", percent(F.col("natural_events_per_second"), total))
        .select(
            "edge_id", "sensors", "rows", "rows_per_day", "natural_events_per_second", "load_share_pct",
            "mean_distance_km", "p95_distance_km", "max_radius_km", "centroid_x_km", "centroid_y_km",
            "edge_cluster",
        )
    )


def k_metrics(assigned: DataFrame, zones: DataFrame, silhouettes: DataFrame) -> DataFrame:
    """One row per k from ``assigned`` (k, sensor_id, cluster, distance, load_eps).

    ``zones`` lists every (k, cluster), so that an empty zone counts as zero.
    """
    per_zone = assigned.groupBy("k", "cluster").agg(
        F.count("*").alias("n"),
        F.sum("distance").alias("d"),
        F.sum(F.col("distance") * F.col("distance")).alias("d2"),
        F.max("distance").alias("radius"),
        F.sum("load_eps").alias("load"),
    )
    per_k = (
        zones.join(per_zone, ["k", "cluster"], "left")
        .fillna(0, ["n", "d", "d2", "load"])
        .groupBy("k")
        .agg(
            F.sum("d2").alias("inertia"),
            F.min("n").alias("min_sensors"), F.avg("n").alias("mean_sensors"), F.max("n").alias("max_sensors"),
            F.try_divide(F.sum("d"), F.sum("n")).alias("mean_distance_km"),
            F.max("radius").alias("max_radius_km"),
            F.avg("load").alias("mean_load_eps"), F.max("load").alias("max_load_eps"),
            F.stddev_pop("load").alias("_std"),
        )
        .withColumns({
            "load_cv": F.try_divide("_std", "mean_load_eps"),
            "max_load_factor": F.try_divide("max_load_eps", "mean_load_eps"),
        })
    )
    p95 = exact_quantile(assigned, ["k"], "distance", 0.95, "p95_distance_km")
    return per_k.join(p95, "k").join(silhouettes, "k", "left").select(
        "k", "inertia", "silhouette", "min_sensors", "mean_sensors", "max_sensors", "mean_distance_km",
        "p95_distance_km", "max_radius_km", "mean_load_eps", "max_load_eps", "load_cv", "max_load_factor",
    )


def assignments_per_k(population: DataFrame, fitted: dict[int, list[Center]]) -> DataFrame:
    """Rows (sensor_id, x_km, y_km, k, cluster, distance, load_eps), one per sensor and k."""
    x, y = F.col("x_km"), F.col("y_km")
    centers = population.sparkSession.createDataFrame(
        [(k, c, cx, cy) for k, cs in fitted.items() for c, cx, cy in cs], "k INT, cluster INT, x DOUBLE, y DOUBLE")
    lists = centers.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("cluster", "x", "y"))).alias("centers"))
    every = lists.agg(F.sort_array(F.collect_list(F.struct("k", "centers")))).scalar()
    per_k = F.transform("_every", lambda one: F.struct(one["k"].alias("k"), nearest(x, y, one["centers"]).alias("near")))
    return population.withColumn("_every", every).select(
        "sensor_id", "x_km", "y_km", per_second(F.col("rows_per_day")).alias("load_eps"),
        F.explode(per_k).alias("_a"),
    ).select(
        "sensor_id", "x_km", "y_km", F.col("_a.k").alias("k"),
        F.col("_a.near.cluster").cast("int").alias("cluster"), F.col("_a.near.distance").alias("distance"),
        "load_eps",
    )


def zone_list(spark, fitted: dict[int, list[Center]]) -> DataFrame:
    return spark.createDataFrame([(k, c[0]) for k, cs in fitted.items() for c in cs], "k INT, cluster INT")


# -- choosing k ----------------------------------------------------------------

def elbow_distances(metrics: DataFrame) -> DataFrame:
    """Add ``chord_distance``: distance of the normalized (k, inertia) curve to its end-to-end chord.

    A metrics table has one row per candidate k, so one task handles it.
    """
    everything = W.partitionBy()
    ordered = everything.orderBy("k").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)

    def scaled(c):
        low, high = F.min(c).over(everything), F.max(c).over(everything)
        return F.try_divide(F.col(c) - low, high - low)

    norm = metrics.withColumns({"_x": scaled("k"), "_y": scaled("inertia")})
    norm = norm.withColumns({
        "_x0": F.first("_x").over(ordered), "_y0": F.first("_y").over(ordered),
        "_x1": F.last("_x").over(ordered), "_y1": F.last("_y").over(ordered),
    })
    dx, dy = F.col("_x1") - F.col("_x0"), F.col("_y1") - F.col("_y0")
    cross = dx * (F.col("_y") - F.col("_y0")) - dy * (F.col("_x") - F.col("_x0"))
    return norm.withColumn(
        "chord_distance", F.try_divide(F.abs(cross), F.sqrt(dx * dx + dy * dy))
    ).drop("_x", "_y", "_x0", "_y0", "_x1", "_y1")


def elbow_k(metrics: DataFrame) -> DataFrame:
    """One row: the k farthest from the chord; the smallest such k on a tie."""
    return elbow_distances(metrics).orderBy(F.desc("chord_distance"), "k").limit(1).select("k", "chord_distance")


def best_k(metrics: DataFrame) -> DataFrame:
    """One row: the k with the highest silhouette; the smallest such k on a tie."""
    return metrics.orderBy(F.desc("silhouette"), "k").limit(1)


# -- silhouette ----------------------------------------------------------------

def silhouette_squared(points: DataFrame, label: str = "cluster") -> float:
    """MLlib's silhouette on squared distances: linear in the points, not comparable to the exact one."""
    df = VectorAssembler(inputCols=["x_km", "y_km"], outputCol="features").transform(points)
    evaluator = ClusteringEvaluator(predictionCol=label, featuresCol="features", metricName="silhouette")
    return evaluator.evaluate(df)


def point_silhouettes(sums: DataFrame) -> DataFrame:
    """Silhouette of every point from (k, sensor_id, own, cluster, size, total).

    ``total`` is the sum of distances from the point to the members of
    ``cluster``. A point alone in its cluster gets 0.
    """
    mine = F.col("cluster") == F.col("own")
    a = F.max(F.when(mine, F.try_divide("total", F.col("size") - 1)))
    b = F.min(F.when(~mine, F.try_divide("total", "size")))
    per_point = sums.groupBy("k", "sensor_id").agg(a.alias("a"), b.alias("b"))
    s = F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b"))
    return per_point.select("k", "sensor_id", F.coalesce(s, F.lit(0.0)).alias("silhouette"))


def mean_silhouette(per_point: DataFrame) -> DataFrame:
    return per_point.groupBy("k").agg(F.avg("silhouette").alias("silhouette"))
