"""Sums of distances from every point to every cluster, the quadratic part of the exact silhouette.

Points are dealt into blocks of bounded size. A pair (block, strip) of points
meets in one task, where numpy adds up the distances per cluster, tile by tile; what leaves
the task is one array of sums per point, never a pair. A task's work and memory
depend on the block, strip and tile sizes only, and the clusterings of all k share
one pass over the distances: those to points of equal clusters in every k are added up first.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.operators.clustering import mean_silhouette, point_silhouettes

BLOCK_ROWS = 16_384
STRIP_ROWS = 65_536
TILE_ROWS = 512  # of either side: what a task holds of the distances
SPREAD, SPREAD_ROWS = 16, 512  # few points still make so many blocks, of so many rows at least
SUMS = "sensor_id string, own array<int>, sums array<double>"


def _dealt(rows: int, n: int, least: int = 1) -> tuple[int, object]:
    pieces = max(least, -(-n // rows))
    return pieces, F.pmod(F.xxhash64("sensor_id"), F.lit(pieces)).cast("int")


def _distance_sums(ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray, own: np.ndarray, width: int) -> np.ndarray:
    """Per point of a and slot: the sum of its distances to the points of b that have the slot among their ``own``."""
    sums = np.zeros((len(ax), width))
    own, kind = np.unique(own, axis=0, return_inverse=True)
    member = np.zeros((len(own), width))
    np.put_along_axis(member, own, 1.0, axis=1)
    kind = kind.ravel()
    by_kind = np.argsort(kind, kind="stable")
    kind, bx, by = kind[by_kind], bx[by_kind], by[by_kind]
    for s in range(0, len(bx), TILE_ROWS):
        theirs = slice(s, s + TILE_ROWS)
        starts = np.flatnonzero(np.diff(kind[theirs], prepend=-1))
        slots = member[kind[theirs][starts]]
        for t in range(0, len(ax), TILE_ROWS):
            part = slice(t, t + TILE_ROWS)
            distance = bx[theirs, None] - ax[None, part]
            distance *= distance
            dy = by[theirs, None] - ay[None, part]
            dy *= dy
            distance += dy
            np.sqrt(distance, out=distance)
            sums[part] += np.add.reduceat(distance, starts, axis=0).T @ slots
    return sums


def cluster_distance_sums(
    assigned: DataFrame, block_rows: int = BLOCK_ROWS, strip_rows: int = STRIP_ROWS
) -> DataFrame:
    """Rows (k, sensor_id, own, cluster, size, total) from (sensor_id, x_km, y_km, k, cluster).

    ``assigned`` holds one row per sensor and k. It is read several times and
    should be materialized.
    """
    sizes = sorted(
        (r["k"], r["cluster"], r["n"])
        for r in assigned.groupBy("k", "cluster").agg(F.count("*").alias("n")).collect()
    )
    slot = {(k, c): i for i, (k, c, _) in enumerate(sizes)}
    ks = sorted({k for k, _, _ in sizes})
    slots = F.array(*[
        F.struct(F.lit(k).alias("k"), F.lit(ks.index(k)).alias("nth"), F.lit(c).alias("cluster"), F.lit(n).alias("size")) for k, c, n in sizes
    ])
    position = F.create_map(*[
        part for (k, c), i in slot.items() for part in (F.lit(f"{k}:{c}"), F.lit(i))
    ])
    # one row per sensor: its slot (position of its (k, cluster)) for every k; the list is as long as the sweep
    points = assigned.withColumn("_slot", position[F.concat_ws(":", "k", "cluster")]).groupBy("sensor_id").agg(
        F.first("x_km").alias("x"), F.first("y_km").alias("y"), F.sort_array(F.collect_list("_slot")).alias("own")
    )
    n = assigned.agg(F.count_distinct("sensor_id")).first()[0]
    blocks, block = _dealt(block_rows, n, min(SPREAD, n // SPREAD_ROWS + 1))
    strips, strip = _dealt(strip_rows, n)
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    # the rows are few for their work, so their partitions are counted by pairs of pieces rather than by bytes
    tasks = min(blocks * strips, 4 * int(assigned.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    left = points.withColumn("block", block).withColumn("strip", every(strips)).repartition(tasks, "block", "strip")
    right = points.select("x", "y", "own", strip.alias("strip")).withColumn("block", every(blocks)).repartition(tasks, "block", "strip")
    width = len(sizes)

    def add_up(mine: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        if mine.empty or others.empty:
            return pd.DataFrame({"sensor_id": [], "own": [], "sums": []})
        own = np.array(others["own"].tolist(), dtype=int).reshape(len(others), -1)
        ours, theirs = (tuple(side[c].to_numpy(float) for c in "xy") for side in (mine, others))
        sums = _distance_sums(*ours, *theirs, own, width)
        return pd.DataFrame({"sensor_id": mine["sensor_id"], "own": mine["own"], "sums": list(sums)})

    partial = left.groupBy("block", "strip").cogroup(right.groupBy("block", "strip")).applyInPandas(add_up, SUMS)
    totals = [f"_{i}" for i in range(width)]
    per_point = partial.groupBy("sensor_id").agg(F.first("own").alias("own"), *[F.sum(F.get("sums", F.lit(i))).alias(c) for i, c in enumerate(totals)])
    return (
        per_point.select("sensor_id", "own", F.posexplode(F.array(*totals)).alias("_pos", "total"))
        .withColumn("_s", F.get(slots, F.col("_pos")))
        .select(
            F.col("_s.k").alias("k"), "sensor_id",
            # slots are in order of k, and so are a point's own
            F.get(slots, F.get("own", F.col("_s.nth")))["cluster"].alias("own"),
            F.col("_s.cluster").alias("cluster"), F.col("_s.size").alias("size"), "total",
        )
    )


def silhouette_exact(assigned: DataFrame, **blocks) -> DataFrame:
    """(k, silhouette): mean over the points of (b - a) / max(a, b) with plain distances."""
    return mean_silhouette(point_silhouettes(cluster_distance_sums(assigned, **blocks)))
