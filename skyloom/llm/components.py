"""Connected components of a graph that is too big for one machine."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.plans.tables import materialize


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the edges (u, v); root is the smallest node that it is connected with.

    Each round takes the smallest root among a node and its neighbours, then follows roots of roots, so a
    path of length n takes about log n rounds. Rounds are written, so a lost executor repeats one at most.
    """
    both = materialize(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    roots = materialize(both.groupBy(F.col("u").alias("node")).agg(F.least(F.first("u"), F.min("v")).alias("root")), "roots")
    for _ in range(rounds):
        near = (both.join(roots.toDF("v", "near"), "v").groupBy(F.col("u").alias("node")).agg(F.min("near").alias("near")))
        lower = roots.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        up = roots.toDF("root", "above")
        step = materialize(lower.join(up, "root").select("node", "old", F.least("root", "above").alias("root")), "roots")
        roots = step.select("node", "root")
        if step.filter("root < old").isEmpty():
            return roots
    raise RuntimeError("components: more rounds needed than allowed")


def forest(near: np.ndarray) -> list[tuple[int, int]]:
    """The components of a small graph, given as a symmetric boolean matrix: an edge from the first node of each to every other one."""
    left, edges = np.ones(len(near), bool), []
    for root in range(len(near)):
        if not left[root]:
            continue
        left[root], front = False, [root]
        while front:
            u = front.pop()
            new = np.flatnonzero(near[u] & left)
            left[new] = False
            edges += [(root, int(v)) for v in new]
            front += new.tolist()
    return edges
