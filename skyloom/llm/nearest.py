"""Nearest neighbours by cosine with cross-polytope hashing.

Unit vectors are turned by fast pseudo-rotations (signs and a Hadamard transform, three times) and fall to the nearest signed
axis. Each table has its own rotation. A query looks into the buckets of its ``probes`` nearest axes of every table, and all
that lies there is compared exactly. Equal vectors are one point of the index.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyloom.llm.common import col
from skyloom.plans.tables import materialize

TABLES, PROBES = 16, 6
INDEX_BLOCK, QUERY_BLOCK = 4096, 1024
EXACT = -1  # the table of queries that are compared with every point


class Rotations:
    """The pseudo-rotations of all tables for vectors of one dimension."""

    def __init__(self, dim: int, tables: int, seed: int):
        self.width = 1 << max(0, (dim - 1).bit_length())
        self.signs = np.random.default_rng([seed, dim]).choice(np.array([-1.0, 1.0]), (tables, 3, self.width))

    def __call__(self, x: np.ndarray, table: int) -> np.ndarray:
        y = np.zeros((len(x), self.width))
        y[:, :x.shape[1]] = x
        for signs in self.signs[table]:
            y *= signs
            half = 1
            while half < self.width:
                y = y.reshape(len(x), -1, 2, half)
                y = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2)
                half *= 2
            y = y.reshape(len(x), self.width)
        return y


def axes(y: np.ndarray, probes: int) -> np.ndarray:
    """The nearest signed axes of each row, nearest first: 2 * axis, and 1 more on its positive side."""
    probes = min(probes, y.shape[1])
    order = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :probes]
    return 2 * order + (np.take_along_axis(y, order, axis=1) > 0)


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = np.asarray(flat.flatten(), dtype=np.float64).reshape(len(flat), -1)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])  # exact, and keeps squares in range


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _buckets(tables: int, probes: int, seed: int):
    """A row per vector, table and probe."""
    def rows(batches):
        for batch in batches:
            dims = np.asarray(batch.column("dim"))
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                unit, turn = _unit(_matrix(part.column("vector"))), Rotations(int(dim), tables, seed)
                for table in range(tables):
                    near = axes(turn(unit, table), probes)
                    take = np.repeat(np.arange(len(unit)), near.shape[1])
                    names = ["a", "b", "dim", "vector", *(["ids"] if "ids" in part.schema.names else [])]
                    out = part.select(names).take(pa.array(take))
                    yield pa.RecordBatch.from_arrays(
                        [*out.columns, pa.array(np.full(len(take), table), pa.int32()), pa.array(near.ravel(), pa.int32())], names=[*names, "table", "bucket"])

    return rows


def _best(k: int):
    def rows(key, points, queries):
        out = []
        if points.num_rows and queries.num_rows:
            x, q = _matrix(points.column("vector")), _matrix(queries.column("vector"))
            nx, nq = (np.sqrt((m * m).sum(axis=1)) for m in (x, q))
            ids = points.column("ids").to_pylist()
            first = np.array([i[0] for i in ids])
            a, b = queries.column("a").to_pylist(), queries.column("b").to_pylist()
            for i, row in enumerate(q @ x.T / nx / nq[:, None]):
                least = np.partition(row, -k)[-k] - 1e-9 if len(row) > k else -np.inf
                near = np.flatnonzero(row >= least)
                # one way of summing for every block, so that equal vectors have equal scores
                score = (x[near] * q[i]).sum(axis=1) / (nx[near] * nq[i])
                out += [(a[i], b[i], ids[near[j]], float(score[j])) for j in np.lexsort((first[near], -score))[:k]]
        return pa.table({"a": pa.array([o[0] for o in out], pa.int64()), "b": pa.array([o[1] for o in out], pa.int64()),
                         "ids": pa.array([o[2] for o in out], pa.list_(pa.int64())), "score": pa.array([o[3] for o in out], pa.float64())})

    return rows


def _searched(points: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Best points of each query in the places where both are; big places are cut into blocks of either side."""
    place = ["dim", "table", "bucket"]
    # a row per bucket: at most tables * 2 * dimension of them
    n, m = (x.groupBy(place).agg(F.ceil(F.count("*") / size).cast("int").alias(c)) for x, size, c in ((points, INDEX_BLOCK, "n"), (queries, QUERY_BLOCK, "m")))
    cuts = F.broadcast(materialize(n.join(m, place), "cuts"))
    dealt = lambda own, parts: F.pmod(F.xxhash64("a", "b"), own).cast("int") if parts is None else F.explode(F.sequence(F.lit(0), own - 1))
    left = points.join(cuts, place).withColumn("i", dealt(F.col("n"), None)).withColumn("j", dealt(F.col("m"), 1))
    right = queries.join(cuts, place).withColumn("i", dealt(F.col("n"), 1)).withColumn("j", dealt(F.col("m"), None))
    keys = [*place, "i", "j"]
    return left.drop("n", "m").groupBy(keys).cogroup(right.drop("n", "m").groupBy(keys)).applyInArrow(
        _best(k), "a long, b long, ids array<long>, score double")


def nearest(
    vectors: DataFrame, is_query: str, k: int = 5, tables: int = TABLES, probes: int = PROBES, seed: int = 11,
    key: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows found for each row where the SQL expression ``is_query`` holds, itself left out.

    Nearness is the cosine in double precision; ties go to the smaller id. A query finds all candidates if there are fewer than ``k``: one
    that the tables leave short is compared with every row, in blocks. Null, empty and zero vectors, vectors
    with null or non-finite components, and rows without an id take no part, neither does a vector of another
    length than the query's. Rows with one id and one vector are one; rows with one id and several vectors
    all count. An empty table gives an empty result.
    """
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    rows = vectors.select(col(key).cast("long").alias("vec_id"), col(vector).cast("array<double>").alias("vector"), F.expr(is_query).alias("asks"))
    rows = rows.filter(F.col("vec_id").isNotNull() & (F.size("vector") > 0) & finite).withColumns({
        "a": F.xxhash64("vector"), "b": F.xxhash64(F.lit(seed), "vector"), "dim": F.size("vector")})
    point = ["a", "b"]
    # of equal vectors k + 1 ids can be among the nearest; the rank is bounded before the shuffle
    by_id = W.partitionBy(point).orderBy("vec_id")
    copies = rows.dropDuplicates([*point, "vec_id"]).withColumn("copy", F.row_number().over(by_id)).filter(F.col("copy") <= k + 1)
    points = materialize(copies.groupBy(point).agg(
        F.sort_array(F.collect_list("vec_id")).alias("ids"), F.first("vector").alias("vector"), F.first("dim").alias("dim")), "points")
    asking = materialize(rows.filter("asks").select(*point, F.col("vec_id").alias("query_id")).distinct(), "asking")
    queries = materialize(points.drop("ids").join(asking.select(point).distinct(), point, "left_semi"), "queries")
    placed = "a long, b long, dim int, vector array<double>, {}table int, bucket int"
    hits = _searched(
        points.mapInArrow(_buckets(tables, 1, seed), placed.format("ids array<long>, ")), queries.mapInArrow(_buckets(tables, probes, seed), placed.format("")), k + 1)
    hits = materialize(hits.distinct(), "hits")
    found = hits.select(*point, F.explode("ids").alias("vec_id")).distinct().groupBy(point).agg(F.count("*").alias("found"))
    short = materialize(queries.join(found, point, "left").filter(F.coalesce("found", F.lit(0)) < k + 1).drop("found"), "short")
    if not short.isEmpty():
        everywhere = {"table": F.lit(EXACT), "bucket": F.lit(0)}
        hits = hits.unionByName(_searched(points.withColumns(everywhere), short.withColumns(everywhere), k + 1)).distinct()
    near = hits.select(*point, "score", F.explode("ids").alias("vec_id")).groupBy(*point, "vec_id").agg(F.max("score").alias("score"))
    order = [F.col("score").desc(), F.col("vec_id")]
    near = materialize(near.withColumn("rank", F.row_number().over(W.partitionBy(point).orderBy(*order))).filter(F.col("rank") <= k + 1).drop("rank"), "near")
    mine = asking.join(near, point).filter("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = mine.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order)))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
