"""The skew-safe paths must agree with the simple ones, also when one key holds most rows."""

from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyloom.plans import invariants, joins, numbering, quantiles, tables


@pytest.fixture(scope="module")
def skewed(spark):
    """6 000 rows; key 'a' holds two thirds, and a third of all rows are copies of one row."""
    df = spark.range(6_000, numPartitions=6).select(
        F.when(F.col("id") % 3 < 2, "a").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("key"),
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") * 7919 % 1_000).alias("t"),
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("tie"),
    )
    return tables.materialize(df, "skewed")


def test_number_rows_of_a_hot_group(skewed):
    ranged = numbering.number_rows(skewed, ["key"], ["t", "tie"], "n")
    plain = skewed.withColumn("n", F.row_number().over(W.partitionBy("key").orderBy("t", "tie")).cast("bigint"))
    assert sorted(map(tuple, ranged.collect())) == sorted(map(tuple, plain.collect()))
    assert ranged.dtypes == plain.dtypes


def test_number_rows_without_keys(skewed):
    ranged = numbering.number_rows(skewed, [], ["t", "key", "tie"], "n")
    rows = ranged.orderBy("n").collect()
    assert [r["n"] for r in rows] == list(range(1, 6_001))
    assert [(r["t"], r["key"], r["tie"]) for r in rows] == sorted((r["t"], r["key"], r["tie"]) for r in rows)


def test_number_rows_null_key(spark):
    df = spark.createDataFrame([(None, 3), (None, 1), ("x", 2)], "key string, t int")
    ranged = numbering.number_rows(df, ["key"], ["t"], "n")
    assert sorted(map(tuple, ranged.collect()), key=str) == [("x", 2, 1), (None, 1, 1), (None, 3, 2)]


def test_hot_group_is_split(skewed):
    ranged = numbering.number_rows(skewed, ["key"], ["t", "tie"], "n")
    plan = ranged._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan  # only over the run counts
    assert "row_number" not in plan


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_lookup_join_of_a_hot_key(spark, skewed, how):
    lookup = spark.createDataFrame([("a", 1), ("k2", 2), ("zz", 3)], "key string, v int")
    kept = {"left": lambda k: True, "inner": lambda k: k in ("a", "k2"), "left_semi": lambda k: k in ("a", "k2"), "left_anti": lambda k: k not in ("a", "k2")}[how]
    value = {"a": (1,), "k2": (2,)}
    want = [(*r, *(value.get(r["key"], (None,)) if how in ("left", "inner") else ())) for r in skewed.collect() if kept(r["key"])]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for limit in (before, "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        got = joins.lookup_join(skewed, lookup, "key", how).collect()
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_lookup_join_can_insist_on_one_row_per_key(spark, skewed):
    lookup = spark.createDataFrame([("a", 1), ("k2", 2), ("k2", 2)], "key string, v int")
    assert joins.lookup_join(skewed, lookup.limit(1), "key", "left", unique=True).columns == ["key", "t", "tie", "v"]
    with pytest.raises(Exception, match="more than one row for key k2"):
        joins.lookup_join(skewed, lookup, "key", "inner", unique=True).collect()


def test_against_previous_with_a_null_block(spark):
    df = spark.createDataFrame([(None, 0, 5), (None, 1, 3), ("b", 2, 1)], "block string, row int, t int")
    out = numbering.against_previous(df, "t", [F.col("block")], F.col("row")).orderBy("row").collect()
    assert [(r["t"], r["previous_t"]) for r in out] == [(5, None), (3, 5), (1, 3)]


def test_against_previous(spark):
    rows = [(i, t) for i, t in enumerate([5, 3, None, 9, 1, 1, 8])]
    df = spark.createDataFrame(rows, "row int, t int")
    out = numbering.against_previous(df, "t", [F.floor(F.col("row") / 2)], F.col("row"))
    got = [r["previous_t"] for r in out.orderBy("row").collect()]
    assert got == [None, 5, 3, None, 9, 1, 1]


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.95, 1.0])
def test_exact_quantile_paths_agree_with_numpy(spark, q):
    rng = np.random.default_rng(1)
    rows = [("hot", float(v)) for v in rng.lognormal(0, 3, 4_000)] + [("hot", 2.0)] * 2_000
    rows += [("cold", float(v)) for v in rng.normal(size=7)] + [("one", 5.0), ("none", None)]
    df = spark.createDataFrame(rows, "key string, v double")
    expected = {k: float(np.quantile([v for kk, v in rows if kk == k and v is not None], q))
                for k in ("hot", "cold", "one")}
    expected["none"] = None
    plain = {r["key"]: r["p"] for r in quantiles.exact_quantile(df, ["key"], "v", q, "p").collect()}
    hard = {
        r["key"]: r["p"]
        for r in quantiles.exact_quantile(df, ["key"], "v", q, "p", accuracy=200).collect()
    }
    for k, want in expected.items():
        assert plain[k] == (None if want is None else pytest.approx(want, abs=1e-9))
        assert hard[k] == (None if want is None else pytest.approx(want, abs=1e-9))


def test_exact_quantile_two_keys_and_none(spark):
    df = spark.range(1_000).selectExpr("id % 2 AS a", "id % 3 AS b", "cast(id AS double) AS v")
    plain = quantiles.exact_quantile(df, ["a", "b"], "v", 0.95, "p").collect()
    hard = quantiles.exact_quantile(df, ["a", "b"], "v", 0.95, "p", accuracy=50).collect()
    key = lambda r: (r["a"], r["b"], round(r["p"], 9))
    assert sorted(map(key, plain)) == sorted(map(key, hard))
    one = quantiles.exact_quantile(df, [], "v", 0.95, "p", accuracy=50).first()["p"]
    assert one == pytest.approx(np.quantile(np.arange(1_000), 0.95))


def test_quantile_argument(spark):
    with pytest.raises(ValueError):
        quantiles.exact_quantile(spark.range(1), [], "id", 1.5, "p")


def test_invariants(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), ("b", 2)], "id string, v int")
    rules = {
        "unique": invariants.unique(df, ["id"]),
        "filled": invariants.no_nulls(["id", "v"]),
        "size": invariants.rows_are(3),
    }
    found = invariants.violations(df, rules)
    assert {r["rule"]: r["offending"] for r in found.collect()} == {"unique": 1, "filled": 1}
    with pytest.raises(ValueError, match="unique"):
        invariants.require(found)
    invariants.require(found.limit(0))


def test_shared_folder_is_read_from_the_session(tmp_path):
    class Session:
        class conf:
            @staticmethod
            def get(key, default=None):
                return f"{tmp_path}/" if key == "spark.checkpoint.dir" else default

    assert tables.shared_folder(Session) == str(tmp_path)
    assert tables.new_path(Session, "x") != tables.new_path(Session, "x")
    assert tables.new_path(Session, "x").startswith(f"{tmp_path}/skyloom/x-")


def test_materialized_table_keeps_rows_and_schema(spark, skewed):
    out = tables.materialize(skewed.limit(5), "five")
    assert out.count() == 5
    assert out.dtypes == skewed.dtypes


def test_a_cluster_needs_a_shared_folder(tmp_path):
    def session(master, folder=None):
        conf = SimpleNamespace(get=lambda key, default=None: folder)
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, applicationId=f"app-{master}", getConf=lambda: conf))

    assert tables.shared_folder(session("yarn", "hdfs:///shared/")) == "hdfs:///shared"
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            tables.shared_folder(session(master))
    own = tables.shared_folder(session("local[2]"))
    assert own == tables.shared_folder(session("local[2]")) and own != tables.shared_folder(session("local"))
