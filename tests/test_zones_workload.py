"""Clustering, silhouettes, quotas, samples."""

import tracemalloc

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from skyloom.operators import clustering, kmeans, pairwise, sweep, workload
from skyloom.params import KSweep
from skyloom.plans.tables import materialize

SCHEMA = "sensor_id string, x_km double, y_km double, rows long, rows_per_day double"


@pytest.fixture(scope="module")
def population(spark):
    rng = np.random.default_rng(3)
    centers = [(0, 0), (500, 0), (0, 500), (500, 500), (250, 900)]
    rows = [
        (f"s{i}", float(centers[i % 5][0] + dx), float(centers[i % 5][1] + dy), 10 + i, (10.0 + i) / 31)
        for i, (dx, dy) in enumerate(rng.normal(0, 20, (300, 2)))
    ]
    rows += [(f"c{i}", 0.0, 0.0, 10, 1.0) for i in range(60)]  # copies of one place
    return materialize(spark.createDataFrame(rows, SCHEMA).repartition(4), "population")


def brute_silhouette(points, labels):
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(2))
    out = []
    for i, own in enumerate(labels):
        same = labels == own
        if same.sum() == 1:
            out.append(0.0)
            continue
        a = d[i][same].sum() / (same.sum() - 1)
        b = min(d[i][labels == c].mean() for c in set(labels) if c != own)
        out.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return np.mean(out)


def test_fit_matches_mllib_and_is_reproducible(spark, population):
    fitted = kmeans.fit_kmeans(population, KSweep(3, 6, 4))
    points = np.array(population.select("x_km", "y_km").collect())
    features = VectorAssembler(inputCols=["x_km", "y_km"], outputCol="features").transform(population).cache()
    costs = []
    for k, centers in fitted.items():
        c = np.array([(x, y) for _, x, y in centers])
        costs.append(((points[:, None] - c[None]) ** 2).sum(2).min(1).sum())
        reference = min(KMeans(k=k, seed=s, maxIter=300).fit(features).summary.trainingCost for s in range(6))
        assert costs[-1] <= reference * 1.02
    assert all(a >= b for a, b in zip(costs, costs[1:]))
    again = kmeans.fit_kmeans(population.repartition(7), KSweep(3, 6, 4))
    for k in fitted:
        assert np.allclose(sorted(fitted[k]), sorted(again[k]))


def test_too_few_points(spark, population):
    with pytest.raises(ValueError):
        kmeans.fit_kmeans(population.limit(3), KSweep(3, 4, 1))


def test_seeds_come_from_few_passes_and_are_near_the_end(spark, population, monkeypatch):
    passes, frames = [], kmeans._draw
    monkeypatch.setattr(kmeans, "_draw", lambda *a: passes.append(a[3]) or frames(*a))
    frame = population.select(F.col("x_km").alias("x"), F.col("y_km").alias("y"), F.xxhash64("sensor_id").alias("h"))
    models = [kmeans._Model(k, seed) for k in (3, 5, 12) for seed in (42, 43)]
    kmeans._seed(frame, models)
    assert passes == list(range(kmeans.SEED_PASSES))
    assert [m.centers.shape for m in models] == [(m.k, 2) for m in models]
    kmeans._cost(frame, models)
    seeded = {m.k: min(o.cost for o in models if o.k == m.k) for m in models}
    best = kmeans.fit_kmeans(population, KSweep(5, 5, 2))[5]
    points = np.array(population.select("x_km", "y_km").collect())
    assert seeded[5] <= 1.1 * ((points[:, None] - np.array([c[1:] for c in best])[None]) ** 2).sum(2).min(1).sum()


def test_a_step_is_one_job(spark, population):
    frame = population.select(F.col("x_km").alias("x"), F.col("y_km").alias("y"), F.xxhash64("sensor_id").alias("h"))
    points, models = kmeans._packed(frame), [kmeans._Model(2, 1, np.array([[0.0, 0.0], [900.0, 900.0]]))]
    spark.sparkContext.setJobGroup("step", "")
    try:
        kmeans._move(points, models)
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("step")) == 1
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert (kmeans._sums(points, models) == kmeans._sums(frame, models)).all()


def test_a_place_with_nearly_all_points_hides_no_other(spark):
    """Copies fill whole draws; each different place still becomes a center."""
    places = [(0.0, 0.0), *[(10.0 * 3 ** i, 1.0) for i in range(7)]]
    rows = [(f"a{i}", 0.0, 0.0, 1, 1.0) for i in range(3_000)]
    rows += [(f"b{p}-{i}", *places[p], 1, 1.0) for p in range(1, 8) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    fitted = kmeans.fit_kmeans(df, KSweep(8, 8, 3))[8]
    assert sorted(c[1:] for c in fitted) == sorted(places)
    # fewer places than centers: some stand twice
    few = kmeans.fit_kmeans(df, KSweep(9, 10, 1))
    assert all({c[1:] for c in few[k]} == set(places) and len(few[k]) == k for k in few)


def test_topology_has_stable_ids(spark, population):
    topology, centers = clustering.edge_topology(population, 5, restarts=4)
    assert [c[0] for c in centers] == list(range(5))
    assert [c[1:] for c in centers] == sorted(c[1:] for c in centers)
    rows = topology.collect()
    assert len(rows) == 360 and {r["edge_id"] for r in rows} == {f"edge-{i}" for i in range(5)}
    for r in rows:
        d = [np.hypot(r["x_km"] - x, r["y_km"] - y) for _, x, y in centers]
        assert r["edge_cluster"] == int(np.argmin(d)) and r["distance_to_edge_km"] == pytest.approx(min(d))
    table = clustering.centroid_table(spark, centers)
    summary = clustering.edge_population_summary(topology, table).collect()
    assert sum(r["sensors"] for r in summary) == 360
    assert sum(r["load_share_pct"] for r in summary) == pytest.approx(100)


def test_silhouette_of_four_points(spark):
    rows = [("a", 0.0, 0.0, 2, 0), ("b", 0.0, 1.0, 2, 0), ("c", 10.0, 0.0, 2, 1), ("d", 10.0, 1.0, 2, 1)]
    df = spark.createDataFrame(rows, "sensor_id string, x_km double, y_km double, k int, cluster int")
    b = (10 + np.hypot(10, 1)) / 2
    assert pairwise.silhouette_exact(df).first()["silhouette"] == pytest.approx((b - 1) / b)


@pytest.mark.parametrize("blocks", [{}, {"block_rows": 40, "strip_rows": 90}])
def test_silhouette_matches_brute_force(spark, population, blocks):
    fitted = {k: [(i, float(100 * i), float(150 * i)) for i in range(k)] for k in (3, 5)}
    fitted[5][4] = (4, 1e5, 1e5)  # an empty zone
    assigned = materialize(clustering.assignments_per_k(population, fitted), "assigned")
    got = {r["k"]: r["silhouette"] for r in pairwise.silhouette_exact(assigned, **blocks).collect()}
    for k in fitted:
        rows = assigned.filter(F.col("k") == k).collect()
        points = np.array([(r["x_km"], r["y_km"]) for r in rows])
        assert got[k] == pytest.approx(brute_silhouette(points, np.array([r["cluster"] for r in rows])), abs=1e-12)


def test_distances_are_added_up_in_small_tiles():
    rng = np.random.default_rng(1)
    (ax, ay), (bx, by), own = rng.random((2, 3_000)), rng.random((2, 4_100)), np.stack([rng.integers(0, 5, 4_100), rng.integers(5, 11, 4_100)], axis=1)
    tracemalloc.start()
    got = pairwise._distance_sums(ax, ay, bx, by, own, 11)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    distance = np.hypot(ax[:, None] - bx, ay[:, None] - by)
    assert peak < 12e6  # all distances are 98 MB
    for slot in range(11):
        assert np.allclose(got[:, slot], distance[:, (own == slot).any(axis=1)].sum(axis=1))


def test_few_points_are_spread_over_tasks(spark):
    rows = [(f"s{i}", float(i % 50), float(i // 50), 2, i % 2) for i in range(3_000)]
    assigned = materialize(spark.createDataFrame(rows, "sensor_id string, x_km double, y_km double, k int, cluster int"), "assigned")
    spark.sparkContext.setJobGroup("spread", "")
    try:
        pairwise.cluster_distance_sums(assigned).write.format("noop").mode("overwrite").save()
        told = spark.sparkContext.statusTracker()
        stages = [told.getStageInfo(s) for j in told.getJobIdsForGroup("spread") for s in told.getJobInfo(j).stageIds]
        assert max(s.numTasks for s in stages if s) >= 6
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_singletons_and_copies_have_silhouette_zero(spark):
    rows = [("a", 0.0, 0.0, 2, 0), ("b", 5.0, 0.0, 2, 1), ("c", 5.0, 0.0, 2, 1)]
    df = spark.createDataFrame(rows, "sensor_id string, x_km double, y_km double, k int, cluster int")
    per_point = {r["sensor_id"]: r["silhouette"] for r in
                 clustering.point_silhouettes(pairwise.cluster_distance_sums(df)).collect()}
    assert per_point == {"a": 0.0, "b": 1.0, "c": 1.0}


def test_sweep_finds_the_five_groups(spark, population):
    metrics = materialize(sweep.sweep_metrics(population, KSweep(3, 7, 4)), "metrics")
    rows = {r["k"]: r for r in metrics.collect()}
    assert sorted(rows) == [3, 4, 5, 6, 7]
    assert clustering.best_k(metrics).first()["k"] == 5
    assert clustering.elbow_k(metrics).first()["k"] == 5
    assert all(r["mean_sensors"] == 360 / k for k, r in rows.items())
    inertia = [rows[k]["inertia"] for k in sorted(rows)]
    assert inertia == sorted(inertia, reverse=True)
    assert rows[5]["max_load_factor"] == pytest.approx(rows[5]["max_load_eps"] / rows[5]["mean_load_eps"])


def test_metrics_count_empty_zones(spark):
    assigned = spark.createDataFrame([(2, "a", 0, 1.0, 3.0), (2, "b", 0, 3.0, 1.0)],
                                     "k int, sensor_id string, cluster int, distance double, load_eps double")
    zones = spark.createDataFrame([(2, 0), (2, 1)], "k int, cluster int")
    sil = spark.createDataFrame([(2, 0.5)], "k int, silhouette double")
    r = clustering.k_metrics(assigned, zones, sil).first()
    assert (r["min_sensors"], r["max_sensors"], r["mean_sensors"]) == (0, 2, 1.0)
    assert (r["mean_load_eps"], r["max_load_eps"], r["load_cv"], r["max_load_factor"]) == (2.0, 4.0, 1.0, 2.0)
    assert (r["inertia"], r["mean_distance_km"], r["max_radius_km"]) == (10.0, 2.0, 3.0)
    assert r["p95_distance_km"] == pytest.approx(2.9)


def test_ties_take_the_smallest_k(spark):
    df = spark.createDataFrame([(5, 8.0, 0.4), (6, 6.0, 0.7), (7, 4.0, 0.7), (8, 2.0, 0.1), (9, 0.0, 0.1)],
                               "k int, inertia double, silhouette double")
    assert clustering.best_k(df).first()["k"] == 6
    assert clustering.elbow_k(df).first()["k"] == 5  # a straight line: all distances equal


def quotas(spark, sizes, size):
    df = spark.createDataFrame([(i, f"edge-{i}", n) for i, n in enumerate(sizes)],
                               "edge_cluster int, edge_id string, population_sensors long")
    return [r["sensor_quota"] for r in workload.balanced_quotas(df, size).orderBy("edge_cluster").collect()]


def test_quotas(spark):
    assert quotas(spark, [5, 5, 5], 6) == [2, 2, 2]
    assert quotas(spark, [5, 9, 7], 8) == [2, 3, 3]
    assert quotas(spark, [7, 7, 7, 9], 10) == [3, 2, 2, 3]  # ties go to the lower cluster
    assert quotas(spark, [1, 9], 3) == [1, 2]


@pytest.mark.parametrize("sizes, size, message", [
    ([5, 5, 5], 2, "cannot be represented"),
    ([2, 2], 5, "bigger than the population"),
    ([1, 9], 4, "fewer sensors than the base quota"),
    ([1, 1, 9], 5, "cannot be distributed"),
    ([], 5, "no edge"),
])
def test_impossible_quotas(spark, sizes, size, message):
    with pytest.raises(ValueError, match=message):
        quotas(spark, sizes, size)


def test_sample_is_exact_reproducible_and_cut_before_the_shuffle(spark, population):
    topology, _ = clustering.edge_topology(population, 4, restarts=2)
    topology = materialize(topology, "topology")
    table = workload.balanced_quotas(workload.population_by_edge(topology), 50)
    one = workload.stratified_sample(topology, table, 50)
    two = workload.stratified_sample(topology.repartition(9), table, 50)
    other = workload.stratified_sample(topology, table, 50, seed=7)
    ids = lambda df: sorted(r["sensor_id"] for r in df.collect())
    assert ids(one) == ids(two) and len(set(ids(one))) == 50 and ids(one) != ids(other)
    shares = workload.workload_shares(table, one, 50)
    assert workload.quota_mismatches(shares).isEmpty()
    assert sum(r["workload_share_pct"] for r in shares.collect()) == pytest.approx(100)
    assert workload.assignment_mismatches(one, topology).isEmpty()
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan.split("WindowGroupLimit")[2]


def test_load(spark):
    df = spark.createDataFrame([("a", 0, "edge-0", 10, 86_400.0), ("b", 1, "edge-1", 30, 259_200.0)],
                               "sensor_id string, edge_cluster int, edge_id string, rows long, rows_per_day double")
    rows = {r["edge_id"]: r for r in workload.workload_edge_summary(df, 100).collect()}
    assert rows["edge-1"]["natural_events_per_second"] == 3.0
    assert rows["edge-1"]["load_share_pct"] == 75.0 and rows["edge-1"]["target_events_per_second"] == 75.0
    assert tuple(workload.natural_rate(df, 100).first()) == (4.0, 25.0)
    got = {r["replay_factor"]: r["total_events_per_second"] for r in workload.replay_scenarios(df).collect()}
    assert got == {1: 4.0, 100: 400.0, 1000: 4000.0}
