import numpy as np

from skyloom.llm.nearest import nearest

ASKS = "vec_id % 50 = 0"


def brute(rows, asks, k=5):
    good = {(i, tuple(map(float, v))) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for i, v in good:
        if asks(i):
            best = out.setdefault(i, {})
            for j, w in good:
                if j != i and len(v) == len(w):
                    a, b = np.array(v), np.array(w)
                    best[j] = max(best.get(j, -2), float(a @ b / np.sqrt((a @ a) * (b @ b))))
    return {i: sorted(b.items(), key=lambda x: (-round(x[1], 12), x[0]))[:k] for i, b in out.items()}


def test_recall_and_scores(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.1')}/embeddings.parquet")
    t = df.toPandas()
    x = np.stack(t.embedding.to_numpy()).astype(float)
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    got = nearest(df, ASKS).toPandas()
    at = {v: i for i, v in enumerate(t.vec_id)}
    queries = t.vec_id[t.vec_id % 50 == 0].tolist()
    assert len(got) == 5 * len(queries)
    hit = 0
    for q in queries:
        s = x @ x[at[q]]
        s[at[q]] = -2
        mine = got[got.query_id == q].sort_values("rank")
        assert list(mine["rank"]) == [1, 2, 3, 4, 5]
        assert np.allclose(mine.score, s[[at[v] for v in mine.vec_id]], atol=1e-12)
        assert list(mine.score) == sorted(mine.score, reverse=True)
        hit += len({*mine.vec_id} & {*t.vec_id[np.argsort(-s)[:5]]})
    assert hit / (5 * len(queries)) >= 0.9


def test_ties_copies_and_bad_vectors(spark):
    rng = np.random.default_rng(3)
    same, rows = [1.0, 2.0, -1.0], []
    rows += [(i, same) for i in range(0, 300)]
    rows += [(i, [2 * x for x in same]) for i in range(300, 340)]
    rows += [(i, rng.normal(size=3).tolist()) for i in range(340, 420)]
    rows += [(500, None), (550, []), (600, [0.0, 0.0, 0.0]), (650, [1.0, None, 2.0]), (700, [float("nan"), 1.0, 1.0]), (750, [float("inf"), 1.0, 1.0]),
             (None, same), (800, [1.0, 2.0]), (801, [2.0, 1.0]), (850, [1e-200, 0.0, 0.0]), (400, rows[400][1]), (400, [9.0, 1.0, 1.0])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, `table` int, a int")
    got = {}
    for r in sorted(nearest(df, ASKS).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    want = brute([(i, [1.0, 0.0, 0.0] if i == 850 else v) for i, v in rows], lambda i: i % 50 == 0)
    assert {q: [v for v, _ in b] for q, b in got.items()} == {q: [v for v, _ in b] for q, b in want.items()}


def test_fewer_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (7, [0.0, 1.0]), (8, [0.0, -1.0])], "vec_id long, embedding array<float>")
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in nearest(df, ASKS).orderBy("rank").collect()] == [(0, 1, 7, 0.0), (0, 2, 8, 0.0)]
    assert nearest(df.limit(0), ASKS).collect() == []
