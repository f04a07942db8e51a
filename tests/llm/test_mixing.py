import pytest
from pyspark.sql import functions as F

from skyloom.llm import mixing
from skyloom.llm.mixing import mixed, mixed_copies, targets


def water(sizes, weights, share, ceiling):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, full = {}, share * sum(sizes.values()), set()
    while True:
        open_ = [s for s in names if s not in full]
        rest = left - sum(ceiling * sizes[s] for s in full)
        target = {s: ceiling * sizes[s] if s in full else rest * weight[s] / sum(weight[o] for o in open_) for s in names}
        over = {s for s in open_ if target[s] > ceiling * sizes[s]}
        if not over:
            return target
        full |= over


def check(df, limit=None, **options):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in df.collect()]
    size = lambda t: len((t or "").encode().split())
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    want = water(sizes, options.get("weights", (5, 2, 1)), options.get("share", 1.5), options.get("ceiling", 2.0))
    got = mixed_copies(df, **options).collect()
    assert sorted((repr(r["doc_id"]), r["size"], repr(r["source"]), r["source_size"]) for r in got) == sorted((repr(d), size(t), repr(s), sizes[s]) for d, t, s in rows)
    for s in sizes:
        own = [r for r in got if r["source"] == s]
        assert all(r["target"] == pytest.approx(want[s], rel=1e-9) for r in own)
        factor = want[s] / sizes[s] if sizes[s] else 0
        assert all(r["copies"] in (int(factor + 1e-9), int(factor + 1e-9) + 1) or abs(r["copies"] - factor) < 1e-6 for r in own)
        assert abs(sum(r["copies"] * r["size"] for r in own) - want[s]) <= max(r["size"] for r in own) + 1e-6
    return got


def test_given_documents(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet")
    a = check(df)
    b = mixed_copies(df.repartition(7)).collect()
    assert sorted((r["doc_id"], r["copies"]) for r in a) == sorted((r["doc_id"], r["copies"]) for r in b)


def test_sources_at_the_ceiling(spark):
    rows = [(i, "w " * (i % 17), ["a", "b", "c", "d", None][min(4, i // 10)]) for i in range(700)]
    check(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    check(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(1, 100), share=1.9)


def test_chance_is_fair(spark):
    rows = [(i, "w " * (1 + i % 3), "a" if i % 2 else "b") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    total = {}
    for seed in range(12):
        for r in mixed_copies(df, seed=seed, share=0.5, weights=(1,)).collect():
            total.setdefault(r["size"], []).append(r["copies"])
    assert all(abs(sum(x) / len(x) - 0.5) < 0.06 for x in total.values())


def test_odd_rows(spark):
    rows = [(1, None, None), (1, "", "a"), (None, "x y", "a"), (None, "x y", "a"), (3, "x", "é"), (4, "q " * 30_000, "a"), (5, "x y z", ""), (5, "x y z", "")]
    df = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "doc_id long, text string, source string, copies int, target double")
    check(df)
    assert mixed_copies(df.limit(0)).collect() == [] and mixed(df.limit(0)).collect() == []
    assert mixed(df).columns == df.columns
    words = lambda x: x.agg(F.sum(F.size(F.split("text", " ")))).first()[0]
    assert words(mixed(df)) > words(df)


def test_copies_of_a_row_spread_over_groups(spark, monkeypatch):
    largest, write = [], mixing.materialize

    def watched(df, label):
        out = write(df, label)
        if label == "met":
            largest.append(out.agg(F.max(F.expr("size(s.done)"))).first()[0])
        return out

    monkeypatch.setattr(mixing, "materialize", watched)
    rows = [(7, "one and the same text", "a")] * 6000 + [(i, "w " * (1 + i % 9), "a") for i in range(100, 3000)]
    check(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(1,), share=0.7)
    assert len(largest) >= 2 and max(largest) < 4 * mixing.FAN_IN
