from collections import Counter

import corpus_pipeline
from skyloom.llm.common import numbered
from skyloom.llm.decontamination import contaminated
from skyloom.llm.mixing import mixed_copies
from skyloom.llm.ngram_join import Likeness
from skyloom.llm.quality import quality_scores
from tests.llm import test_ngram_join, test_token_file


def test_stages_one_by_one(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    steps, labels = dict(corpus_pipeline.STAGES), spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = lambda df: sorted(tuple(r) for r in df.collect())

    kept = steps["quality"](spark, docs, sf_dir)
    good = {r["doc_id"] for r in quality_scores(docs, labels).collect() if r["keep"]}
    assert kept.columns == docs.columns and rows(kept) == [r for r in rows(docs) if r[0] in good]

    single = steps["near_duplicates"](spark, kept, sf_dir)
    groups = test_ngram_join.brute([(r["doc_id"], r["text"]) for r in kept.collect()], Likeness())
    first = {d for d, _, c in groups if d == c}
    assert single.columns == docs.columns and rows(single) == [r for r in rows(kept) if r[0] in first]

    clean = steps["decontamination"](spark, single, sf_dir)
    bad = {r["doc_id"] for r in contaminated(single, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
    assert clean.columns == docs.columns and rows(clean) == [r for r in rows(single) if r[0] not in bad]

    mix = steps["mixing"](spark, clean, sf_dir)
    copies = {r["doc_id"]: r["copies"] for r in mixed_copies(clean).collect()}
    assert mix.columns == docs.columns and Counter(r[0] for r in rows(mix)) == Counter({d: n for d, n in copies.items() if n})

    out = sorted((tuple(r) for r in steps["tokens"](spark, mix, sf_dir).collect()), key=lambda r: r[1])
    assert out == test_token_file.expected([(r["doc_id"], r["text"]) for r in mix.collect()])
    assert out == sorted((tuple(r) for r in corpus_pipeline.run(spark, sf_dir).collect()), key=lambda r: r[1])


def test_keeps_clashing_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("*", "1 AS _id", "2 AS _row", "3 AS keep", "4 AS `a.b`", "5 AS copies", "6 AS row").limit(60)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns[-6:] == ["_id", "_row", "keep", "a.b", "copies", "row"] and docs.count()


def test_repeated_and_idless_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    steps, labels = dict(corpus_pipeline.STAGES), spark.read.parquet(f"{sf_dir}/labels.parquet")
    schema, all_rows = docs.schema, docs.collect()
    make = lambda rows, ids: spark.createDataFrame([(i, *tuple(r)[1:]) for r, i in zip(rows, ids)], schema)
    texts = lambda df: sorted(r["text"] for r in df.collect())

    kept = {r["doc_id"] for r in quality_scores(docs, labels).collect() if r["keep"]}
    good, bad = [r for r in all_rows if r["doc_id"] in kept][0], [r for r in all_rows if r["doc_id"] not in kept and r["text"]][0]
    more = make([good, good, bad, bad], [None, 10**9, 10**9, None])
    got = steps["quality"](spark, docs.union(more), sf_dir)
    assert sorted(repr(r["doc_id"]) for r in got.collect() if r["doc_id"] in (None, 10**9)) == ["1000000000", "None"]

    long = " ".join(f"w{k}" for k in range(60))
    other = " ".join(f"v{k}" for k in range(60))
    one = make([all_rows[0]] * 9, [7, 7, 7, 5, None, None, 8, 8, None])
    one = spark.createDataFrame([(*tuple(r)[:1], t, *tuple(r)[2:]) for r, t in zip(one.collect(), [long] * 5 + [other] + [other + " x"] + ["alone " + long[::-1]] * 2)], schema)
    got = steps["near_duplicates"](spark, one, sf_dir).collect()
    assert sorted(r["doc_id"] for r in got) == [5, 8, 8] and len({r["text"] for r in got}) == 3

    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").filter("length(text) > 100").first()["text"]
    rows = [(*tuple(all_rows[0])[:1], t, *tuple(all_rows[0])[2:]) for t in (item, item, long)]
    rows = spark.createDataFrame([(i, *r[1:]) for r, i in zip(rows, (None, 3, 3))], schema)
    assert texts(steps["decontamination"](spark, rows, sf_dir)) == [long]


def test_numbers_of_rows(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs.repartition(5).write.parquet(str(tmp_path / "parts"))
    parts = spark.read.parquet(str(tmp_path / "parts"))
    frames = [parts, docs, docs.limit(20), docs.filter("doc_id > 5"), docs.union(docs), docs.crossJoin(spark.range(2)), docs.limit(0), spark.createDataFrame([(1, "x")], "doc_id long, _metadata string")]
    for df in frames:
        rows = numbered(df)
        once, again = ({r["_row"]: repr(r["_doc"]) for r in x.collect()} for x in (rows, rows.repartition(3)))
        assert once == again and len(once) == rows.count() == df.count()
        assert rows.select("_doc.*").columns == df.columns
    assert sorted(map(repr, (r["_doc"] for r in numbered(parts).collect()))) == sorted(map(repr, docs.collect()))
