import pyarrow as pa
import pytest

from skyloom.llm import substring_dedup as module
from skyloom.llm.substring_dedup import substring_dedup


def brute(rows, window=13):
    first, words = {}, []
    for doc, text, *_ in rows:
        w = (text or "").encode().split()
        words.append(w)
        if doc is not None:
            for i in range(len(w) - window + 1):
                k = tuple(w[i:i + window])
                first[k] = min(first.get(k, doc), doc)
    out = []
    for (doc, *_), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - window + 1):
            if doc is not None and first[tuple(w[i:i + window])] < doc:
                gone.update(range(i, i + window))
        out.append((doc, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(out, key=repr)


def check(df, window=13):
    got = [tuple(r) for r in substring_dedup(df, window).collect()]
    assert sorted(got, key=repr) == brute([(r["doc_id"], r["text"]) for r in df.collect()], window)
    return got


def test_given_documents(spark, sf_dir):
    got = check(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    assert any(r[2] for r in got)


@pytest.mark.parametrize("window", [2, 3, 13])
def test_odd_rows(spark, window):
    p = " ".join(f"w{i}" for i in range(20))
    q = " ".join(f"v{i}" for i in range(16))
    rows = [(1, p), (2, "x " + p + "\ty"), (3, p + " " + p), (3, p), (4, None), (5, ""), (6, " \n\t"), (None, p), (None, None),
            (-7, q), (8, q + " " + q), (9, "a " * 3000 + p), (9, "a " * 3000 + p), (10, "x" * 200_000 + " " + q),
            (2**62, "w19 " + p + " w0 w1")]
    df = spark.createDataFrame([(a, b, "block", "7") for a, b in rows], "doc_id long, text string, block string, _row string")
    check(df, window)


def test_empty(spark):
    assert substring_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_common_passage_is_one_entry_of_its_bucket_per_piece(spark):
    passage = " ".join(f"p{i}" for i in range(50))
    docs = pa.record_batch({"doc_id": pa.array(range(8000)), "text": pa.array([f"a{i} {passage} b{i}" for i in range(8000)])})
    parts = [(k, module._unpack(p)) for x in module._windows(13, 8, 40)([docs]) for k, p in zip(x.column("bucket").to_pylist(), x.column("packed").to_pylist())]
    pieces = sum(1 for _ in module.pieces(docs.column("text")))
    assert sum(len(h) for k, (h, _) in parts if k >= 0) <= pieces * 38 + 2 * 8000 + 38
    shards = {k: len(h) for k, (h, _) in parts if k < 0}
    assert len(shards) == 40 and max(shards.values()) < 3 * 38 * 8000 / 40


def test_a_common_passage_and_many_rows_without_an_id(spark, monkeypatch):
    monkeypatch.setattr(module, "BLOCK_BYTES", 4096)
    monkeypatch.setattr(module, "BUCKET_BYTES", 64)
    passage = " ".join(f"p{i}" for i in range(20))
    rows = [(None if i % 3 == 0 else i - 50, f"a{i % 7} {passage} {'b ' * (i % 40)}") for i in range(600)]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
