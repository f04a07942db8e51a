import math
import re
from collections import Counter

import numpy as np
import pytest

from skyloom.llm import lexical
from skyloom.llm.lexical import ranked

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return Counter(TERM.findall((text or "").translate(LOWER)))


def brute(docs, items, k=10):
    docs = [(d, terms(t)) for d, t in docs]
    sizes = [sum(c.values()) for _, c in docs]
    n, total = sum(x > 0 for x in sizes), sum(sizes)
    df = Counter(t for _, c in docs for t in c)
    w = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) for t, x in df.items()}
    out = []
    for item, text in items:
        asked, best = terms(text), []
        for (d, c), size in zip(docs, sizes):
            score = sum(q * w[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * (25 + 75 * size * n // total))) for t, q in asked.items() if t in c)
            if score > 0:
                best.append((-score, d is None, d or 0, d))
        out += [(item, i + 1, b[3], -b[0]) for i, b in enumerate(sorted(best)[:k])]
    return sorted(out, key=repr)


def check(spark, docs, items, k=10):
    d = spark.createDataFrame([(i, t, 1, "x", 0.5) for i, t in docs], "doc_id long, text string, row int, term string, tf double")
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, weight int")
    got = ranked(d, q, k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(docs, items, k)


DOCS = [(1, "Apple apple pie"), (2, "apple-PIE_pie"), (3, None), (4, ""), (5, " \x00\x7f .,"), (6, "Äpfel äpfel 1a2b"), (7, "apple pie"), (7, "apple pie"), (None, "apple pie"), (None, "apple pie"),
        (9, "pie " * 50_000 + "rare"), (10, "x" * 300_000 + " apple"), (-3, "zebra"), (11, "İstanbul K 日本語 日本語"), (12, "all of them")]
ITEMS = [(0, "apple PIE"), (1, "pie pie pie rare"), (1, "zebra"), (None, "äpfel"), (2, None), (3, "..."), (4, "unknown words"), (5, "日本語 istanbul İstanbul k K"), (6, "X" * 300_000), (7, "apple " * 5000)]


def test_odd_rows(spark):
    for k in (1, 3, 10):
        check(spark, DOCS, ITEMS, k)


def test_no_documents_or_queries(spark):
    check(spark, [], ITEMS)
    check(spark, DOCS, [])
    check(spark, [(1, None), (2, "")], ITEMS)
    check(spark, [(1, "a")], [(1, "a")])  # every document has it: its weight is 0.28, so 287


@pytest.mark.parametrize("segment, block", [(200_000, 256), (500, 3)])
def test_random_texts(spark, monkeypatch, segment, block):
    monkeypatch.setattr(lexical, "SEGMENT_POSTINGS", segment)
    monkeypatch.setattr(lexical, "BLOCK_QUERIES", block)
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(rng.choice(words, n, p=np.arange(60, 0, -1) / 1830))
    docs = [(int(rng.integers(0, 1500)), text(int(rng.integers(0, 40)))) for _ in range(1200)] + [(5000 + i, "w1 w2 w3 w40 w59") for i in range(300)]
    check(spark, docs, [(i, text(int(rng.integers(1, 12)))) for i in range(20)])


def test_strata_beyond_the_bound_are_not_visited():
    import pyarrow as pa

    n = 3000
    tf = np.where(np.arange(n) < 12, 50, 1)
    index = lexical.Segment(pa.table({"row": np.arange(n), "id": np.arange(n), "m": 25 + np.arange(n) // 30, "tid": np.zeros(n, np.int64), "tf": tf}))
    seen = []
    original = lexical._ranges
    lexical._ranges = lambda b, s, v: (seen.append(int(s.sum())), original(b, s, v))[1]
    try:
        places, _ = index.best(np.array([0]), np.array([7]), 10)
    finally:
        lexical._ranges = original
    assert places.tolist() == list(range(10)) and sum(seen[1:]) <= 30
