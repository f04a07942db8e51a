import random

import pytest

from skyloom.llm import ngram_join
from skyloom.llm.components import components
from skyloom.llm.ngram_join import Likeness, similar_groups

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
RULE = Likeness(85, 100, 4)


def brute(rows, like):
    sets = []
    for _, text in rows:
        w = (text or "").translate(LOWER).encode().split()
        k = like.shingle
        sets.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and like.den * both >= like.num * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    names = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            names[find(i)] = min(names.get(find(i), doc), doc)
    return sorted(((d, len(s), names.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr)


def check(df, like=RULE):
    got = sorted((tuple(r) for r in similar_groups(df, like).collect()), key=repr)
    assert got == brute([(r["doc_id"], r["text"]) for r in df.collect()], like)
    return got


def test_given_documents(spark, sf_dir):
    got = check(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    assert any(d != c for d, _, c in got)


def edited(words, n, rng):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.random()}"
    return words


@pytest.mark.parametrize("like", [RULE, Likeness(), Likeness(1, 2, 1), Likeness(1, 1, 2)])
def test_close_to_the_threshold(spark, monkeypatch, like):
    # small blocks: the groups of this test are cut into many
    monkeypatch.setattr(ngram_join, "SKETCH_BLOCK", 7)
    monkeypatch.setattr(ngram_join, "SET_BLOCK", 5)
    rng, rows = random.Random(7), []
    for size in (1, 2, 3, 4, 5, 6, 8, 9, 11, 15, 22, 40, 90, 300):
        base = [f"b{size}-{rng.randrange(50 if size % 2 else 10**6)}" for _ in range(size)]
        for i in range(22):
            words = edited(base, rng.choice([0, 0, 1, 1, 2, size // 30]), rng)
            rows.append((len(rows), " ".join(words[:rng.choice([size, size, max(1, size - 1), size * 9 // 10 + 1])])))
    check(spark.createDataFrame(rows, "doc_id long, text string"), like)


def test_odd_rows(spark):
    p = "One two  THREE four five six seven eight nine ten"
    rows = [(5, p), (3, p.lower()), (3, p.lower()), (None, p), (None, "alone"), (7, None), (8, ""), (9, " \t"), (10, "A b"), (11, "a\nB"),
            (12, "a"), (13, "x" * 300_000), (14, "word " * 50_000), (15, "word " * 60_000), (-1, "é É"), (2, "é é")]
    check(spark.createDataFrame([(a, b, 1, 2) for a, b in rows], "doc_id long, text string, node int, `group` int"))


def test_rows_without_an_id_link_others(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(words)), (None, " ".join(words[3:])), (2, " ".join(words[6:])), (None, " ".join(words[9:])), (None, " ".join(words[9:])), (3, " ".join(words[12:]))]
    got = check(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {c for *_, c in got} == {1}


def test_empty(spark):
    assert similar_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 3), (100, 100)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}}
