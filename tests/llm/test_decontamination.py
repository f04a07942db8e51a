import random
import re
from itertools import combinations

from skyloom.llm import decontamination as d


def words(text):
    return [w for w in re.split(r"[^\w]|_", (text or "").lower()) if w]


def brute(docs, items):
    out = {}
    for i, t in items:
        h = words(t)
        for doc, text in docs:
            if doc is None or i is None or text is None:
                continue
            w = words(text)
            for at in range(-len(h) + 1, len(w)):
                same = [h[j] == w[j + at] if 0 <= j + at < len(w) else None for j in range(len(h))]
                seeded = any(all(same[j + k] for k, x in enumerate(m) if x == "1") for m in d.MASKS for j in range(len(h) - len(m) + 1)
                             if all(same[j + k] is not None for k in range(m.rindex("1") + 1)))
                if not seeded:
                    continue
                inside = [x for x in same if x is not None]
                best = max((sum(inside[s:s + d.WINDOW]) for s in range(len(inside) - d.WINDOW + 1)), default=0)
                if best >= d.LEAST:
                    key = (doc, i)
                    if key not in out or (best, -at) > (out[key][0], -out[key][1]):
                        out[key] = (best, at)
    return sorted((*k, *v) for k, v in out.items())


def test_given_documents(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    got = sorted(tuple(r) for r in d.contaminated(docs, items).collect())
    held = {(r["doc_id"], i["item_id"]) for r in docs.collect() for i in items.collect() if " ".join(words(i["text"])) in " ".join(words(r["text"]))}
    assert held and held <= {(a, b) for a, b, *_ in got}
    some = {a for a, *_ in got} | {0, 1, 2, 3}
    few = docs.filter(docs["doc_id"].isin(*some))
    assert got == brute([(r["doc_id"], r["text"]) for r in few.collect()], [(r["item_id"], r["text"]) for r in items.collect()])


def test_substitutions_and_odd_rows(spark, monkeypatch):
    rng = random.Random(2)
    items = [(i, " ".join(f"t{i}x{k}" for k in range(n))) for i, n in enumerate((5, 12, 13, 14, 20, 40, 60))] + [(90, None), (91, ""), (None, "a b c"), (4, "again " * 20)]
    docs = [(None, items[4][1]), (50, None), (51, ""), (52, "again " * 15), (52, items[5][1]), (53, items[3][1].upper().replace(" ", ", ")), (54, "w " * 50_000 + items[6][1])]
    for n in range(60):
        w = items[rng.randrange(2, 7)][1].split()
        for _ in range(rng.randrange(6)):
            w[rng.randrange(len(w))] = "sub"
        cut = rng.randrange(len(w))
        docs.append((n, " ".join(["pre"] * rng.randrange(3) + w[cut if rng.random() < 0.3 else 0:] + ["post"])))
    make = lambda rows, key: spark.createDataFrame([(*r, 1, 2) for r in rows], f"{key} long, text string, at int, seed int")
    want = brute([x for x in docs if x[0] != 54], items)
    got = sorted(tuple(r) for r in d.contaminated(make(docs, "doc_id"), make(items, "item_id")).collect())
    assert [g for g in got if g[0] != 54] == want and [g[1] for g in got if g[0] == 54] == [6]
    monkeypatch.setattr(d, "BROADCAST_SEEDS", 0)
    assert sorted(tuple(r) for r in d.contaminated(make(docs, "doc_id"), make(items, "item_id")).collect()) == got
    assert d.contaminated(make(docs, "doc_id").limit(0), make(items, "item_id")).collect() == []
    assert d.contaminated(make(docs, "doc_id"), make(items, "item_id").limit(0)).collect() == []


def every_alignment(docs, items):
    """As brute(), but without seeds."""
    out = {}
    for i, t in items:
        h = words(t)
        for doc, text in docs:
            w = words(text)
            for at in range(d.WINDOW - len(h), len(w) - d.WINDOW + 1):
                same = [h[j] == w[j + at] for j in range(max(0, -at), min(len(h), len(w) - at))]
                best = max((sum(same[s:s + d.WINDOW]) for s in range(len(same) - d.WINDOW + 1)), default=0)
                if best >= d.LEAST and ((doc, i) not in out or (best, -at) > (out[doc, i][0], -out[doc, i][1])):
                    out[doc, i] = (best, at)
    return sorted((*k, *v) for k, v in out.items())


def test_masks_fit_all_replacements():
    placed = [{s + k for k, x in enumerate(m) if x == "1"} for m in d.MASKS for s in range(d.WINDOW - len(m) + 1)]
    for n in range(d.WINDOW - d.LEAST + 1):
        assert all(any(not p & set(gone) for p in placed) for gone in combinations(range(d.WINDOW), n))


def test_all_passages_are_found(spark):
    rng = random.Random(5)
    items = [(i, " ".join(f"t{i}x{k}" for k in range(n))) for i, n in enumerate((13, 15, 20, 25, 60))]
    docs = [(n, " ".join("sub" if k in gone else f"t0x{k}" for k in range(13))) for n, gone in enumerate(combinations(range(13), 3))]
    for n in range(1000, 1200):
        w = items[rng.randrange(5)][1].split()
        share = rng.choice((0.1, 0.15, 0.2, 0.25))
        docs.append((n, " ".join(["pre"] * rng.randrange(3) + ["sub" if rng.random() < share else x for x in w] + ["post"])))
    docs += [(2000 + i, " ".join("sub" if k % 4 == 3 else x for k, x in enumerate(t.split()))) for i, t in items]
    want = every_alignment(docs, items)
    assert {x[0] for x in want} >= set(range(286))
    got = d.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(tuple(r) for r in got.collect()) == want
