import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from skyloom.llm import quality
from skyloom.llm.quality import kneser_ney, perplexities, quality_scores


class Plain:
    """Interpolated modified Kneser-Ney, written down directly."""

    def __init__(self, texts, order):
        self.order, self.levels = order, {}
        counts = Counter()
        for t in texts:
            t = bytes([quality.START]) * (order - 1) + t.encode()
            counts.update(t[i:i + order] for i in range(len(t) - order + 1))
        for n in range(order, 0, -1):
            many = Counter(counts.values())
            d = [0.5, 1.0, 1.5]
            if many[1] and many[2]:
                y = many[1] / (many[1] + 2 * many[2])
                d = [min(max(i - (i + 1) * y * many[i + 1] / many[i] if many[i] else i / 2, 0.05 * i), 0.95 * i) for i in (1, 2, 3)]
            follow = defaultdict(dict)
            for g, c in counts.items():
                follow[g[:-1]][g[-1:]] = c
            self.levels[n] = (follow, d)
            counts = Counter(g[1:] for g in counts)

    def p(self, gram):
        p = 1 / 256
        for n in range(1, self.order + 1):
            follow, d = self.levels[n]
            seen = follow.get(gram[self.order - n:-1])
            if seen:
                total = sum(seen.values())
                lost = sum(d[min(c, 3) - 1] for c in seen.values())
                c = seen.get(gram[-1:], 0)
                p = (c - d[min(c, 3) - 1] if c else 0) / total + lost / total * p
        return p

    def perplexity(self, text):
        t = bytes([quality.START]) * (self.order - 1) + text.encode()
        grams = [t[i:i + self.order] for i in range(len(t) - self.order + 1)]
        return math.exp(-sum(math.log(self.p(g)) for g in grams) / len(grams)) if grams else None


@pytest.mark.parametrize("order", [1, 2, 5])
def test_perplexity_against_the_formula(spark, monkeypatch, order):
    # several blocks, shards, and repeats of the model
    monkeypatch.setattr(quality, "BLOCK_BYTES", 200)
    monkeypatch.setattr(quality, "BLOCKS_PER_TASK", 3)
    monkeypatch.setattr(quality, "TYPES_PER_SHARD", 300)
    trusted = ["the cat sat on the mat", "the dog sat on a log", "a cat and a dog é", "", "mat " * 30]
    texts = [*trusted, "unseen ÿ words \x02", "the cat", "x", "ZZZ!!" * 40, None, "long text " * 3000]
    model = kneser_ney(spark.createDataFrame([(t,) for t in trusted], "text string"), order)
    plain = Plain(trusted, order)
    docs = spark.createDataFrame([(i, "en", t) for i, t in enumerate(texts)], "doc_id long, lang string, text string")
    for r in perplexities(docs, model, order).collect():
        want = plain.perplexity(texts[r["doc_id"]] or "")
        assert r["perplexity"] == (None if want is None else pytest.approx(want, rel=1e-5))
    assert sum(plain.p(b"\x02" * (order - 1) + bytes([c])) for c in range(256)) == pytest.approx(1)


def test_given_labels(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.1")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = quality_scores(docs, labels).join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("keep").cast("int")).alias("kept"))
    kept = {r["quality"]: r["kept"] for r in got.collect()}
    assert kept[1] > 0.99 and kept[0] < 0.15


def test_every_trusted_document_of_one_half_is_learned(spark, monkeypatch):
    # more trusted documents than the 50 000 that the model was once cut to
    n, texts = 110_000, []
    docs = spark.range(n + 500).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"))
    labels = spark.range(n).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    monkeypatch.setattr(quality, "kneser_ney", lambda rows, order: texts.append(rows) or kneser_ney(rows, order))
    quality_scores(docs, labels, order=2)
    learned = docs.filter(F.col("doc_id") < n).filter(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0).select("text")
    assert learned.count() > 50_000 and texts[0].exceptAll(learned).isEmpty() and learned.exceptAll(texts[0]).isEmpty()


def test_filter_before_the_join_loses_no_id(spark, monkeypatch):
    monkeypatch.setattr(quality, "WORDS", 8)
    rows = spark.createDataFrame([(None, "a"), *[(i, "b") for i in range(-300, 300)], (7, "again")], "doc_id long, text string")
    ids = spark.createDataFrame([(i,) for i in range(-20, 20)], "doc_id long")
    passed = quality._perhaps(rows, ids)
    assert rows.join(ids, "doc_id", "left_semi").exceptAll(passed).isEmpty() and 41 <= passed.count() < 300
    assert quality._perhaps(rows, ids.limit(0)).isEmpty()


def test_odd_rows(spark):
    prose = "the quick brown fox jumps over the lazy dog and the cat "
    docs = [(i, "en", prose * (1 + i % 5)) for i in range(60)] + [(90, None, prose), (91, "xx", prose), (92, "en", None), (93, None, ""), (None, "en", prose),
            (94, "en", "#@!*&^%$" * 50), (95, "en", prose * 3000), (95, "en", prose * 3000)]
    make = lambda rows: spark.createDataFrame([(*r, 1.0, True) for r in rows], "doc_id long, lang string, text string, score double, keep boolean")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(94, 0, 0), (None, 1, 0), (3, None, 1), (999, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality_scores(make(docs), labels).collect()
    assert sorted((repr(r["doc_id"]), r["lang"] or "") for r in got) == sorted((repr(d), x or "") for d, x, _ in docs)
    assert {r["doc_id"] for r in got if not r["keep"]} == {92, 93, 94}
    assert all(r["perplexity"] is None for r in got if r["doc_id"] in (92, 93))
    none = {r["doc_id"]: r["keep"] for r in quality_scores(make(docs), labels.limit(0)).collect()}
    assert none[94] and not none[92] and quality_scores(make([]), labels).collect() == []


def test_toxic_text_is_not_trusted(spark):
    prose = "the quick brown fox jumps over the lazy dog and the cat "
    insult = "you worthless moron, what a pathetic idiot "
    docs = spark.createDataFrame([(i, "en", prose * (1 + i % 5)) for i in range(60)] + [(i, "en", insult * 20) for i in range(60, 100)], "doc_id long, lang string, text string")
    schema = "doc_id long, quality int, toxic int"
    clean = [(i, 1, None if i % 2 else 0) for i in range(60)]
    toxic = [(i, 1, 1) for i in range(60, 90)] + [(i, q, t) for i in range(90, 100) for q, t in ((1, 0), (0, 1))]
    rows = lambda labels: sorted(tuple(r) for r in quality_scores(docs, spark.createDataFrame(labels, schema)).collect())
    assert [r[0] for r in rows(clean + toxic) if not r[-1]] == list(range(60, 100))


def test_given_toxic_labels(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.1")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    aside = labels.filter("quality = 1").filter(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1)
    got = quality_scores(docs, labels).join(aside, "doc_id").groupBy("toxic").agg(
        F.avg(F.col("keep").cast("int")).alias("kept"), F.expr("percentile(score, array(0.5, 0.9))").alias("scores"))
    by = {r["toxic"]: r for r in got.collect()}
    assert by[0]["kept"] > 0.99 and by[1]["kept"] < 0.99 and by[1]["scores"][0] > by[0]["scores"][1]


def test_memory_of_a_piece_does_not_depend_on_its_text():
    import random
    import tracemalloc

    rnd = random.Random(4)
    texts = {
        "letters": "".join(rnd.choices("etaoin shrdlu", k=1 << 20)), "latin": "".join(chr(rnd.randrange(32, 256)) for _ in range(700_000)),
        "base64": "".join(rnd.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=1 << 20)),
        "han": "".join(chr(rnd.randrange(0x4E00, 0x9FFF)) for _ in range(350_000))}
    for name, text in texts.items():
        raw = text.encode()
        tracemalloc.start()
        grams = quality.Grams([raw], 5)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 220 * (1 << 20), (name, peak)
        padded = bytes([quality.START]) * 4 + raw
        for i in (0, 1, 5000, len(raw) - 1):
            assert int(grams.codes[grams.ids[i]]).to_bytes(5) == padded[i:i + 5]


def test_pieces_by_sorting_give_the_same(spark, monkeypatch):
    texts = [b"some text", b"", b"other text, some more", bytes(range(256))]
    want = quality.Grams(texts, 5)
    monkeypatch.setattr(quality, "CELLS", 0)
    got = quality.Grams(texts, 5)
    assert (got.codes == want.codes).all() and (got.ids == want.ids).all() and (got.doc == want.doc).all()
