"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model's symbols are UTF-8 bytes, so that it has no unknown words; its counts are those of all n-grams of every
trusted document of one half. Count tables and weights are DataFrames. For scoring, each block of
documents asks for the n-grams it holds, once each; the requests meet shards of the model, more of them the larger it is and
the more blocks ask, and the answers go back to the block. What is gathered grows with the corpus, a task's share doesn't.
"""

from __future__ import annotations

import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import text_bytes, text_rows
from skyloom.llm.words import pieces
from skyloom.plans.tables import materialize

ORDER = 5
BLOCK_BYTES = 16 << 20
BLOCKS_PER_TASK = 4  # a shard answers so many blocks' worth of requests
TYPES_PER_SHARD = 500_000
WORDS = 1 << 17  # of 64 bits, in the filter before the join with trusted ids
PIECE_BYTES = 1 << 20  # of texts at once: a piece takes some 50 bytes of memory per byte
CELLS = 16 << 20
START = 2  # stands before a text, order - 1 times
_TAG = 56  # an n-gram's key holds its bytes, and its length above


class Grams:
    """All n-grams of some texts: ``codes`` of the distinct ones, ``ids`` of each position, and the text ``doc`` of it."""

    def __init__(self, texts, order: int):
        raw = [(START.to_bytes() * (order - 1)) + t for t in texts]
        data = np.frombuffer(b"".join(raw), np.uint8)
        size = np.array([len(t) for t in raw], np.int64)
        present = np.bincount(data, minlength=256) > 0
        symbol, many = (np.cumsum(present) - 1).astype(np.int32), int(present.sum())
        last = symbol[data]
        ids, codes = last, np.flatnonzero(present).astype(np.uint64)
        letters = codes
        for n in range(1, order):
            key = ids[:-1].astype(np.int64) * many + last[n:]
            if len(codes) * many <= CELLS:
                seen = np.zeros(len(codes) * many, bool)
                seen[key] = True
                kinds = np.flatnonzero(seen)
                place = np.zeros(len(seen), np.int32)
                place[kinds] = np.arange(len(kinds), dtype=np.int32)
                ids = place[key]
            else:  # text of many different n-grams: by sorting, which takes no more than the text does
                kinds, ids = np.unique(key, return_inverse=True)
                ids = ids.astype(np.int32)
            codes = codes[kinds // many] << np.uint64(8) | letters[kinds % many]
        begin = np.cumsum(size) - size
        length = size - (order - 1)
        at = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length) + np.repeat(begin, length)
        self.ids, self.codes, self.length = ids[at], codes, length
        self.doc = np.repeat(np.arange(len(size)), length)


def _key(codes: np.ndarray, n: int) -> np.ndarray:
    """Keys of the last n bytes of the codes."""
    return codes & np.uint64((1 << 8 * n) - 1) | np.uint64(n << _TAG)


def _texts(column, a: int, b: int) -> list[bytes]:
    return [(t or "").encode() for t in column.slice(a, b - a).to_pylist()]


def _counts(order: int):
    def rows(batches):
        for batch in batches:
            column = batch.column("text")
            for a, b in pieces(column, PIECE_BYTES):
                grams = Grams(_texts(column, a, b), order)
                count = np.bincount(grams.ids, minlength=len(grams.codes))
                held = np.flatnonzero(count)
                yield pa.RecordBatch.from_arrays([
                    pa.array(_key(grams.codes[held], order).view(np.int64)), pa.array(count[held])], names=["key", "n"])

    return rows


def _discounts(counts: DataFrame) -> list[float]:
    """Discounts of counts 1, 2, and more, from the numbers of n-grams that occur 1 to 4 times."""
    n = counts.agg(*[F.count_if(F.col("n") == i) for i in (1, 2, 3, 4)]).first()
    if not n[0] or not n[1]:
        return [0.5, 1.0, 1.5]
    y = n[0] / (n[0] + 2 * n[1])
    return [min(max(i - (i + 1) * y * n[i] / n[i - 1] if n[i - 1] else i / 2, 0.05 * i), 0.95 * i) for i in (1, 2, 3)]


def _discount(d: list[float]) -> Column:
    return F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])


def _tagged(code: Column, n: int) -> Column:
    return code.bitwiseOR(F.lit(n << _TAG))


def kneser_ney(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """(key, alpha, gamma) of every n-gram of the rows of ``text``, of 1 to ``order`` bytes.

    alpha: its own discounted share after its context. gamma: the share its continuations leave to the next shorter
    context. Counts below the highest order are numbers of different bytes before the n-gram.
    """
    counts = materialize(texts.mapInArrow(_counts(order), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "grams")
    parts = []
    for n in range(order, 0, -1):
        code = F.col("key").bitwiseAND(F.lit((1 << 8 * n) - 1))
        lost = _discount(_discounts(counts))
        after = counts.withColumn("context", _tagged(F.shiftright(code, 8), n - 1))
        contexts = after.groupBy("context").agg(F.sum("n").alias("total"), F.sum(lost).alias("lost"))
        parts.append(after.join(contexts, "context").select("key", ((F.col("n") - lost) / F.col("total")).alias("alpha"), F.lit(None).cast("double").alias("gamma")))
        parts.append(contexts.select(F.col("context").alias("key"), F.lit(None).cast("double").alias("alpha"), (F.col("lost") / F.col("total")).alias("gamma")))
        if n > 1:
            shorter = _tagged(F.col("key").bitwiseAND(F.lit((1 << 8 * (n - 1)) - 1)), n - 1)
            counts = materialize(counts.groupBy(shorter.alias("key")).agg(F.count("*").alias("n")), "grams")
    merged = reduce(DataFrame.unionByName, parts).groupBy("key").agg(F.max("alpha").alias("alpha"), F.max("gamma").alias("gamma"))
    return merged.select("key", F.coalesce("alpha", F.lit(0.0)).alias("alpha"), F.coalesce("gamma", F.lit(1.0)).alias("gamma"))


def _squeezed(keys: np.ndarray) -> bytes:
    """Sorted keys, by their differences."""
    return zlib.compress(np.diff(keys, prepend=np.uint64(0)).tobytes(), 1)


def _loosened(packed: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(packed), np.uint64), dtype=np.uint64)


def _requests(order: int, shards: int):
    def rows(key, docs):
        column, keys = docs.column("text").combine_chunks(), np.zeros(0, np.uint64)
        for a, b in pieces(column, PIECE_BYTES):
            codes = Grams(_texts(column, a, b), order).codes
            own = [_key(codes, n) for n in range(1, order + 1)]
            contexts = [_key(codes >> np.uint64(8), n) for n in range(order)]
            keys = np.unique(np.concatenate([keys, *own, *contexts]))
        shard, block = (keys % np.uint64(shards)).astype(int), key[0].as_py()
        parts = [(s, _squeezed(keys[shard == s])) for s in range(shards)]
        return pa.table({
            "shard": pa.array([s for s, _ in parts], pa.int32()), "block": pa.array([block] * len(parts), pa.int32()),
            "keys": pa.array([k for _, k in parts], pa.binary())})

    return rows


def _answers(key, asked, model):
    own = np.asarray(model.column("key")).view(np.uint64)
    order = np.argsort(own)
    own, weights = own[order], [np.asarray(model.column(c))[order] for c in ("alpha", "gamma")]
    out = []
    for packed in asked.column("keys").to_pylist():
        keys = _loosened(packed)
        place = np.minimum(np.searchsorted(own, keys), max(0, len(own) - 1))
        known = own[place] == keys if len(own) else np.zeros(len(keys), bool)
        out.append((_squeezed(keys[known]), *(w[place[known]].astype(np.float32).tobytes() if len(own) else b"" for w in weights)))
    return pa.table({"block": asked.column("block"), **{
        c: pa.array([x[i] for x in out], pa.binary()) for i, c in enumerate(("keys", "alpha", "gamma"))}})


def _likelihood(codes: np.ndarray, order: int, keys: np.ndarray, alpha: np.ndarray, gamma: np.ndarray) -> np.ndarray:
    """Logarithm of the interpolated probability of the last byte of each code after the others."""
    def weight(wanted: np.ndarray, of: np.ndarray, missing: float) -> np.ndarray:
        if not len(keys):
            return np.full(len(wanted), missing)
        place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[place] == wanted, of[place], missing)

    p = np.full(len(codes), 1 / 256)
    for n in range(1, order + 1):
        p = weight(_key(codes, n), alpha, 0.0) + weight(_key(codes >> np.uint64(8), n - 1), gamma, 1.0) * p
    return np.log(p)


def _scores(order: int, more: list[str]):
    def rows(key, docs, model):
        keys = np.concatenate([np.zeros(0, np.uint64), *map(_loosened, model.column("keys").to_pylist())])
        alpha, gamma = (np.frombuffer(b"".join(model.column(c).to_pylist()), np.float32) for c in ("alpha", "gamma"))
        by = np.argsort(keys)
        keys, alpha, gamma = keys[by], alpha[by].astype(np.float64), gamma[by].astype(np.float64)
        column, out = docs.column("text").combine_chunks(), []
        for a, b in pieces(column, PIECE_BYTES):
            grams = Grams(_texts(column, a, b), order)
            value = _likelihood(grams.codes, order, keys, alpha, gamma)[grams.ids]
            total = np.bincount(grams.doc, value, len(grams.length))
            out += [(float(np.exp(-t / n)) if n else None, int(n)) for t, n in zip(total, grams.length)]
        return pa.table({
            **{c: docs.column(c) for c in more}, "doc_id": docs.column("doc_id"), "lang": docs.column("lang"), "n_bytes": pa.array([x[1] for x in out], pa.int64()),
            "perplexity": pa.array([x[0] for x in out], pa.float64())})

    return rows


def perplexities(docs: DataFrame, model: DataFrame, order: int = ORDER, row: str | None = None) -> DataFrame:
    """(doc_id, lang, n_bytes, perplexity) of every row, after its number if ``row`` names one; no perplexity for a text without a byte."""
    more = [row] if row else []
    blocks = text_bytes(docs) // BLOCK_BYTES + 1
    shards = model.count() // TYPES_PER_SHARD + blocks // BLOCKS_PER_TASK + 1
    # without a row number the text tells rows apart whose ids are null or repeat
    block = F.pmod(F.xxhash64(row) if row else F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")
    by_block = docs.select(*more, "doc_id", "lang", "text", block.alias("block")).groupBy("block")
    asked = by_block.applyInArrow(_requests(order, shards), "shard int, block int, keys binary")
    offered = model.withColumn("shard", F.pmod("key", F.lit(shards)).cast("int"))
    answers = asked.groupBy("shard").cogroup(offered.groupBy("shard")).applyInArrow(
        _answers, "block int, keys binary, alpha binary, gamma binary")
    return by_block.cogroup(answers.groupBy("block")).applyInArrow(
        _scores(order, more), "".join(f"{c} long, " for c in more) + "doc_id long, lang string, n_bytes long, perplexity double")


def quality_scores(
    docs: DataFrame, labels: DataFrame, quantile: float = 0.995, margin: float = 1.05, prior: int = 200, order: int = ORDER,
    row: str | None = None,
) -> DataFrame:
    """Per row of ``docs``: doc_id, lang, n_bytes, perplexity, score, threshold, keep.

    Trusted rows are those with quality 1 in ``labels`` (doc_id, quality, toxic) and without a row there that is toxic; a hash of the id puts half of them aside. The
    model learns from all others. The score is the
    perplexity of the text along with ``prior`` bytes of its language's mean, since a few bytes prove little. A language's
    threshold is ``margin`` times the ``quantile`` of the scores of its documents set aside, so it is not fitted
    to text the model has seen; a language without any, null too, takes mean and threshold of all of them. keep: the score is at most the
    threshold. A text without a byte has no perplexity and isn't kept; without any trusted document set aside every
    other one is. Rows that share a doc_id are judged one by one; ``row`` names a column of unique numbers, if the caller
    has one, which comes first in the result. An empty table gives an empty result.
    """
    more = [row] if row else []
    rows = text_rows(docs, "lang", *more)
    spread = F.xxhash64("doc_id")
    known = labels.select(F.col("doc_id").cast("long"), "quality", "toxic").filter("doc_id IS NOT NULL").groupBy("doc_id")
    judged_good, judged_toxic = (F.coalesce(F.bool_or(F.col(c) == 1), F.lit(False)) for c in ("quality", "toxic"))
    trusted = materialize(known.agg((judged_good & ~judged_toxic).alias("trusted")).filter("trusted").select("doc_id"), "trusted")
    learned = trusted.filter(F.pmod(spread, F.lit(2)) == 0)
    model = materialize(kneser_ney(_perhaps(rows, learned).join(learned, "doc_id", "left_semi").select("text"), order), "model")
    scored = materialize(perplexities(rows, model, order, row), "perplexities")
    aside = materialize(
        scored.join(trusted.filter(F.pmod(spread, F.lit(2)) == 1), "doc_id", "left_semi").filter("perplexity IS NOT NULL"), "aside")
    bits = F.col("n_bytes") * F.log("perplexity")
    means = _by_language(aside, F.sum(bits) / F.sum("n_bytes"), "mean")
    score = F.exp((bits + F.col("mean") * prior) / (F.col("n_bytes") + prior))

    def judged(rows: DataFrame) -> DataFrame:
        return _with(rows, means, "mean").withColumn("score", F.when(F.col("mean").isNull(), F.col("perplexity")).otherwise(score))

    cuts = materialize(_by_language(judged(aside), F.percentile_approx("score", quantile, 100_000) * margin, "threshold"), "cuts")
    out = _with(judged(scored), cuts, "threshold").withColumn("threshold", F.coalesce("threshold", F.lit(float("inf"))))
    return out.select(*more, "doc_id", "lang", "n_bytes", "perplexity", "score", "threshold", F.coalesce(F.expr("score <= threshold"), F.lit(False)).alias("keep"))


def _perhaps(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose doc_id is one of ``ids``, and some others: a bitmap of bounded size, so that a join needs not shuffle all texts."""
    place = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(WORDS * 64))
    word, bit = F.shiftright(place, 6), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int"))
    empty = ids.sparkSession.range(WORDS).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
    words = ids.select(word.alias("word"), bit.alias("bits")).unionByName(empty).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    bitmap = words.agg(F.transform(F.sort_array(F.collect_list(F.struct("word", "bits"))), lambda w: w["bits"])).scalar()
    return rows.filter(F.get(bitmap, word.cast("int")).bitwiseAND(bit) != 0)


def _by_language(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """A row per language, and one for all with ``every``."""
    return rows.groupBy("lang").agg(value.alias(name)).withColumn("every", F.lit(False)).unionByName(
        rows.agg(value.alias(name)).select(F.lit(None).cast("string").alias("lang"), name, F.lit(True).alias("every")))


def _with(rows: DataFrame, values: DataFrame, name: str) -> DataFrame:
    """Rows with the value of their language, or else that of all."""
    own = values.filter("NOT every").select(F.col("lang").alias("_lang"), F.col(name).alias("_own"))
    every = values.filter("every").select(F.col(name).alias("_every"))
    # a lookup of one row per language, and a single row
    joined = rows.join(own, F.col("lang").eqNullSafe(F.col("_lang")), "left").join(F.broadcast(every))
    return joined.withColumn(name, F.coalesce("_own", "_every")).drop("_lang", "_own", "_every")
