"""Finding benchmark passages in documents by spaced seeds, in DataFrame expressions only.

A seed is the hash of those tokens of a span that a mask does not ignore, so that a replaced word between them does not
hide a passage. Equal seeds of a benchmark item and a document give an alignment; along it the tokens are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import text_rows
from skyloom.plans.tables import materialize

# Spaced masks; 0 ignores a token. Whichever WINDOW - LEAST tokens of a window are replaced, one of the masks
# fits somewhere between them, so no passage is missed.
MASKS = ("11010111", "111001011", "1101000111", "1101111", "111100000011")
WINDOW = 13
LEAST = 10
BROADCAST_SEEDS = 200_000


def tokens(text: Column) -> Column:
    """Hashes of the runs of letters and digits of a text, in lower case."""
    words = F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda w: w != "")
    return F.transform(F.coalesce(words, F.array().cast("array<string>")), lambda w: F.xxhash64(w))


def _seeds(rows: DataFrame) -> DataFrame:
    """Every (at, seed) of the tokens ``h``, next to the other columns.

    One row per position is made inside the generator's code; the array is not copied to it.
    """
    span = min(len(m) for m in MASKS)
    last = F.size("h") - span
    placed = rows.withColumn("at", F.explode(F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))))

    def seed(number: int, mask: str) -> Column:
        used = [F.get("h", F.col("at") + i) for i, x in enumerate(mask) if x == "1"]
        return F.when(used[-1].isNotNull(), F.xxhash64(F.lit(number), *used))

    kept = [c for c in rows.columns if c != "h"]
    out = placed.select(*kept, "at", F.explode(F.array(*[seed(i, m) for i, m in enumerate(MASKS)])).alias("seed"))
    return out.filter("seed IS NOT NULL")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_equal, begins): items of ``benchmark`` (item_id, text) that documents hold a passage of.

    Tokens are runs of letters and digits, in lower case. A passage is a stretch of ``WINDOW`` aligned tokens around a common seed,
    at least ``LEAST`` of them equal; of its best stretch a row gives the number of equal tokens and where in the
    document its alignment with the item begins, the first of equals. A text of fewer tokens, an empty or a null one, has none, on
    either side; rows without an id are not looked at. Rows that share a doc_id give one row per item. Empty tables give an
    empty result.
    """
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).filter("item_id IS NOT NULL")
    items = materialize(items.select("item_id", tokens(F.col("text")).alias("h")).distinct(), "items")
    known = materialize(_seeds(items).select("seed", "item_id", F.col("at").alias("item_at")).distinct(), "seeds")
    if known.count() <= BROADCAST_SEEDS:  # beyond it the join is Spark's choice
        known = F.broadcast(known)
    rows = text_rows(docs).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    hits = _seeds(rows.select("doc_id", tokens(F.col("text")).alias("h"))).join(known, "seed")
    lines = materialize(hits.select("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("at")).distinct(), "hits")
    aligned = (
        rows.join(lines, "doc_id").withColumn("d", tokens(F.col("text"))).drop("text").join(items, "item_id")
        .withColumns({"begin": F.greatest(F.lit(0), -F.col("at")), "end": F.least(F.size("h"), F.size("d") - F.col("at"))})
        .filter(F.col("end") - F.col("begin") >= WINDOW)
        .withColumn("same", F.transform(F.sequence("begin", F.col("end") - 1), lambda j: (F.get("h", j) == F.get("d", j + F.col("at"))).cast("int"))))
    totals = F.transform(F.sequence(F.lit(1), F.size("same") - WINDOW + 1), lambda s: F.aggregate(
        F.slice("same", s, WINDOW), F.lit(0), lambda a, x: a + x))
    best = aligned.select("doc_id", "item_id", "at", F.array_max(totals).alias("n_equal")).filter(F.col("n_equal") >= LEAST)
    return best.groupBy("doc_id", "item_id").agg(F.max("n_equal").alias("n_equal"), F.min_by("at", F.struct(-F.col("n_equal"), "at")).alias("begins"))
