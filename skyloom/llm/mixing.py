"""Mixing of sources to target weights by weighted pivotal sampling, in DataFrame expressions only.

A document of a source that needs 1.3 copies of its words has one copy and a fraction of 0.3. Two fractions meet:
words move from one to the other, by chance in one or the other direction, until one of them is 0 or 1. Words are
conserved, and so are expectations. Every source has its own tree: at each level, groups of about ``FAN_IN`` fractions leave
one, and the last one is rounded by chance. So the words taken differ from the target by less than one document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyloom.llm.common import col, numbered
from skyloom.plans.numbering import number_rows
from skyloom.plans.tables import materialize

FAN_IN = 32
WORD = "[^\\x20\\x09-\\x0D]+"

# State: the open fraction, and the rows that are decided. x: words that can move to the open one, y: from it.
_MEET = """aggregate(
  slice(items, 2, size(items)),
  named_struct('open', items[0], 'done', array_repeat(cast(named_struct('row', 0L, 'extra', 0) AS struct<row: bigint, extra: int>), 0)),
  (s, b) -> {step})"""
_PARTS = """named_struct('a', s.open, 'b', b,
  'x', least((1 - s.open.p) * s.open.w, b.p * b.w), 'y', least(s.open.p * s.open.w, (1 - b.p) * b.w),
  'u', shiftrightunsigned(xxhash64({seed}L, s.open.key, b.key), 11) / 9007199254740992D)"""
_MOVED = """named_struct(
  'pa', CASE WHEN {up} THEN CASE WHEN (1 - v.a.p) * v.a.w <= v.b.p * v.b.w THEN 1D ELSE v.a.p + v.x / v.a.w END
             ELSE CASE WHEN v.a.p * v.a.w <= (1 - v.b.p) * v.b.w THEN 0D ELSE v.a.p - v.y / v.a.w END END,
  'pb', CASE WHEN {up} THEN CASE WHEN v.b.p * v.b.w <= (1 - v.a.p) * v.a.w THEN 0D ELSE v.b.p - v.x / v.b.w END
             ELSE CASE WHEN (1 - v.b.p) * v.b.w <= v.a.p * v.a.w THEN 1D ELSE v.b.p + v.y / v.b.w END END)"""


def _let(name: str, value: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def _step(seed: int) -> str:
    up = "v.u * (v.x + v.y) < v.y"
    # one of the two is decided and leaves; if both are, the second stays open as a whole number and leaves next
    one = "abs(q.pa - round(q.pa)) < 1e-12"
    body = f"""named_struct(
      'open', named_struct('key', IF({one}, v.b.key, v.a.key), 'row', IF({one}, v.b.row, v.a.row),
                           'w', IF({one}, v.b.w, v.a.w), 'p', IF({one}, q.pb, q.pa)),
      'done', concat(s.done, array(named_struct('row', IF({one}, v.a.row, v.b.row), 'extra', cast(round(IF({one}, q.pa, q.pb)) AS int)))))"""
    return _let("v", _PARTS.format(seed=seed), _let("q", _MOVED.format(up=up), body))


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, ceiling: float) -> DataFrame:
    """(source, source_size, n, target) from (source, source_size, n): a row per source.

    Sources by code point, null last, have the weights in turn. ``share`` times all words is dealt by weight; a source
    takes at most ``ceiling`` times its words, and the excess goes to the others by weight, until none is above.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(F.col("rank") - 1, F.lit(len(weights))).cast("int") + 1)
    by_need = W.orderBy("need", "rank")
    # in order of cap / weight, the sources that reach their cap come first; level: words per weight if those before do
    filled = (
        ranked.withColumn("weight", weight).withColumn("cap", ceiling * F.col("source_size")).withColumn("need", F.col("cap") / F.col("weight"))
        .withColumn("all", F.sum("source_size").over(W.partitionBy()) * share)
        .withColumn("before", F.coalesce(F.sum("cap").over(by_need.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(by_need.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("level", (F.col("all") - F.col("before")) / F.col("open")).withColumn("capped", F.col("need") <= F.col("level")))
    level = F.first(F.when(~F.col("capped"), F.col("level")), ignorenulls=True).over(by_need.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return filled.select("source", "source_size", "n", F.when(F.col("capped"), F.col("cap")).otherwise(level * F.col("weight")).alias("target"))


def _rounded(rows: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """(row, extra): each fraction ``p`` of a row with ``w`` words becomes 0 or 1."""
    count, done = sources.select(F.col("source").alias("_source"), "n"), []
    many = sources.agg(F.max("n")).first()[0] or 0
    level = 0
    while many > 1:
        joined = rows.join(count, F.col("source").eqNullSafe(F.col("_source")))
        group = F.pmod(F.xxhash64(F.lit(seed), F.lit(level), "key"), F.ceil(F.col("n") / FAN_IN))
        met = joined.groupBy("source", group.alias("group")).agg(F.sort_array(F.collect_list(F.struct("key", "row", "w", "p"))).alias("items"))
        met = materialize(met.select("source", F.expr(_MEET.format(step=_step(seed + level))).alias("s")), "met")
        done.append(met.select(F.explode("s.done").alias("d")).select("d.row", "d.extra"))
        whole = "abs(s.open.p - round(s.open.p)) < 1e-12"
        done.append(met.filter(whole).select("s.open.row", F.expr("cast(round(s.open.p) AS int)").alias("extra")))
        rows = met.filter(f"NOT {whole}").select("source", "s.open.key", "s.open.row", "s.open.w", "s.open.p")
        count = count.select("_source", F.ceil(F.col("n") / FAN_IN).alias("n"))
        many = -(-many // FAN_IN)
        level += 1
    chance = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit("last"), "key"), 11) / 2.0**53
    done.append(rows.select("row", (chance < F.col("p")).cast("int").alias("extra")))
    return reduce(DataFrame.unionByName, done)


def mixed_copies(
    docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, ceiling: float = 2.0, seed: int = 42,
    key: str = "doc_id", text: str = "text", source: str = "source", row: str | None = None,
) -> DataFrame:
    """Per row of ``docs``: row, doc_id, source, size (words), source_size, target (words of its source), copies.

    Words are ``[^\\x20\\x09-\\x0D]+``; a null or empty text has none and is copied as the others, which adds nothing. Null is a
    source of its own. Chance comes from hashes of id and text, so reruns agree; rows equal in both may change places. ``row`` names
    a column of unique numbers, if the caller has one. The table of sources has a row per source; targets
    are found in one task over it. No row has more than the ceiling, rounded up, of copies. An empty table gives an empty result.
    """
    number = col(row).cast("long") if row else F.monotonically_increasing_id()
    words = F.coalesce(F.regexp_count(col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    rows = materialize(docs.select(
        number.alias("row"), col(key).cast("long").alias("doc_id"), col(source).cast("string").alias("source"), words.alias("size"),
        F.xxhash64(col(key), col(text)).alias("key")), "sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    sources = materialize(targets(sizes, weights, share, ceiling), "sources")
    factor = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    each = rows.join(sources.withColumn("factor", factor).withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "n")
    each = each.withColumn("base", F.floor("factor").cast("int")).withColumn("p", F.col("factor") - F.col("base"))
    open_rows = each.filter("p > 0 AND size > 0").select("source", "key", "row", F.col("size").cast("double").alias("w"), "p")
    # copies of a row have keys of their own, so they spread over groups as other rows do
    copies = number_rows(open_rows, ["source", "key"], ["row"], "copy")
    open_rows = copies.withColumn("key", F.when(F.col("copy") == 1, F.col("key")).otherwise(F.xxhash64("key", "copy"))).drop("copy")
    extra = _rounded(open_rows, sources, seed)
    return each.join(extra, "row", "left").select(
        "row", "doc_id", "source", "size", "source_size", "target", (F.col("base") + F.coalesce("extra", F.lit(0))).alias("copies"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with each row as often as ``mixed_copies`` says, all columns kept."""
    packed = numbered(docs)
    flat = packed.select("_row", "_doc.doc_id", "_doc.text", "_doc.source")
    copies = mixed_copies(flat, row="_row", **options).select(F.col("row").alias("_row"), "copies").filter("copies > 0")
    return packed.join(copies, "_row").select("_doc", F.explode(F.sequence(F.lit(1), "copies"))).select("_doc.*")
