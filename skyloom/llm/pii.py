"""Personal data by patterns, and by contexts learned from what the patterns found.

The four base kinds are regular expressions with a check. Each match is a seed. The words next to seeds, with the outline of the
seed, form lexical patterns; the words that stand in the same surroundings are instances. Spark scores the graph of patterns and
instances in rounds: a pattern is as good as the instances it finds, an instance as good as its patterns. Instances of good patterns that
no expression matched are added as spans of their kind.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import text_rows
from skyloom.plans.tables import materialize

# The base expressions.
KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# a match never begins inside a run of digits; saying so keeps long runs linear
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile("[0-9]")
MARK = re.compile("[0-9@]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGE = "\"'`()[]{}<>,;:!?=*#|"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(DIGITS.findall(text))


def _emails(text: str):
    """As EMAIL.finditer, but a search starts at each @ only: a match begins with the run of name characters before it."""
    at, done = text.find("@"), 0
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _NAME:
            begin -= 1
        found = EMAIL.match(text, begin) if begin < at else None
        if found:
            yield found.span()
            done = found.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(at + 1, done))


_NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds: leftmost non-overlapping matches of each, less those that fail their check."""
    out = [(a, 0, b) for a, b in _emails(text)]
    if DIGITS.search(text):
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.group().split("."))]
        out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 12 <= len(d := _digits(m.group())) <= 19 and luhn(d)]
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return sorted(out)


def outline(word: str) -> str:
    """Classes of characters, repeats as one."""
    out = []
    for c in word:
        k = "9" if c in "0123456789" else "a" if c.isalpha() else c
        if not out or out[-1] != k:
            out.append(k)
    return "".join(out)[:24]


def _place(text: str, start: int, end: int) -> tuple[str, str]:
    """The words before and after a span, in lower case, without marks at their edges."""
    left = text[max(0, start - 64):start].split()
    right = text[end:end + 64].split()
    clean = lambda w: w.strip(EDGE + ".").lower()
    return clean(left[-1]) if left else "^", clean(right[0]) if right else "$"


def _marked(text: str):
    """Words with a digit or an @, without marks at their edges."""
    done = 0
    for m in MARK.finditer(text):
        if m.start() < done:
            continue
        begin, done = m.start(), WORD.match(text, m.start()).end()
        while begin and not text[begin - 1] in " \t\n\x0b\x0c\r":
            begin -= 1
        word = text[begin:done].lstrip(EDGE)
        begin, end = done - len(word), done - len(word) + len(word.rstrip(EDGE))
        if MARK.search(text, begin, end):
            yield begin, end


def _looked(batches):
    """Per text: base spans and, of them and of all other words with a digit or an @, the surroundings."""
    for batch in batches:
        spans, seen = [], []
        for text in batch.column("text").to_pylist():
            base = base_spans(text or "")
            spans.append(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in base))
            places = [(KINDS[k], a, b, outline(text[a:b]), text[a:b], *_place(text, a, b)) for a, k, b in base]
            starts, reach = [a for a, _, _ in base], list(accumulate((b for *_, b in base), max))
            for a, b in _marked(text or ""):
                before = bisect_left(starts, b)
                if not before or reach[before - 1] <= a:
                    places.append((None, a, b, outline(text[a:b]), text[a:b], *_place(text, a, b)))
            seen.append([dict(zip(("kind", "start", "end", "outline", "word", "before", "after"), p)) for p in places])
        yield pa.RecordBatch.from_arrays([
            batch.column("doc_id"), batch.column("row"), pa.array(spans, pa.string()), pa.array(seen, pa.list_(_SEEN))], names=["doc_id", "row", "base", "seen"])


_SEEN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("outline", pa.string()), ("word", pa.string()),
                   ("before", pa.string()), ("after", pa.string())])
_SCHEMA = ("doc_id long, row long, base string, seen array<struct<kind: string, start: long, `end`: long, outline: string, word: string, "
           "before: string, after: string>>")


def learned(places: DataFrame, rounds: int, support: int, confident: float) -> DataFrame:
    """(word, kind): identifiers that no expression matched, but good patterns find.

    ``places`` has (kind, word, outline, before, after); kind is null for words that are not seeds.
    """
    patterns = F.explode(F.array(
        F.concat_ws("\x1f", F.lit("b"), "before", "outline"), F.concat_ws("\x1f", F.lit("a"), "outline", "after"), F.concat_ws("\x1f", F.lit("c"), "before", "after")))
    graph = materialize(places.select("kind", "word", patterns.alias("pattern")).distinct(), "graph")
    kinds = graph.filter("kind IS NOT NULL").select("pattern", F.col("kind").alias("as_kind")).distinct()
    # one edge per pattern, word and kind the pattern has seeds of: what a word is worth as that kind
    edges = materialize(graph.join(kinds, "pattern").withColumn("seed", F.when(F.col("kind").isNull(), F.lit(None)).otherwise((F.col("kind") == F.col("as_kind")).cast("double")))
                        .groupBy("pattern", "as_kind", "word").agg(F.max("seed").alias("seed")), "edges")
    worth = edges.select("word", "as_kind", F.coalesce("seed", F.lit(0.0)).alias("worth")).groupBy("word", "as_kind").agg(F.max("worth").alias("worth"))
    for _ in range(rounds):
        known = materialize(worth.select("word", "as_kind", "worth"), "worth")
        scored = edges.join(known, ["word", "as_kind"]).groupBy("pattern", "as_kind").agg(
            F.avg("worth").alias("good"), F.count_if(F.col("seed") == 1).alias("seeds")).filter(F.col("seeds") >= support)
        back = edges.join(scored, ["pattern", "as_kind"]).groupBy("word", "as_kind").agg(
            F.max("seed").alias("seed"), (1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("good"), F.lit(1e-6)))))).alias("by_pattern"), F.max("good").alias("best"))
        worth = back.select("word", "as_kind", F.coalesce("seed", "by_pattern").alias("worth"), "seed", "best")
    return worth.filter(F.col("seed").isNull() & (F.col("best") >= confident) & (F.col("worth") >= confident)).groupBy("word").agg(
        F.max_by("as_kind", F.struct("worth", "as_kind")).alias("kind"))


def personal_data(docs: DataFrame, rounds: int = 3, support: int = 3, confident: float = 0.8) -> DataFrame:
    """Per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone (all spans), base (spans of the expressions), spans (all).

    Spans are kind:start:end in code points, end exclusive, by start, then kind as listed, joined by commas. Learned spans are words with a
    digit or an @, without marks at their edges, that overlap no base span. A pattern needs ``support`` different seeds of its kind and an
    average worth of its words of ``confident``. Null and empty texts have no span and empty strings. Repeated rows and rows
    without a doc_id are searched one by one. An empty table gives an empty result.
    """
    rows = text_rows(docs).withColumn("row", F.monotonically_increasing_id())
    looked = materialize(rows.mapInArrow(_looked, _SCHEMA), "looked")
    places = looked.select("row", F.explode("seen").alias("s")).select("row", "s.*")
    new = materialize(learned(places, rounds, support, confident), "learned")
    number = {k: i for i, k in enumerate(KINDS)}
    order = F.create_map(*[x for k, i in number.items() for x in (F.lit(k), F.lit(i))])
    name = F.array(*[F.lit(k) for k in KINDS])
    base = places.filter("kind IS NOT NULL").select("row", "kind", "start", "end")
    added = places.filter("kind IS NULL").drop("kind").join(new, "word").select("row", "kind", "start", "end")
    # the spans of one document
    spans = base.unionByName(added).groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("start", order[F.col("kind")].alias("k"), "end"))).alias("all"))

    def count(kind: int):
        return F.size(F.filter("all", lambda s: s["k"] == kind)).cast("long")

    counts = [count(i).alias(f"n_{k}") for k, i in number.items()]
    text = F.array_join(F.transform("all", lambda s: F.concat_ws(":", F.get(name, s["k"]), s["start"], s["end"])), ",")
    none = F.array().cast("array<struct<start: bigint, k: int, end: bigint>>")
    return looked.drop("seen").join(spans, "row", "left").withColumn("all", F.coalesce("all", none)).select("doc_id", *counts, "base", text.alias("spans"))
