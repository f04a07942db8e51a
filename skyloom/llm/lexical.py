"""Ranked search for texts by their terms, with an index that is stratified by length.

A document's length counts only through the whole number m. So the index puts documents of equal m into one stratum, and the postings
of a term in a stratum are kept by tf: what a posting adds is the same for all with one tf, and is computed once. The largest tf of a
term in a stratum bounds what it can add there; the sum over a query's terms bounds every score of the stratum. Strata are
visited from the highest bound down, and a query is done once it has its k documents and no bound left reaches the last of them.

The index comes in segments of documents, so a stratum that holds most documents is cut as well. Queries travel as files of
blocks that every segment's task reads one after the other.
"""

from __future__ import annotations

import posixpath
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyloom.llm.common import col, open_file, text_rows
from skyloom.plans.tables import materialize, new_path

SEGMENT_POSTINGS = 200_000
BLOCK_QUERIES = 256
LONG_SHARE, LONG_ALL = 75, 100
FLUSH = 100_000
# every byte that is not of a term becomes a space, A to Z small letters; bytes from 0x80 belong to terms
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

_POSTINGS = "row long, id long, n long, term string, tf long"
_FOUND = "query long, row long, id long, score long"


def _strings(parts: list[bytes]) -> pa.Array:
    made = pa.array(parts, pa.binary())
    return pa.Array.from_buffers(pa.string(), len(made), made.buffers())


def _term_counts(with_totals: bool):
    """Rows (row, id, n, term, tf); for ``with_totals`` also one per text that has terms, with n and a "term" that starts with a space."""
    totals = [b" %d" % i for i in range(997)]  # many, so that no partition of a join gets all of them

    def rows(batches):
        out, terms = ([], [], [], []), []

        def flush():
            columns = [pa.array(x, pa.int64()) for x in out]
            batch = pa.record_batch([*columns[:3], _strings(terms), columns[3]], names=["row", "id", "n", "term", "tf"])
            for x in (*out, terms):
                x.clear()
            return batch

        for batch in batches:
            for row, doc, text in zip(batch.column("row").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                counts = Counter((text or b"").translate(TERM_BYTES).split())
                if not counts:
                    continue
                n, size = sum(counts.values()), len(counts) + with_totals
                out[0].extend([row] * size)
                out[1].extend([doc] * size)
                out[2].extend([n] * size)
                out[3].extend(counts.values())
                terms.extend(counts)
                if with_totals:
                    out[3].append(0)
                    terms.append(totals[row % len(totals)])
                if len(terms) >= FLUSH:
                    yield flush()
        if terms:
            yield flush()

    return rows


def _numbered(df: DataFrame) -> DataFrame:
    return df.withColumn("row", F.monotonically_increasing_id())


class Segment:
    """The postings of some documents, by term, stratum and tf."""

    def __init__(self, postings: pa.Table):
        row, m, tid, tf = (postings.column(c).to_numpy() for c in ("row", "m", "tid", "tf"))
        rows, first, doc = np.unique(row, return_index=True, return_inverse=True)
        ids = postings.column("id").take(pa.array(first))
        missing, value = ids.is_null().to_numpy(), ids.fill_null(0).to_numpy()
        # a document's place is its place among equal scores: by id, without one last
        by_id = np.lexsort((rows, value, missing))
        place = np.empty(len(rows), np.int64)
        place[by_id] = np.arange(len(rows))
        self.rows, self.ids, doc = rows[by_id], ids.take(pa.array(by_id)), place[doc]
        self.m, stratum = np.unique(m, return_inverse=True)
        self.terms, term = np.unique(tid, return_inverse=True)
        order = np.lexsort((tf, stratum, term))
        self.doc, term, stratum, tf = doc[order], term[order], stratum[order], tf[order]
        # impacts once per (term, stratum, tf)
        new_list = np.r_[True, (term[1:] != term[:-1]) | (stratum[1:] != stratum[:-1])]
        new_run = new_list | np.r_[True, tf[1:] != tf[:-1]]
        runs = np.flatnonzero(new_run)
        each = tf[runs]
        impact = 1_000_000_000 * each // (1000 * each + 8 * self.m[stratum[runs]])
        self.impact = np.repeat(impact, np.diff(np.r_[runs, len(tf)]))
        # a list holds the postings of a term in a stratum; its last has the largest tf, so the largest impact
        self.begin = np.flatnonzero(new_list)
        self.size = np.diff(np.r_[self.begin, len(tf)])
        self.stratum, self.most = stratum[self.begin], self.impact[self.begin + self.size - 1]
        self.lists = np.searchsorted(term[self.begin], np.arange(len(self.terms) + 1))

    def best(self, tids: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of the k best documents with a score above 0, best first."""
        at = np.minimum(np.searchsorted(self.terms, tids), len(self.terms) - 1)
        here = self.terms[at] == tids
        at, weights = at[here], weights[here]
        of, weight = _ranges(self.lists[at], self.lists[at + 1] - self.lists[at], weights)
        bound = np.zeros(len(self.m), np.int64)
        np.add.at(bound, self.stratum[of], weight * self.most[of])
        visits = np.argsort(-bound, kind="stable")
        visits = visits[bound[visits] > 0]
        places, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        done, step = 0, 1
        while done < len(visits):
            last = scores[-1] if len(scores) == k else 1
            now = visits[done:done + step]
            now = now[bound[now] >= last]
            if not len(now):
                break
            chosen = np.isin(self.stratum[of], now)
            lists = of[chosen]
            postings, w = _ranges(self.begin[lists], self.size[lists], weight[chosen])
            found, which = np.unique(self.doc[postings], return_inverse=True)
            total = np.zeros(len(found), np.int64)
            np.add.at(total, which, w * self.impact[postings])
            found, total = np.r_[places, found[total > 0]], np.r_[scores, total[total > 0]]
            top = np.lexsort((found, -total))[:k]
            places, scores = found[top], total[top]
            done, step = done + step, step * 2
        return places, scores


def _ranges(begin: np.ndarray, size: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers begin .. begin + size - 1 of all entries, one entry after the other, and each entry's value beside them."""
    before = np.cumsum(size) - size
    return np.arange(size.sum()) + np.repeat(begin - before, size), np.repeat(value, size)


def _write_block(folder: str):
    def write(table):
        files, base = fs.FileSystem.from_uri(folder)
        files.create_dir(base, recursive=True)
        name = f"queries-{uuid.uuid4().hex}.arrow"
        table = table.select(["query", "tid", "weight"]).sort_by("query")
        with files.open_output_stream(posixpath.join(base, name)) as out, pa.ipc.new_file(out, table.schema) as file:
            file.write_table(table)
        return pa.table({"path": [f"{folder}/{name}"]})

    return write


def _search(blocks: list[str], k: int):
    def segment(postings):
        index, out = Segment(postings.combine_chunks()), []
        for path in blocks:
            asked = pa.ipc.open_file(open_file(path)).read_all()
            query, tid, weight = (asked.column(c).to_numpy() for c in ("query", "tid", "weight"))
            cuts = np.r_[np.flatnonzero(np.r_[True, query[1:] != query[:-1]]), len(query)].tolist()
            for a, b in zip(cuts, cuts[1:]):
                places, scores = index.best(tid[a:b], weight[a:b], k)
                if len(places):
                    out.append((np.full(len(places), query[a]), places, scores))
        query, places, scores = (np.concatenate(x) if out else np.zeros(0, np.int64) for x in (zip(*out) if out else ((), (), ())))
        return pa.table({"query": query, "row": index.rows[places], "id": index.ids.take(pa.array(places)), "score": scores})

    return segment


def ranked(docs: DataFrame, queries: DataFrame, k: int = 10, query_key: str = "item_id", query_text: str = "text") -> DataFrame:
    """The k documents of highest score for every row of ``queries``: query_key, rank (from 1), doc_id, score.

    Terms are runs of ASCII letters and digits and of all characters beyond ASCII, A to Z lower-cased; null texts have none. Statistics are
    over all documents; a document is a row of ``docs``, so equal rows are ranked each by itself, and one without an id after all
    others of its score. Equal scores stand by doc_id. A query row is a query of its own, also where keys repeat or are null; one
    without a term, or whose terms no document has, gives no row. No documents, no result. Extra columns play no part.

    Every document's term counts are taken once; postings are kept for the terms that queries have. A segment of postings has about
    ``SEGMENT_POSTINGS`` of them: all those of one document are together.
    """
    asks = materialize(_numbered(queries.select(col(query_key).alias("key"), col(query_text).cast("string").alias("text"))), "queries")
    asked = materialize(asks.select("row", F.lit(None).cast("long").alias("doc_id"), "text").mapInArrow(_term_counts(False), _POSTINGS).select("row", "term", F.col("tf").alias("times")), "query-terms")
    vocabulary = materialize(asked.select("term").distinct().withColumn("tid", F.monotonically_increasing_id()), "vocabulary")

    counted = _numbered(text_rows(docs)).mapInArrow(_term_counts(True), _POSTINGS)
    postings = materialize(
        counted.join(vocabulary, "term", "left").filter(F.col("tid").isNotNull() | F.col("term").startswith(" ")).select("row", "id", "n", "tid", "tf"), "postings")
    n_docs, n_terms, n_postings = postings.agg(F.count_if(F.col("tid").isNull()), F.sum(F.when(F.col("tid").isNull(), F.col("n"))), F.count("tid")).first()
    postings = postings.filter("tid IS NOT NULL")
    df = postings.groupBy("tid").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.ln(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1).cast("double"))).cast("long")
    terms = asked.join(vocabulary, "term").join(df, "tid").select(F.col("row").alias("query"), "tid", (F.col("times") * weight).alias("weight"))
    folder = new_path(docs.sparkSession, "lexical")
    n_blocks = asks.count() // BLOCK_QUERIES + 1
    # a path per block of queries
    blocks = [r[0] for r in terms.filter("weight > 0").withColumn("block", F.pmod(F.xxhash64("query"), F.lit(n_blocks))).groupBy("block").applyInArrow(_write_block(folder), "path string").collect()]

    m = (F.lit(LONG_ALL - LONG_SHARE) + F.expr(f"({LONG_SHARE}L * n * {n_docs}L) DIV {n_terms or 1}L")).alias("m")
    segments = n_postings // SEGMENT_POSTINGS + 1
    found = (
        postings.select("row", "id", m, "tid", "tf", F.pmod(F.xxhash64("row"), F.lit(segments)).alias("segment"))
        .groupBy("segment").applyInArrow(_search(blocks, k), _FOUND))
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "row"))
    best = found.withColumn("rank", rank).filter(F.col("rank") <= k)
    return best.join(asks.select(F.col("row").alias("query"), "key"), "query").select(F.col("key").alias(query_key), "rank", F.col("id").alias("doc_id"), "score")
