"""Removal of lines that repeat in windows of three consecutive lines."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import text_rows

SEED = 7


def line_dedup(docs: DataFrame, window: int = 3) -> DataFrame:
    """Per row of ``docs``: doc_id, n_lines, n_removed, text of the lines that stay.

    Lines are cut at \\\\n and compared exactly, but for two 64-bit hashes of each window of ``window``
    consecutive lines. Of equal windows the one with the smallest (doc_id, line) is first; every line that some later one
    covers goes, within a document as well. Windows are judged on the input. A text of fewer lines has
    no window and stays; so does a row without a doc_id, which has no place in the order. A null text has no line, and
    null as text; a text that loses all lines is empty. Rows with equal doc_id count as one place: their
    equal windows don't remove each other. An empty table gives an empty result.
    """
    if window < 1:
        raise ValueError("window must be 1 or more")
    # the hash of the text tells rows with one doc_id apart
    rows = text_rows(docs).withColumns({"lines": F.split("text", "\n"), "whole": F.xxhash64("text")})

    def hashed(i):
        lines = [F.get("lines", i + k) for k in range(window)]
        return F.struct(i.alias("line"), F.xxhash64(*lines).alias("a"), F.xxhash64(F.lit(SEED), *reversed(lines)).alias("b"))

    starts = F.when(F.size("lines") >= window, F.sequence(F.lit(0), F.size("lines") - window)).otherwise(F.array().cast("array<int>"))
    windows = rows.filter("doc_id IS NOT NULL").select("doc_id", "whole", F.explode(F.transform(starts, hashed)).alias("w")).select("doc_id", "whole", "w.*")
    firsts = (
        windows.groupBy("a", "b").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "line")).alias("first"))
        .filter("n > 1").select("a", "b", F.col("first.doc_id").alias("first_doc"), F.col("first.line").alias("first_line")))
    later = windows.join(firsts, ["a", "b"]).filter("doc_id > first_doc OR line > first_line").select("doc_id", "whole", "line")
    # one entry per repeated window of a document: bounded by its lines
    starts = later.groupBy("doc_id", "whole").agg(F.collect_set("line").alias("starts"))
    return rows.drop("lines").join(starts, ["doc_id", "whole"], "left").mapInArrow(
        _without(window), "doc_id long, n_lines long, n_removed long, text string")


def _without(window: int):
    def rows(batches):
        for batch in batches:
            out = []
            for text, starts in zip(batch.column("text").to_pylist(), batch.column("starts").to_pylist()):
                lines = [] if text is None else text.split("\n")
                gone = {s + i for s in starts or () for i in range(window)}  # covered positions, merged
                out.append((len(lines), len(gone), "\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else text))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()),
                pa.array([x[2] for x in out], pa.string())], names=["doc_id", "n_lines", "n_removed", "text"])

    return rows
