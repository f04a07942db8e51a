"""Helpers that several operators share."""

from __future__ import annotations

import pyarrow as pa
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyloom.plans.tables import materialize

ROW_BITS = 36  # of a row's place in its file


def col(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_rows(docs: DataFrame, *more: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the key (long), the text, and columns asked for; other columns can't clash with an operator's own."""
    return docs.select(col(key).cast("long").alias("doc_id"), col(text).cast("string").alias("text"), *[col(c).alias(c) for c in more])


def numbered(docs: DataFrame) -> DataFrame:
    """(_row, _doc): every row under a number of its own, the same for all readers, and its columns.

    A row of a Parquet table is numbered by its file and its place there; nothing is written but a row per file.
    The rows of any other frame are written once under their numbers.
    """
    packed = F.struct(*[col(c) for c in docs.columns]).alias("_doc")
    placed = _placed(docs, packed)
    if placed is None:
        return materialize(docs.select(F.monotonically_increasing_id().alias("_row"), packed), "numbered")
    # one row per file, so this unpartitioned window is small
    files = placed.select("_file").distinct().withColumn("_n", F.row_number().over(W.orderBy("_file")).cast("long"))
    number = F.shiftleft("_n", ROW_BITS).bitwiseOR(F.col("_at"))
    return placed.join(materialize(files, "files"), "_file").select(number.alias("_row"), "_doc")


def _placed(docs: DataFrame, packed: Column) -> DataFrame | None:
    """(_file, _at, _doc) of a plain Parquet scan. Above a scan, the place may name several rows (joins) or others at each run (limits)."""
    if not docs._jdf.queryExecution().analyzed().children().isEmpty() or "_metadata" in (c.lower() for c in docs.columns):
        return None
    try:
        return docs.select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"), packed)
    except AnalysisException:  # no files, or files without places
        return None


def text_bytes(docs: DataFrame) -> int:
    """Bytes of text of all rows; one sum, for the number of blocks."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def block_of(key: Column, blocks: int) -> Column:
    """The block of a long key; ``block_numbers`` gives the same for an array."""
    return F.coalesce(F.pmod(key.bitwiseXOR(F.shiftright(key, 7)).bitwiseXOR(F.shiftright(key, 19)), F.lit(blocks)), F.lit(0)).cast("int")


def block_numbers(keys, blocks: int):
    return (keys ^ (keys >> 7) ^ (keys >> 19)) % blocks


def open_file(path: str):
    """A file of the shared folder for pyarrow: mapped where it is mounted, else a stream that can seek."""
    files, at = fs.FileSystem.from_uri(path)
    return pa.memory_map(at) if isinstance(files, fs.LocalFileSystem) else files.open_input_file(at)
