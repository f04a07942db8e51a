"""From raw documents to token files: the stages of the training corpus.

Each stage takes (spark, docs, sf_dir) and works on all that the one before has kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from public_tokenizers import path

from skyloom.llm import queries
from skyloom.llm.common import numbered
from skyloom.llm.decontamination import contaminated
from skyloom.llm.mixing import mixed
from skyloom.llm.ngram_join import Likeness, similar_groups
from skyloom.llm.quality import quality_scores
from skyloom.llm.token_file import read_tokens, write_tokens
from skyloom.plans.tables import materialize

ORACLE_SQL = None  # the first stage has no SQL form


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier keeps, with or without an id."""
    rows = numbered(docs)
    scores = quality_scores(rows.select("_row", "_doc.doc_id", "_doc.text", "_doc.lang"), queries.table(spark, sf_dir, "labels"), row="_row")
    return rows.join(scores.filter("keep").select("_row"), "_row").select("_doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that with the smallest doc_id, one without an id only if none has any."""
    rows = numbered(docs)
    groups = similar_groups(rows.select(F.col("_row").alias("doc_id"), "_doc.text"), Likeness(num=4, den=5, shingle=5))
    members = groups.select(F.col("doc_id").alias("_row"), "component_id").join(rows.select("_row", F.col("_doc.doc_id").cast("long").alias("id")), "_row")
    first = members.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "_row")).alias("first"))
    return rows.join(first.select("first._row"), "_row").select("_doc.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no passage of the benchmark, with or without an id."""
    rows = numbered(docs)
    found = contaminated(rows.select(F.col("_row").alias("doc_id"), "_doc.text"), queries.table(spark, sf_dir, "benchmark"))
    return rows.join(found.select(F.col("doc_id").alias("_row")).distinct(), "_row", "left_anti").select("_doc.*")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks: never, once, or twice."""
    return mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all documents, and what they hold of each."""
    return read_tokens(write_tokens(docs, path("word_bpe_49k.json")))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = queries.QUERIES | {"pipeline": run}
ORACLE = queries.ORACLE | ({"pipeline": ORACLE_SQL} if ORACLE_SQL else {})
