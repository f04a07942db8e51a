"""The registered query of each operator, with its production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from public_tokenizers import path

from skyloom.llm.decontamination import contaminated
from skyloom.llm.html_text import html_text
from skyloom.llm.lexical import ranked
from skyloom.llm.line_dedup import line_dedup
from skyloom.llm.merkle import tamper_proofs
from skyloom.llm.mixing import mixed_copies
from skyloom.llm.nearest import nearest
from skyloom.llm.ngram_join import Likeness, similar_groups
from skyloom.llm.oracle import ORACLE  # noqa: F401
from skyloom.llm.pii import personal_data
from skyloom.llm.quality import quality_scores
from skyloom.llm.substring_dedup import substring_dedup
from skyloom.llm.token_file import read_tokens, write_tokens
from skyloom.llm.url_filter import url_verdicts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # texts are long: fewer rows per batch bound the memory of a Python worker
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query
def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(table(spark, sf_dir, "documents"), Likeness(85, 100, 4))


@query
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents"))


@query
def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text(table(spark, sf_dir, "pages"))


@query
def op4_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_tokens(write_tokens(table(spark, sf_dir, "documents"), path("word_bpe_49k.json")))


@query
def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


@query
def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixed_copies(table(spark, sf_dir, "documents"))
    return taken.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


@query
def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0")


@query
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return tamper_proofs(table(spark, sf_dir, "documents"), tampered, {"text": F.translate("text", "\n", "")})


@query
def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
    return url_verdicts(table(spark, sf_dir, "pages"), spark.createDataFrame(rules, "host string, path string, verdict string"))
