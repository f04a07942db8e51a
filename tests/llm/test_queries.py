import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from skyloom.llm.queries import ORACLE, QUERIES

NO_SQL = {"op3_html_text", "op4_token_file", "op5_personal_data", "op6_quality_classifier", "op8_source_mixing", "op9_nearest_neighbours"}


def test_registered():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(QUERIES) - set(ORACLE) == NO_SQL
    assert {*QUERIES, "pipeline"} <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())
    assert len(corpus_pipeline.STAGES) == 5 and "pipeline" not in entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    want = con.execute(ORACLE[name])
    columns = [d[0] for d in want.description]
    got = QUERIES[name](spark, sf_dir).select(*columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


@pytest.mark.parametrize("name", sorted(NO_SQL))
def test_digests(spark, sf_dir, name):
    columns = {
        "op3_html_text": "page_id url text n_chars", "op4_token_file": "doc_id start n_tokens ids_crc32",
        "op5_personal_data": "doc_id n_email n_ip n_card n_phone base_sha256 spans", "op6_quality_classifier": "doc_id keep",
        "op8_source_mixing": "doc_id size source_size target taken", "op9_nearest_neighbours": "query_id rank vec_id score"}[name].split()
    df = QUERIES[name](spark, sf_dir)
    assert set(columns) <= set(df.columns) and df.count() > 0
