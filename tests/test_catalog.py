"""Every registered query against its SQL form."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_module

from catalog.oracle import ORACLE
from catalog.registry import QUERIES

WITHOUT_SQL = {"kmeans_topology", "k_sweep"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        return None if isinstance(v, float) and math.isnan(v) else v

    return sorted(repr([cell(r[i]) for i in order]) for r in rows)


def test_every_query_has_sql_or_is_listed():
    assert set(QUERIES) - set(ORACLE) == WITHOUT_SQL
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"k_sweep", "k_sweep_checks"}))
def test_query(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    rows = df.collect()
    if name not in ORACLE:
        assert rows
        return
    rel = duck.execute(ORACLE[name])
    columns = [d[0] for d in rel.description]
    assert sorted(df.columns) == sorted(columns)
    assert canonical(df.columns, rows) == canonical(columns, rel.fetchall())


def test_entry(spark):
    assert set(QUERIES) <= set(entry_module.queries()) and set(ORACLE) <= set(entry_module.oracle_sql())
    assert entry_module.entry(spark).count() > 0
