"""Columns that are computed once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with more columns, which no filter above computes a second time.

    The optimizer moves a filter below a projection by writing the projected expressions into it, once per mention, and a filter
    does not share them. It does not look into a generator, here one of a single row.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))
