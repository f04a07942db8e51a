"""Checks that return one row per broken rule, so an empty frame means "all hold"."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unique(df: DataFrame, keys: list[str]) -> Column:
    """Aggregate: number of rows beyond one per key."""
    return F.count("*") - F.count_distinct(F.struct(*keys))


def no_nulls(columns: list[str]) -> Column:
    """Aggregate: rows with a NULL in any of the columns."""
    return F.count_if(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns]))


def rows_are(expected: int) -> Column:
    """Aggregate: distance of the row count from the expected one."""
    return F.abs(F.count("*") - F.lit(expected))


def sum_is(column: str, expected: int) -> Column:
    """Aggregate: distance of a sum from the expected one."""
    return F.abs(F.coalesce(F.sum(column), F.lit(0)) - F.lit(expected))


def none_where(condition: str) -> Column:
    """Aggregate: rows for which the condition holds."""
    return F.count_if(F.expr(condition))


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Evaluate aggregate rules in one pass; rows (rule, offending) where offending > 0."""
    one = df.agg(*[rule.cast("bigint").alias(name) for name, rule in rules.items()])
    return one.unpivot([], list(rules), "rule", "offending").filter("offending > 0")


def require(found: DataFrame) -> None:
    """Raise when a violation frame is not empty; shows at most ten of its rows."""
    rows = found.limit(10).collect()
    if rows:
        raise ValueError("; ".join(str(r.asDict()) for r in rows))
