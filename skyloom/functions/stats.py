"""Exactly mergeable summaries: count, min, max, sum, sum of squares.

A summary lives in five flat columns ``<name>_count .. <name>_sum_squares`` while
it is being aggregated (all plain declarative aggregates, so Spark combines them
before every shuffle) and is folded into a struct only for output.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

FIELDS = ("count", "min", "max", "sum", "sum_squares")


def summarize(name: str, value: Column) -> list[Column]:
    """First-level aggregates over values; NULL and NaN are left out."""
    v = F.when(~F.isnan(value), value)
    return [
        F.count(v).alias(f"{name}_count"),
        F.min(v).alias(f"{name}_min"),
        F.max(v).alias(f"{name}_max"),
        F.coalesce(F.sum(v), F.lit(0.0)).alias(f"{name}_sum"),
        F.coalesce(F.sum(v * v), F.lit(0.0)).alias(f"{name}_sum_squares"),
    ]


def merge(name: str) -> list[Column]:
    """Aggregates that merge summaries of the same name."""
    return [
        F.sum(f"{name}_count").alias(f"{name}_count"),
        F.min(f"{name}_min").alias(f"{name}_min"),
        F.max(f"{name}_max").alias(f"{name}_max"),
        F.sum(f"{name}_sum").alias(f"{name}_sum"),
        F.sum(f"{name}_sum_squares").alias(f"{name}_sum_squares"),
    ]


def as_struct(name: str) -> Column:
    return F.struct(*[F.col(f"{name}_{f}").alias(f) for f in FIELDS])


def as_map(names: Iterable[str]) -> Column:
    """map(name -> summary), the shape of a window record."""
    return F.create_map(*[part for n in names for part in (F.lit(n), as_struct(n))])


def mean(name: str) -> Column:
    """NULL for an empty summary."""
    return F.try_divide(F.col(f"{name}_sum"), F.col(f"{name}_count"))


def population_std(name: str) -> Column:
    m = mean(name)
    variance = F.try_divide(F.col(f"{name}_sum_squares"), F.col(f"{name}_count")) - m * m
    return F.when(m.isNotNull(), F.sqrt(F.greatest(variance, F.lit(0.0))))
