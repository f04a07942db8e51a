"""Join of a big frame with a lookup that has one row per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup_join(facts: DataFrame, lookup: DataFrame, key: str, how: str = "left", unique: bool = False) -> DataFrame:
    """``facts`` joined with ``lookup`` on one key.

    Spark chooses by the lookup's bytes whether it travels to the facts, and splits a hot key at run time
    (adaptive skew join, on by default): both sides are shuffled for this join only. ``unique`` makes the job fail at a key that
    the lookup holds more than once, where it would multiply facts.
    """
    if how not in ("left", "inner", "left_semi", "left_anti"):
        raise ValueError(f"unsupported lookup join type {how!r}")
    return facts.join(one_per_key(lookup, key) if unique else lookup, key, how)


def one_per_key(lookup: DataFrame, key: str) -> DataFrame:
    """The lookup; the job fails at a key with several rows."""
    others = [c for c in lookup.columns if c != key]
    rows = lookup.groupBy(key).agg(F.count("*").alias("_n"), *[F.any_value(F.struct(*others)).alias("_row")] if others else [])
    ok = F.when(F.col("_n") == 1, True).otherwise(F.raise_error(
        F.concat(F.lit(f"more than one row for {key} "), F.coalesce(F.col(key).cast("string"), F.lit("NULL")))).cast("boolean"))
    return rows.filter(ok).select(key, *[F.col("_row")[c].alias(c) for c in others])
