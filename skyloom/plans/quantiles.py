"""Exact quantiles per group, also when one group holds most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyloom.plans.tables import materialize

SKETCH_ACCURACY = 10_000


def exact_quantile(
    df: DataFrame, keys: list[str], value: str, q: float, name: str, accuracy: int = SKETCH_ACCURACY,
) -> DataFrame:
    """One row per group with the linearly interpolated quantile of non-null values.

    A mergeable sketch with a guaranteed rank error brackets the wanted ranks; only the
    few values inside the bracket are then counted and ranked. A group of at most ``accuracy`` values is its own bracket.
    """
    if not 0 <= q <= 1:
        raise ValueError("a quantile lies between 0 and 1")
    if not keys:
        return _bracketed(df, keys, value, q, name, accuracy)
    key = F.col(keys[0]) if len(keys) == 1 else F.struct(*keys)
    return _bracketed(df.withColumn("_key", key), keys, value, q, name, accuracy)


def _bracketed(rows: DataFrame, keys: list[str], value: str, q: float, name: str, accuracy: int) -> DataFrame:
    # The margin is three times the sketch's error, so beyond `accuracy` values it
    # spans three ranks or more on each side; smaller groups are kept whole.
    margin = 3.0 / accuracy
    ends = F.array(F.lit(max(q - margin, 0.0)), F.lit(min(q + margin, 1.0)))
    by = ["_key"] if keys else []
    sketched = rows.groupBy(*by).agg(
        F.count(value).alias("_n"), F.percentile_approx(value, ends, F.lit(accuracy)).alias("_ends")
    )
    big = F.col("_n") > accuracy
    bracket = materialize(sketched.select(
        *by, "_n",
        F.when(big, F.get("_ends", F.lit(0))).alias("_low"), F.when(big, F.get("_ends", F.lit(1))).alias("_high"),
    ), "brackets")
    rows = rows.filter(F.col(value).isNotNull())
    if keys:
        joined = rows.join(bracket.withColumnRenamed("_key", "_of"), F.col("_key").eqNullSafe(F.col("_of")))
    else:
        one = bracket.first()
        joined = rows.withColumns({c: F.lit(one[c]) for c in ("_n", "_low", "_high")})

    below = F.coalesce(F.col(value) < F.col("_low"), F.lit(False))
    above = F.coalesce(F.col(value) > F.col("_high"), F.lit(False))
    # all values below the bracket collapse into one counted row (NULL value);
    # copies of a value collapse too
    ranked = (
        joined.filter(~above)
        .groupBy(*keys, "_n", F.when(~below, F.col(value)).alias("_v"))
        .agg(F.count("*").alias("_c"))
    )
    w = W.partitionBy(*keys).orderBy(F.col("_v").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)
    cumulated = ranked.withColumn("_upto", F.sum("_c").over(w)).withColumn("_pos", (F.col("_n") - 1) * F.lit(q))
    picked = cumulated.groupBy(*keys).agg(
        F.min(F.when(F.col("_upto") > F.floor("_pos"), F.col("_v"))).alias("_a"),
        F.min(F.when(F.col("_upto") > F.ceil("_pos"), F.col("_v"))).alias("_b"),
        F.max("_pos").alias("_pos"),
    )
    fraction = F.col("_pos") - F.floor("_pos")
    picked = picked.select(*keys, (F.col("_a") + (F.col("_b") - F.col("_a")) * fraction).alias(name))
    if not keys:
        return picked
    # a group without a value has no rank, but a row
    single = len(keys) == 1
    picked = picked.select((F.col(keys[0]) if single else F.struct(*keys)).alias("_key"), name)
    groups = bracket.select(F.col("_key").alias("_of"))
    return groups.join(picked, F.col("_of").eqNullSafe(F.col("_key")), "left").select(
        *[(F.col("_of") if single else F.col("_of")[k]).alias(k) for k in keys], name)
