"""Row numbers and previous-row comparison without a task that grows with a group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyloom.plans.tables import materialize


def number_rows(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """1-based row number within ``keys`` in ascending ``order``.

    The rows are range-partitioned by (keys, order), which cuts a hot group into
    many partitions, and a row's number is its place in its partition plus the rows
    its group has in earlier partitions. ``order`` should be total; rows equal
    in it are numbered in any order.
    """
    # The last sort column makes all keys differ, so copies of a row split too.
    ranged = (
        df.withColumn("_tie", F.monotonically_increasing_id())
        .repartitionByRange(*keys, *order, "_tie")
        .sortWithinPartitions(*keys, *order, "_tie")
        .drop("_tie")
        # partition number in the upper bits, place in the partition in the lower 33
        .withColumn("_place", F.monotonically_increasing_id())
    )
    # Both readers below must see one and the same partitioning, so it is written.
    ranged = materialize(ranged, "ranged").withColumn("_run", F.shiftright("_place", 33))
    runs = ranged.groupBy(*keys, "_run").agg(F.min("_place").alias("_first"), F.count("*").alias("_n"))
    earlier = W.partitionBy(*keys).orderBy("_run").rowsBetween(W.unboundedPreceding, -1)
    offsets = runs.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_run").alias("_k_run"),
        "_first",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
    )
    same = ranged["_run"] == F.col("_k_run")
    for k in keys:
        same = same & ranged[k].eqNullSafe(F.col(f"_k_{k}"))
    numbered = ranged.join(offsets, same).withColumn(
        name, F.col("_before") + F.col("_place") - F.col("_first") + 1
    )
    return numbered.select(*df.columns, name)


def against_previous(df: DataFrame, value: str, block: list[Column], row: Column) -> DataFrame:
    """Add ``previous_<value>``: the value of the row just before, over the whole frame.

    Rows are ordered by (block, row). A block is a piece of bounded size, such
    as one input split. The lag runs inside each block; the last value of every
    block (one row per block) is carried to the next block.
    """
    names = [f"_b{i}" for i in range(len(block))]
    keyed = df.withColumns({**dict(zip(names, block)), "_row": row})
    last = keyed.groupBy(*names).agg(F.max_by(value, "_row").alias("_last"))
    # one row per block, so this unpartitioned window is small
    carried = last.select(*names, F.lag("_last").over(W.orderBy(*names)).alias("_carried"))
    w = W.partitionBy(*names).orderBy("_row")
    lagged = keyed.withColumns({"_lag": F.lag(value).over(w), "_lag_row": F.lag("_row").over(w)})
    # a NULL row marks the first row of a block; a NULL value may just be missing
    previous = F.when(F.col("_lag_row").isNull(), F.col("_carried")).otherwise(F.col("_lag"))
    same = reduce(Column.__and__, [F.col(n).eqNullSafe(F.col(f"_c{n}")) for n in names])
    carried = carried.select(*[F.col(n).alias(f"_c{n}") for n in names], "_carried")
    return lagged.join(carried, same).withColumn(f"previous_{value}", previous).drop(
        *names, *[f"_c{n}" for n in names], "_row", "_lag", "_lag_row", "_carried"
    )
