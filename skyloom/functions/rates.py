"""Small arithmetic on times, rates and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skyloom.params import SECONDS_PER_DAY


def days_between(a: Column, b: Column) -> Column:
    return (F.unix_micros(b) - F.unix_micros(a)) / F.lit(SECONDS_PER_DAY * 1e6)


def per_second(rows_per_day: Column) -> Column:
    return rows_per_day / F.lit(SECONDS_PER_DAY)


def percent(part: Column, total: Column) -> Column:
    return F.try_divide(part * F.lit(100.0), total)


def edge_label(cluster: Column) -> Column:
    return F.concat(F.lit("edge-"), cluster.cast("string"))
