"""Normalization, valid ranges and quality flags of measured values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.functions.clean import null_like, strip, to_number
from skyloom.params import Measure


def measurement_map(measures: tuple[Measure, ...]) -> Column:
    """map(logical name -> trimmed raw text); an absent value is the empty text."""
    return F.create_map(*[
        part for m in measures
        for part in (F.lit(m.name), F.coalesce(strip(F.col(m.column)), F.lit("")))
    ])


def normalize(value: Column, measure: Measure) -> Column:
    """Pressure in Pa becomes hPa where only that reading is in range; else unchanged."""
    if measure.normalizer == "identity":
        return value
    scaled = value / 100
    in_pa = ~value.between(measure.low, measure.high) & scaled.between(measure.low, measure.high)
    return F.when(in_pa, scaled).otherwise(value)


def with_measures(df: DataFrame, raw: dict[str, Column], measures: tuple[Measure, ...]) -> DataFrame:
    """Add one double per measure, and the row's counts of missing and invalid values.

    ``raw`` maps a measure name to its raw text. The double is the normalized
    value where it is a number inside the valid range, else NULL. A value is
    missing when it is null-like, invalid when it is present but not valid.
    Each step is a projection of its own, so no parse is written twice.
    """
    parsed = {f"_num_{m.name}": to_number(raw[m.name]) for m in measures}
    gone = {f"_gone_{m.name}": null_like(raw[m.name]) for m in measures}
    scaled = {f"_val_{m.name}": normalize(F.col(f"_num_{m.name}"), m) for m in measures}
    kept = {}
    for m in measures:
        v = F.col(f"_val_{m.name}")
        kept[m.name] = F.when(v.between(m.low, m.high), v)
    missing = " + ".join(f"cast(_gone_{m.name} AS BIGINT)" for m in measures)
    invalid = " + ".join(f"cast(NOT _gone_{m.name} AND {m.name} IS NULL AS BIGINT)" for m in measures)
    return (
        df.withColumns({**parsed, **gone}).withColumns(scaled).withColumns(kept)
        .withColumns({"missing_values": F.expr(missing), "invalid_values": F.expr(invalid)})
        .drop(*parsed, *gone, *scaled)
    )
