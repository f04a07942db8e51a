"""Parsing and validity of raw text values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.params import NA_TOKENS, NULL_WORDS, BoundingBox, TimeWindow, TraceColumns
from skyloom.plans.shared import computed_once

# Fixed value: white space that is cut from the ends of values, all Unicode blanks included.
WHITE_SPACE = (
    " \t\n\x0b\x0c\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# Fixed value: one time layout, quote marks allowed around it.
STRICT_TIME = r"^\s*'*\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?'*\s*$"
# Fixed value: letters that no decimal number has. Keeps out what a cast would
# read on top of decimals: Java suffixes ("5d"), hexadecimal, NaN, Infinity.
NOT_IN_NUMBERS = "[a-df-zA-DF-Z]"


def strip(c: Column) -> Column:
    """Text without white space at its ends; no condition around it, so that Spark can share the result."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def clean_text(c: Column) -> Column:
    """Stripped and lower-cased text."""
    return F.lower(strip(c))


def null_like(c: Column) -> Column:
    """True for NULL, blank text, and every spelling of "no value"."""
    text = c.cast("string")
    return text.isNull() | clean_text(text).isin(*NULL_WORDS) | text.isin(*NA_TOKENS)


def to_number(c: Column) -> Column:
    """Text to double; NULL where it is not a plain decimal number. Blanks around it are fine."""
    return F.when(~c.rlike(NOT_IN_NUMBERS), strip(c).try_cast("double"))


def parse_time(c: Column) -> Column:
    """Lenient ISO time: blanks and quote marks stripped, offsets honoured, NULL on failure.

    Text without an offset is read in the session time zone, which must be UTC. A time without
    a date is NULL: a cast would give it the date of today.
    """
    return _bare_time(_time_text(c))


def _time_text(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE_SPACE + "'\""))


def _bare_time(text: Column) -> Column:
    return F.when(~F.instr(text, ":").between(1, 4), text.try_cast("timestamp"))


def parse_time_strict(c: Column) -> Column:
    """One layout only, ``2024-01-31T23:59:59`` with an optional fraction."""
    return F.when(c.rlike(STRICT_TIME), F.btrim(c, F.lit(WHITE_SPACE + "'")).try_cast("timestamp"))


def in_window(t: Column, window: TimeWindow) -> Column:
    """``start <= t < end``; false where ``t`` is NULL."""
    return F.coalesce((t >= F.lit(window.start)) & (t < F.lit(window.end)), F.lit(False))


def valid_sensor_id(c: Column) -> Column:
    return F.coalesce(strip(c) != "", F.lit(False))


def valid_coordinates(lat: Column, lon: Column) -> Column:
    """In range and not at the null island; NULL counts as invalid."""
    at_origin = (F.abs(lat) < 0.01) & (F.abs(lon) < 0.01)
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180) & ~at_origin, F.lit(False))


def in_box(lat: Column, lon: Column, box: BoundingBox) -> Column:
    """Inclusive on all four sides."""
    return lat.between(box.lat_min, box.lat_max) & lon.between(box.lon_min, box.lon_max)


def mask(ok: Column, value: Column) -> Column:
    """The value where ``ok``, else NULL."""
    return F.when(ok, value)


def with_time(df: DataFrame, column: str, name: str = "event_time") -> DataFrame:
    """``parse_time`` of a text column, trimmed once and parsed once per row, whatever filters follow."""
    timed = computed_once(df.withColumn("_time_text", _time_text(F.col(column))), {name: _bare_time(F.col("_time_text"))})
    return timed.drop("_time_text")


def observation_flags(df: DataFrame, window: TimeWindow, cols: TraceColumns = TraceColumns()) -> DataFrame:
    """Add typed columns and validity flags; drops no row, so every count stays possible."""
    lat, lon = to_number(F.col(cols.lat)), to_number(F.col(cols.lon))
    return (
        with_time(df, cols.timestamp).withColumns({"lat_num": lat, "lon_num": lon})
        .withColumns({
            "in_window": in_window(F.col("event_time"), window),
            "sensor_ok": valid_sensor_id(F.col(cols.sensor_id)),
            "coord_ok": valid_coordinates(F.col("lat_num"), F.col("lon_num")),
        })
    )


def located_rows(df: DataFrame, cols: TraceColumns = TraceColumns()) -> DataFrame:
    """Rows with usable coordinates, which are added as numbers; each text is parsed once."""
    numbers = {"lat_num": to_number(F.col(cols.lat)), "lon_num": to_number(F.col(cols.lon))}
    return computed_once(df, numbers).filter(valid_coordinates(F.col("lat_num"), F.col("lon_num")))
