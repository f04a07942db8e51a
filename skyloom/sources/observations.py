"""Observation files: delimited text whose columns are found by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.functions.clean import parse_time_strict, strip
from skyloom.functions.measures import measurement_map
from skyloom.params import MEASURES, Measure, TraceColumns

SEPARATOR = ";"
BAD_ROW = "_bad_row"


def scan_text_table(
    spark: SparkSession,
    path: str,
    required: list[str],
    separator: str = SEPARATOR,
    multiline: bool = False,
) -> DataFrame:
    """All-string scan with a header; names are trimmed, and missing or doubled ones are errors.

    Every file's header must agree with the first one's. A row with more or fewer cells than the header has its text
    in ``_bad_row``, which is NULL for others; its cells are only those that were read.
    ``multiline`` allows line breaks inside quoted values, at the price of one task per file; without it
    such a value makes two bad rows.
    """
    if len(separator) != 1:
        raise ValueError("the separator must be one character")
    header = _header(spark, path, separator)
    names = [n.strip() for n in header]
    doubled = sorted({n for n in names if names.count(n) > 1})
    if doubled:
        raise ValueError(f"duplicate columns in the header: {doubled}")
    absent = [n for n in required if n not in names]
    if absent:
        raise ValueError(f"required columns missing from the header: {absent}")
    schema = ", ".join(f"`{n.replace('`', '``')}` STRING" for n in [*header, BAD_ROW])
    # the width of a row is known only if all of its cells are parsed
    df = spark.read.option("columnPruning", False).csv(
        path, schema=schema, sep=separator, header=True, quote='"', escape='"',
        enforceSchema=False, multiLine=multiline, mode="PERMISSIVE", columnNameOfCorruptRecord=BAD_ROW,
    )
    return df.toDF(*names, BAD_ROW)


def whole_rows(df: DataFrame, strict: bool = False) -> DataFrame:
    """Rows with as many cells as the header, without ``_bad_row``; ``strict`` fails the job at another one instead."""
    if BAD_ROW not in df.columns:
        return df
    bad = F.col(BAD_ROW)
    ok = F.when(bad.isNull(), True).otherwise(F.raise_error(F.concat(F.lit("wrong number of columns: "), bad)).cast("boolean")) if strict else bad.isNull()
    # always true; Spark refuses to read nothing but the text of bad rows
    other = F.col("`" + df.columns[0].replace("`", "``") + "`")
    return df.filter(ok & (other.isNull() | (F.length(other) >= 0))).drop(BAD_ROW)


def _header(spark: SparkSession, path: str, separator: str) -> list[str]:
    first = spark.read.text(path).limit(1).collect()
    if not first:
        raise ValueError(f"no header in {path}")
    line = first[0][0]
    cells = spark.createDataFrame([(line,)], "line string").select(
        F.from_csv("line", ", ".join(f"c{i} STRING" for i in range(line.count(separator) + 1)),
                   {"sep": separator, "quote": '"', "escape": '"'}).alias("c")
    ).first()[0]
    return [c for c in cells if c is not None]


def scan_observations(spark: SparkSession, path: str, cols: TraceColumns = TraceColumns(), **options) -> DataFrame:
    """Raw observations; every value stays text."""
    needed = [cols.sensor_id, cols.location_id, cols.timestamp, cols.lat, cols.lon]
    return scan_text_table(spark, path, needed, **options)


def scan_trace(
    spark: SparkSession,
    path: str,
    cols: TraceColumns = TraceColumns(),
    measures: tuple[Measure, ...] = MEASURES,
    **options,
) -> DataFrame:
    """A replay trace; only the columns a record needs are required."""
    needed = [cols.sensor_id, cols.location_id, cols.timestamp, *[m.column for m in measures]]
    return scan_text_table(spark, path, needed, **options)


def preview(df: DataFrame, rows: int = 5) -> DataFrame:
    return df.limit(rows)


def with_file_position(df: DataFrame) -> DataFrame:
    """Add ``_file``, ``_split`` and ``_line``: the order of rows as stored.

    ``_split`` is the start of the input split, ``_line`` grows inside a split.
    Use directly on a file scan.
    """
    return df.withColumns({
        "_file": F.col("_metadata.file_path"),
        "_split": F.col("_metadata.file_block_start"),
        "_line": F.monotonically_increasing_id(),
    })


def trace_records(
    df: DataFrame,
    cols: TraceColumns = TraceColumns(),
    measures: tuple[Measure, ...] = MEASURES,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Typed records with ``reject_reason``: NULL for a good one.

    Every bad row is kept with its reason; :func:`good_records` drops them, or
    stops at the first one.
    """
    bad = F.col(BAD_ROW).isNotNull() if BAD_ROW in df.columns else F.lit(False)
    sensor = strip(F.col(cols.sensor_id))
    time = parse_time_strict(F.col(cols.timestamp))
    return df.select(
        *keep,
        sensor.alias("sensor_id"),
        F.coalesce(strip(F.col(cols.location_id)), F.lit("")).alias("location_id"),
        time.alias("event_time"),
        measurement_map(measures).alias("measurements"),
        F.when(bad, "wrong number of columns").when(F.coalesce(sensor, F.lit("")) == "", "empty sensor_id")
        .when(time.isNull(), "invalid timestamp").alias("reject_reason"),
    )


def good_records(records: DataFrame, strict: bool = False) -> DataFrame:
    """Records without a reject reason; ``strict`` fails the job at a bad one instead."""
    if strict:
        # raise_error sits in the filter so that no optimizer step can drop it
        ok = F.when(F.col("reject_reason").isNull(), True).otherwise(
            F.raise_error(F.concat(F.lit("bad trace row: "), F.col("reject_reason"))).cast("boolean")
        )
        return records.filter(ok).drop("reject_reason")
    return records.filter("reject_reason IS NULL").drop("reject_reason")
