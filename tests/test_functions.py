"""Column functions on hand-made values."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from skyloom.functions import clean, geo, measures, messages, rates, stats
from skyloom.params import MEASURES, BoundingBox, KSweep, Measure, TimeWindow, WindowSizes


def column(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_numbers(spark):
    texts = ["1", " 2.5 ", "-3e2", ".5", "5.", "", None, "5d", "5F", "0x10", "nan", "NaN", "inf", "Infinity", "1_0", "abc"]
    assert column(spark, texts, clean.to_number) == [1.0, 2.5, -300.0, 0.5, 5.0] + [None] * 11


def test_lenient_times(spark):
    texts = ["'2024-01-02T03:04:05'", ' "2024-01-02 03:04:05.25" ', "2024-01-02T03:04:05Z", "2024-01-02T04:04:05+01:00",
             "2024-01-02", "junk", "", None]
    t = datetime(2024, 1, 2, 3, 4, 5)
    micros = lambda c: F.unix_micros(clean.parse_time(c))
    epoch = lambda d: int((d - datetime(1970, 1, 1)).total_seconds() * 1_000_000)
    assert column(spark, texts, micros) == [
        epoch(t), epoch(t.replace(microsecond=250_000)), epoch(t), epoch(t), epoch(datetime(2024, 1, 2)), None, None, None]


def test_strict_times(spark):
    texts = ["'2024-01-02T03:04:05'", "2024-01-02T03:04:05.5", "2024-01-02 03:04:05", '"2024-01-02T03:04:05"',
             "2024-01-02T03:04:05Z", "2024-13-02T03:04:05", "2024-01-02", None]
    ok = [v is not None for v in column(spark, texts, clean.parse_time_strict)]
    assert ok == [True, True, False, False, False, False, False, False]


def test_null_like(spark):
    texts = ["", "  ", "NULL", " <null> ", "None", "NaN", "N/A", "#N/A", None, "0", "n", "nil"]
    assert column(spark, texts, clean.null_like) == [True] * 9 + [False] * 3


def test_sensor_ids_and_coordinates(spark):
    assert column(spark, ["7", " 7 ", "", " \t", None], clean.valid_sensor_id) == [True, True, False, False, False]
    df = spark.createDataFrame(
        [(0, 90.0, 180.0), (1, -90.0, -180.0), (2, 90.1, 0.0), (3, 0.009, -0.009), (4, 0.01, 0.0), (5, None, 1.0),
         (6, float("nan"), 1.0)], "i int, lat double, lon double")
    got = [r[0] for r in df.orderBy("i").select(clean.valid_coordinates(F.col("lat"), F.col("lon"))).collect()]
    assert got == [True, True, False, False, True, False, False]


def test_time_window_is_half_open(spark):
    window = TimeWindow.of("2024-01-01", "2024-01-02T00:00:00+00:00")
    assert window.days == 1.0
    texts = ["2024-01-01", "2024-01-01T23:59:59.999999", "2024-01-02", "2023-12-31T23:59:59", None]
    inside = lambda c: clean.in_window(clean.parse_time(c), window)
    assert column(spark, texts, inside) == [True, True, False, False, False]


def test_projection_check_points(spark):
    df = spark.createDataFrame([(50.0, 5.0), (52.0, 10.0)], "lat double, lon double")
    x, y = geo.project_europe_km(F.col("lat"), F.col("lon"))
    got = df.select(x, y).collect()
    assert got[0][0] * 1000 == pytest.approx(3962799.4510, abs=1e-3)
    assert got[0][1] * 1000 == pytest.approx(2999718.8532, abs=1e-3)
    assert got[1][0] * 1000 == pytest.approx(4321000, abs=1e-6)
    assert got[1][1] * 1000 == pytest.approx(3210000, abs=1e-6)


def test_nearest_prefers_the_lower_id_on_a_tie(spark):
    df = spark.createDataFrame([(0.0, 0.0), (3.0, 4.0)], "x double, y double")
    near = geo.nearest(F.col("x"), F.col("y"), F.array(*[
        F.struct(F.lit(i).alias("cluster"), F.lit(cx).alias("x"), F.lit(0.0).alias("y")) for i, cx in ((2, 1.0), (1, -1.0), (5, 3.0))]))
    got = [r[0] for r in df.select(near).collect()]
    assert (got[0]["cluster"], got[0]["distance"]) == (1, 1.0)
    assert (got[1]["cluster"], got[1]["distance"]) == (5, 4.0)


def test_summary_merge_of_two_halves(spark):
    """{1, 2} merged with {3, 4}: count 4, min 1, max 4, sum 10, mean 2.5, std sqrt(1.25)."""
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 3.0), ("b", 4.0), ("b", float("nan")), ("b", None)],
                               "half string, v double")
    halves = df.groupBy("half").agg(*stats.summarize("m", F.col("v")))
    row = halves.agg(*stats.merge("m")).select("*", stats.mean("m").alias("mean"), stats.population_std("m").alias("std")).first()
    assert (row["m_count"], row["m_min"], row["m_max"], row["m_sum"], row["m_sum_squares"]) == (4, 1.0, 4.0, 10.0, 30.0)
    assert row["mean"] == 2.5
    assert row["std"] == pytest.approx(1.25 ** 0.5, abs=1e-12)


def test_empty_summary(spark):
    df = spark.createDataFrame([(None,)], "v double").agg(*stats.summarize("m", F.col("v")))
    row = df.select("*", stats.mean("m").alias("mean"), stats.population_std("m").alias("std")).first()
    assert (row["m_count"], row["m_min"], row["m_sum"], row["mean"], row["std"]) == (0, None, 0.0, None, None)


def test_measures(spark):
    rows = [(0, "20.5", "50", "101325"), (1, "-41", "101", "1013.25"), (2, "", "nan", "300"), (3, "x", None, "30000"),
            (4, "85", "0", "1100.5"), (5, "1", "1", "29999")]
    df = spark.createDataFrame(rows, "i int, temperature string, humidity string, pressure string")
    out = measures.with_measures(df, {m.name: F.col(m.column) for m in MEASURES}, MEASURES).orderBy("i").collect()
    assert [r["temperature_c"] for r in out] == [20.5, None, None, None, 85.0, 1.0]
    assert [r["humidity_pct"] for r in out] == [50.0, None, None, None, 0.0, 1.0]
    assert [r["pressure_hpa"] for r in out] == [1013.25, 1013.25, 300.0, 300.0, None, None]
    assert [r["missing_values"] for r in out] == [0, 0, 2, 1, 0, 0]
    assert [r["invalid_values"] for r in out] == [0, 2, 0, 1, 1, 1]


def test_topics(spark):
    df = spark.createDataFrame([("e1", "7"), ("e1", " "), (None, "7")], "edge string, sensor string")
    got = [r[0] for r in df.select(messages.topic(F.col("edge"), F.col("sensor"))).collect()]
    assert got == ["telemetry/e1/7", None, None]
    texts = ["telemetry/e1/7", "telemetry/e1/", "telemetry/e1/7/x", "telemetry/e2/7", "x/e1/7", None]
    match = lambda c: messages.on_edge_subscription(c, "e1")
    assert column(spark, texts, match) == [True, True, False, False, False, False]
    with pytest.raises(ValueError):
        messages.on_edge_subscription(F.lit("x"), " ")


def test_event_id(spark):
    t = F.lit("2024-01-01 00:00:00.000001").cast("timestamp")
    got = spark.range(1).select(messages.event_id(F.lit("s"), t, F.lit(3))).first()[0]
    assert got == "v1:s:1704067200000001000:3"


def test_decode(spark):
    good = '{"schema_version":1,"event_id":"e","sensor_id":"7","sequence":2,"observed_at":"2024-01-01T00:00:00.123456789Z",' \
           '"emitted_at":"2024-01-01T01:00:00+01:00","measurements":{"a":"1"},"other":5}'
    rows = column(spark, [good, "{", "[]", None, '{"sequence":"x"}'], lambda c: F.struct(messages.decode_event(c).alias("e")))
    e = rows[0]["e"]
    assert (e["event_id"], e["sequence"], e["measurements"], e["_corrupt_record"]) == ("e", 2, {"a": "1"}, None)
    assert e["observed_at"] == datetime.fromtimestamp(1704067200.123456)
    for r in rows[1:]:
        assert r["e"] is None or r["e"]["_corrupt_record"] is not None


def test_rates(spark):
    got = spark.range(1).select(
        rates.per_second(F.lit(86_400.0)), rates.percent(F.lit(1), F.lit(4)), rates.percent(F.lit(1), F.lit(0)),
        rates.edge_label(F.lit(3)),
        rates.days_between(F.lit("2024-01-01").cast("timestamp"), F.lit("2024-01-02 12:00:00").cast("timestamp")),
    ).first()
    assert tuple(got) == (1.0, 25.0, None, "edge-3", 1.5)


@pytest.mark.parametrize("make", [
    lambda: TimeWindow.of("2024-01-02", "2024-01-02"),
    lambda: BoundingBox(1, 1, 0, 1),
    lambda: Measure("a", "a", "u", "identity", 1, 1),
    lambda: Measure("a", "a", "u", "log", 0, 1),
    lambda: WindowSizes(300, 400),
    lambda: WindowSizes(300, 200),
    lambda: WindowSizes(lateness_seconds=-1),
    lambda: KSweep(5, 4),
    lambda: KSweep(5, 6, 0),
])
def test_argument_checks(make):
    with pytest.raises(ValueError):
        make()
