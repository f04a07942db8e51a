"""Files in, files out."""

import pytest
from pyspark.sql import functions as F

from skyloom.operators import quality, sensors
from skyloom.params import TimeWindow
from skyloom.sources import footprint, observations, sinks, topology

HEADER = "sensor_id;location; lat ;lon;timestamp;temperature;humidity;pressure;extra"
WINDOW = TimeWindow.of("2024-01-01", "2024-02-01")


def write(folder, text, name="a.csv"):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(text)
    return str(folder)


def test_scan_by_name_keeps_text(spark, tmp_path):
    path = write(tmp_path / "o", HEADER + '\n07;1;1.50;2;\'2024-01-01T00:00:00\';"a;b";;"say ""x""";\n8;1\n')
    rows = observations.scan_observations(spark, path).orderBy("sensor_id").collect()
    assert rows[0]["sensor_id"] == "07" and rows[0]["lat"] == "1.50" and rows[0]["temperature"] == "a;b"
    assert rows[0]["pressure"] == 'say "x"' and rows[0]["humidity"] is None
    assert rows[1]["sensor_id"] == "8" and rows[1]["timestamp"] is None


@pytest.mark.parametrize("header, message", [
    ("sensor_id;sensor_id ;lat;lon;timestamp;location", "duplicate"),
    ("sensor_id;lat;lon;timestamp", "location"),
])
def test_bad_headers(spark, tmp_path, header, message):
    path = write(tmp_path / "o", header + "\n")
    with pytest.raises(ValueError, match=message):
        observations.scan_observations(spark, path)


def test_headers_must_agree_between_files(spark, tmp_path):
    write(tmp_path / "o", HEADER + "\n1;1;1;1;2024-01-01;1;1;1;1\n", "a.csv")
    path = write(tmp_path / "o", HEADER.replace("lat", "x") + "\n1;1;1;1;2024-01-01;1;1;1;1\n", "b.csv")
    with pytest.raises(Exception, match="(?i)header"):
        observations.scan_observations(spark, path).collect()


def test_records_and_strict_mode(spark, tmp_path):
    body = "1;9;1;1;'2024-01-01T00:00:00'; 20 ;;1000;\n ;9;1;1;2024-01-01T00:00:00;1;1;1;\n2;9;1;1;yesterday;1;1;1;\n"
    scan = observations.scan_trace(spark, write(tmp_path / "o", HEADER + "\n" + body))
    records = observations.trace_records(scan)
    assert {r["reject_reason"] for r in records.collect()} == {None, "empty sensor_id", "invalid timestamp"}
    good = observations.good_records(records).collect()
    assert len(good) == 1
    assert good[0]["measurements"] == {"temperature_c": "20", "humidity_pct": "", "pressure_hpa": "1000"}
    with pytest.raises(Exception, match="bad trace row"):
        observations.good_records(records, strict=True).collect()


def test_file_position_and_footprint(spark, tmp_path):
    lines = "".join(f"{i};1;1;1;2024-01-01T00:00:0{i};1;1;1;\n" for i in range(5))
    path = write(tmp_path / "o", HEADER + "\n" + lines)
    scan = observations.scan_observations(spark, path)
    placed = observations.with_file_position(scan).orderBy("_file", "_split", "_line")
    assert [r["sensor_id"] for r in placed.collect()] == list("01234")
    row = footprint.file_footprint(spark, path).first()
    assert (row["files"], row["bytes"]) == (1, (tmp_path / "o" / "a.csv").stat().st_size)


TOPOLOGY = "sensor_id,macroarea_id,edge_id,lat,lon\n"


def test_topology_load(spark, tmp_path):
    path = write(tmp_path / "t", TOPOLOGY + "42,0,edge-0,41.9,12.5\n")
    assert [tuple(r) for r in topology.load_topology(spark, path).collect()] == [("42", "0", "edge-0", 41.9, 12.5)]


@pytest.mark.parametrize("body, message", [
    ("", "no sensor assignments"),
    (" ,0,e,1,1\n", "empty sensor_id"),
    ("1,0,e,91,1\n", "invalid lat"),
    ("1,0,e,1,x\n", "invalid lon"),
    ("1,0,e,1,1\n1,0,e,1,1\n", "duplicate sensor"),
    ("1,0,e,1,1\n2,1,e,1,1\n", "several macroareas"),
])
def test_topology_errors(spark, tmp_path, body, message):
    with pytest.raises(ValueError, match=message):
        topology.load_topology(spark, write(tmp_path / "t", TOPOLOGY + body))


def test_profile_of_a_file(spark, tmp_path):
    body = ("1;9;10;10;2024-01-05T00:00:00;1;nan;1;\n1;9;0;0;2024-01-06T00:00:00;1;;1;\n;9;10;10;2024-01-07;1;None;1;\n"
            "1;9;10;10;2025-01-01;1;5;1;\n1;9;10;10;soon;1;5;1;\n")
    path = write(tmp_path / "o", HEADER + "\n" + body)
    scan = observations.scan_observations(spark, path)
    profile = quality.scan_profile(scan, WINDOW)
    assert tuple(quality.scan_quality(profile).first()) == (5, 3, 1, 1, 1, 1)
    assert quality.active_columns(profile) == [
        "sensor_id", "location", "lat", "lon", "timestamp", "temperature", "pressure"]
    dead = {r["column"] for r in quality.column_quality(profile).collect() if r["all_null"]}
    assert dead == {"humidity", "extra"}
    stats = sensors.sensor_stats(scan, WINDOW)
    summary = quality.dataset_summary(profile, stats, WINDOW, footprint.file_footprint(spark, path)).first()
    assert summary["unique_sensors"] == 1 and summary["configured_days"] == 31.0 and summary["observed_days"] == 2.0
    assert summary["file_gb"] == pytest.approx((tmp_path / "o" / "a.csv").stat().st_size / 1e9)


def test_scan_reads_only_needed_columns(spark, tmp_path):
    scan = observations.scan_observations(spark, write(tmp_path / "o", HEADER + "\n1;9;1;1;2024-01-05;1;1;1;\n"))
    plan = sensors.sensor_stats(scan, WINDOW)._jdf.queryExecution().executedPlan().toString()
    read = plan.split("ReadSchema: ")[1].split("\n")[0]
    assert "temperature" not in read and "location" not in read and "sensor_id" in read


def test_written_trace_is_ordered_and_counted(spark, tmp_path):
    rows = [("b", "3", 3), ("a", "3", 3), ("a", " 1", 1), ("c", "2", 2), ("c", "2", 2)]
    df = spark.createDataFrame(rows, "sensor_id string, text string, t int").repartition(3)
    path = str(tmp_path / "trace")
    summary = sinks.write_trace(df, path, "t", "sensor_id").first()
    assert summary["rows"] == 5 and summary["files"] >= 1 and summary["bytes"] > 0
    back = observations.with_file_position(
        spark.read.csv(path, sep=";", header=True)).orderBy("_file", "_split", "_line").collect()
    assert [(r["sensor_id"], r["text"]) for r in back] == [("a", " 1"), ("c", "2"), ("c", "2"), ("a", "3"), ("b", "3")]
    assert back[0].asDict().keys() >= {"sensor_id", "text"} and "t" not in back[0]


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0, "x"), (0, 1.0, "y")], "replay_factor int, total_events_per_second double, z string")
    written = sinks.export_tables({"replay_load_scenarios": df}, str(tmp_path / "out"))
    back = spark.read.csv(written[0], header=True)
    assert back.columns == ["replay_factor", "total_events_per_second"] and back.count() == 2
    with pytest.raises(ValueError):
        sinks.export_tables({"other": df}, str(tmp_path))


def test_upsert_keeps_the_newest(spark):
    old = spark.createDataFrame([("w1", 1, 10), ("w2", 5, 20)], "window_id string, version int, n int")
    new = spark.createDataFrame([("w1", 2, 11), ("w2", 4, 21), ("w3", 1, 30), ("w2", 5, 22)],
                                "window_id string, version int, n int")
    out = sinks.upsert_windows(old, new, "version")
    assert sorted(map(tuple, out.collect())) == [("w1", 2, 11), ("w2", 5, 22), ("w3", 1, 30)]
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()


def test_upsert_survives_a_new_checkpoint(spark, tmp_path):
    """Two days, a repeated batch, and a second query whose batch ids start again at 0."""
    folder, rows = str(tmp_path / "table"), lambda x: spark.createDataFrame(x, "window_id string, version int, value int")
    assert sinks.upserted(spark, folder) is None
    first = sinks.upsert_into(spark, folder, "version")
    for i in range(3):
        first(rows([("a:0", i, i), (f"b{i}:90000", 1, i)]), i)
    first(rows([("a:0", 99, 99)]), 2)  # already committed
    second = sinks.upsert_into(spark, folder, "version")
    second(rows([("c:0", 1, 7), ("b1:90000", 0, 8), ("odd", 1, 1)]), 0)
    got = sorted(map(tuple, sinks.upserted(spark, folder).collect()))
    assert got == [("a:0", 2, 2), ("b0:90000", 1, 0), ("b1:90000", 1, 1), ("b2:90000", 1, 2), ("c:0", 1, 7), ("odd", 1, 1)]
    assert spark.read.parquet(f"{folder}/log").filter("day = '1970-01-02'").count() == 4


def test_window_envelope_nests_metrics(spark):
    df = spark.createDataFrame([("m1:0", "m1", 2, 2, 1.0, 3.0, 4.0, 10.0)],
                               "window_id string, macroarea_id string, input_events int, a_count int, a_min double, "
                               "a_max double, a_sum double, a_sum_squares double")
    from skyloom.params import Measure
    row = sinks.window_envelope(df, "t", (Measure("a", "a", "u", "identity", 0, 1),)).first()
    assert (row["topic"], row["key"]) == ("t", "m1")
    assert '"metrics":{"a":{"count":2,"min":1.0,"max":3.0,"sum":4.0,"sum_squares":10.0}}' in row["value"]
    assert "a_count" not in row["value"]


def test_preview(spark):
    assert observations.preview(spark.range(10)).count() == 5


def test_one_pass_scan_equals_the_separate_ones(spark, tmp_path):
    body = ("1;9;10;10;2024-01-05T00:00:00;1;nan;1;\n1;9;0;0;2024-01-06T00:00:00;1;;1;\n;9;10;10;2024-01-07;1;None;1;\n"
            " 2 ;9;10;10;2025-01-01;1;5;1;\n3;9;10;x;2024-01-09;1;5;1;\n3;9;10;10;soon;1;5;1;\n")
    scan = observations.scan_observations(spark, write(tmp_path / "o", HEADER + "\n" + body))
    by_sensor = quality.scan_by_sensor(scan, WINDOW)
    one, two = quality.profile_from(by_sensor).first().asDict(), quality.scan_profile(scan, WINDOW).first().asDict()
    assert one == two
    a, b = sensors.stats_from(by_sensor, WINDOW), sensors.sensor_stats(scan, WINDOW)
    assert sorted(map(str, a.select(*b.columns).collect())) == sorted(map(str, b.collect()))
    assert {r["sensor_id"] for r in a.collect()} == {"1", "3"}


def test_rows_of_the_wrong_width(spark, tmp_path):
    body = '1;9;2024-01-05T00:00:00;1;2;3\n2;9;2024-01-05T00:00:00;1\n3;9;2024-01-05T00:00:00;1;2;3;4;5\n4;"a\nb";2024-01-05T00:00:00;1;2;3\n'
    path = write(tmp_path / "r", "sensor_id;location;timestamp;temperature;humidity;pressure\n" + body)
    scan = observations.scan_trace(spark, path)
    rows = observations.trace_records(scan).collect()
    assert [r["reject_reason"] for r in rows] == [None] + ["wrong number of columns"] * 4
    assert sorted(r["_bad_row"] or "" for r in scan.collect())[0] == "" and observations.whole_rows(scan).count() == 1
    with pytest.raises(Exception, match="wrong number of columns"):
        observations.whole_rows(scan, strict=True).collect()
    whole = observations.scan_trace(spark, path, multiline=True)
    assert observations.whole_rows(whole).count() == 2


def test_unicode_blanks_and_times_without_a_date(spark):
    from skyloom.functions import clean
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(x,) for x in ("\u2003", "\u3000 7.5\u2009", " é\u00a0", "12:30", "T1:2:3", "'2024-01-05 12:30'", "2024-01-05", None)], "v string")
    got = df.select(clean.strip(F.col("v")), clean.valid_sensor_id(F.col("v")), clean.to_number(F.col("v")), clean.parse_time(F.col("v")).cast("string")).collect()
    assert [r[0] for r in got[:3]] == ["", "7.5", "é"] and [r[1] for r in got[:3]] == [False, True, True] and got[1][2] == 7.5
    assert [r[3] for r in got[3:]] == [None, None, "2024-01-05 12:30:00", "2024-01-05 00:00:00", None]


def test_an_export_is_whole_or_not_there(spark, tmp_path, monkeypatch):
    from skyloom.sources.commits import CommitLog

    folder = str(tmp_path / "exports")
    loads = spark.createDataFrame([(1, 2.5), (2, 5.0), (2, 5.0)], "replay_factor int, total_events_per_second double")
    centers = spark.createDataFrame([(0, "edge-0", 1.5, None)], "edge_cluster int, edge_id string, centroid_x_km double, centroid_y_km double")
    with pytest.raises(ValueError, match="no committed export"):
        sinks.exported(spark, folder)
    manifest = sinks.export_set({"replay_load_scenarios": loads, "edge_centroids": centers}, folder)
    assert {r["name"]: r["rows"] for r in manifest.collect()} == {"replay_load_scenarios": 3, "edge_centroids": 1}
    with monkeypatch.context() as m:
        m.setattr(CommitLog, "commit", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            sinks.export_set({"replay_load_scenarios": loads.limit(1), "edge_centroids": centers}, folder)
    got = sinks.exported(spark, folder)
    assert got["replay_load_scenarios"].count() == 3 and got["edge_centroids"].first()["edge_id"] == "edge-0"
    sinks.export_set({"replay_load_scenarios": loads.limit(1), "edge_centroids": centers}, folder)
    assert sinks.exported(spark, folder)["replay_load_scenarios"].count() == 1
    path = sinks.exported_paths(spark, folder)["edge_centroids"]
    spark.createDataFrame([(0, "edge-1", 1.5, None)], centers.schema).coalesce(1).write.csv(path, mode="overwrite", header=True)
    with pytest.raises(ValueError, match="edge_centroids of the export is not whole"):
        sinks.exported(spark, folder)
    spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).delete(spark._jvm.org.apache.hadoop.fs.Path(path), True)
    with pytest.raises(ValueError, match="edge_centroids of the export is missing"):
        sinks.exported(spark, folder)
