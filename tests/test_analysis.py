"""The whole offline analysis, and the way from its trace to edge windows."""

import pytest
from pyspark.sql import functions as F

from catalog import views
from skyloom.analysis import analyse
from skyloom.operators import ingest, replay, windows
from skyloom.params import KSweep, TimeWindow
from skyloom.sources import observations, sinks
from skyloom.sources.topology import load_topology
from skyloom.streaming.queries import deduplicated


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("analysis"))
    rows = views.obs(spark, "/root/testdata/sf0.01").drop("event_id")
    sinks.write_text_table(rows, f"{folder}/raw", separator=";")
    return folder


def test_analysis_end_to_end(spark, files):
    raw = observations.scan_observations(spark, f"{files}/raw")
    done = analyse(raw, views.WINDOW, files, sweep=KSweep(5, 6, 2), size=20)
    assert done.k in (5, 6)
    assert done.workload.count() == 20
    assert set(done.tables) == set(sinks.EXPORTS) == set(sinks.exported(spark, f"{files}/tables"))

    topology = load_topology(spark, sinks.exported_paths(spark, f"{files}/tables")["kmeans_topology"])
    assert topology.count() == 20
    trace = observations.scan_trace(spark, f"{files}/trace")
    assert "altitude" not in trace.columns
    placed = observations.with_file_position(trace)
    records = observations.trace_records(placed, keep=("_file", "_split", "_line"))
    good = observations.good_records(records, strict=True)
    order = [F.col("_file"), F.col("_split")]
    assert replay.order_violations(good, "event_time", order, F.col("_line")).isEmpty()

    routed = replay.require_routes(replay.route(good, topology))
    events = replay.sensor_events(routed, ["_file", "_split", "_line"])
    assert events.count() == done.trace.first()["rows"]
    assert replay.edge_changes(events).isEmpty()
    messages = sinks.event_envelope(events)
    judged = ingest.judge(ingest.decode_messages(messages.unionByName(messages)), topology)
    assert ingest.rejected(judged).isEmpty()
    once = deduplicated(ingest.accepted(judged))
    edge = windows.edge_windows(windows.measured_events(once))
    assert edge.agg(F.sum("input_events")).first()[0] == events.count()


def test_unknown_sensor_fails_a_strict_replay(spark, files):
    topology = spark.createDataFrame([("nobody", "e", "m")], "sensor_id string, edge_id string, macroarea_id string")
    records = spark.createDataFrame([("7",)], "sensor_id string")
    with pytest.raises(Exception, match="not in the topology"):
        replay.require_routes(replay.route(records, topology)).collect()


def test_empty_window_is_an_error(spark, files):
    raw = observations.scan_observations(spark, f"{files}/raw")
    with pytest.raises(ValueError, match="no observation"):
        analyse(raw, TimeWindow.of("1999-01-01", "1999-01-02"), files)
