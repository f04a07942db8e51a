"""Trace to events, and events through the ingest rules."""

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from skyloom.operators import ingest, replay, topology, windows
from skyloom.params import Measure, WindowSizes
from skyloom.sources import sinks

TOPO = [("42", "m0", "edge-0", 41.9, 12.5), ("43", "m0", "edge-1", 1.0, 1.0), ("44", "m1", "edge-2", 1.0, 1.0)]


@pytest.fixture(scope="module")
def topo(spark):
    return spark.createDataFrame(TOPO, "sensor_id string, macroarea_id string, edge_id string, lat double, lon double")


def records(spark, rows):
    """rows: (position, sensor, second)"""
    df = spark.createDataFrame(rows, "pos int, sensor_id string, s int")
    return df.select(
        "pos", "sensor_id", F.lit("9").alias("location_id"), F.timestamp_seconds(F.col("s")).alias("event_time"),
        F.create_map(F.lit("temperature_c"), F.lit("20")).alias("measurements"),
    )


def test_sequence_follows_time_then_place(spark, topo):
    rows = [(0, "42", 5), (1, "43", 5), (2, "42", 5), (3, "42", 1), (4, "42", 9)]
    routed = replay.route(records(spark, rows), topo)
    events = replay.sensor_events(routed, ["pos"], F.lit("2024-01-01").cast("timestamp"))
    got = {(r["sensor_id"], r["sequence"]): r["event_id"] for r in events.collect()}
    assert got == {
        ("42", 1): "v1:42:1000000000:1", ("42", 2): "v1:42:5000000000:2", ("42", 3): "v1:42:5000000000:3",
        ("42", 4): "v1:42:9000000000:4", ("43", 1): "v1:43:5000000000:1",
    }


def test_unknown_sensor_keeps_null_route(spark, topo):
    rec = records(spark, [(0, "99", 1), (1, "42", 1)])
    routes = {r["sensor_id"]: r["edge_id"] for r in replay.route(rec, topo).collect()}
    assert routes == {"99": None, "42": "edge-0"}
    assert [r["sensor_id"] for r in replay.unknown_sensors(rec, topo).collect()] == ["99"]


def test_schedule(spark, topo):
    events = replay.sensor_events(replay.route(records(spark, [(0, "42", 1_000), (1, "43", 1_000), (2, "42", 3_500)]), topo), ["pos"])
    start = datetime(2025, 1, 1, tzinfo=timezone.utc)
    out = replay.replay_schedule(events, start, 1_000).orderBy("observed_at").collect()
    base = int(start.timestamp() * 1e6)
    micros = [r[0] for r in replay.replay_schedule(events, start, 1_000).orderBy("observed_at")
              .select(F.unix_micros("deadline")).collect()]
    assert micros == [base, base, base + 2_500_000]
    assert len(out) == 3
    with pytest.raises(ValueError):
        replay.replay_schedule(events, start, 0)


def test_order_violations(spark):
    df = records(spark, [(0, "a", 5), (1, "a", 5), (2, "a", 4), (3, "a", 6), (4, "a", 5)])
    for size in (2, 100):
        found = replay.order_violations(df, "event_time", [F.floor(F.col("pos") / size)], F.col("pos"))
        assert sorted(r["pos"] for r in found.collect()) == [2, 4]


def test_edge_changes(spark):
    df = spark.createDataFrame([("a", "e1"), ("a", "e1"), ("b", "e1"), ("b", "e2")], "sensor_id string, edge_id string")
    assert [tuple(r) for r in replay.edge_changes(df).collect()] == [("b", 2)]


def test_first_events(spark):
    df = spark.range(100).withColumn("t", 100 - F.col("id"))
    got = replay.first_events(df, 10, ["t", "id"])
    assert sorted(r["id"] for r in got.collect()) == list(range(90, 100))
    assert replay.first_events(df, 0, ["t"]).count() == 100
    with pytest.raises(ValueError):
        replay.first_events(df, -1, ["t"])


def event(spark, **change):
    base = dict(schema_version=1, event_id="event-1", sensor_id="42", location_id="9", sequence=1,
                observed_at="2025-01-01 00:00:00", emitted_at="2025-01-01 00:00:01",
                measurements={"temperature": "20.0"}, receiving_edge="edge-0")
    base.update(change)
    schema = ("schema_version int, event_id string, sensor_id string, location_id string, sequence long, "
              "observed_at string, emitted_at string, measurements map<string,string>, receiving_edge string")
    df = spark.createDataFrame([tuple(base.values())], schema)
    return df.withColumns({c: F.col(c).cast("timestamp") for c in ("observed_at", "emitted_at")})


@pytest.mark.parametrize("change, reason", [
    ({}, None),
    ({"schema_version": 2}, "unsupported schema version"),
    ({"schema_version": None}, "unsupported schema version"),
    ({"event_id": " "}, "missing event or sensor id"),
    ({"sensor_id": None}, "missing event or sensor id"),
    ({"observed_at": None}, "missing time"),
    ({"emitted_at": None}, "missing time"),
    ({"sensor_id": "7"}, "unknown sensor"),
    ({"sensor_id": "43"}, "sensor of another edge"),
    ({"measurements": {}}, "no measurements"),
    ({"measurements": None}, "no measurements"),
    ({"schema_version": 3, "event_id": "", "measurements": {}}, "unsupported schema version"),
])
def test_ingest_rules(spark, topo, change, reason):
    judged = ingest.judge(event(spark, **change), topo)
    assert judged.first()["reject_reason"] == reason
    count = ingest.accepted_count(judged).first()
    assert (count["accepted"], count["rejected"]) == ((1, 0) if reason is None else (0, 1))


def test_accepted_events_are_enriched(spark, topo):
    row = ingest.accepted(ingest.judge(event(spark), topo)).first()
    assert (row["edge_id"], row["macroarea_id"]) == ("edge-0", "m0")


def test_messages(spark, topo):
    wire = sinks.event_envelope(event(spark).withColumnRenamed("receiving_edge", "edge_id"))
    good = wire.first()
    assert good["topic"] == "telemetry/edge-0/42"
    assert "edge_id" not in good["value"] and "macroarea" not in good["value"]
    rows = [tuple(good), ("telemetry/edge-1/42", "42", good["value"]), ("telemetry/edge-0/43", "42", good["value"]),
            ("telemetry/edge-0/42", "42", "{broken"), ("telemetry/edge-0/42", "42", None), ("x", "42", good["value"])]
    messages = spark.createDataFrame(rows, "topic string, key string, value string")
    reasons = [r["reject_reason"] for r in ingest.judge(ingest.decode_messages(messages), topo).collect()]
    assert sorted(map(str, reasons)) == sorted(
        ["None", "sensor of another edge", "wrong topic", "malformed payload", "malformed payload", "wrong topic"])
    assert ingest.subscribed(messages, "edge-1").count() == 1


def test_unpublishable(spark):
    df = event(spark, sensor_id="").withColumnRenamed("receiving_edge", "edge_id")
    assert sinks.event_envelope(df).count() == 0
    assert sinks.unpublishable(df).first()["reject_reason"] == "empty sensor_id"
    df = event(spark, receiving_edge=None).withColumnRenamed("receiving_edge", "edge_id")
    assert sinks.unpublishable(df).first()["reject_reason"] == "empty edge_id"


def test_progress_is_observed(spark, topo):
    from pyspark.sql import Observation

    seen = Observation("ingest")
    judged = ingest.judge(event(spark), topo)
    judged.observe(seen, F.count_if(F.col("reject_reason").isNull()).alias("accepted")).collect()
    assert seen.get["accepted"] == 1
    assert ingest.observed_progress(judged).count() == 1


def test_topology_questions(spark, topo):
    assert tuple(topology.topology_counts(topo).first()) == (3, 3, 2)
    assert topology.require_edge(topo, "edge-0")["macroarea_id"] == "m0"
    with pytest.raises(ValueError):
        topology.require_edge(topo, "edge-9")
    endpoints = spark.createDataFrame([("edge-0", "mqtt://x"), ("edge-2", "mqtt://y")], "edge_id string, url string")
    assert [r["edge_id"] for r in topology.uncovered_edges(topo, endpoints).collect()] == ["edge-1"]


def test_edge_then_macroarea_equals_direct_aggregation(spark):
    measure = (Measure("a", "a", "u", "identity", 0, 100),)
    rows = [(s, f"edge-{s % 3}", f"m{s % 3 % 2}", t, str((s * 37 + t) % 120)) for s in range(9) for t in range(0, 7_200, 97)]
    df = spark.createDataFrame(rows, "s int, edge_id string, macroarea_id string, t int, a string").select(
        F.col("s").cast("string").alias("sensor_id"), "edge_id", "macroarea_id",
        F.timestamp_seconds("t").alias("observed_at"), F.create_map(F.lit("a"), F.col("a")).alias("measurements"))
    measured = windows.measured_events(df, measure)
    edge = windows.edge_windows(measured, WindowSizes(), measure)
    macro = windows.macroarea_windows(edge, WindowSizes(), measure)
    direct = measured.groupBy(F.window("observed_at", "15 minutes"), "macroarea_id").agg(
        F.count("*").alias("n"), F.count("a").alias("c"), F.sum("a").alias("s"), F.min("a").alias("lo"),
        F.max("a").alias("hi"), F.sum(F.col("a") * F.col("a")).alias("ss"), F.count_distinct("edge_id").alias("e"))
    want = sorted((r["macroarea_id"], str(r["window"]["start"]), r["n"], r["c"], r["s"], r["lo"], r["hi"], r["ss"], r["e"])
                  for r in direct.collect())
    got = sorted((r["macroarea_id"], str(r["window_start"]), r["input_events"], r["a_count"], r["a_sum"], r["a_min"],
                  r["a_max"], r["a_sum_squares"], r["edge_count"]) for r in macro.collect())
    assert got == want
    first = edge.filter("edge_id = 'edge-0'").orderBy("window_start").first()
    assert (first["window_id"], first["sensor_count"], first["input_events"]) == ("edge-0:0", 3, 12)
    assert first["invalid_values"] + first["a_count"] == 12
