"""Streams against their batch twins."""

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from skyloom.operators import ingest, windows
from skyloom.params import MEASURES, WindowSizes
from skyloom.plans.tables import new_path
from skyloom.sources import sinks
from skyloom.sources.stream import message_files
from skyloom.streaming import queries as streams

SIZES = WindowSizes()


@pytest.fixture(scope="module")
def topo(spark):
    rows = [(str(s), f"m{s % 2}", f"edge-{s % 4}") for s in range(12)]
    return spark.createDataFrame(rows, "sensor_id string, macroarea_id string, edge_id string")


def events(spark, topo, seconds):
    """One event per sensor and second; sensor 99 is unknown."""
    sensors = topo.select("sensor_id", F.col("edge_id")).unionByName(
        spark.createDataFrame([("99", "edge-0")], "sensor_id string, edge_id string"))
    times = spark.createDataFrame([(t,) for t in seconds], "t int")
    return sensors.join(F.broadcast(times)).select(
        F.lit(1).alias("schema_version"), F.concat_ws("-", "sensor_id", "t").alias("event_id"), "sensor_id",
        F.lit("9").alias("location_id"), F.col("t").cast("long").alias("sequence"),
        F.timestamp_seconds("t").alias("observed_at"), F.timestamp_seconds("t").alias("emitted_at"),
        F.create_map(*[x for m in MEASURES for x in (F.lit(m.name), F.col("t").cast("string"))]).alias("measurements"),
        "edge_id",
    )


def publish(df, path, mode="overwrite"):
    sinks.event_envelope(df).coalesce(1).write.mode(mode).json(path)


def batch_windows(spark, topo, wire):
    judged = ingest.judge(ingest.decode_messages(sinks.event_envelope(wire)), topo)
    edge = windows.edge_windows(windows.measured_events(ingest.accepted(judged)))
    return edge, windows.macroarea_windows(edge)


def rows(df):
    return sorted(map(repr, (r.asDict(recursive=True) for r in df.drop("window").collect())))


def test_streams_equal_batch_and_the_last_window_stays_open(spark, topo, tmp_path):
    path = str(tmp_path / "messages")
    wire = events(spark, topo, range(0, 4_000, 70))
    publish(wire, path)
    edge, macro = batch_windows(spark, topo, wire)

    def run(label, chain):
        source = streams.ingest(message_files(spark, path), topo)
        stream = streams.edge_window_stream(ingest.accepted(source))
        return streams.run_to_table(spark, streams.macroarea_window_stream(stream) if chain else stream, label)

    closed = edge.filter(F.col("window_end") <= F.timestamp_seconds(F.lit(3_990)))
    assert rows(run("edge", False)) == rows(closed)
    assert closed.count() < edge.count()

    at = datetime(1970, 1, 1, 3, tzinfo=timezone.utc)
    streams.closing_messages(topo, at).write.mode("append").json(path)
    assert rows(run("edge", False)) == rows(edge)
    assert rows(run("macro", True)) == rows(macro)


def test_late_rows_are_dropped_and_lateness_keeps_them(spark, topo, tmp_path):
    def run(path, lateness):
        sizes = WindowSizes(lateness_seconds=lateness)
        source = streams.ingest(message_files(spark, path, files_per_batch=1), topo)
        stream = streams.edge_window_stream(ingest.accepted(source), sizes)
        out = new_path(spark, "late")
        checkpoint = f"{out}-checkpoint"
        query = streams.start(stream, out, checkpoint)
        query.awaitTermination()
        return spark.read.schema(stream.schema).parquet(out).agg(F.sum("input_events")).first()[0]

    path = str(tmp_path / "late")
    one = lambda t: publish(events(spark, topo, [t]).filter("sensor_id = '1'"), path, "append")
    import time
    # a batch's watermark takes effect for late rows one batch later, hence the filler at 1 100
    for t in (10, 1_000, 1_100, 20, 5_000):
        one(t)
        time.sleep(1.1)  # files are read in the order of their modification time
    assert run(path, 0) == 3
    assert run(path, 2_000) == 4


def test_restart_continues_from_the_checkpoint(spark, topo, tmp_path):
    path, out, checkpoint = (str(tmp_path / n) for n in ("messages", "out", "checkpoint"))

    def run():
        source = streams.ingest(message_files(spark, path), topo).drop("measurements")
        query = streams.start(source, out, checkpoint)
        query.awaitTermination()
        return query, spark.read.schema(source.schema).parquet(out)

    publish(events(spark, topo, [0]), path)
    first, table = run()
    assert table.count() == 13
    progress = [p["observedMetrics"]["ingest"] for p in first.recentProgress if "ingest" in p["observedMetrics"]]
    assert (progress[0]["accepted"], progress[0]["rejected"]) == (12, 1)
    publish(events(spark, topo, [1]), path, "append")
    _, table = run()
    assert table.count() == 26 and table.select("event_id").distinct().count() == 26


def test_deduplication(spark, topo, tmp_path):
    path = str(tmp_path / "twice")
    wire = events(spark, topo, range(100, 1_100, 100))
    publish(wire, path)
    publish(wire, path, "append")
    judged = ingest.accepted(streams.ingest(message_files(spark, path), topo))
    out = streams.run_to_table(spark, streams.deduplicated(judged).drop("measurements"), "dedup")
    assert out.count() == 12 * 10
    plain = streams.run_to_table(spark, judged.drop("measurements"), "plain")
    assert plain.count() == 2 * 12 * 10


def test_windows_upserted_by_batches(spark, topo, tmp_path):
    """Update-mode style sink: every micro-batch merges its newest window versions."""
    folder = str(tmp_path / "windows")
    apply = sinks.upsert_into(spark, folder, "input_events")
    edge, _ = batch_windows(spark, topo, events(spark, topo, range(0, 300, 100)))
    more, _ = batch_windows(spark, topo, events(spark, topo, range(0, 900, 100)))
    apply(edge.drop("window"), 0)
    apply(more.drop("window"), 1)
    assert rows(sinks.upserted(spark, folder)) == rows(more)
