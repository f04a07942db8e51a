"""Late rows, commits of several tables, keyed state and timers."""

import os

import pytest
from pyspark.sql import functions as F

from skyloom.operators import ingest, replay, windows
from skyloom.params import MEASURES, WindowSizes
from skyloom.sources import sinks
from skyloom.sources.commits import LINE, CommitLog
from skyloom.sources.stream import message_files
from skyloom.streaming import keyed, targets
from skyloom.streaming import queries as streams
from tests.test_streaming import events, publish, rows, topo  # noqa: F401

SIZES = WindowSizes(lateness_seconds=100)


def one_file(spark, topo, path, times, sensor="1"):
    publish(events(spark, topo, times).filter(F.col("sensor_id") == sensor), path, "append")


def test_late_rows_over_micro_batches(spark, topo, tmp_path):  # noqa: F811
    path, folder, checkpoint = (str(tmp_path / n) for n in ("messages", "tables", "checkpoint"))
    seen = [("1", [10, 1_000]), ("2", [20, 299, 590, 700, 3_000]), ("3", [2_500, 2_690, 2_700, 2_900, 5_000, 30])]
    for i, (sensor, times) in enumerate(seen):
        one_file(spark, topo, path, times, sensor)
        for f in os.listdir(path):  # files are read in the order of their modification time
            at = os.stat(f"{path}/{f}").st_mtime_ns
            if at > 10 ** 18:
                os.utime(f"{path}/{f}", ns=(10 ** 15 * (i + 1),) * 2)
    judged = streams.ingest(message_files(spark, path, files_per_batch=1), topo)
    targets.run_batches(judged, targets.write_together(spark, folder, targets.split_late(SIZES)), checkpoint)
    late = targets.committed(spark, folder, "late")
    # marks: none, 1 000 - 100, 3 000 - 100; a window is late when its end is reached
    assert sorted((r["sensor_id"], r["sequence"], r["lag_seconds"], r["reason"]) for r in late.collect()) == [
        ("2", 20, 880.0, "window closed"), ("2", 299, 601.0, "window closed"), ("2", 590, 310.0, "window closed"), ("2", 700, 200.0, "window closed"),
        ("3", 30, 2870.0, "window closed"), ("3", 2500, 400.0, "window closed"), ("3", 2690, 210.0, "window closed")]
    row = targets.reconciled(spark, folder).first()
    assert (row["windowed"], row["late"], row["rejected"]) == (6, 7, 0)
    assert [r["rows"] for r in targets.progress(spark, folder).filter("name = 'late'").orderBy("batch_id").collect()] == [0, 4, 3]


def test_parts_of_one_sensor_and_window_are_merged(spark, topo, tmp_path):  # noqa: F811
    folder = str(tmp_path / "tables")
    apply = targets.write_together(spark, folder, targets.split_late(SIZES))
    assert targets.committed(spark, folder, "parts") is None
    wire = events(spark, topo, range(0, 900, 50))
    judged = ingest.judge(ingest.decode_messages(sinks.event_envelope(wire)), topo)
    for i in range(3):
        apply(judged.filter(F.col("sequence") % 3 == i), i)
    want = windows.edge_windows(windows.measured_events(ingest.accepted(judged)))
    late = targets.committed(spark, folder, "late").count()
    got = targets.windows_from(targets.committed(spark, folder, "parts"))
    assert late > 0 and got.agg(F.sum("input_events")).first()[0] + late == want.agg(F.sum("input_events")).first()[0]
    apply(judged.limit(0), 3)
    assert rows(targets.windows_from(targets.committed(spark, folder, "parts"))) == rows(got)


def test_a_failed_batch_leaves_each_table_once(spark, topo, tmp_path, monkeypatch):  # noqa: F811
    path, folder, checkpoint = (str(tmp_path / n) for n in ("wire", "tables", "checkpoint"))
    wire = events(spark, topo, range(0, 200, 50)).withColumn("sensor_id", F.when(F.col("sequence") == 50, " ").otherwise(F.col("sensor_id")))
    wire.write.parquet(path)
    stream = spark.readStream.schema(wire.schema).parquet(path)
    commit, failures = CommitLog.commit, iter([True, False])

    def killed(self, *args):
        if next(failures):
            raise RuntimeError("killed between data and commit")
        commit(self, *args)

    monkeypatch.setattr(CommitLog, "commit", killed)
    with pytest.raises(Exception, match="killed between data and commit"):
        targets.run_batches(stream, targets.write_together(spark, folder, targets.split_routes()), checkpoint)
    assert targets.committed(spark, folder, "envelopes") is None
    targets.run_batches(stream, targets.write_together(spark, folder, targets.split_routes()), checkpoint)
    counts = {n: targets.committed(spark, folder, n).count() for n in ("envelopes", "rejects", "counts")}
    assert counts == {"envelopes": 39, "rejects": 13, "counts": 4}
    assert len(os.listdir(f"{folder}/data")) == 2
    CommitLog(spark, folder, latest=False, keep_seconds=0).clean()
    assert len(os.listdir(f"{folder}/data")) == 1 and targets.committed(spark, folder, "envelopes").count() == 39


def test_upsert_killed_between_data_and_commit(spark, topo, tmp_path, monkeypatch):  # noqa: F811
    folder = str(tmp_path / "table")
    small = windows.edge_windows(windows.measured_events(events(spark, topo, [0, 10]).filter("sensor_id <> '99'").withColumn("macroarea_id", F.lit("m")))).drop("window")
    more = windows.edge_windows(windows.measured_events(events(spark, topo, [0, 10, 20]).filter("sensor_id <> '99'").withColumn("macroarea_id", F.lit("m")))).drop("window")
    apply = sinks.upsert_into(spark, folder, "input_events")
    apply(small, 0)
    with monkeypatch.context() as m:
        m.setattr(CommitLog, "commit", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            apply(more, 1)
    assert rows(sinks.upserted(spark, folder)) == rows(small)
    # and one that was killed while the commit was written
    os.makedirs(f"{folder}/log/{2:020d}")
    assert rows(sinks.upserted(spark, folder)) == rows(small)
    for batch in (1, 1, 0):
        apply(more, batch)
    assert rows(sinks.upserted(spark, folder)) == rows(more)


def test_the_work_of_a_commit_stays_constant(spark, tmp_path):
    folder = str(tmp_path / "log")
    for latest in (True, False):
        log = CommitLog(spark, f"{folder}-{latest}", latest=latest, every=4, keep_seconds=0)
        for batch in range(14):
            assert log.last_batch(log.lines(), "q") == (batch - 1 if batch else None)
            path = log.new_data()
            spark.range(1).write.parquet(f"{path}/x")
            log.commit("q", batch, [(f"day{batch % 3}", f"{path}/x", batch)], batch * 10)
            assert len(log._open()[2]) < 4
        assert log.lines().agg(F.max("high")).first()[0] == 130
        assert len(os.listdir(f"{log.folder}/log")) <= 4 and len(os.listdir(f"{log.folder}/snapshot")) == 1
        got = sorted((r["name"], r["rows"]) for r in log.lines().filter("name IS NOT NULL").collect())
        assert got == sorted([("day0", 12), ("day1", 13), ("day2", 11)] if latest else [(f"day{b % 3}", b) for b in range(14)])
        assert all(spark.read.parquet(p).count() == 1 for p in log.paths())


def test_a_log_of_plain_folders_goes_on(spark, tmp_path):
    """Commits of the former layout count, are gone on from, and are folded with those of the present one."""
    folder = str(tmp_path / "log")
    log = CommitLog(spark, folder, latest=False, every=4, keep_seconds=0, called="day")
    for batch in range(3):
        path = log.new_data()
        spark.range(1).write.parquet(f"{path}/x")
        if batch < 2:
            spark.createDataFrame([("q", batch, batch + 1, f"day{batch}", f"{path}/x", batch, batch)], LINE).write.parquet(f"{folder}/log/{batch + 1:020d}")
        else:
            log.commit("q", batch, [(f"day{batch}", f"{path}/x", batch)], batch)
    assert log.last_batch(log.lines(), "q") == 2 and len(log.paths()) == 3
    assert [r["day"] for r in spark.read.parquet(f"{folder}/log/commit={3:020d}").collect()] == ["day2"]
    log.commit("q", 3, [], 3)
    assert os.listdir(f"{folder}/log") == [f"commit={4:020d}"]
    assert log.last_batch(log.lines(), "q") == 3 and sorted(r["rows"] for r in log.lines().filter("name IS NOT NULL").collect()) == [0, 1, 2]


def test_numbers_go_on_over_runs(spark, topo, tmp_path):  # noqa: F811
    path, out, checkpoint = (str(tmp_path / n) for n in ("records", "out", "checkpoint"))
    records = replay.route(events(spark, topo, range(0, 60, 10)).select(
        "sensor_id", F.lit("9").alias("location_id"), F.col("observed_at").alias("event_time"), "measurements", "sequence").drop("edge_id"), topo).filter("edge_id IS NOT NULL")
    records = records.withColumnRenamed("sequence", "line")

    def run(part):
        part.write.mode("append").parquet(path)
        stream = keyed.sensor_event_stream(spark.readStream.schema(part.schema).parquet(path), ["line"])
        with streams.state_settings(spark):
            query = streams.start(stream, out, checkpoint)
        query.awaitTermination()
        assert query.exception() is None
        return spark.read.schema(stream.schema).parquet(out)

    run(records.filter("line < 30"))
    got = run(records.filter("line >= 30"))
    want = replay.sensor_events(records, ["line"])
    key = lambda df: sorted((r["event_id"], r["sequence"], str(r["measurements"])) for r in df.collect())
    assert key(got) == key(want)
    # a row that comes late gets the next number
    got = run(records.filter("line = 20 AND sensor_id = '3'"))
    assert [r["sequence"] for r in got.filter("sensor_id = '3'").orderBy("sequence").collect()] == [1, 2, 3, 4, 5, 6, 7]
    assert got.filter("sensor_id = '3' AND sequence = 7").select(F.unix_seconds("observed_at")).first()[0] == 20


def test_many_sensors_share_a_state_and_their_rows_go_together(spark, tmp_path):
    path, out, checkpoint = (str(tmp_path / n) for n in ("records", "out", "checkpoint"))
    n = F.col("id")
    records = spark.range(0, 900, 1, 3).select(
        F.when(n % 41 > 0, F.concat(F.lit("s"), (n % 41).cast("string"))).alias("sensor_id"), F.lit("é 9").alias("location_id"),
        F.when(n % 13 > 0, F.timestamp_micros(1_700_000_000_000_001 + n * 7919 % 450)).alias("event_time"),  # nulls and ties
        F.when(n % 7 > 0, F.create_map(F.lit("t"), n.cast("string"), F.lit("h"), F.lit(None).cast("string"))).alias("measurements"),
        F.when(n % 5 > 0, F.lit("edge-1")).alias("edge_id"), F.lit("m").alias("macroarea_id"), F.when(n % 900 > 13, (1 << 60) + n).alias("line"))
    columns = ["event_id", "sensor_id", "location_id", "sequence", F.unix_micros("observed_at").alias("at"), F.to_json("measurements").alias("m"), "edge_id", "macroarea_id"]

    def run(part):
        part.write.mode("append").parquet(path)
        stream = keyed.sensor_event_stream(spark.readStream.schema(part.schema).parquet(path), ["line"], F.lit("2024-01-01").cast("timestamp"), buckets=2)
        with streams.state_settings(spark):
            query = streams.start(stream, out, checkpoint)
        query.awaitTermination()
        assert query.exception() is None
        assert max(s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"]) <= 2
        return rows(spark.read.schema(stream.schema).parquet(out).select(*columns))

    early = records.filter("event_time IS NULL")  # nulls come first, so both orders agree
    run(early)
    got = run(records.filter("event_time IS NOT NULL"))
    assert got == rows(replay.sensor_events(records, ["line"], F.lit("2024-01-01").cast("timestamp")).select(*columns))
    assert len(got) == 900


def test_first_event_on_another_edge(spark, tmp_path):
    path, out, checkpoint = (str(tmp_path / n) for n in ("events", "out", "checkpoint"))
    schema = "sensor_id string, edge_id string, event_id string, sequence long, observed_at timestamp, extra int"
    make = lambda part: spark.createDataFrame([(s, e, f"{s}{n}", n, None if t is None else __import__("datetime").datetime.fromtimestamp(t), 1) for s, e, n, t in part], schema)
    parts = [make([("a", "x", 1, 10), ("a", "y", 2, 20), ("a", "y", 3, 30), ("a", None, 4, 5), (None, "x", 5, 5), ("b", "x", 6, 10), ("b", "x", 7, 10), ("c", "x", 8, None)]),
             make([("a", "z", 11, 40), ("a", "y", 12, 41), ("a", "x", 13, 42), ("b", "y", 14, 50), ("c", "q", 15, 50)])]
    for part in parts:
        part.write.mode("append").parquet(path)
        stream = keyed.edge_change_stream(spark.readStream.schema(part.schema).parquet(path), ["sequence"])
        got = keyed.run_until_quiet(spark, stream, "changes", checkpoint=checkpoint, path=out)
    want = replay.edge_change_events(parts[0].union(parts[1]), ["sequence"])
    assert rows(got) == rows(want)
    assert sorted((r["sensor_id"], r["home_edge"], r["edge_id"], r["sequence"]) for r in got.collect()) == [("a", "x", "y", 2), ("a", "x", "z", 11), ("b", "x", "y", 14)]


def test_windows_close_without_another_event_and_open_again(spark, topo, tmp_path):  # noqa: F811
    path, out, checkpoint = (str(tmp_path / n) for n in ("messages", "out", "checkpoint"))
    wire = events(spark, topo, range(0, 700, 90))

    def run(part):
        publish(part, path, "append")
        judged = streams.ingest(message_files(spark, path), topo)
        stream = keyed.closing_window_stream(ingest.accepted(judged), idle_seconds=1, parts=3)
        return keyed.run_until_quiet(spark, stream, "closed", quiet_seconds=2, checkpoint=checkpoint, path=out)

    def batch(df):
        judged = ingest.judge(ingest.decode_messages(sinks.event_envelope(df)), topo)
        return windows.edge_windows(windows.measured_events(ingest.accepted(judged)))

    first = wire.filter("sequence <> 90")
    assert rows(keyed.newest_windows(run(first))) == rows(batch(first))
    again = run(wire.filter("sequence = 90"))
    assert rows(keyed.newest_windows(again)) == rows(batch(wire))
    assert again.count() > again.select("edge_id", "window_start", "part").distinct().count()
