"""Keyed state on a stream: running numbers, edge changes, windows that close by timers.

The processors hold one small state per key. What a key gets in one micro-batch is put in order by the processor, so the
size of micro-batches (``files_per_batch`` of the source) bounds what a task holds.
"""

from __future__ import annotations

import sys
import time
from datetime import datetime, timezone

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from skyloom.functions import stats
from skyloom.operators.replay import numbered_events
from skyloom.operators.windows import measured_events
from skyloom.params import MEASURES, SCHEMA_VERSION, Measure, WindowSizes
from skyloom.plans.tables import new_path
from skyloom.streaming.queries import state_settings

ROWS = 10_000  # of a numbered batch

# Processors travel with their code, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _in_order(rows, columns: list[str]) -> list[Row]:
    """Rows of one key and micro-batch; nulls first."""
    return sorted(rows, key=lambda row: [(row[c] is not None, row[c]) if row[c] is not None else (False,) for c in columns])


def _to_bytes(rows: pa.RecordBatch) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, rows.schema) as stream:
        stream.write_batch(rows)
    return out.getvalue().to_pybytes()


def _by_bucket(batches):
    """For each batch and bucket one row, which holds the bucket's rows as an Arrow stream."""
    for batch in batches:
        if not batch.num_rows:
            continue
        buckets = batch.column("_bucket").to_numpy()
        order = np.argsort(buckets, kind="stable")
        rows, buckets = batch.drop_columns(["_bucket"]).take(pa.array(order)), buckets[order]
        cuts = [0, *(np.flatnonzero(np.diff(buckets)) + 1).tolist(), len(buckets)]
        yield pa.record_batch({"_bucket": buckets[cuts[:-1]], "rows": pa.array([_to_bytes(rows.slice(x, y - x)) for x, y in zip(cuts, cuts[1:])], pa.binary())})


def _from_bytes(batches):
    for batch in batches:
        for data in batch.column("rows"):
            yield from pa.ipc.open_stream(data.as_buffer())


class SequenceCounter(StatefulProcessor):
    """Numbers the rows of each sensor from 1, on and on over micro-batches and restarts.

    A key is a bucket of sensors: its rows come and go as Arrow streams, and one state has the last number of each of its sensors.
    """

    def __init__(self, order: list[str], names: list[str], sensor: str):
        self.order, self.names, self.sensor = order, names, sensor

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", f"sensors ARRAY<{self.sensor}>, numbers ARRAY<BIGINT>")

    def handleInputRows(self, key, rows, timerValues):
        held = self.last.get()
        last = dict(zip(*held)) if held else {}
        table = pa.Table.from_batches([batch for row in rows for batch in pa.ipc.open_stream(row["rows"])])
        table = table.take(pc.sort_indices(table, [(c, "ascending") for c in self.order], null_placement="at_start"))
        sensors = table["sensor_id"].combine_chunks().dictionary_encode(null_encoding="encode")
        codes, sensors = sensors.indices.to_numpy(), sensors.dictionary.to_pylist()
        counts, before = np.bincount(codes, minlength=len(sensors)), np.array([last.get(s, 0) for s in sensors])
        together, numbers = np.argsort(codes, kind="stable"), np.empty(len(codes), np.int64)  # the rows of each sensor in order
        numbers[together] = np.arange(1, len(codes) + 1) + np.repeat(before - np.cumsum(counts) + counts, counts)
        for batch in table.select(self.names).append_column("sequence", pa.array(numbers)).to_batches(max_chunksize=ROWS):
            yield Row(rows=_to_bytes(batch))
        last.update(zip(sensors, (before + counts).tolist()))
        self.last.update((list(last), list(last.values())))

    def close(self) -> None:
        pass


def sensor_event_stream(routed: DataFrame, tie: list[str], emitted_at: Column | None = None, buckets: int = 1024) -> DataFrame:
    """As ``replay.sensor_events`` on a stream: numbers go on where the last micro-batch ended.

    Rows of one micro-batch are numbered in (event_time, tie) order, micro-batches as they come; a row that comes late gets the next
    number, not one between others. Rows need a sensor. Sensors share ``buckets`` keys by hash. A task holds the rows that one bucket
    gets in a micro-batch and the last numbers of its sensors, so many millions of sensors want more buckets. A
    checkpoint belongs to its number of buckets.
    """
    names = ["sensor_id", "location_id", "event_time", "measurements", "edge_id", "macroarea_id"]
    needed = routed.select(*dict.fromkeys([*names, *tie])).withColumn("_bucket", F.pmod(F.xxhash64("sensor_id"), F.lit(buckets)))
    packed = needed.repartition("_bucket").mapInArrow(_by_bucket, "_bucket BIGINT, rows BINARY")
    counter = SequenceCounter(["event_time", *tie], names, needed.schema["sensor_id"].dataType.simpleString())
    numbered = packed.groupBy("_bucket").transformWithState(counter, "rows BINARY", "Append", "None")
    schema = StructType([*[needed.schema[c] for c in names], StructField("sequence", LongType())])
    return numbered_events(numbered.mapInArrow(_from_bytes, schema), emitted_at)


_CHANGE = "sensor_id STRING, home_edge STRING, edge_id STRING, event_id STRING, sequence BIGINT, observed_at TIMESTAMP"


class EdgeGuard(StatefulProcessor):
    """The first event of a sensor on each edge that is not its own; its own is that of its first event."""

    def __init__(self, order: list[str], seconds: int):
        self.order, self.ttl = order, seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.home = handle.getValueState("home", "edge STRING", self.ttl)
        self.seen = handle.getMapState("seen", "edge STRING", "since TIMESTAMP", self.ttl)

    def handleInputRows(self, key, rows, timerValues):
        home, met = self.home.get(), set()
        home = home[0] if home else None
        for row in _in_order(rows, self.order):
            if home is None:
                home = row["edge_id"]
            elif row["edge_id"] != home and row["edge_id"] not in met:
                met.add(row["edge_id"])
                if not self.seen.containsKey((row["edge_id"],)):
                    self.seen.updateValue((row["edge_id"],), (row["observed_at"],))
                    yield Row(sensor_id=key[0], home_edge=home, edge_id=row["edge_id"], event_id=row["event_id"], sequence=row["sequence"], observed_at=row["observed_at"])
        if home is not None:
            self.home.update((home,))  # a sensor that still sends keeps its edge

    def close(self) -> None:
        pass


def edge_change_stream(events: DataFrame, tie: list[str], seconds: int = 86_400) -> DataFrame:
    """First events of sensors on another edge than their own, as they happen.

    A sensor's edge is forgotten when it has sent nothing for ``seconds``, and a change is reported again after
    as long. Events without a sensor, an edge or a time take no part.
    """
    whole = events.filter("sensor_id IS NOT NULL AND edge_id IS NOT NULL AND observed_at IS NOT NULL")
    needed = whole.select("sensor_id", "edge_id", "event_id", "sequence", "observed_at", *[c for c in tie if c not in ("sequence", "event_id")])
    return needed.groupBy("sensor_id").transformWithState(EdgeGuard(["observed_at", *tie], seconds), _CHANGE, "Append", "ProcessingTime")


_KEYS = ["edge_id", "macroarea_id", "window_start", "part"]
_COUNTERS = ["input_events", "missing_values", "invalid_values"]


def _summary_fields(names: list[str]) -> list[tuple[str, str]]:
    return [(f"{n}_{f}", "BIGINT" if f == "count" else "DOUBLE") for n in names for f in stats.FIELDS]


class WindowCloser(StatefulProcessor):
    """The windows of one place and day; each comes out when nothing has been added to it for ``idle`` seconds.

    All windows of a key are one state with one timer, for the earliest that is due: a day has a bounded number of them. Their
    starts are microseconds, the same number in rows and in state whatever the worker's time zone.
    """

    def __init__(self, names: list[str], summary: list[tuple[str, str]], idle: float, keep: float):
        self.names, self.idle, self.keep = names, int(idle * 1000), int(keep * 1000)
        held = [("start", "BIGINT"), ("due", "BIGINT"), ("sensors", "ARRAY<STRING>"), *[(c, "BIGINT") for c in _COUNTERS], *summary]
        self.schema = f"windows ARRAY<STRUCT<{', '.join(f'{c}: {t}' for c, t in held)}>>"
        self.row = Row(*_KEYS, "sensor_count", *_COUNTERS, *[c for c, _ in summary])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.day = handle.getValueState("day", self.schema, self.keep)

    def handleInputRows(self, key, rows, timerValues):
        held = self.day.get()
        windows = {w[0]: (w[1], set(w[2]), list(w[3:6]), list(w[6:])) for w in held[0]} if held else {}
        timer = min((w[0] for w in windows.values() if w[0] is not None), default=None)  # registered already
        due = timerValues.getCurrentProcessingTimeInMs() + self.idle
        for row in rows:
            _, sensors, counts, sums = windows.get(row["window_start"]) or (None, set(), [0, 0, 0], [0, None, None, 0.0, 0.0] * len(self.names))
            sensors.add(row["sensor_id"])
            for i, n in enumerate((1, row["missing_values"], row["invalid_values"])):
                counts[i] += n
            for i, name in enumerate(self.names):
                x = row[name]
                if x is not None:
                    n, low, high, total, squares = sums[5 * i:5 * i + 5]
                    sums[5 * i:5 * i + 5] = n + 1, x if low is None else min(low, x), x if high is None else max(high, x), total + x, squares + x * x
            windows[row["window_start"]] = (due, sensors, counts, sums)
        if timer is None:
            self.handle.registerTimer(due)
        self.day.update(([(start, w[0], sorted(w[1]), *w[2], *w[3]) for start, w in windows.items()],))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        held = self.day.get()
        if held is None:
            return
        now, kept = expiredTimerInfo.getExpiryTimeInMs(), []
        for start, due, sensors, *values in held[0]:
            if due is not None and due <= now:  # else rows have come since, or it is out already
                due = None
                yield self.row(key[0], key[1], start, key[3], len(sensors), *values)
            kept.append((start, due, sensors, *values))
        self.day.update((kept,))
        later = min((w[1] for w in kept if w[1] is not None), default=None)
        if later is not None:
            self.handle.registerTimer(later)

    def close(self) -> None:
        pass


def closing_window_stream(
    events: DataFrame,
    sizes: WindowSizes = WindowSizes(),
    measures: tuple[Measure, ...] = MEASURES,
    idle_seconds: float = 60,
    keep_seconds: float = 86_400,
    parts: int = 1,
) -> DataFrame:
    """Edge windows of accepted events that close by timers; needs no later event and no message that ends the trace.

    A window comes out once nothing has been added to it for ``idle_seconds`` of clock time. It is kept for ``keep_seconds`` more: rows
    that come meanwhile are added, and it comes out again with more ``input_events``. Keys are edges and days; ``parts`` cuts them further by
    sensor, so that a hot edge is many keys. :func:`newest_windows` puts versions and parts together.
    """
    size = sizes.edge_seconds * 1_000_000
    at = F.unix_micros("observed_at")
    names = [m.name for m in measures]
    keyed = measured_events(events, measures).select(
        "edge_id", "macroarea_id", F.to_date("observed_at").alias("day"), (at - F.pmod(at, F.lit(size))).alias("window_start"),
        F.pmod(F.xxhash64("sensor_id"), F.lit(parts)).cast("int").alias("part"), "sensor_id", "missing_values", "invalid_values", *names)
    out = ["edge_id STRING", "macroarea_id STRING", "window_start BIGINT", "part INT", "sensor_count BIGINT", *[f"{c} BIGINT" for c in _COUNTERS],
           *[f"{c} {t}" for c, t in _summary_fields(names)]]
    closer = WindowCloser(names, _summary_fields(names), idle_seconds, keep_seconds)
    rows = keyed.groupBy("edge_id", "macroarea_id", "day", "part").transformWithState(closer, ", ".join(out), "Append", "ProcessingTime")
    return rows.withColumn("window_start", F.timestamp_micros("window_start"))


def newest_windows(rows: DataFrame, sizes: WindowSizes = WindowSizes(), measures: tuple[Measure, ...] = MEASURES) -> DataFrame:
    """Edge windows from what :func:`closing_window_stream` has written: of each part the version with most events, then all parts as one."""
    values = [c for c in rows.columns if c not in _KEYS]
    newest = rows.groupBy(*_KEYS).agg(F.max_by(F.struct(*values), "input_events").alias("v")).select(*_KEYS, "v.*")
    merged = newest.groupBy("edge_id", "macroarea_id", "window_start").agg(
        *[F.sum(c).alias(c) for c in ("sensor_count", *_COUNTERS)], *[a for m in measures for a in stats.merge(m.name)])
    return merged.select(
        F.lit(SCHEMA_VERSION).alias("schema_version"), F.concat_ws(":", "edge_id", F.unix_seconds("window_start").cast("string")).alias("window_id"),
        "edge_id", "macroarea_id", "window_start", F.timestamp_micros(F.unix_micros("window_start") + sizes.edge_seconds * 1_000_000).alias("window_end"),
        "input_events", "sensor_count", "missing_values", "invalid_values", *[c for c, _ in _summary_fields([m.name for m in measures])])


def run_until_quiet(
    spark: SparkSession, df: DataFrame, label: str, quiet_seconds: float = 0, checkpoint: str | None = None, path: str | None = None,
    partitions: int | None = None, timeout_seconds: float = 3600,
) -> DataFrame:
    """Run a stream with timers or a time to live into the shared folder until its input is used up and ``quiet_seconds`` have passed.

    Such a query goes on for ever, as a timer may be due without any input; it is stopped after two batches without input, of which
    the last began ``quiet_seconds`` after the last one with input had ended. (A restarted query first repeats a batch that was not finished,
    which may have had none.)
    """
    path = path or new_path(spark, label)
    with state_settings(spark, partitions):
        query = (df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint or f"{path}-checkpoint")
                 .trigger(processingTime="1 second").start(path))
    used, seen, empty = time.time(), -1, 0
    end = used + timeout_seconds
    while query.isActive and time.time() < end:
        for p in query.recentProgress:
            if p["batchId"] <= seen:
                continue
            seen = p["batchId"]
            began = datetime.fromisoformat(p["timestamp"].replace("Z", "+00:00")).astimezone(timezone.utc).timestamp()
            if p["numInputRows"]:
                used, empty = began + p["durationMs"]["triggerExecution"] / 1000, 0
                continue
            empty += 1
            if empty > 1 and began >= used + quiet_seconds:
                query.stop()
                break
        time.sleep(0.1)
    query.stop()
    if query.exception() is not None:
        raise query.exception()
    return spark.read.schema(df.schema).parquet(path)
