"""Writers of result tables, traces, and message envelopes."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyloom.functions import stats
from skyloom.functions.clean import strip
from skyloom.functions.messages import TIME_FORMAT, encode_event, topic
from skyloom.params import EDGE_WINDOW_PARTITIONS, MEASURES, TOPIC_TEMPLATE, Measure
from skyloom.sources.commits import CommitLog
from skyloom.sources.footprint import file_footprint

# Fixed value: columns of the exported result tables, in output order.
EXPORTS = {
    "edge_k_metrics": [
        "k", "inertia", "silhouette", "min_sensors", "mean_sensors", "max_sensors", "mean_distance_km",
        "p95_distance_km", "max_radius_km", "mean_load_eps", "max_load_eps", "load_cv", "max_load_factor",
    ],
    "edge_population_summary": [
        "edge_id", "sensors", "rows", "rows_per_day", "natural_events_per_second", "load_share_pct",
        "mean_distance_km", "p95_distance_km", "max_radius_km", "centroid_x_km", "centroid_y_km", "edge_cluster",
    ],
    "edge_centroids": ["edge_cluster", "edge_id", "centroid_x_km", "centroid_y_km"],
    "europe_topology": [
        "sensor_id", "macroarea_id", "edge_cluster", "edge_id", "lat", "lon", "x_km", "y_km", "rows",
        "rows_per_day", "distance_to_edge_km",
    ],
    "workload_by_edge": [
        "edge_id", "population_sensors", "population_share_pct", "sensor_quota", "selected_sensors",
        "workload_share_pct", "edge_cluster",
    ],
    "workload_edge_summary": [
        "edge_cluster", "edge_id", "sensors", "rows", "rows_per_day", "natural_events_per_second",
        "load_share_pct", "target_events_per_second",
    ],
    "kmeans_topology": [
        "sensor_id", "macroarea_id", "edge_id", "lat", "lon", "x_km", "y_km", "rows", "rows_per_day",
        "distance_to_edge_km",
    ],
    "replay_load_scenarios": ["replay_factor", "total_events_per_second"],
}
# Fixed value: sort column of each exported table.
EXPORT_ORDER = {
    "edge_k_metrics": "k", "edge_population_summary": "edge_cluster", "edge_centroids": "edge_cluster",
    "europe_topology": "sensor_id", "workload_by_edge": "edge_cluster", "workload_edge_summary": "edge_cluster",
    "kmeans_topology": "sensor_id", "replay_load_scenarios": "replay_factor",
}


def write_text_table(df: DataFrame, path: str, separator: str = ",", mode: str = "overwrite") -> None:
    """Delimited text with a header; blanks at the ends of values are kept."""
    df.write.csv(
        path, mode=mode, sep=separator, header=True, quote='"', escape='"',
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )


def export_tables(tables: dict[str, DataFrame], folder: str) -> list[str]:
    """Write result tables as ``<folder>/<name>``, with fixed column order and sorting."""
    unknown = set(tables) - set(EXPORTS)
    if unknown:
        raise ValueError(f"unknown export tables: {sorted(unknown)}")
    written = []
    for name, df in tables.items():
        ordered = df.select(*EXPORTS[name]).orderBy(EXPORT_ORDER[name])
        write_text_table(ordered, f"{folder}/{name}")
        written.append(f"{folder}/{name}")
    return written


_EXPORTED = "name STRING, path STRING, rows BIGINT, columns STRING, checksum STRING"


def export_set(tables: dict[str, DataFrame], folder: str) -> DataFrame:
    """Write result tables so that readers see all of them or none; gives the manifest: name, path, rows, columns, checksum.

    Every table goes to a place of its own. Rows and checksum are taken from the files as they lie there. One commit then names the
    manifest, and with it all tables of the set; an export that stops before it changes nothing for readers.
    """
    spark = next(iter(tables.values())).sparkSession
    log = CommitLog(spark, folder)
    place = log.new_data()
    lines = []
    for name, path in zip(tables, export_tables(tables, place)):
        lines.append((name, path, *_content(spark, path)))
    manifest = spark.createDataFrame(lines, _EXPORTED)
    manifest.coalesce(1).write.parquet(f"{place}/_manifest")
    last = log.last_batch(log.lines(), "export")
    log.commit("export", 0 if last is None else last + 1, [("manifest", f"{place}/_manifest", len(lines))])
    return manifest


def _content(spark: SparkSession, path: str) -> tuple[int, str, str]:
    """Rows, columns, and a checksum of a written table, whatever the order of its rows."""
    rows = _read_text_table(spark, path)
    # null and text are hashed apart; a sum counts repeated rows, as exclusive or would not
    each = F.xxhash64(*[F.struct(F.col(f"`{c}`").isNull(), F.col(f"`{c}`")) for c in rows.columns]).cast("decimal(38,0)")
    n, total = rows.agg(F.count("*"), F.sum(each)).first()
    return n, ",".join(rows.columns), str(total or 0)


def _read_text_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, quote='"', escape='"', inferSchema=False)


def _manifest(spark: SparkSession, folder: str) -> list:
    paths = CommitLog(spark, folder).paths("manifest")
    if not paths:
        raise ValueError(f"no committed export in {folder}")
    return spark.read.schema(_EXPORTED).parquet(*paths).collect()  # a row per table


def exported_paths(spark: SparkSession, folder: str) -> dict[str, str]:
    """Where the tables of the newest committed export lie."""
    return {r["name"]: r["path"] for r in _manifest(spark, folder)}


def exported(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of the newest committed export, as text; fails if one is missing or not what the manifest says."""
    out = {}
    for name, path, *said in _manifest(spark, folder):
        try:
            found = _content(spark, path)
        except AnalysisException as missing:
            raise ValueError(f"table {name} of the export is missing") from missing
        if list(found) != said:
            raise ValueError(f"table {name} of the export is not whole: {found} instead of {tuple(said)}")
        out[name] = _read_text_table(spark, path)
    return out


def write_trace(trace: DataFrame, path: str, event_time: str, sensor: str, separator: str = ";") -> DataFrame:
    """Write a trace ordered by (time, sensor); returns one row (rows, files, bytes) counted from the files.

    Rows equal in both are ordered by content. The last sort column only lets a
    run of equal rows spread over several tasks.
    """
    spark, names = trace.sparkSession, [c for c in trace.columns if c != event_time]
    ordered = (
        trace.withColumns({"_content": F.xxhash64(*names), "_spread": F.monotonically_increasing_id()})
        .orderBy(event_time, sensor, "_content", "_spread")
        .select(*names)
    )
    write_text_table(ordered, path, separator)
    return trace_summary(spark, path, separator)


def trace_summary(spark: SparkSession, path: str, separator: str = ";") -> DataFrame:
    """One row (rows, files, bytes) of a written trace."""
    written = spark.read.csv(path, sep=separator, header=True, quote='"', escape='"', inferSchema=False)
    size = file_footprint(spark, path)
    return written.agg(
        F.count("*").alias("rows"),
    ).select("rows", size.select("files").scalar().alias("files"), size.select("bytes").scalar().alias("bytes"))


def event_envelope(events: DataFrame, template: str = TOPIC_TEMPLATE) -> DataFrame:
    """(topic, key, value) rows, the frame that ``write(Stream).format("kafka")`` takes.

    Events without a sensor or edge id have a NULL topic and are left out, see
    :func:`unpublishable`.
    """
    target = topic(F.col("edge_id"), F.col("sensor_id"), template)
    return events.select(
        target.alias("topic"), F.col("sensor_id").alias("key"), encode_event().alias("value")
    ).filter("topic IS NOT NULL")


def unpublishable(events: DataFrame) -> DataFrame:
    """Events that have no topic, with the reason."""
    reason = F.when(F.coalesce(strip(F.col("sensor_id")), F.lit("")) == "", "empty sensor_id").when(
        F.coalesce(strip(F.col("edge_id")), F.lit("")) == "", "empty edge_id"
    )
    return events.withColumn("reject_reason", reason).filter("reject_reason IS NOT NULL")


def window_envelope(windows: DataFrame, target: str, measures: tuple[Measure, ...] = MEASURES) -> DataFrame:
    """Windows as (topic, key, value); the key is the macroarea."""
    flat = {f"{m.name}_{f}" for m in measures for f in stats.FIELDS}
    names = [c for c in windows.columns if c not in flat]
    record = F.struct(*[F.col(c) for c in names], stats.as_map(m.name for m in measures).alias("metrics"))
    return windows.select(
        F.lit(target).alias("topic"), F.col("macroarea_id").alias("key"),
        F.to_json(record, {"timestampFormat": TIME_FORMAT}).alias("value"),
    )


def partitioned_by_key(envelope: DataFrame, partitions: int = EDGE_WINDOW_PARTITIONS) -> DataFrame:
    """Hash the envelope over the topic's partitions, for a file sink that mirrors the topic."""
    return envelope.repartition(partitions, "key")


def upsert_windows(existing: DataFrame, updates: DataFrame, version: str, key: str = "window_id") -> DataFrame:
    """One row per key: the one with the highest version; an update wins a tie.

    The rank filter is pushed below the shuffle, so each task sends at most one
    row per key.
    """
    both = existing.withColumn("_new", F.lit(0)).unionByName(updates.withColumn("_new", F.lit(1)))
    w = W.partitionBy(key).orderBy(F.desc(version), F.desc("_new"), F.xxhash64(*existing.columns))
    return both.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank", "_new")


# Fixed value: day of a window from its id, "<place>:<start in epoch seconds>".
WINDOW_DAY = "coalesce(cast(date(timestamp_seconds(try_cast(substring_index(window_id, ':', -1) AS BIGINT))) AS STRING), 'none')"


def upsert_into(
    spark: SparkSession, folder: str, version: str, key: str = "window_id", day: str = WINDOW_DAY, every: int = 20, keep_seconds: float = 86_400,
):
    """A ``foreachBatch`` function that keeps a parquet table of the newest row per key.

    A batch writes the days it touches anew and commits them to the log at once: a repeated batch is skipped, and a query that
    starts over with batch 0 goes on from what is there. The log is folded every ``every`` commits, and replaced versions of a day
    go ``keep_seconds`` later, which must be longer than any reader takes.
    """
    own, log = uuid.uuid4().hex, CommitLog(spark, folder, every=every, keep_seconds=keep_seconds, called="day")

    def apply(batch: DataFrame, batch_id: int) -> None:
        query, lines = query_of(batch) or own, log.lines()
        last = log.last_batch(lines, query)
        if last is not None and batch_id <= last:
            return
        rows = batch.withColumn("_day", F.expr(day))
        touched = [r[0] for r in rows.select("_day").distinct().collect()]  # days of one micro-batch
        if not touched:
            return
        held = lines.filter(F.col("name").isin(touched)).select("path").collect()
        existing = spark.read.schema(batch.schema).parquet(*[r[0] for r in held]) if held else batch.limit(0)
        path = log.new_data()
        upsert_windows(existing, batch, version, key).withColumn("_day", F.expr(day)).write.partitionBy("_day").parquet(path)
        log.commit(query, batch_id, [(d, f"{path}/_day={d}", None) for d in touched])

    return apply


def query_of(batch: DataFrame) -> str | None:
    """Id of the streaming query that a micro-batch belongs to."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")


def upserted(spark: SparkSession, folder: str) -> DataFrame | None:
    """The table that :func:`upsert_into` keeps, as last committed; None before the first commit."""
    paths = CommitLog(spark, folder).paths()  # one per day
    return spark.read.parquet(*paths) if paths else None
