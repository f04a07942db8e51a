"""One callable per query, (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone
from functools import wraps

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from catalog import views as v
from skyloom.functions import clean, geo, messages, rates, stats
from skyloom.functions.measures import with_measures
from skyloom.operators import clustering, ingest, pairwise, quality, replay, sensors, topology, windows, workload
from skyloom.operators.sweep import sweep_metrics
from skyloom.params import MEASURES, KSweep, TOPIC_TEMPLATE, WindowSizes
from skyloom.plans import invariants
from skyloom.plans.tables import materialize, new_path
from skyloom.sources import observations, sinks
from skyloom.sources.footprint import file_footprint
from skyloom.sources.stream import message_files
from skyloom.sources.topology import load_topology, parse_assignments, topology_conflicts
from skyloom.streaming import keyed, targets
from skyloom.streaming import queries as streams
from skyloom.streaming.progress import ProgressTable

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
NAMES = [m.name for m in MEASURES]
START = datetime(2025, 1, 1, tzinfo=timezone.utc)


def query(fn: Query) -> Query:
    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return run


def r(c: Column | str, digits: int = 6) -> Column:
    return F.round(c, digits)


def us(name: str) -> Column:
    return F.unix_micros(name).alias(name)


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: r(c, digits) for c in columns})


# -- scans ---------------------------------------------------------------------

@query
def preview(spark, sf):
    return observations.preview(v.obs(spark, sf).orderBy("event_id"))


@query
def observation_scan(spark, sf):
    path = new_path(spark, "observations")
    sinks.write_text_table(v.obs(spark, sf), path, separator=";")
    return observations.whole_rows(observations.scan_observations(spark, path), strict=True)


@query
def trace_scan(spark, sf):
    path = new_path(spark, "trace")
    sinks.write_text_table(v.obs(spark, sf), path, separator=";")
    return observations.scan_trace(spark, path).select("sensor_id", "location", "timestamp", *[m.column for m in MEASURES])


@query
def trace_records(spark, sf):
    path = new_path(spark, "trace")
    sinks.write_text_table(v.obs(spark, sf), path, separator=";")
    rows = observations.trace_records(observations.scan_trace(spark, path), keep=("event_id",))
    values = [F.col("measurements")[n].alias(n) for n in NAMES]
    return rows.select("event_id", "sensor_id", "location_id", us("event_time"), *values, "reject_reason")


@query
def topology_scan(spark, sf):
    path = new_path(spark, "topology")
    sinks.write_text_table(v.topo(spark, sf), path)
    return load_topology(spark, path)


# -- cleaning --------------------------------------------------------------------

@query
def parsed_timestamps(spark, sf):
    rows = v.obs(spark, sf).withColumn("t", clean.parse_time(F.col("timestamp")))
    return rows.select("event_id", F.unix_micros("t").alias("event_time"))


@query
def time_filtered(spark, sf):
    return sensors.in_window_rows(v.obs(spark, sf), v.WINDOW).select("event_id", "sensor_id", us("event_time"))


@query
def valid_sensor_rows(spark, sf):
    rows = v.obs(spark, sf).filter(clean.valid_sensor_id(F.col("sensor_id")))
    return rows.select("event_id", clean.clean_text(F.col("sensor_id")).alias("sensor_id"))


@query
def valid_coordinate_rows(spark, sf):
    return clean.located_rows(v.obs(spark, sf)).select("event_id", "lat_num", "lon_num")


@query
def masked_coordinates(spark, sf):
    rows, ok = clean.observation_flags(v.obs(spark, sf), v.WINDOW), F.col("coord_ok")
    return rows.select(
        "event_id", clean.mask(ok, F.col("lat_num")).alias("lat"), clean.mask(ok, F.col("lon_num")).alias("lon")
    )


# -- quality -----------------------------------------------------------------------

def _profile(spark, sf):
    return quality.scan_profile(v.obs(spark, sf), v.WINDOW)


@query
def scan_quality(spark, sf):
    return quality.scan_quality(_profile(spark, sf))


@query
def timestamp_bounds(spark, sf):
    return quality.timestamp_bounds(_profile(spark, sf)).select(*[us(c) for c in quality.BOUNDS])


@query
def column_quality(spark, sf):
    return quality.column_quality(_profile(spark, sf))


@query
def active_rows(spark, sf):
    active = quality.active_columns(_profile(spark, sf))
    return sensors.in_window_rows(v.obs(spark, sf), v.WINDOW).select(*active)


@query
def dataset_summary(spark, sf):
    by_sensor = materialize(quality.scan_by_sensor(v.obs(spark, sf), v.WINDOW), "by-sensor")
    stats_ = sensors.stats_from(by_sensor, v.WINDOW)
    out = quality.dataset_summary(quality.profile_from(by_sensor), stats_, v.WINDOW)
    return out.withColumns({c: F.unix_micros(c) for c in quality.BOUNDS}).withColumn("observed_days", r("observed_days"))


# -- sensors -----------------------------------------------------------------------

SENSOR_COLUMNS = ["sensor_id", "rows", "coordinate_rows", "lat", "lon", "rows_per_day"]


@query
def sensor_stats(spark, sf):
    return rounded(sensors.sensor_stats(v.obs(spark, sf), v.WINDOW), "lat_sum", "lon_sum", "lat", "lon", "rows_per_day")


@query
def located_sensors(spark, sf):
    rows = sensors.located_sensors(sensors.sensor_stats(v.obs(spark, sf), v.WINDOW))
    return rounded(rows.select(*SENSOR_COLUMNS), "lat", "lon", "rows_per_day")


@query
def europe_population(spark, sf):
    rows = sensors.population_in(sensors.located_sensors(sensors.sensor_stats(v.obs(spark, sf), v.WINDOW)))
    return rounded(rows.select(*SENSOR_COLUMNS), "lat", "lon", "rows_per_day")


@query
def sorted_outputs(spark, sf):
    rows = v.population(spark, sf).select("sensor_id", "rows", "rows_per_day").orderBy("sensor_id")
    return rounded(rows, "rows_per_day")


@query
def location_summary(spark, sf):
    return sensors.location_summary(sensors.sensor_stats(v.obs(spark, sf), v.WINDOW))


@query
def population_summary(spark, sf):
    out = sensors.population_summary(v.population(spark, sf))
    return rounded(out, "lat_min", "lat_max", "lon_min", "lon_max", "rows_per_day")


@query
def unique_sensors(spark, sf):
    return sensors.unique_sensors(v.obs(spark, sf), v.WINDOW)


@query
def projected_population(spark, sf):
    return v.population(spark, sf).select("sensor_id", r("x_km", 4).alias("x_km"), r("y_km", 4).alias("y_km"))


# -- topology ------------------------------------------------------------------------

@query
def topology_counts(spark, sf):
    return topology.topology_counts(v.topo(spark, sf))


@query
def edges(spark, sf):
    return topology.edges(v.topo(spark, sf))


@query
def topology_rejects(spark, sf):
    return rounded(parse_assignments(v.topo_raw(spark, sf)), "lat", "lon")


@query
def topology_conflict_rows(spark, sf):
    return topology_conflicts(v.topo_conflicting(spark, sf))


@query
def edge_ids_sorted(spark, sf):
    return topology.edge_ids(v.topo(spark, sf))


@query
def distinct_macroareas(spark, sf):
    return topology.macroareas(v.topo(spark, sf))


@query
def edge_lookup(spark, sf):
    return topology.edge_lookup(v.topo(spark, sf), "edge-m1-1")


@query
def endpoint_coverage(spark, sf):
    return topology.uncovered_edges(v.topo(spark, sf), v.endpoints(spark, sf))


# -- replay --------------------------------------------------------------------------

@query
def routed_events(spark, sf):
    rows = replay.route(v.records(spark, sf), v.topo(spark, sf))
    return rows.select("event_id", "sensor_id", "location_id", us("event_time"), "edge_id", "macroarea_id")


@query
def unknown_sensors(spark, sf):
    rows = replay.unknown_sensors(v.records(spark, sf), v.topo(spark, sf))
    return rows.select("event_id", "sensor_id", us("event_time"))


def _events(spark, sf):
    emitted = F.lit(v.EMITTED_AT).cast("timestamp")
    return replay.sensor_events(v.routed(spark, sf), tie=["event_id"], emitted_at=emitted)


@query
def sensor_events(spark, sf):
    values = [F.col("measurements")[n].alias(n) for n in NAMES]
    return _events(spark, sf).select(
        F.col("schema_version").cast("bigint").alias("schema_version"), "event_id", "sensor_id", "location_id",
        "sequence", us("observed_at"), us("emitted_at"), *values, "edge_id", "macroarea_id",
    )


@query
def replay_schedule(spark, sf):
    rows = replay.replay_schedule(_events(spark, sf), START)
    return rows.select("event_id", us("observed_at"), us("deadline"))


def _stored_trace(spark, sf):
    """The trace in stored order, with every 211th time set back by two hours."""
    return v.records(spark, sf).withColumn(
        "event_time", F.when(F.col("event_id") % 211 == 0, F.col("event_time") - F.expr("INTERVAL 2 HOURS"))
        .otherwise(F.col("event_time")),
    )


@query
def trace_order_violations(spark, sf):
    row = F.col("event_id")
    found = replay.order_violations(_stored_trace(spark, sf), "event_time", [F.floor(row / 65_536)], row)
    return found.select("event_id", us("event_time"), us("previous_event_time"))


@query
def sensor_edge_changes(spark, sf):
    """Judged by the edge that received each event."""
    return replay.edge_changes(v.inbox(spark, sf).withColumnRenamed("receiving_edge", "edge_id"))


@query
def edge_change_events(spark, sf):
    """The first event of a sensor on each edge that is not its own."""
    return _change_columns(replay.edge_change_events(_guarded(spark, sf), ["sequence"]))


def _guarded(spark, sf):
    """Arriving events of named sensors, by the edge that received them."""
    return v.inbox(spark, sf).withColumnRenamed("receiving_edge", "edge_id").filter("sensor_id <> ''")


def _change_columns(rows):
    return rows.select("sensor_id", "home_edge", "edge_id", "event_id", "sequence", us("observed_at"))


@query
def first_n_events(spark, sf):
    rows = replay.first_events(v.records(spark, sf), 1_000, ["event_time", "event_id"])
    return rows.select("event_id", "sensor_id", us("event_time"))


# -- messages ------------------------------------------------------------------------

@query
def event_topics(spark, sf):
    rows = v.routed(spark, sf)
    return rows.select("event_id", messages.topic(F.col("edge_id"), F.col("sensor_id"), TOPIC_TEMPLATE).alias("topic"))


def _wire(spark, sf):
    return v.inbox(spark, sf).withColumnRenamed("receiving_edge", "edge_id")


@query
def event_envelope(spark, sf):
    """Topic and key, with the payload taken apart again by JSON path."""
    out = sinks.event_envelope(_wire(spark, sf))
    field = lambda f: F.get_json_object("value", f"$.{f}")
    return out.select(
        "topic", "key", field("event_id").alias("event_id"), field("sequence").cast("bigint").alias("sequence"),
        field("observed_at").alias("observed_at"), *[field(f"measurements.{n}").alias(n) for n in NAMES],
    )


@query
def unpublishable_events(spark, sf):
    return sinks.unpublishable(_wire(spark, sf)).select("sequence", "reject_reason")


@query
def event_json_roundtrip(spark, sf):
    rows = ingest.decode_messages(sinks.event_envelope(_wire(spark, sf)))
    values = [F.col("measurements")[n].alias(n) for n in NAMES]
    return rows.select(
        "topic", "receiving_edge", "decode_error", F.col("schema_version").cast("bigint").alias("schema_version"),
        "event_id", "sensor_id", "location_id", "sequence", us("observed_at"), us("emitted_at"), *values,
    )


@query
def topic_filter(spark, sf):
    rows = ingest.subscribed(sinks.event_envelope(_wire(spark, sf)), "edge-m1-1")
    return rows.select("topic", "key")


# -- ingest --------------------------------------------------------------------------

def _judged(spark, sf):
    return ingest.judge(v.inbox(spark, sf), v.topo(spark, sf))


@query
def ingest_rejects(spark, sf):
    rows = ingest.rejected(_judged(spark, sf))
    return rows.select("sequence", "event_id", "sensor_id", "receiving_edge", "reject_reason")


@query
def ingest_accepted(spark, sf):
    rows = ingest.accepted(_judged(spark, sf))
    return rows.select("sequence", "event_id", "sensor_id", us("observed_at"), "edge_id", "macroarea_id")


@query
def accepted_count(spark, sf):
    return ingest.accepted_count(_judged(spark, sf))


# -- windows -------------------------------------------------------------------------

def _measured(spark, sf):
    return windows.measured_events(ingest.accepted(_judged(spark, sf)))


def _summary_columns(names=NAMES):
    """Values have at most four decimals once squared, so four digits are exact."""
    out = []
    for n in names:
        out += [F.col(f"{n}_count"), r(f"{n}_min").alias(f"{n}_min"), r(f"{n}_max").alias(f"{n}_max"),
                r(f"{n}_sum", 4).alias(f"{n}_sum"), r(f"{n}_sum_squares", 4).alias(f"{n}_sum_squares")]
    return out


@query
def normalized_measures(spark, sf):
    rows = with_measures(v.obs(spark, sf), {m.name: F.col(m.column) for m in MEASURES}, MEASURES)
    return rows.select("event_id", *[r(n).alias(n) for n in NAMES], "missing_values", "invalid_values")


@query
def quality_counters(spark, sf):
    return windows.quality_counters(_measured(spark, sf), ["edge_id"])


@query
def metric_stats(spark, sf):
    return windows.metric_stats(_measured(spark, sf), ["sensor_id"]).select("sensor_id", *_summary_columns())


@query
def metric_stats_merged(spark, sf):
    per_sensor = windows.metric_stats(_measured(spark, sf), ["edge_id", "sensor_id"])
    out = windows.merged_stats(per_sensor, ["edge_id"])
    extra = [r(f"{n}_{s}").alias(f"{n}_{s}") for n in NAMES for s in ("mean", "std")]
    return out.select("edge_id", *_summary_columns(), *extra)


def _window_columns(keys, counts):
    return [
        "window_id", *keys, F.unix_seconds("window_start").alias("window_start"),
        F.unix_seconds("window_end").alias("window_end"), *counts, *_summary_columns(),
    ]


EDGE_OUT = (["edge_id", "macroarea_id"], ["input_events", "sensor_count", "missing_values", "invalid_values"])
MACRO_OUT = (["macroarea_id"], ["edge_count", "input_events"])


@query
def edge_windows(spark, sf):
    return windows.edge_windows(_measured(spark, sf)).select(*_window_columns(*EDGE_OUT))


@query
def macroarea_windows(spark, sf):
    out = windows.macroarea_windows(windows.edge_windows(_measured(spark, sf)))
    return out.select(*_window_columns(*MACRO_OUT))


@query
def edge_window_envelope(spark, sf):
    out = sinks.window_envelope(windows.edge_windows(_measured(spark, sf)).drop("window"), "edge-windows.v1")
    field = lambda f: F.get_json_object("value", f"$.{f}")
    return sinks.partitioned_by_key(out).select(
        "topic", "key", field("window_id").alias("window_id"),
        field("input_events").cast("bigint").alias("input_events"),
        *[field(f"metrics.{n}.count").cast("bigint").alias(f"{n}_count") for n in NAMES],
        *[r(field(f"metrics.{n}.{f}").cast("double"), 4).alias(f"{n}_{f}") for n in NAMES for f in stats.FIELDS[1:]],
    )


def _macro_versions(spark, sf):
    """Windows of the first half of the trace, and those of the rest, which overlap."""
    rows = materialize(_measured(spark, sf), "measured")
    early = rows.filter(F.col("observed_at") < F.lit("2024-01-15 12:10:00").cast("timestamp"))
    keep = ["window_id", "macroarea_id", "input_events", "edge_count", "version"]

    def macro(events, version):
        out = windows.macroarea_windows(windows.edge_windows(events))
        return out.withColumn("version", F.lit(version).cast("bigint")).select(*keep)

    late = rows.filter(F.col("observed_at") >= F.lit("2024-01-15 12:00:00").cast("timestamp"))
    return macro(early, 1), macro(late, 2)


@query
def upserted_windows(spark, sf):
    """Windows of the first half of the trace, updated by those of the rest."""
    return sinks.upsert_windows(*_macro_versions(spark, sf), "version")


@query
def stream_upsert(spark, sf):
    """As upserted_windows, by two streaming queries: the second has a fresh checkpoint and counts batches from 0."""
    table = new_path(spark, "window-table")
    rows = _macro_versions(spark, sf)
    for version, part in enumerate(rows):
        source = new_path(spark, "versions")
        part.write.parquet(source)
        stream = spark.readStream.schema(part.schema).parquet(source)
        running = (stream.writeStream.foreachBatch(sinks.upsert_into(spark, table, "version"))
                   .option("checkpointLocation", new_path(spark, "checkpoint")).trigger(availableNow=True).start())
        running.awaitTermination()
        if running.exception() is not None:
            raise running.exception()
    return sinks.upserted(spark, table)


# -- rows of the wrong width -----------------------------------------------------------

def _ragged(spark, sf):
    """A trace file with rows that lack two cells, have two more, or a line break inside quotes."""
    path = new_path(spark, "ragged")
    cells = ["sensor_id", "location", "timestamp", *[m.column for m in MEASURES]]
    line = F.concat_ws(";", F.col("event_id").cast("string"), *[F.coalesce(c, F.lit("")) for c in cells])
    two = F.split(line, ";")
    text = (F.when(F.col("event_id") % 7 == 0, F.array(F.array_join(F.slice(two, 1, 5), ";")))
            .when(F.col("event_id") % 11 == 0, F.array(F.concat(line, F.lit(";1;2"))))
            .when(F.col("event_id") % 13 == 0, F.array(F.concat_ws(";", F.get(two, F.lit(0)), F.get(two, F.lit(1)), F.lit('"x')), F.lit('y";1;2')))
            .otherwise(F.array(line)))
    header = ";".join(["event_id", *cells])
    # one column whose name is the header, without quoting: lines as they are, a header in each file
    v.obs(spark, sf).select(F.explode(text).alias(header)).write.csv(
        path, header=True, sep="\x01", quote="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return observations.scan_trace(spark, path)


@query
def ragged_trace_rows(spark, sf):
    rows = observations.trace_records(_ragged(spark, sf), keep=("event_id", observations.BAD_ROW))
    return rows.select("event_id", "sensor_id", us("event_time"), "reject_reason", F.col(observations.BAD_ROW).alias("bad_row"))


@query
def ragged_profile(spark, sf):
    """Rows by what became of them, whole rows first read."""
    rows = observations.trace_records(_ragged(spark, sf))
    return rows.groupBy(F.coalesce("reject_reason", F.lit("good")).alias("reason")).agg(F.count("*").alias("rows"))


# -- zones ---------------------------------------------------------------------------

def _zone_table(spark, sf):
    return clustering.stable_labels(v.zones(spark, sf).drop("edge_id")).withColumn(
        "edge_id", rates.edge_label(F.col("edge_cluster"))
    )


def _zone_topology(spark, sf):
    return materialize(clustering.assign_edges(v.population(spark, sf), _zone_table(spark, sf)), "zones")


@query
def stable_labels(spark, sf):
    rows = clustering.stable_labels(v.zones(spark, sf))
    return rows.select("edge_id", F.col("edge_cluster").cast("bigint").alias("edge_cluster"),
                       "centroid_x_km", "centroid_y_km")


@query
def nearest_edge(spark, sf):
    rows = clustering.assign_edges(v.population(spark, sf), _zone_table(spark, sf))
    return rows.select("sensor_id", F.col("edge_cluster").cast("bigint").alias("edge_cluster"), "edge_id",
                       "macroarea_id", r("distance_to_edge_km", 4).alias("distance_to_edge_km"))


@query
def edge_population_summary(spark, sf):
    out = clustering.edge_population_summary(_zone_topology(spark, sf), _zone_table(spark, sf))
    out = rounded(out, "mean_distance_km", "p95_distance_km", "max_radius_km", digits=4)
    out = rounded(out, "rows_per_day", "load_share_pct", digits=6)
    return rounded(out, "natural_events_per_second", digits=9).withColumn(
        "edge_cluster", F.col("edge_cluster").cast("bigint")
    )


def _segments(spark, sf):
    """Assignments of sensors for three fixed cluster counts: k bands of equal width in x."""
    pop = materialize(v.population(spark, sf), "population")
    bands = F.explode(F.array(*[F.lit(k) for k in (5, 6, 7)]))
    width = F.lit(6_000.0)
    cluster = F.least(F.floor((F.col("x_km") - 1_000) * F.col("k") / width), F.col("k") - 1)
    rows = pop.withColumn("k", bands).withColumn("cluster", F.greatest(cluster, F.lit(0)).cast("int"))
    center_x = F.lit(1_000.0) + (F.col("cluster") + 0.5) * width / F.col("k")
    distance = geo.euclidean(F.col("x_km"), F.col("y_km"), center_x, F.lit(3_000.0))
    return rows.select(
        "sensor_id", "x_km", "y_km", "k", "cluster", distance.alias("distance"),
        rates.per_second(F.col("rows_per_day")).alias("load_eps"),
    )


@query
def k_table_metrics(spark, sf):
    rows = materialize(_segments(spark, sf), "segments")
    grid = spark.createDataFrame([(k, c) for k in (5, 6, 7) for c in range(k)], "k INT, cluster INT")
    out = clustering.k_metrics(rows, grid, pairwise.silhouette_exact(rows))
    out = rounded(out, "inertia", digits=2)
    out = rounded(out, "silhouette", "mean_sensors", "load_cv", "max_load_factor", digits=6)
    out = rounded(out, "mean_distance_km", "p95_distance_km", "max_radius_km", digits=4)
    return rounded(out, "mean_load_eps", "max_load_eps", digits=9).withColumn("k", F.col("k").cast("bigint"))


@query
def silhouette_exact(spark, sf):
    rows = materialize(_segments(spark, sf), "segments")
    per_point = clustering.point_silhouettes(pairwise.cluster_distance_sums(rows))
    return per_point.select(F.col("k").cast("bigint").alias("k"), "sensor_id", r("silhouette").alias("silhouette"))


@query
def silhouette_squared(spark, sf):
    rows = materialize(_segments(spark, sf), "segments")
    values = {k: clustering.silhouette_squared(rows.filter(F.col("k") == k)) for k in (5, 6, 7)}
    value = F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.col("k"))
    return rows.groupBy("k").agg(F.count("*").alias("sensors")).select(
        F.col("k").cast("bigint").alias("k"), "sensors", F.round(value, 6).alias("silhouette")
    )


def _k_table(spark, sf):
    """A metrics table derived from the data: one row per nation key as candidate k."""
    rows = v.table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(
        F.count("*").alias("n"), F.avg("c_acctbal").alias("b")
    )
    return rows.select(
        F.col("k").cast("bigint").alias("k"),
        (F.lit(1e6) / (F.col("k") + 1) + F.col("n")).alias("inertia"),
        F.round(F.col("b") / 1e4, 2).alias("silhouette"),
    )


@query
def elbow_k(spark, sf):
    return rounded(clustering.elbow_k(_k_table(spark, sf)), "chord_distance")


@query
def best_k(spark, sf):
    return rounded(clustering.best_k(_k_table(spark, sf)), "inertia", digits=4)


@query
def kmeans_topology(spark, sf):
    pop = materialize(v.population(spark, sf), "population")
    topology_, _ = clustering.edge_topology(pop, k=5)
    return topology_


@query
def k_sweep(spark, sf):
    pop = materialize(v.population(spark, sf), "population")
    return sweep_metrics(pop, KSweep())


@query
def kmeans_topology_checks(spark, sf):
    """What any right fit has in common: see the columns."""
    pop = materialize(v.population(spark, sf), "population")
    rows, centers = clustering.edge_topology(pop, k=5)
    rows = materialize(rows, "topology")
    zones = materialize(clustering.centroid_table(spark, centers), "centers")
    # five zones
    every = rows.join(F.broadcast(zones.select(F.col("edge_cluster").alias("_c"), "centroid_x_km", "centroid_y_km")))
    apart = geo.euclidean(F.col("x_km"), F.col("y_km"), F.col("centroid_x_km"), F.col("centroid_y_km"))
    nearer = every.filter((F.col("_c") != F.col("edge_cluster")) & (apart < F.col("distance_to_edge_km") - 1e-9))
    means = rows.groupBy("edge_cluster").agg(F.avg("x_km").alias("x"), F.avg("y_km").alias("y")).join(zones, "edge_cluster")
    off = means.filter(geo.euclidean(F.col("x"), F.col("y"), F.col("centroid_x_km"), F.col("centroid_y_km")) > 1.0)
    west_east = zones.withColumn("_x", F.lag("centroid_x_km").over(W.orderBy("edge_cluster"))).filter("centroid_x_km < _x")
    cost = rows.agg(F.sum(F.col("distance_to_edge_km") ** 2)).scalar()
    least = min(_library_cost(pop, 5, seed) for seed in range(4))
    count = lambda df: df.agg(F.count("*")).scalar()
    return rows.agg(F.count("*").alias("sensors"), F.count_distinct("edge_cluster").alias("zones")).select(
        "sensors", "zones", count(nearer).alias("sensors_nearer_to_another_zone"), count(off).alias("centers_off_their_mean"),
        count(west_east).alias("breaks_of_west_east_order"), (cost > 1.05 * least).cast("int").alias("cost_above_the_library"))


def _library_cost(points, k, seed):
    """Cost of a fit by Spark's own K-Means."""
    features = VectorAssembler(inputCols=["x_km", "y_km"], outputCol="features").transform(points)
    return KMeans(k=k, seed=seed).fit(features).summary.trainingCost


@query
def k_sweep_checks(spark, sf):
    """Per k: sensors over all zones, whether the cost rises over that of k - 1, whether all values are in range."""
    pop = materialize(v.population(spark, sf), "population")
    rows = materialize(sweep_metrics(pop, KSweep(), "squared"), "metrics")
    before = F.lag("inertia").over(W.orderBy("k"))
    right = ((F.col("min_sensors") >= 1) & (F.col("mean_sensors") <= F.col("max_sensors")) & F.col("silhouette").between(-1, 1)
             & (F.col("p95_distance_km") <= F.col("max_radius_km")) & (F.col("max_load_factor") >= 1))
    return rows.select(F.col("k").cast("bigint").alias("k"), F.round(F.col("mean_sensors") * F.col("k")).cast("bigint").alias("sensors"),
                       F.coalesce((F.col("inertia") > before).cast("int"), F.lit(0)).alias("cost_rises"), F.col("k").isNotNull().cast("int").alias("rows"),
                       right.cast("int").alias("in_range"))


# -- workload ------------------------------------------------------------------------

def _workload_size(population: DataFrame) -> int:
    """A size with a remainder that every edge population can serve: the smallest
    population for all, and one more for half of the bigger ones."""
    low = population.agg(F.min("population_sensors")).scalar()
    row = population.agg(
        F.count("*").alias("n"), F.min("population_sensors").alias("low"),
        F.count_if(F.col("population_sensors") > low).alias("bigger"),
    ).first()
    return row["n"] * row["low"] + row["bigger"] // 2


def _drawn(spark, sf):
    topology_ = materialize(_zone_topology(spark, sf), "zone-topology")
    population = workload.population_by_edge(topology_)
    size = _workload_size(population)
    quotas = materialize(workload.balanced_quotas(population, size), "quotas")
    return topology_, quotas, materialize(workload.stratified_sample(topology_, quotas, size), "sample"), size


def _wide_cluster(df):
    return df.withColumn("edge_cluster", F.col("edge_cluster").cast("bigint"))


@query
def balanced_quotas(spark, sf):
    _, quotas, _, _ = _drawn(spark, sf)
    return _wide_cluster(quotas)


@query
def stratified_sample(spark, sf):
    _, _, sample, _ = _drawn(spark, sf)
    return _wide_cluster(sample.select("sensor_id", "edge_id", "edge_cluster", "rows"))


@query
def workload_shares(spark, sf):
    _, quotas, sample, size = _drawn(spark, sf)
    out = workload.workload_shares(quotas, sample, size)
    return _wide_cluster(rounded(out, "population_share_pct", "workload_share_pct"))


@query
def quota_mismatches(spark, sf):
    """The sample without its first sensor, which its edge then misses."""
    _, quotas, sample, size = _drawn(spark, sf)
    sample = sample.filter(F.col("sensor_id") > sample.agg(F.min("sensor_id")).scalar())
    return _wide_cluster(workload.quota_mismatches(workload.workload_shares(quotas, sample, size)).select(
        "edge_id", "edge_cluster", "sensor_quota", "selected_sensors"))


@query
def assignment_consistency(spark, sf):
    """The sample against the deployment topology, which numbers its edges differently."""
    _, _, sample, _ = _drawn(spark, sf)
    return workload.assignment_mismatches(sample, v.topo(spark, sf))


@query
def workload_edge_summary(spark, sf):
    _, _, sample, _ = _drawn(spark, sf)
    out = rounded(workload.workload_edge_summary(sample), "rows_per_day", "load_share_pct", "target_events_per_second")
    return _wide_cluster(rounded(out, "natural_events_per_second", digits=9))


@query
def replay_scenarios(spark, sf):
    _, _, sample, _ = _drawn(spark, sf)
    out = workload.replay_scenarios(sample)
    return out.select(F.col("replay_factor").cast("bigint").alias("replay_factor"),
                      r("total_events_per_second").alias("total_events_per_second"))


@query
def natural_rate(spark, sf):
    _, _, sample, _ = _drawn(spark, sf)
    out = workload.natural_rate(sample)
    return out.select(r("natural_events_per_second", 9).alias("natural_events_per_second"),
                      r("required_replay_factor", 4).alias("required_replay_factor"))


@query
def workload_trace(spark, sf):
    """The replay trace as written and read back."""
    _, _, sample, _ = _drawn(spark, sf)
    active = quality.active_columns(_profile(spark, sf))
    rows = workload.workload_rows(v.obs(spark, sf), sample, v.WINDOW, active)
    path = new_path(spark, "replay-trace")
    sinks.write_trace(rows, path, "event_time", "sensor_id")
    return observations.whole_rows(observations.scan_trace(spark, path), strict=True)


@query
def reduction_summary(spark, sf):
    _, _, sample, _ = _drawn(spark, sf)
    by_sensor = materialize(quality.scan_by_sensor(v.obs(spark, sf), v.WINDOW), "by-sensor")
    stats_ = sensors.stats_from(by_sensor, v.WINDOW)
    located = sensors.located_sensors(stats_)
    out = quality.reduction_summary(
        quality.profile_from(by_sensor), stats_, located, sensors.population_in(located), sample)
    return rounded(out, "workload_rows_pct", "row_reduction_pct")


# -- streams -------------------------------------------------------------------------

def _message_folder(spark, sf, repeat: bool = False):
    """All publishable messages as files, plus the one that closes the last windows."""
    path = new_path(spark, "messages")
    out = sinks.event_envelope(_wire(spark, sf))
    if repeat:  # every message is delivered twice
        out = out.unionByName(out)
    out.write.json(path)
    closed = datetime.fromisoformat(v.CLOSED_AT).replace(tzinfo=timezone.utc)
    streams.closing_messages(v.topo(spark, sf), closed).write.mode("append").json(path)
    return path


def _stream(spark, sf, repeat: bool = False):
    source = message_files(spark, _message_folder(spark, sf, repeat))
    return streams.ingest(source, v.topo(spark, sf))


@query
def stream_ingest(spark, sf):
    out = streams.run_to_table(spark, _stream(spark, sf), "ingested")
    rows = out.filter(~F.col("event_id").eqNullSafe("end-of-trace"))
    values = [F.col("measurements")[n].alias(n) for n in NAMES]
    return rows.select("sequence", "event_id", "sensor_id", "receiving_edge", *values, "reject_reason")


@query
def stream_edge_windows(spark, sf):
    rows = streams.edge_window_stream(ingest.accepted(_stream(spark, sf)))
    return streams.run_to_table(spark, rows, "edge-windows").select(*_window_columns(*EDGE_OUT))


@query
def stream_macroarea_windows(spark, sf):
    rows = streams.macroarea_window_stream(streams.edge_window_stream(ingest.accepted(_stream(spark, sf))))
    return streams.run_to_table(spark, rows, "macroarea-windows").select(*_window_columns(*MACRO_OUT))


@query
def stream_dedup(spark, sf):
    """Edge windows over a stream that delivers every message twice."""
    events = streams.deduplicated(ingest.accepted(_stream(spark, sf, repeat=True)))
    rows = streams.edge_window_stream(events, watermarked=True)
    return streams.run_to_table(spark, rows, "deduplicated").select("window_id", "input_events", "sensor_count")


# -- results as a whole --------------------------------------------------------------------

@query
def export_manifest(spark, sf):
    """Tables of one committed export, each as read back from its files."""
    zones = materialize(_zone_topology(spark, sf), "zone-topology")
    folder = new_path(spark, "exports")
    sinks.export_set({"europe_topology": zones.withColumn("macroarea_id", F.lit("m0")), "edge_population_summary": edge_population_summary(spark, sf)}, folder)
    read = sinks.exported(spark, folder)
    counts = [df.agg(F.count("*").alias("rows"), F.count_distinct("edge_id").alias("edges"), r(F.sum(F.col("rows").cast("bigint"))).cast("bigint").alias("observations"))
              .select(F.lit(name).alias("name"), "*") for name, df in read.items()]
    return counts[0].unionByName(counts[1])


@query
def broken_rules(spark, sf):
    """Rules that the topology with planted conflicts breaks, and by how many rows."""
    rows = v.topo_conflicting(spark, sf).withColumn("edge_id", F.when(F.col("macroarea_id") != "m3", F.col("edge_id")))
    return invariants.violations(rows, {
        "unique sensor": invariants.unique(rows, ["sensor_id"]), "edge known": invariants.no_nulls(["edge_id"]),
        "no area m1": invariants.none_where("macroarea_id = 'm1'"), "no area m9": invariants.none_where("macroarea_id = 'm9'")})


@query
def written_bytes(spark, sf):
    """Size of a written text file, from the file listing."""
    path = new_path(spark, "lines")
    v.obs(spark, sf).select(F.concat_ws(";", F.col("event_id").cast("string"), "location")).write.text(path)
    return file_footprint(spark, path).select("bytes")


@query
def trace_summary(spark, sf):
    """Rows of a written trace, counted from its files."""
    rows = workload.workload_rows(v.obs(spark, sf), v.topo(spark, sf), v.WINDOW, ["sensor_id", "timestamp", "temperature"])
    return sinks.write_trace(rows, new_path(spark, "trace"), "event_time", "sensor_id").select("rows")


# -- streams in several micro-batches ----------------------------------------------------

LATE = WindowSizes(lateness_seconds=600)
DELIVERY = """least(3, CASE WHEN observed_at < TIMESTAMP '2024-01-12' THEN 1 WHEN observed_at < TIMESTAMP '2024-01-19' THEN 2
  WHEN observed_at IS NULL THEN 1 ELSE 3 END + CASE WHEN sequence % 19 = 0 THEN 2 WHEN sequence % 17 = 0 THEN 1 ELSE 0 END)"""


def _deliveries(spark, sf):
    """Messages of three deliveries in the order of time, with every 17th event one and every 19th two deliveries late.

    Gives a folder and one function per delivery, which writes its messages there.
    """
    path = new_path(spark, "deliveries")
    wire = materialize(_wire(spark, sf).withColumn("_delivery", F.expr(DELIVERY)), "wire")

    def deliver(number):
        sinks.event_envelope(wire.filter(F.col("_delivery") == number)).write.mode("append").json(path)

    return path, [lambda n=n: deliver(n) for n in (1, 2, 3)]


def _late_tables(spark, sf):
    """Each delivery is a micro-batch of a query that goes on from its checkpoint."""
    path, deliveries = _deliveries(spark, sf)
    folder, checkpoint = new_path(spark, "late"), new_path(spark, "checkpoint")
    for deliver in deliveries:
        deliver()
        judged = streams.ingest(message_files(spark, path), v.topo(spark, sf))
        targets.run_batches(judged, targets.write_together(spark, folder, targets.split_late(LATE)), checkpoint)
    return folder


@query
def stream_late_rows(spark, sf):
    rows = targets.committed(spark, _late_tables(spark, sf), "late")
    return rows.select("sequence", "event_id", "sensor_id", us("observed_at"), us("window_end"), us("watermark"), "lag_seconds", "reason")


@query
def stream_ontime_windows(spark, sf):
    """Edge windows of the rows that were in time."""
    return targets.windows_from(targets.committed(spark, _late_tables(spark, sf), "parts")).select(*_window_columns(*EDGE_OUT))


@query
def stream_reconciled(spark, sf):
    """Accepted events are in a window or late."""
    row = targets.reconciled(spark, _late_tables(spark, sf))
    return row.select((F.col("windowed") + F.col("late")).alias("accepted"), "windowed", "late", "rejected")


def _published(spark, sf):
    """The wire as a stream of three deliveries, published to three tables."""
    wire = materialize(_wire(spark, sf).withColumn("_delivery", F.expr(DELIVERY)), "wire")
    source, folder, checkpoint = (new_path(spark, n) for n in ("to-publish", "published", "checkpoint"))
    for number in (1, 2, 3):
        wire.filter(F.col("_delivery") == number).drop("_delivery").write.mode("append").parquet(source)
        stream = spark.readStream.schema(wire.drop("_delivery").schema).parquet(source)
        targets.run_batches(stream, targets.write_together(spark, folder, targets.split_routes(), every=2), checkpoint)
    return folder


@query
def stream_envelope(spark, sf):
    rows = targets.committed(spark, _published(spark, sf), "envelopes")
    return rows.select("topic", "key", F.get_json_object("value", "$.sequence").cast("bigint").alias("sequence"))


@query
def stream_publish_counts(spark, sf):
    """Rows per micro-batch and table, as committed with them."""
    return targets.progress(spark, _published(spark, sf)).select("batch_id", F.col("name").alias("target"), "rows")


@query
def stream_progress(spark, sf):
    """Accepted and rejected messages per micro-batch, as told while the stream ran."""
    path, deliveries = _deliveries(spark, sf)
    out, checkpoint = new_path(spark, "ingested"), new_path(spark, "checkpoint")
    told = ProgressTable(spark, new_path(spark, "progress"))
    spark.streams.addListener(told)
    try:
        for deliver in deliveries:
            deliver()
            running = streams.start(streams.ingest(message_files(spark, path), v.topo(spark, sf)).drop("measurements"), out, checkpoint)
            running.awaitTermination()
            if running.exception() is not None:
                raise running.exception()
            told.wait_for(running)
    finally:
        spark.streams.removeListener(told)
    return told.table().select("batch_id", "input_rows", "accepted", "rejected")


def _in_time_order(rows, time, parts):
    """Parquet files that a stream reads: one function per part of the rows, in the order of time."""
    rows, path = materialize(rows, "ordered"), new_path(rows.sparkSession, "ordered-source")
    cuts = ["2000-01-01", *parts, "3000-01-01"]

    def write(low, high):
        rows.filter(F.col(time).between(F.lit(low).cast("timestamp"), F.lit(high).cast("timestamp") - F.expr("INTERVAL 1 MICROSECOND"))).write.mode("append").parquet(path)

    return rows.schema, path, [lambda a=a, b=b: write(a, b) for a, b in zip(cuts, cuts[1:])]


@query
def stream_sequence(spark, sf):
    """As sensor_events, numbered by state that three runs of one query share."""
    schema, path, steps = _in_time_order(v.routed(spark, sf), "event_time", ["2024-01-12", "2024-01-19"])
    out, checkpoint = new_path(spark, "sequenced"), new_path(spark, "checkpoint")
    for step in steps:
        step()
        events = keyed.sensor_event_stream(spark.readStream.schema(schema).parquet(path), ["event_id"], F.lit(v.EMITTED_AT).cast("timestamp"))
        with streams.state_settings(spark):
            running = streams.start(events, out, checkpoint)
        running.awaitTermination()
        if running.exception() is not None:
            raise running.exception()
    rows = spark.read.schema(events.schema).parquet(out)
    return rows.select("event_id", "sensor_id", "sequence", us("observed_at"), "edge_id", "macroarea_id")


@query
def stream_edge_changes(spark, sf):
    """As edge_change_events, by state that two runs of one query share."""
    schema, path, steps = _in_time_order(_guarded(spark, sf), "observed_at", ["2024-01-15"])
    out, checkpoint = new_path(spark, "changes"), new_path(spark, "checkpoint")
    for step in steps:
        step()
        changes = keyed.edge_change_stream(spark.readStream.schema(schema).parquet(path), ["sequence"])
        rows = keyed.run_until_quiet(spark, changes, "changes", checkpoint=checkpoint, path=out)
    return _change_columns(rows)


@query
def stream_closed_windows(spark, sf):
    """As edge_windows, by timers: nothing ends the trace, and no window is kept back."""
    path = new_path(spark, "messages")
    sinks.event_envelope(_wire(spark, sf)).write.json(path)
    events = ingest.accepted(streams.ingest(message_files(spark, path), v.topo(spark, sf)))
    rows = keyed.run_until_quiet(spark, keyed.closing_window_stream(events, idle_seconds=2, parts=2), "closed", quiet_seconds=3)
    return keyed.newest_windows(rows).select(*_window_columns(*EDGE_OUT))


@query
def stream_upsert_compacted(spark, sf):
    """As upserted_windows, in many micro-batches; the log is folded every two commits and old versions go at once."""
    table = new_path(spark, "window-table")
    for part in _macro_versions(spark, sf):
        source, pieces = new_path(spark, "versions"), 3
        for i in range(pieces):
            part.filter(F.pmod(F.xxhash64("window_id"), F.lit(pieces)) == i).write.mode("append").parquet(source)
            stream = spark.readStream.schema(part.schema).parquet(source)
            if not i:
                checkpoint = new_path(spark, "checkpoint")
            targets.run_batches(stream, sinks.upsert_into(spark, table, "version", every=2, keep_seconds=0), checkpoint)
    return sinks.upserted(spark, table)
