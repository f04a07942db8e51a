"""The same results in DuckDB SQL, written independently of the library.

``VIEWS`` holds the shared derived tables; a query names those it needs and they
are put in front of it as common table expressions.
"""

from __future__ import annotations

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
NULLS = "'', 'null', '<null>', 'none', 'nan'"
MEASURES = {"temperature_c": "temperature", "humidity_pct": "humidity", "pressure_hpa": "pressure"}
RANGES = {"temperature_c": (-40, 85), "humidity_pct": (0, 100), "pressure_hpa": (300, 1100)}


def _number(c: str) -> str:
    return f"CASE WHEN regexp_matches(trim({c}), '{NUMBER}') THEN try_cast(trim({c}) AS DOUBLE) END"


def _from_file(c: str) -> str:
    return f"nullif(cast({c} AS VARCHAR), '')"


def _null_like(c: str) -> str:
    return f"({c} IS NULL OR lower(trim({c})) IN ({NULLS}))"


def _measured(name: str, c: str) -> str:
    low, high = RANGES[name]
    x = _number(c)
    if name == "pressure_hpa":
        x = f"""CASE WHEN NOT (({x}) BETWEEN {low} AND {high}) AND ({x}) / 100 BETWEEN {low} AND {high}
                     THEN ({x}) / 100 ELSE ({x}) END"""
    return f"CASE WHEN ({x}) BETWEEN {low} AND {high} THEN ({x}) END"


# EPSG:3035, constants spelled out: GRS80, origin 52N 10E.
_LAEA = """
{name}_c AS (
  SELECT 0.0818191910428158 AS e, 0.006694380022900788 AS e2, 6378137.0 AS a, radians(52.0) AS p0),
{name}_k AS (
  SELECT *, (1 - e2) * (1 / (1 - e2) + atanh(e) / e) AS qp,
    (1 - e2) * (sin(p0) / (1 - e2 * sin(p0) * sin(p0)) + atanh(e * sin(p0)) / e) AS q0 FROM {name}_c),
{name}_m AS (
  SELECT *, a * sqrt(qp / 2) AS rq, asin(q0 / qp) AS b0,
    a * cos(p0) / sqrt(1 - e2 * sin(p0) * sin(p0)) / (a * sqrt(qp / 2) * cos(asin(q0 / qp))) AS d FROM {name}_k),
{name}_b AS (
  SELECT t.*, m.rq, m.b0, m.d, radians(t.lon - 10.0) AS lam,
    asin((1 - e2) * (sin(radians(lat)) / (1 - e2 * sin(radians(lat)) * sin(radians(lat)))
         + atanh(e * sin(radians(lat))) / e) / qp) AS beta
  FROM {source} t, {name}_m m),
{name} AS (
  SELECT {columns},
    (4321000 + rq * d * sqrt(2 / (1 + sin(b0) * sin(beta) + cos(b0) * cos(beta) * cos(lam)))
       * cos(beta) * sin(lam)) / 1000 AS x_km,
    (3210000 + rq / d * sqrt(2 / (1 + sin(b0) * sin(beta) + cos(b0) * cos(beta) * cos(lam)))
       * (cos(b0) * sin(beta) - sin(b0) * cos(beta) * cos(lam))) / 1000 AS y_km
  FROM {name}_b)"""

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def view(name: str, *needs: str, sql: str) -> None:
    VIEWS[name] = (needs, sql)


view("obs", sql="""obs AS (
  SELECT event_id,
    CASE WHEN event_id % 101 = 0 THEN ' ' ELSE cast(user_id AS VARCHAR) END AS sensor_id,
    cast(user_id % 40 AS VARCHAR) AS location,
    CASE WHEN event_id % 97 = 0 THEN 'junk'
         WHEN event_id % 3 = 0 THEN concat('''', replace(cast(ts AS VARCHAR), ' ', 'T'), '''')
         ELSE replace(cast(ts AS VARCHAR), ' ', 'T') END AS timestamp,
    CASE WHEN event_id % 53 = 0 THEN 'abc' WHEN event_id % 59 = 0 THEN '0.0'
         ELSE cast(cast(30000 + user_id * 37 % 450 * 100 + event_id % 7 AS DOUBLE) / 1000 AS VARCHAR) END AS lat,
    CASE WHEN event_id % 59 = 0 THEN '0.0'
         ELSE cast(cast(-30000 + user_id * 53 % 800 * 100 + event_id % 5 AS DOUBLE) / 1000 AS VARCHAR) END AS lon,
    CASE WHEN event_id % 89 = 0 THEN '' WHEN event_id % 83 = 0 THEN 'nan'
         ELSE cast(value AS VARCHAR) END AS temperature,
    cast(cast(event_id % 120 AS DOUBLE) AS VARCHAR) AS humidity,
    CASE WHEN event_id % 2 = 0 THEN cast(cast(95000 + event_id % 9000 AS DOUBLE) AS VARCHAR)
         ELSE cast(cast(950 + event_id % 90 AS DOUBLE) AS VARCHAR) END AS pressure,
    cast(NULL AS VARCHAR) AS altitude
  FROM events)""")

view("topo", sql="""topo AS (
  SELECT cast(c_custkey AS VARCHAR) AS sensor_id,
    concat('m', cast(n_regionkey AS VARCHAR)) AS macroarea_id,
    concat('edge-m', cast(n_regionkey AS VARCHAR), '-', cast(n_nationkey AS VARCHAR)) AS edge_id,
    cast(300 + c_custkey * 37 % 450 AS DOUBLE) / 10 AS lat,
    cast(-300 + c_custkey * 53 % 800 AS DOUBLE) / 10 AS lon
  FROM customer JOIN nation ON c_nationkey = n_nationkey
  WHERE c_acctbal >= 0)""")

view("flagged", "obs", sql=f"""flagged_t AS (
  SELECT *, try_cast(trim(trim(timestamp), '''"') AS TIMESTAMP) AS t,
    {_number('lat')} AS lat_num, {_number('lon')} AS lon_num FROM obs),
flagged AS (
  SELECT *,
    coalesce(t >= TIMESTAMP '2024-01-05' AND t < TIMESTAMP '2024-01-25', false) AS in_window,
    coalesce(trim(sensor_id) <> '', false) AS sensor_ok,
    coalesce(lat_num BETWEEN -90 AND 90 AND lon_num BETWEEN -180 AND 180
      AND NOT (abs(lat_num) < 0.01 AND abs(lon_num) < 0.01), false) AS coord_ok
  FROM flagged_t)""")

view("stats", "flagged", sql="""stats_a AS (
  SELECT trim(sensor_id) AS sensor_id, count(*) AS rows, count(CASE WHEN coord_ok THEN lat_num END) AS coordinate_rows,
    sum(CASE WHEN coord_ok THEN lat_num END) AS lat_sum, sum(CASE WHEN coord_ok THEN lon_num END) AS lon_sum
  FROM flagged WHERE in_window AND sensor_ok GROUP BY 1),
stats AS (
  SELECT *, lat_sum / coordinate_rows AS lat, lon_sum / coordinate_rows AS lon, rows / 20.0 AS rows_per_day
  FROM stats_a)""")

view("located", "stats", sql="""located AS (
  SELECT * FROM stats WHERE coordinate_rows > 0 AND lat IS NOT NULL AND lon IS NOT NULL)""")

view("boxed", "located", sql="""boxed AS (
  SELECT * FROM located WHERE lat BETWEEN 34 AND 72 AND lon BETWEEN -25 AND 45)""")

view("population", "boxed", sql=_LAEA.format(
    name="population", source="boxed", columns="sensor_id, rows, rows_per_day, lat, lon").strip())

view("placed", "topo", sql=_LAEA.format(
    name="placed", source="topo", columns="sensor_id, macroarea_id, edge_id, lat, lon").strip())

view("zones", "placed", sql="""zones AS (
  SELECT edge_id, round(avg(x_km), 3) AS centroid_x_km, round(avg(y_km), 3) AS centroid_y_km
  FROM placed GROUP BY edge_id)""")

view("labels_", "zones", sql="""labels_ AS (
  SELECT edge_id AS source_edge, row_number() OVER (ORDER BY centroid_x_km, centroid_y_km) - 1 AS edge_cluster,
    centroid_x_km, centroid_y_km FROM zones)""")

view("assigned", "population", "labels_", sql="""assigned AS (
  SELECT p.sensor_id, p.rows, p.rows_per_day, edge_cluster, concat('edge-', cast(edge_cluster AS VARCHAR)) AS edge_id,
    centroid_x_km, centroid_y_km,
    sqrt((x_km - centroid_x_km) * (x_km - centroid_x_km) + (y_km - centroid_y_km) * (y_km - centroid_y_km)) AS dist
  FROM population p, labels_
  QUALIFY row_number() OVER (PARTITION BY p.sensor_id ORDER BY dist, edge_cluster) = 1)""")

view("quotas", "assigned", sql="""pops AS (
  SELECT edge_cluster, edge_id, count(DISTINCT sensor_id) AS population_sensors FROM assigned GROUP BY 1, 2),
plan AS (
  SELECT count(*) AS n, min(population_sensors) AS low,
    count(*) FILTER (WHERE population_sensors > (SELECT min(population_sensors) FROM pops)) // 2 AS extra,
    count(*) * min(population_sensors)
      + count(*) FILTER (WHERE population_sensors > (SELECT min(population_sensors) FROM pops)) // 2 AS size FROM pops),
quotas AS (
  SELECT edge_cluster, edge_id, population_sensors,
    size // n + CASE WHEN row_number() OVER (ORDER BY population_sensors DESC, edge_cluster) <= size % n
                     THEN 1 ELSE 0 END AS sensor_quota
  FROM pops, plan)""")

view("sample_", "quotas", sql="""sample_ AS (
  SELECT * FROM (
    SELECT a.*, row_number() OVER (PARTITION BY a.edge_id ORDER BY md5(concat('42:', a.sensor_id)), a.sensor_id) AS rk
    FROM assigned a) r JOIN quotas q USING (edge_id) WHERE rk <= sensor_quota)""")

view("shares", "sample_", sql="""shares AS (
  SELECT q.edge_id, q.population_sensors,
    100.0 * q.population_sensors / (SELECT sum(population_sensors) FROM quotas) AS population_share_pct,
    q.sensor_quota, c.n AS selected_sensors, 100.0 * c.n / (SELECT size FROM plan) AS workload_share_pct,
    q.edge_cluster
  FROM quotas q LEFT JOIN (SELECT edge_id, count(DISTINCT sensor_id) AS n FROM sample_ GROUP BY 1) c USING (edge_id))""")

view("parsed", "obs", sql="""parsed AS (
  SELECT event_id, trim(sensor_id) AS sensor_id, location AS location_id,
    CASE WHEN regexp_matches(trim(trim(timestamp), ''''), '^\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2}(\\.\\d+)?$')
         THEN try_cast(trim(trim(timestamp), '''') AS TIMESTAMP) END AS t,
    coalesce(trim(temperature), '') AS temperature_c, coalesce(trim(humidity), '') AS humidity_pct,
    coalesce(trim(pressure), '') AS pressure_hpa
  FROM obs)""")

view("ragged", "parsed", sql="""ragged_lines AS (
  SELECT p.event_id, p.sensor_id, p.t, concat_ws(';', p.event_id::VARCHAR, o.sensor_id, o.location, o.timestamp, coalesce(o.temperature, '')) AS five,
    concat(';', coalesce(o.humidity, ''), ';', coalesce(o.pressure, ''), ';1;2') AS more,
    concat_ws(';', p.event_id::VARCHAR, o.sensor_id, '"x') AS opened,
    CASE WHEN p.event_id % 7 = 0 THEN 'short' WHEN p.event_id % 11 = 0 THEN 'long' WHEN p.event_id % 13 = 0 THEN 'broken' ELSE 'whole' END AS kind
  FROM parsed p JOIN obs o USING (event_id)),
ragged AS (
  SELECT event_id::VARCHAR AS event_id, sensor_id, epoch_us(t) AS event_time,
    CASE WHEN kind <> 'whole' THEN 'wrong number of columns' WHEN sensor_id = '' THEN 'empty sensor_id'
         WHEN t IS NULL THEN 'invalid timestamp' END AS reject_reason,
    CASE kind WHEN 'short' THEN five WHEN 'long' THEN concat(five, more) END AS bad_row
  FROM ragged_lines WHERE kind <> 'broken'
  UNION ALL SELECT event_id::VARCHAR, sensor_id, NULL, 'wrong number of columns', opened FROM ragged_lines WHERE kind = 'broken'
  UNION ALL SELECT 'y"', '1', NULL, 'wrong number of columns', 'y";1;2' FROM ragged_lines WHERE kind = 'broken')""")

view("records", "parsed", sql="records AS (SELECT * FROM parsed WHERE sensor_id <> '' AND t IS NOT NULL)")

view("routed", "records", "topo", sql="""routed AS (
  SELECT r.*, edge_id, macroarea_id FROM records r JOIN topo USING (sensor_id))""")

view("numbered", "routed", sql="""numbered AS (
  SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY t, event_id) AS sequence,
    concat('v1:', sensor_id, ':', cast(epoch_us(t) * 1000 AS VARCHAR), ':',
      cast(row_number() OVER (PARTITION BY sensor_id ORDER BY t, event_id) AS VARCHAR)) AS id
  FROM routed)""")

view("inbox", "parsed", "topo", sql="""inbox AS (
  SELECT p.event_id AS sequence,
    CASE WHEN p.event_id % 71 = 0 THEN 2 ELSE 1 END AS schema_version,
    CASE WHEN p.event_id % 73 = 0 THEN ' ' ELSE concat('e', cast(p.event_id AS VARCHAR)) END AS event_id,
    p.sensor_id, p.location_id,
    CASE WHEN p.event_id % 79 <> 0 THEN t END AS observed_at,
    TIMESTAMP '2024-02-01 00:00:00' AS emitted_at,
    p.event_id % 67 = 0 AS no_measures,
    CASE WHEN p.event_id % 67 <> 0 THEN temperature_c END AS temperature_c,
    CASE WHEN p.event_id % 67 <> 0 THEN humidity_pct END AS humidity_pct,
    CASE WHEN p.event_id % 67 <> 0 THEN pressure_hpa END AS pressure_hpa,
    CASE WHEN p.event_id % 61 = 0 THEN 'edge-m9-9' ELSE coalesce(topo.edge_id, 'edge-m0-0') END AS receiving_edge,
    topo.edge_id, topo.macroarea_id
  FROM parsed p LEFT JOIN topo USING (sensor_id))""")

view("wire", "inbox", sql="""wire AS (
  SELECT *, concat('telemetry/', receiving_edge, '/', sensor_id) AS topic FROM inbox WHERE trim(sensor_id) <> '')""")

view("judged", "inbox", sql="""judged AS (
  SELECT *, CASE WHEN schema_version <> 1 THEN 'unsupported schema version'
      WHEN trim(event_id) = '' OR trim(sensor_id) = '' THEN 'missing event or sensor id'
      WHEN observed_at IS NULL THEN 'missing time'
      WHEN edge_id IS NULL THEN 'unknown sensor'
      WHEN edge_id <> receiving_edge THEN 'sensor of another edge'
      WHEN no_measures THEN 'no measurements' END AS reject_reason
  FROM inbox)""")

view("measured", "judged", sql=f"""measured_v AS (
  SELECT sequence, sensor_id, edge_id, macroarea_id, observed_at,
    {', '.join(f"{n} AS {n}_raw, {_measured(n, n)} AS {n}" for n in MEASURES)}
  FROM judged WHERE reject_reason IS NULL),
measured AS (
  SELECT *,
    {' + '.join(f"{_null_like(n + '_raw')}::BIGINT" for n in MEASURES)} AS missing_values,
    {' + '.join(f"(NOT {_null_like(n + '_raw')} AND {n} IS NULL)::BIGINT" for n in MEASURES)} AS invalid_values
  FROM measured_v)""")


def _summary(names=tuple(MEASURES)) -> str:
    return ", ".join(
        f"count({n}) AS {n}_count, round(min({n}), 6) AS {n}_min, round(max({n}), 6) AS {n}_max, "
        f"round(coalesce(sum({n}), 0), 4) AS {n}_sum, round(coalesce(sum({n} * {n}), 0), 4) AS {n}_sum_squares"
        for n in names
    )


def _windowed(seconds: int, keys: str, id_key: str, counts: str) -> str:
    start = f"(epoch_us(observed_at) // {seconds * 1_000_000} * {seconds})"
    return f"""SELECT concat({id_key}, ':', cast({start} AS VARCHAR)) AS window_id, {keys},
      {start} AS window_start, {start} + {seconds} AS window_end, {counts}, {_summary()}
      FROM measured GROUP BY ALL"""


_EDGE_COUNTS = """count(*) AS input_events, count(DISTINCT sensor_id) AS sensor_count,
  cast(sum(missing_values) AS BIGINT) AS missing_values, cast(sum(invalid_values) AS BIGINT) AS invalid_values"""
_EDGE_WINDOWS = _windowed(300, "edge_id, macroarea_id", "edge_id", _EDGE_COUNTS)
_MACRO_WINDOWS = _windowed(
    900, "macroarea_id", "macroarea_id", "count(DISTINCT edge_id) AS edge_count, count(*) AS input_events")

view("segments", "population", sql="""segments_c AS (
  SELECT p.*, k, cast(greatest(least(floor((x_km - 1000) * k / 6000), k - 1), 0) AS INT) AS cluster
  FROM population p, (SELECT unnest([5, 6, 7]) AS k)),
segments AS (
  SELECT *, rows_per_day / 86400 AS load_eps,
    sqrt((x_km - (1000 + (cluster + 0.5) * 6000 / k)) ** 2 + (y_km - 3000) ** 2) AS dist
  FROM segments_c)""")

view("silhouettes", "segments", sql="""sizes AS (SELECT k, cluster, count(*) AS size FROM segments GROUP BY 1, 2),
pair_sums AS (
  SELECT p.k, p.sensor_id, p.cluster AS own, q.cluster,
    sum(sqrt((p.x_km - q.x_km) * (p.x_km - q.x_km) + (p.y_km - q.y_km) * (p.y_km - q.y_km))) AS total
  FROM segments p JOIN segments q ON p.k = q.k GROUP BY 1, 2, 3, 4),
ab AS (
  SELECT s.k, sensor_id, max(CASE WHEN own = s.cluster AND size > 1 THEN total / (size - 1) END) AS a,
    min(CASE WHEN own <> s.cluster THEN total / size END) AS b
  FROM pair_sums s JOIN sizes z ON s.k = z.k AND s.cluster = z.cluster GROUP BY 1, 2),
silhouettes AS (SELECT k, sensor_id, coalesce((b - a) / greatest(a, b), 0) AS silhouette
  FROM ab)""")

view("k_table", sql="""k_table AS (
  SELECT c_nationkey::BIGINT AS k, 1e6::DOUBLE / (c_nationkey + 1) + count(*) AS inertia,
    round(avg(c_acctbal) / 1e4, 2) AS silhouette FROM customer GROUP BY c_nationkey)""")


def _with(body: str, *needs: str) -> str:
    order: list[str] = []

    def add(name):
        for n in VIEWS[name][0]:
            add(n)
        if name not in order:
            order.append(name)

    for n in needs:
        add(n)
    return "WITH " + ",\n".join(VIEWS[n][1] for n in order) + "\n" + body


SENSOR = """sensor_id, rows, coordinate_rows, round(lat, 6) AS lat, round(lon, 6) AS lon,
  round(rows_per_day, 6) AS rows_per_day"""
COUNTS = """count(*) AS raw_rows, count(*) FILTER (WHERE in_window) AS retained_rows, count(*) FILTER (WHERE t IS NULL) AS invalid_timestamp_rows,
  count(*) FILTER (WHERE t IS NOT NULL AND NOT in_window) AS outside_time_window_rows,
  count(*) FILTER (WHERE in_window AND NOT sensor_ok) AS invalid_sensor_id_rows,
  count(*) FILTER (WHERE in_window AND NOT coord_ok) AS invalid_coordinate_rows"""
BOUNDS = """epoch_us(min(t)) AS observed_timestamp_min, epoch_us(max(t)) AS observed_timestamp_max,
  epoch_us(min(t) FILTER (WHERE in_window)) AS retained_timestamp_min,
  epoch_us(max(t) FILTER (WHERE in_window)) AS retained_timestamp_max"""
OBS_COLUMNS = ("event_id", "sensor_id", "location", "timestamp", "lat", "lon", "temperature", "humidity",
               "pressure", "altitude")
ACTIVE = ("event_id", "sensor_id", "location", "timestamp", "lat", "lon", "temperature", "humidity", "pressure")
ACTIVE_TEXT = ", ".join(f"{_from_file(c)} AS {c}" for c in ACTIVE)

_DELIVERY = """least(3, CASE WHEN observed_at < TIMESTAMP '2024-01-12' THEN 1 WHEN observed_at < TIMESTAMP '2024-01-19' THEN 2
  WHEN observed_at IS NULL THEN 1 ELSE 3 END + CASE WHEN sequence % 19 = 0 THEN 2 WHEN sequence % 17 = 0 THEN 1 ELSE 0 END)"""

view("delivered", "judged", sql=f"""delivered AS (
  SELECT *, {_DELIVERY} AS delivery FROM judged WHERE trim(sensor_id) <> ''),
marks AS (
  SELECT delivery, max(epoch_us(observed_at)) AS high FROM delivered WHERE reject_reason IS NULL GROUP BY delivery),
timed AS (
  SELECT *, coalesce(window_end <= mark, false) AS late FROM (
    SELECT d.*, (epoch_us(observed_at) // 300000000 + 1) * 300000000 AS window_end,
      (SELECT max(high) FROM marks m WHERE m.delivery < d.delivery) - 600000000 AS mark
    FROM delivered d WHERE reject_reason IS NULL))""")

# The first event of a sensor per edge, but for the edge of its very first event.
CHANGES = _with("""SELECT sensor_id, home_edge, receiving_edge AS edge_id, event_id, sequence, epoch_us(observed_at) AS observed_at
  FROM (SELECT *, first_value(receiving_edge) OVER (PARTITION BY sensor_id ORDER BY observed_at, sequence) AS home_edge,
          row_number() OVER (PARTITION BY sensor_id, receiving_edge ORDER BY observed_at, sequence) AS n
        FROM inbox WHERE observed_at IS NOT NULL AND sensor_id <> '')
  WHERE n = 1 AND receiving_edge <> home_edge""", "inbox")

ORACLE: dict[str, str] = {
    "preview": _with("SELECT * FROM obs ORDER BY event_id LIMIT 5", "obs"),
    # an empty value in a file is a missing one
    "observation_scan": _with(
        f"SELECT {', '.join(f'{_from_file(c)} AS {c}' for c in OBS_COLUMNS)} FROM obs", "obs"),
    "trace_scan": _with("""SELECT sensor_id, location, timestamp, nullif(temperature, '') AS temperature, humidity,
        pressure FROM obs""", "obs"),
    "trace_records": _with("""SELECT event_id::VARCHAR AS event_id, sensor_id, location_id, epoch_us(t) AS event_time,
        temperature_c, humidity_pct, pressure_hpa, CASE WHEN sensor_id = '' THEN 'empty sensor_id'
        WHEN t IS NULL THEN 'invalid timestamp' END AS reject_reason FROM parsed""", "parsed"),
    "ragged_trace_rows": _with("""SELECT event_id, sensor_id, event_time, reject_reason, bad_row FROM ragged""", "ragged"),
    "ragged_profile": _with("SELECT coalesce(reject_reason, 'good') AS reason, count(*) AS rows FROM ragged GROUP BY 1", "ragged"),
    "topology_scan": _with("SELECT * FROM topo", "topo"),
    "parsed_timestamps": _with("SELECT event_id, epoch_us(t) AS event_time FROM flagged", "flagged"),
    "time_filtered": _with(
        "SELECT event_id, sensor_id, epoch_us(t) AS event_time FROM flagged WHERE in_window", "flagged"),
    "valid_sensor_rows": _with(
        "SELECT event_id, lower(trim(sensor_id)) AS sensor_id FROM obs WHERE trim(sensor_id) <> ''", "obs"),
    "valid_coordinate_rows": _with("SELECT event_id, lat_num, lon_num FROM flagged WHERE coord_ok", "flagged"),
    "masked_coordinates": _with("""SELECT event_id, CASE WHEN coord_ok THEN lat_num END AS lat,
        CASE WHEN coord_ok THEN lon_num END AS lon FROM flagged""", "flagged"),
    "scan_quality": _with(f"SELECT {COUNTS} FROM flagged", "flagged"),
    "timestamp_bounds": _with(f"SELECT {BOUNDS} FROM flagged", "flagged"),
    "column_quality": _with(" UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) FILTER (WHERE NOT {_null_like(f'cast({c} AS VARCHAR)')}) AS valid_rows,
            count(*) FILTER (WHERE NOT {_null_like(f'cast({c} AS VARCHAR)')}) = 0 AS all_null FROM flagged WHERE in_window"""
        for c in OBS_COLUMNS), "flagged"),
    "active_rows": _with(f"SELECT {', '.join(ACTIVE)} FROM flagged WHERE in_window", "flagged"),
    "dataset_summary": _with(f"""SELECT {COUNTS}, {BOUNDS}, 20.0::DOUBLE AS configured_days,
        round((epoch_us(max(t) FILTER (WHERE in_window)) - epoch_us(min(t) FILTER (WHERE in_window))) / 86400e6, 6)
          AS observed_days,
        count(DISTINCT CASE WHEN in_window AND sensor_ok THEN trim(sensor_id) END) AS unique_sensors
        FROM flagged""", "flagged"),
    "sensor_stats": _with(f"""SELECT {SENSOR}, round(lat_sum, 6) AS lat_sum, round(lon_sum, 6) AS lon_sum
        FROM stats""", "stats"),
    "located_sensors": _with(f"SELECT {SENSOR} FROM located", "located"),
    "europe_population": _with(f"SELECT {SENSOR} FROM boxed", "boxed"),
    "sorted_outputs": _with("""SELECT sensor_id, rows, round(rows_per_day, 6) AS rows_per_day FROM boxed
        ORDER BY sensor_id""", "boxed"),
    "location_summary": _with("""SELECT (SELECT count(*) FROM stats) AS total_sensors,
        (SELECT count(*) FROM stats) - (SELECT count(*) FROM located) AS unlocated_sensors,
        (SELECT count(*) FROM located) AS located_sensors""", "located"),
    "population_summary": _with("""SELECT count(*) AS sensors, round(min(lat), 6) AS lat_min,
        round(max(lat), 6) AS lat_max, round(min(lon), 6) AS lon_min, round(max(lon), 6) AS lon_max,
        cast(sum(rows) AS BIGINT) AS rows, round(sum(rows_per_day), 6) AS rows_per_day FROM boxed""", "boxed"),
    "unique_sensors": _with("""SELECT count(DISTINCT trim(sensor_id)) AS unique_sensors
        FROM flagged WHERE in_window AND sensor_ok""", "flagged"),
    "projected_population": _with(
        "SELECT sensor_id, round(x_km, 4) AS x_km, round(y_km, 4) AS y_km FROM population", "population"),
    "topology_counts": _with("""SELECT count(*) AS sensors, count(DISTINCT edge_id) AS edges,
        count(DISTINCT macroarea_id) AS macroareas FROM topo""", "topo"),
    "edges": _with("SELECT edge_id, macroarea_id, count(*) AS sensor_count FROM topo GROUP BY 1, 2", "topo"),
    "topology_rejects": f"""WITH raw AS (
        SELECT CASE WHEN c_custkey % 31 = 0 THEN ' ' ELSE cast(c_custkey AS VARCHAR) END AS sensor_id,
          CASE WHEN c_custkey % 37 = 0 THEN '' ELSE concat('m', cast(n_regionkey AS VARCHAR)) END AS macroarea_id,
          CASE WHEN c_custkey % 41 = 0 THEN NULL ELSE concat('edge-', cast(n_nationkey AS VARCHAR)) END AS edge_id,
          CASE WHEN c_custkey % 43 = 0 THEN 'north' WHEN c_custkey % 47 = 0 THEN '90.5'
            ELSE cast(cast(300 + c_custkey * 37 % 450 AS DOUBLE) / 10 AS VARCHAR) END AS lat,
          CASE WHEN c_custkey % 53 = 0 THEN '5d'
            ELSE cast(cast(-300 + c_custkey * 53 % 800 AS DOUBLE) / 10 AS VARCHAR) END AS lon
        FROM customer JOIN nation ON c_nationkey = n_nationkey)
        SELECT trim(sensor_id) AS sensor_id, trim(macroarea_id) AS macroarea_id, trim(edge_id) AS edge_id,
          round({_number('lat')}, 6) AS lat, round({_number('lon')}, 6) AS lon,
          CASE WHEN trim(sensor_id) = '' THEN 'empty sensor_id' WHEN trim(macroarea_id) = '' THEN 'empty macroarea_id'
            WHEN edge_id IS NULL THEN 'empty edge_id'
            WHEN NOT coalesce({_number('lat')} BETWEEN -90 AND 90, false) THEN 'invalid lat'
            WHEN NOT coalesce({_number('lon')} BETWEEN -180 AND 180, false) THEN 'invalid lon' END AS reject_reason
        FROM raw""",
    "topology_conflict_rows": _with("""SELECT 'duplicate sensor' AS rule, sensor_id AS id, count(*) AS found
        FROM (SELECT sensor_id FROM topo UNION ALL SELECT cast(s_suppkey AS VARCHAR) FROM supplier)
        GROUP BY sensor_id HAVING count(*) > 1
        UNION ALL
        SELECT 'edge in several macroareas', edge_id, count(DISTINCT macroarea_id) FROM (
          SELECT edge_id, macroarea_id FROM topo UNION ALL
          SELECT concat('edge-m', cast(s_suppkey % 5 AS VARCHAR), '-', cast(s_nationkey AS VARCHAR)),
            concat('m', cast(s_suppkey % 5 AS VARCHAR)) FROM supplier)
        GROUP BY edge_id HAVING count(DISTINCT macroarea_id) > 1""", "topo"),
    "edge_ids_sorted": _with("SELECT DISTINCT edge_id FROM topo ORDER BY edge_id", "topo"),
    "distinct_macroareas": _with("SELECT DISTINCT macroarea_id FROM topo", "topo"),
    "edge_lookup": _with("""SELECT edge_id, macroarea_id, count(*) AS sensor_count FROM topo
        WHERE edge_id = 'edge-m1-1' GROUP BY 1, 2""", "topo"),
    "endpoint_coverage": _with("""SELECT edge_id, macroarea_id, count(*) AS sensor_count FROM topo
        WHERE edge_id NOT IN (SELECT concat('edge-m', cast(n_regionkey AS VARCHAR), '-', cast(n_nationkey AS VARCHAR))
          FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000))
        GROUP BY 1, 2""", "topo"),
    "routed_events": _with("""SELECT event_id, sensor_id, location_id, epoch_us(t) AS event_time, edge_id, macroarea_id
        FROM records LEFT JOIN topo USING (sensor_id)""", "records", "topo"),
    "unknown_sensors": _with("""SELECT event_id, sensor_id, epoch_us(t) AS event_time FROM records
        WHERE sensor_id NOT IN (SELECT sensor_id FROM topo)""", "records", "topo"),
    "sensor_events": _with("""SELECT 1::BIGINT AS schema_version, id AS event_id, sensor_id, location_id, sequence,
        epoch_us(t) AS observed_at, epoch_us(TIMESTAMP '2024-02-01 00:00:00') AS emitted_at, temperature_c,
        humidity_pct, pressure_hpa, edge_id, macroarea_id FROM numbered""", "numbered"),
    "replay_schedule": _with("""SELECT id AS event_id, epoch_us(t) AS observed_at,
        epoch_us(TIMESTAMP '2025-01-01') + (epoch_us(t) - (SELECT min(epoch_us(t)) FROM routed)) // 1000 AS deadline
        FROM numbered""", "numbered"),
    "trace_order_violations": _with("""SELECT event_id, epoch_us(t) AS event_time, epoch_us(p) AS previous_event_time
        FROM (SELECT event_id, t, lag(t) OVER (ORDER BY event_id) AS p FROM (
          SELECT event_id, CASE WHEN event_id % 211 = 0 THEN t - INTERVAL 2 HOURS ELSE t END AS t FROM records))
        WHERE t < p""", "records"),
    "sensor_edge_changes": _with("""SELECT sensor_id, count(DISTINCT receiving_edge) AS edges FROM inbox
        GROUP BY 1 HAVING count(DISTINCT receiving_edge) > 1""", "inbox"),
    "first_n_events": _with("""SELECT event_id, sensor_id, epoch_us(t) AS event_time FROM records
        ORDER BY t, event_id LIMIT 1000""", "records"),
    "event_topics": _with("""SELECT event_id, concat('telemetry/', edge_id, '/', sensor_id) AS topic
        FROM routed""", "routed"),
    "event_envelope": _with("""SELECT topic, sensor_id AS key, event_id, sequence,
        strftime(observed_at, '%Y-%m-%dT%H:%M:%S.%fZ') AS observed_at, temperature_c, humidity_pct, pressure_hpa
        FROM wire""", "wire"),
    "unpublishable_events": _with("""SELECT sequence, 'empty sensor_id' AS reject_reason FROM inbox
        WHERE trim(sensor_id) = ''""", "inbox"),
    "event_json_roundtrip": _with("""SELECT topic, receiving_edge, cast(NULL AS VARCHAR) AS decode_error,
        schema_version::BIGINT AS schema_version, event_id, sensor_id, location_id, sequence,
        epoch_us(observed_at) AS observed_at, epoch_us(emitted_at) AS emitted_at, temperature_c, humidity_pct,
        pressure_hpa FROM wire""", "wire"),
    "topic_filter": _with("""SELECT topic, sensor_id AS key FROM wire
        WHERE regexp_matches(topic, '^telemetry/edge-m1-1/[^/]*$')""", "wire"),
    "ingest_rejects": _with("""SELECT sequence, event_id, sensor_id, receiving_edge, reject_reason FROM judged
        WHERE reject_reason IS NOT NULL""", "judged"),
    "ingest_accepted": _with("""SELECT sequence, event_id, sensor_id, epoch_us(observed_at) AS observed_at, edge_id,
        macroarea_id FROM judged WHERE reject_reason IS NULL""", "judged"),
    "accepted_count": _with("""SELECT count(*) FILTER (WHERE reject_reason IS NULL) AS accepted,
        count(*) FILTER (WHERE reject_reason IS NOT NULL) AS rejected FROM judged""", "judged"),
    "normalized_measures": _with("SELECT event_id, " + ", ".join(
        f"round({_measured(n, c)}, 6) AS {n}" for n, c in MEASURES.items()) + ", " + " + ".join(
        f"{_null_like(c)}::BIGINT" for c in MEASURES.values()) + " AS missing_values, " + " + ".join(
        f"(NOT {_null_like(c)} AND {_measured(n, c)} IS NULL)::BIGINT" for n, c in MEASURES.items())
        + " AS invalid_values FROM obs", "obs"),
    "quality_counters": _with("""SELECT edge_id, count(*) AS input_events,
        cast(sum(missing_values) AS BIGINT) AS missing_values, cast(sum(invalid_values) AS BIGINT) AS invalid_values
        FROM measured GROUP BY 1""", "measured"),
    "metric_stats": _with(f"SELECT sensor_id, {_summary()} FROM measured GROUP BY 1", "measured"),
    "metric_stats_merged": _with(f"SELECT edge_id, {_summary()}, " + ", ".join(
        f"round(avg({n}), 6) AS {n}_mean, round(stddev_pop({n}), 6) AS {n}_std" for n in MEASURES
    ) + " FROM measured GROUP BY 1", "measured"),
    "edge_windows": _with(_EDGE_WINDOWS, "measured"),
    "macroarea_windows": _with(_MACRO_WINDOWS, "measured"),
    "edge_window_envelope": _with(f"""SELECT 'edge-windows.v1' AS topic, macroarea_id AS key, window_id, input_events,
        {', '.join(f"{n}_count" for n in MEASURES)},
        {', '.join(f"round({n}_{f}, 4) AS {n}_{f}" for n in MEASURES for f in ('min', 'max', 'sum', 'sum_squares'))}
        FROM ({_EDGE_WINDOWS})""", "measured"),
    "upserted_windows": _with("""SELECT window_id, macroarea_id, input_events, edge_count, version FROM (
        SELECT concat(macroarea_id, ':', cast(epoch_us(observed_at) // 900000000 * 900 AS VARCHAR)) AS window_id,
          macroarea_id, count(*) AS input_events, count(DISTINCT edge_id) AS edge_count, 1::BIGINT AS version
        FROM measured WHERE observed_at < TIMESTAMP '2024-01-15 12:10:00' GROUP BY 1, 2
        UNION ALL
        SELECT concat(macroarea_id, ':', cast(epoch_us(observed_at) // 900000000 * 900 AS VARCHAR)),
          macroarea_id, count(*), count(DISTINCT edge_id), 2
        FROM measured WHERE observed_at >= TIMESTAMP '2024-01-15 12:00:00' GROUP BY 1, 2)
        QUALIFY row_number() OVER (PARTITION BY window_id ORDER BY version DESC) = 1""", "measured"),
    "stream_upsert": _with("""SELECT window_id, macroarea_id, input_events, edge_count, version FROM (
        SELECT concat(macroarea_id, ':', cast(epoch_us(observed_at) // 900000000 * 900 AS VARCHAR)) AS window_id,
          macroarea_id, count(*) AS input_events, count(DISTINCT edge_id) AS edge_count, 1::BIGINT AS version
        FROM measured WHERE observed_at < TIMESTAMP '2024-01-15 12:10:00' GROUP BY 1, 2
        UNION ALL
        SELECT concat(macroarea_id, ':', cast(epoch_us(observed_at) // 900000000 * 900 AS VARCHAR)),
          macroarea_id, count(*), count(DISTINCT edge_id), 2
        FROM measured WHERE observed_at >= TIMESTAMP '2024-01-15 12:00:00' GROUP BY 1, 2)
        QUALIFY row_number() OVER (PARTITION BY window_id ORDER BY version DESC) = 1""", "measured"),
    "stable_labels": _with("""SELECT source_edge AS edge_id, edge_cluster, centroid_x_km, centroid_y_km
        FROM labels_""", "labels_"),
    "nearest_edge": _with("""SELECT sensor_id, edge_cluster, edge_id, 'none' AS macroarea_id,
        round(dist, 4) AS distance_to_edge_km FROM assigned""", "assigned"),
    "edge_population_summary": _with("""SELECT edge_id, count(DISTINCT sensor_id) AS sensors,
        cast(sum(rows) AS BIGINT) AS rows, round(sum(rows_per_day), 6) AS rows_per_day,
        round(sum(rows_per_day) / 86400, 9) AS natural_events_per_second,
        round(100 * sum(rows_per_day) / (SELECT sum(rows_per_day) FROM assigned), 6) AS load_share_pct,
        round(avg(dist), 4) AS mean_distance_km, round(quantile_cont(dist, 0.95), 4) AS p95_distance_km,
        round(max(dist), 4) AS max_radius_km, max(centroid_x_km) AS centroid_x_km,
        max(centroid_y_km) AS centroid_y_km, edge_cluster FROM assigned GROUP BY edge_id, edge_cluster""", "assigned"),
    "k_table_metrics": _with("""SELECT z.k::BIGINT AS k, round(any_value(inertia), 2) AS inertia,
        round(any_value(sil), 6) AS silhouette, min(n) AS min_sensors, round(avg(n), 6) AS mean_sensors,
        max(n) AS max_sensors, round(any_value(mean_d), 4) AS mean_distance_km,
        round(any_value(p95), 4) AS p95_distance_km, round(any_value(max_d), 4) AS max_radius_km,
        round(avg(load), 9) AS mean_load_eps, round(max(load), 9) AS max_load_eps,
        round(stddev_pop(load) / avg(load), 6) AS load_cv, round(max(load) / avg(load), 6) AS max_load_factor
        FROM (SELECT g.k, g.cluster, count(s.sensor_id) AS n, coalesce(sum(load_eps), 0) AS load
              FROM (SELECT k, unnest(range(k)) AS cluster FROM (SELECT unnest([5, 6, 7]) AS k)) g
              LEFT JOIN segments s ON s.k = g.k AND s.cluster = g.cluster GROUP BY 1, 2) z
        JOIN (SELECT k, sum(dist * dist) AS inertia, avg(dist) AS mean_d, quantile_cont(dist, 0.95) AS p95,
                max(dist) AS max_d FROM segments GROUP BY 1) t ON t.k = z.k
        JOIN (SELECT k, avg(silhouette) AS sil FROM silhouettes GROUP BY 1) q ON q.k = z.k
        GROUP BY z.k""", "silhouettes"),
    "silhouette_exact": _with("""SELECT k::BIGINT AS k, sensor_id, round(silhouette, 6) AS silhouette
        FROM silhouettes""", "silhouettes"),
    "silhouette_squared": _with("""SELECT k::BIGINT AS k, count(*) AS sensors,
        round(avg(coalesce((b - a) / greatest(a, b), 0)), 6) AS silhouette FROM (
          SELECT s.k, sensor_id, max(CASE WHEN own = s.cluster AND size > 1 THEN total / (size - 1) END) AS a,
            min(CASE WHEN own <> s.cluster THEN total / size END) AS b
          FROM (SELECT p.k, p.sensor_id, p.cluster AS own, q.cluster,
                  sum((p.x_km - q.x_km) ** 2 + (p.y_km - q.y_km) ** 2) AS total
                FROM segments p JOIN segments q ON p.k = q.k GROUP BY 1, 2, 3, 4) s
          JOIN (SELECT k, cluster, count(*) AS size FROM segments GROUP BY 1, 2) z ON s.cluster = z.cluster AND s.k = z.k
          GROUP BY 1, 2) GROUP BY 1""", "segments"),
    "elbow_k": _with("""SELECT k, round(chord, 6) AS chord_distance FROM (
        SELECT k, abs((x1 - x0) * (y - y0) - (y1 - y0) * (x - x0)) / sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) AS chord
        FROM (SELECT *, first(x) OVER w AS x0, first(y) OVER w AS y0, last(x) OVER w AS x1, last(y) OVER w AS y1 FROM (
          SELECT k, (k - min(k) OVER ()) / (max(k) OVER () - min(k) OVER ()) AS x,
            (inertia - min(inertia) OVER ()) / (max(inertia) OVER () - min(inertia) OVER ()) AS y FROM k_table)
          WINDOW w AS (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)))
        ORDER BY chord DESC, k LIMIT 1""", "k_table"),
    "best_k": _with("""SELECT k, round(inertia, 4) AS inertia, silhouette FROM k_table
        ORDER BY silhouette DESC, k LIMIT 1""", "k_table"),
    "kmeans_topology_checks": _with("""SELECT count(*) AS sensors, 5::BIGINT AS zones, 0::BIGINT AS sensors_nearer_to_another_zone,
        0::BIGINT AS centers_off_their_mean, 0::BIGINT AS breaks_of_west_east_order, 0::INT AS cost_above_the_library FROM population""", "population"),
    "k_sweep_checks": _with("""SELECT k::BIGINT AS k, (SELECT count(*) FROM population) AS sensors, 0::INT AS cost_rises, 1::INT AS rows, 1::INT AS in_range
        FROM (SELECT unnest(range(5, 16)) AS k)""", "population"),
    "balanced_quotas": _with("SELECT * FROM quotas", "quotas"),
    "stratified_sample": _with("""SELECT sensor_id, edge_id, edge_cluster, rows
        FROM sample_""".replace("edge_cluster,", "sample_.edge_cluster,"), "sample_"),
    "workload_shares": _with("""SELECT edge_id, population_sensors, round(population_share_pct, 6)
        AS population_share_pct, sensor_quota, selected_sensors, round(workload_share_pct, 6) AS workload_share_pct,
        edge_cluster FROM shares""", "shares"),
    "quota_mismatches": _with("""SELECT q.edge_id, q.edge_cluster, q.sensor_quota, c.n AS selected_sensors
        FROM quotas q LEFT JOIN (SELECT edge_id, count(DISTINCT sensor_id) AS n FROM sample_
          WHERE sensor_id > (SELECT min(sensor_id) FROM sample_) GROUP BY 1) c USING (edge_id)
        WHERE c.n IS DISTINCT FROM q.sensor_quota""", "sample_"),
    "assignment_consistency": _with("""SELECT s.sensor_id, s.edge_id AS edge_id_workload,
        topo.edge_id AS edge_id_population FROM sample_ s JOIN topo ON s.sensor_id = topo.sensor_id
        WHERE s.edge_id <> topo.edge_id""", "sample_", "topo"),
    "workload_edge_summary": _with("""SELECT edge_cluster, edge_id, count(DISTINCT sensor_id) AS sensors,
        cast(sum(rows) AS BIGINT) AS rows, round(sum(rows_per_day), 6) AS rows_per_day,
        round(sum(rows_per_day) / 86400, 9) AS natural_events_per_second,
        round(100 * sum(rows_per_day) / (SELECT sum(rows_per_day) FROM sample_), 6) AS load_share_pct,
        round(2500 * sum(rows_per_day) / (SELECT sum(rows_per_day) FROM sample_), 6) AS target_events_per_second
        FROM sample_ GROUP BY 1, 2""", "sample_"),
    "replay_scenarios": _with("""SELECT f::BIGINT AS replay_factor, round(f * (SELECT sum(rows_per_day) / 86400
        FROM sample_), 6) AS total_events_per_second FROM (SELECT unnest([1, 100, 1000]) AS f)""", "sample_"),
    "natural_rate": _with("""SELECT round(sum(rows_per_day) / 86400, 9) AS natural_events_per_second,
        round(2500 / (sum(rows_per_day) / 86400), 4) AS required_replay_factor FROM sample_""", "sample_"),
    "workload_trace": _with(f"""SELECT {ACTIVE_TEXT} FROM flagged
        WHERE in_window AND trim(sensor_id) IN (SELECT sensor_id FROM sample_)""", "sample_"),
    "reduction_summary": _with("""SELECT (SELECT count(*) FROM stats) AS total_sensors,
        (SELECT count(*) FROM located) AS located_sensors, (SELECT count(*) FROM boxed) AS european_sensors,
        (SELECT count(*) FROM sample_) AS workload_sensors, (SELECT count(*) FROM flagged) AS physical_rows,
        count(*) AS window_rows, (SELECT cast(sum(rows) AS BIGINT) FROM sample_) AS workload_rows,
        round(100.0 * (SELECT sum(rows) FROM sample_) / count(*), 6) AS workload_rows_pct,
        round(100 - 100.0 * (SELECT sum(rows) FROM sample_) / count(*), 6) AS row_reduction_pct
        FROM flagged WHERE in_window""", "sample_"),
    "stream_ingest": _with("""SELECT sequence, event_id, sensor_id, receiving_edge, temperature_c, humidity_pct, pressure_hpa, reject_reason
        FROM judged
        WHERE trim(sensor_id) <> ''""", "judged"),
    "stream_edge_windows": _with(_EDGE_WINDOWS, "measured"),
    "stream_macroarea_windows": _with(_MACRO_WINDOWS, "measured"),
    "stream_dedup": _with(f"SELECT window_id, input_events, sensor_count FROM ({_EDGE_WINDOWS})", "measured"),
    "edge_change_events": CHANGES,
    "stream_edge_changes": CHANGES,
    "stream_late_rows": _with("""SELECT sequence, event_id, sensor_id, epoch_us(observed_at) AS observed_at, window_end, mark AS watermark,
        (mark - epoch_us(observed_at)) / 1e6 AS lag_seconds, 'window closed' AS reason FROM timed WHERE late""", "delivered"),
    "stream_ontime_windows": _with(_EDGE_WINDOWS.replace("FROM measured", "FROM measured JOIN (SELECT sequence FROM timed WHERE NOT late) USING (sequence)"), "measured", "delivered"),
    "stream_reconciled": _with("""SELECT count(*) FILTER (WHERE reject_reason IS NULL) AS accepted, count(*) FILTER (WHERE reject_reason IS NOT NULL) AS rejected,
        (SELECT count(*) FROM timed WHERE NOT late) AS windowed, (SELECT count(*) FROM timed WHERE late) AS late FROM delivered""", "delivered"),
    "stream_progress": _with("""SELECT delivery - 1 AS batch_id, count(*) AS input_rows, count(*) FILTER (WHERE reject_reason IS NULL) AS accepted,
        count(*) FILTER (WHERE reject_reason IS NOT NULL) AS rejected FROM delivered GROUP BY delivery""", "delivered"),
    "stream_sequence": _with("""SELECT id AS event_id, sensor_id, sequence, epoch_us(t) AS observed_at, edge_id, macroarea_id FROM numbered""", "numbered"),
    "stream_envelope": _with("SELECT topic, sensor_id AS key, sequence FROM wire", "wire"),
    "stream_publish_counts": _with(f"""SELECT delivery - 1 AS batch_id, unnest(['envelopes', 'rejects', 'counts']) AS target,
        unnest([count(*) FILTER (WHERE trim(sensor_id) <> ''), count(*) FILTER (WHERE trim(sensor_id) = ''), count(DISTINCT receiving_edge)]) AS rows
        FROM (SELECT *, {_DELIVERY} AS delivery FROM inbox) GROUP BY delivery""", "inbox"),
    "stream_closed_windows": _with(_EDGE_WINDOWS, "measured"),
}
ORACLE["stream_upsert_compacted"] = ORACLE["stream_upsert"]
ORACLE["export_manifest"] = f"""SELECT 'europe_topology' AS name, count(*) AS rows, count(DISTINCT edge_id) AS edges, sum(rows)::BIGINT AS observations
  FROM ({_with("SELECT * FROM assigned", "assigned")})
  UNION ALL SELECT 'edge_population_summary', count(*), count(DISTINCT edge_id), sum(rows)::BIGINT FROM ({ORACLE["edge_population_summary"]})"""
ORACLE["broken_rules"] = _with("""SELECT * FROM (SELECT unnest(['unique sensor', 'edge known', 'no area m1', 'no area m9']) AS rule,
    unnest([count(*) - count(DISTINCT sensor_id), count(*) FILTER (WHERE area = 'm3'), count(*) FILTER (WHERE area = 'm1'), 0]) AS offending FROM (
      SELECT sensor_id, macroarea_id AS area FROM topo
      UNION ALL SELECT cast(s_suppkey AS VARCHAR), concat('m', cast(s_suppkey % 5 AS VARCHAR)) FROM supplier)) WHERE offending > 0""", "topo")
ORACLE["written_bytes"] = "SELECT sum(strlen(event_id::VARCHAR) + strlen((user_id % 40)::VARCHAR) + 2)::BIGINT AS bytes FROM events"
ORACLE["trace_summary"] = _with("SELECT count(*) AS rows FROM flagged WHERE in_window AND trim(sensor_id) IN (SELECT sensor_id FROM topo)", "flagged", "topo")
