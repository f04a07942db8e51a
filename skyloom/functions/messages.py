"""Event identity, routing topics, and the JSON form of an event."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyloom.functions.clean import strip
from skyloom.params import SCHEMA_VERSION, TOPIC_TEMPLATE

# Fixed value: RFC 3339 with microseconds, the finest unit Spark keeps.
TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"

EVENT_SCHEMA = T.StructType([
    T.StructField("schema_version", T.IntegerType()),
    T.StructField("event_id", T.StringType()),
    T.StructField("sensor_id", T.StringType()),
    T.StructField("location_id", T.StringType()),
    T.StructField("sequence", T.LongType()),
    T.StructField("observed_at", T.TimestampType()),
    T.StructField("emitted_at", T.TimestampType()),
    T.StructField("measurements", T.MapType(T.StringType(), T.StringType())),
])
CORRUPT = "_corrupt_record"


def event_id(sensor: Column, event_time: Column, sequence: Column) -> Column:
    """``v1:<sensor>:<unix nanoseconds>:<sequence>``."""
    nanos = F.unix_micros(event_time) * F.lit(1000)
    return F.concat_ws(":", F.lit(f"v{SCHEMA_VERSION}"), sensor, nanos.cast("string"), sequence.cast("string"))


def topic(edge: Column, sensor: Column, template: str = TOPIC_TEMPLATE) -> Column:
    """The event's topic; NULL where an id is missing or blank."""
    filled = F.replace(F.lit(template), F.lit("{edge_id}"), edge)
    filled = F.replace(filled, F.lit("{sensor_id}"), sensor)
    return F.when((strip(edge) != "") & (strip(sensor) != ""), filled)


def on_edge_subscription(received: Column, edge_id: str, template: str = TOPIC_TEMPLATE) -> Column:
    """Does a topic match the edge's subscription, any one-level sensor id allowed?"""
    if not edge_id.strip():
        raise ValueError("an edge id is required")
    wanted = template.replace("{edge_id}", edge_id).replace("{sensor_id}", "+").split("/")
    parts = F.split(received, "/", -1)
    match = F.size(parts) == len(wanted)
    for i, level in enumerate(wanted):
        if level != "+":
            match = match & (F.get(parts, F.lit(i)) == level)
    return F.coalesce(match, F.lit(False))


def encode_event() -> Column:
    """JSON payload of the current row; routing columns are not part of it."""
    fields = F.struct(*[F.col(f.name) for f in EVENT_SCHEMA.fields])
    return F.to_json(fields, {"timestampFormat": TIME_FORMAT})


def decode_event(value: Column) -> Column:
    """Struct of the payload plus the raw text of a malformed one; unknown keys are ignored."""
    schema = T.StructType(EVENT_SCHEMA.fields + [T.StructField(CORRUPT, T.StringType())])
    return F.from_json(value.cast("string"), schema, {"columnNameOfCorruptRecord": CORRUPT})
