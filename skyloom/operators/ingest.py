"""Edge-side validation and enrichment; the same functions serve batch and stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.functions.clean import strip
from skyloom.functions.messages import CORRUPT, decode_event, on_edge_subscription, topic
from skyloom.params import SCHEMA_VERSION, TOPIC_TEMPLATE
from skyloom.plans.joins import lookup_join

# Fixed value: reasons in the order in which the rules are tried.
REASONS = (
    "malformed payload", "wrong topic", "unsupported schema version", "missing event or sensor id",
    "missing time", "unknown sensor", "sensor of another edge", "no measurements",
)


def topic_edge(received: Column, template: str = TOPIC_TEMPLATE) -> Column:
    """The edge id inside a received topic."""
    return F.get(F.split(received, "/", -1), F.lit(template.split("/").index("{edge_id}")))


def decode_messages(messages: DataFrame, template: str = TOPIC_TEMPLATE) -> DataFrame:
    """(topic, value) messages to event columns plus ``receiving_edge`` and ``decode_error``.

    The topic must be the one rebuilt from the receiving edge and the payload's sensor.
    """
    e = F.col("_event")
    fields = ["schema_version", "event_id", "sensor_id", "location_id", "sequence",
              "observed_at", "emitted_at", "measurements"]
    edge = topic_edge(F.col("topic"), template)
    malformed = e.isNull() | e[CORRUPT].isNotNull()
    same = topic(edge, e["sensor_id"], template) == F.col("topic")
    error = F.when(malformed, REASONS[0]).when(~F.coalesce(same, F.lit(False)), REASONS[1])
    return messages.withColumn("_event", decode_event(F.col("value"))).select(
        "topic", edge.alias("receiving_edge"), error.alias("decode_error"),
        *[e[f].alias(f) for f in fields],
    )


def subscribed(messages: DataFrame, edge_id: str, template: str = TOPIC_TEMPLATE) -> DataFrame:
    """Messages that match one edge's subscription."""
    return messages.filter(on_edge_subscription(F.col("topic"), edge_id, template))


def judge(events: DataFrame, topology: DataFrame) -> DataFrame:
    """Add ``edge_id``, ``macroarea_id`` and ``reject_reason`` (NULL = accepted).

    ``receiving_edge`` is the edge that got the event. The first failing rule
    names the reason. Works on batch and streaming frames.
    """
    blank = lambda c: F.coalesce(strip(F.col(c)), F.lit("")) == ""
    routes = topology.select("sensor_id", "edge_id", "macroarea_id")
    joined = lookup_join(events, routes, "sensor_id", "left")
    reason = F.col("decode_error") if "decode_error" in events.columns else F.lit(None).cast("string")
    rules = (
        F.when(~F.col("schema_version").eqNullSafe(SCHEMA_VERSION), REASONS[2])
        .when(blank("event_id") | blank("sensor_id"), REASONS[3])
        .when(F.col("observed_at").isNull() | F.col("emitted_at").isNull(), REASONS[4])
        .when(F.col("edge_id").isNull(), REASONS[5])
        .when(~F.col("edge_id").eqNullSafe(F.col("receiving_edge")), REASONS[6])
        .when(F.coalesce(F.size("measurements"), F.lit(0)) <= 0, REASONS[7])
    )
    return joined.withColumn("reject_reason", F.coalesce(reason, rules)).drop("decode_error")


def accepted(judged: DataFrame) -> DataFrame:
    return judged.filter("reject_reason IS NULL").drop("reject_reason", "receiving_edge")


def rejected(judged: DataFrame) -> DataFrame:
    return judged.filter("reject_reason IS NOT NULL")


def accepted_count(judged: DataFrame) -> DataFrame:
    """One row: accepted and rejected events."""
    return judged.agg(
        F.count_if(F.col("reject_reason").isNull()).alias("accepted"),
        F.count_if(F.col("reject_reason").isNotNull()).alias("rejected"),
    )


def observed_progress(judged: DataFrame, name: str = "ingest") -> DataFrame:
    """Attach running counts that show up in an ``Observation`` or in stream progress."""
    return judged.observe(
        name,
        F.count_if(F.col("reject_reason").isNull()).alias("accepted"),
        F.count_if(F.col("reject_reason").isNotNull()).alias("rejected"),
    )
