"""Typed arguments of the operators, with the checks that affect results."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

SECONDS_PER_DAY = 86_400
SCHEMA_VERSION = 1

# Spellings that count as a missing value. The first row is
# compared after trim and lower-casing, the second as written (the tokens a
# pandas CSV reader drops by default).
NULL_WORDS = ("", "null", "<null>", "none", "nan")
NA_TOKENS = (
    "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


@dataclass(frozen=True)
class TimeWindow:
    """Half-open interval of event time, ``start <= t < end``."""

    start: datetime
    end: datetime

    def __post_init__(self):
        if self.end <= self.start:
            raise ValueError("the time window must end after it starts")

    @classmethod
    def of(cls, start: str, end: str) -> "TimeWindow":
        """Build from ISO text; text without an offset is read as UTC."""
        return cls(_utc(start), _utc(end))

    @property
    def days(self) -> float:
        return (self.end - self.start) / timedelta(days=1)


def _utc(text: str) -> datetime:
    t = datetime.fromisoformat(text)
    return t.replace(tzinfo=timezone.utc) if t.tzinfo is None else t.astimezone(timezone.utc)


@dataclass(frozen=True)
class BoundingBox:
    lat_min: float
    lat_max: float
    lon_min: float
    lon_max: float

    def __post_init__(self):
        if self.lat_min >= self.lat_max or self.lon_min >= self.lon_max:
            raise ValueError("a bounding box needs min < max on both axes")


EUROPE = BoundingBox(34.0, 72.0, -25.0, 45.0)


@dataclass(frozen=True)
class Measure:
    """One measured quantity: logical name, source column, cleaning rule, valid range."""

    name: str
    column: str
    unit: str
    normalizer: str
    low: float
    high: float

    def __post_init__(self):
        if self.normalizer not in ("identity", "pressure_pa_or_hpa"):
            raise ValueError(f"unknown normalizer {self.normalizer!r}")
        if self.low >= self.high:
            raise ValueError(f"measure {self.name!r} needs low < high")


MEASURES = (
    Measure("temperature_c", "temperature", "celsius", "identity", -40.0, 85.0),
    Measure("humidity_pct", "humidity", "percent", "identity", 0.0, 100.0),
    Measure("pressure_hpa", "pressure", "hPa", "pressure_pa_or_hpa", 300.0, 1100.0),
)


@dataclass(frozen=True)
class TraceColumns:
    """Physical column names of an observation file."""

    sensor_id: str = "sensor_id"
    location_id: str = "location"
    timestamp: str = "timestamp"
    lat: str = "lat"
    lon: str = "lon"


@dataclass(frozen=True)
class WindowSizes:
    """Edge and macroarea window lengths in seconds, and the allowed lateness."""

    edge_seconds: int = 300
    macro_seconds: int = 900
    lateness_seconds: int = 0

    def __post_init__(self):
        if self.edge_seconds <= 0 or self.macro_seconds < self.edge_seconds:
            raise ValueError("window sizes must be positive, macroarea >= edge")
        if self.macro_seconds % self.edge_seconds:
            raise ValueError("the macroarea window must be a multiple of the edge window")
        if self.lateness_seconds < 0:
            raise ValueError("lateness must not be negative")

    @property
    def edge(self) -> str:
        return f"{self.edge_seconds} seconds"

    @property
    def macro(self) -> str:
        return f"{self.macro_seconds} seconds"

    @property
    def lateness(self) -> str:
        return f"{self.lateness_seconds} seconds"


@dataclass(frozen=True)
class KSweep:
    """Candidate cluster counts and the restarts per candidate."""

    k_min: int = 5
    k_max: int = 15
    restarts: int = 20
    seed: int = 42

    def __post_init__(self):
        if self.k_min < 2 or self.k_max < self.k_min:
            raise ValueError("need 2 <= k_min <= k_max")
        if self.restarts < 1:
            raise ValueError("need at least one restart")

    @property
    def ks(self) -> range:
        return range(self.k_min, self.k_max + 1)


TOPIC_TEMPLATE = "telemetry/{edge_id}/{sensor_id}"
EDGE_WINDOW_TOPIC = "edge-windows.v1"
EDGE_WINDOW_PARTITIONS = 12
TARGET_EVENTS_PER_SECOND = 2_500
REPLAY_FACTORS = (1, 100, 1_000)
REPLAY_SPEEDUP = 1_000.0
WORKLOAD_SENSORS = 150
SEED = 42
