"""Projection and distance.

The projection is the ellipsoidal Lambert azimuthal equal-area one (Snyder,
"Map Projections - A Working Manual", 1987, section 24) with the parameters of
EPSG:3035.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# GRS80 ellipsoid and the EPSG:3035 origin.
SEMI_MAJOR_M = 6_378_137.0
FLATTENING = 1 / 298.257222101
ORIGIN_LAT, ORIGIN_LON = 52.0, 10.0
FALSE_EASTING_M, FALSE_NORTHING_M = 4_321_000.0, 3_210_000.0

_E2 = FLATTENING * (2 - FLATTENING)
_E = math.sqrt(_E2)


def _q(sin_phi: float) -> float:
    es = _E * sin_phi
    return (1 - _E2) * (sin_phi / (1 - es * es) + math.atanh(es) / _E)


_SIN0 = math.sin(math.radians(ORIGIN_LAT))
_Q_POLE = _q(1.0)
_RQ = SEMI_MAJOR_M * math.sqrt(_Q_POLE / 2)
_BETA0 = math.asin(_q(_SIN0) / _Q_POLE)
_M0 = math.cos(math.radians(ORIGIN_LAT)) / math.sqrt(1 - _E2 * _SIN0 * _SIN0)
_D = SEMI_MAJOR_M * _M0 / (_RQ * math.cos(_BETA0))


def project_europe_km(lat: Column, lon: Column) -> tuple[Column, Column]:
    """(x_km, y_km) in EPSG:3035 for WGS84 degrees."""
    sin_phi = F.sin(F.radians(lat))
    es = sin_phi * _E
    q = (sin_phi / (1 - es * es) + F.atanh(es) / _E) * (1 - _E2)
    # rounding can push the ratio a hair past +-1 at the poles
    sin_beta = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), q / _Q_POLE))
    cos_beta = F.sqrt(1 - sin_beta * sin_beta)
    lam = F.radians(lon - ORIGIN_LON)
    scale = F.sqrt(
        F.lit(2.0) / (1 + sin_beta * math.sin(_BETA0) + cos_beta * math.cos(_BETA0) * F.cos(lam))
    ) * _RQ
    x = cos_beta * F.sin(lam) * scale * _D
    y = (sin_beta * math.cos(_BETA0) - cos_beta * math.sin(_BETA0) * F.cos(lam)) * scale / _D
    return (x + FALSE_EASTING_M) / 1000, (y + FALSE_NORTHING_M) / 1000


def euclidean(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    dx, dy = x1 - x2, y1 - y2
    return F.sqrt(dx * dx + dy * dy)


def nearest(x: Column, y: Column, centers: Column) -> Column:
    """struct(distance, cluster) of the closest of an array of struct(cluster, x, y); the lower id wins a tie."""
    return F.array_min(F.transform(centers, lambda c: F.struct(
        euclidean(x, y, c["x"], c["y"]).alias("distance"), c["cluster"].alias("cluster"),
    )))
