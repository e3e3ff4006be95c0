"""Map projections as column expressions (degrees in, metres out)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS84 axes and the mean radius of a sphere, in metres.
A, INVERSE_FLATTENING, SPHERE = 6378137.0, 298.257223563, 6371000.0
E2 = 2 / INVERSE_FLATTENING - 1 / INVERSE_FLATTENING**2
E = math.sqrt(E2)


def polar_equal_area(lon: Column, lat: Column, lon0: float = 0.0) -> tuple[Column, Column]:
    """Lambert azimuthal equal-area on the north pole, on the ellipsoid (Snyder 1987, 24-23 to 24-25)."""
    s = F.sin(F.radians(lat))
    q = (1 - E2) * (s / (1 - E2 * s * s) - F.log((1 - E * s) / (1 + E * s)) / (2 * E))
    q_pole = (1 - E2) * (1 / (1 - E2) - math.log((1 - E) / (1 + E)) / (2 * E))
    rho = A * F.sqrt(F.greatest(F.lit(0.0), F.lit(q_pole) - q))
    angle = F.radians(lon - lon0)
    return rho * F.sin(angle), -rho * F.cos(angle)


def polar_equidistant(lon: Column, lat: Column, lon0: float = 0.0) -> tuple[Column, Column]:
    """Azimuthal equidistant on the north pole, on a sphere."""
    rho = SPHERE * F.radians(90 - lat)
    angle = F.radians(lon - lon0)
    return rho * F.sin(angle), -rho * F.cos(angle)


def inverse_polar_equal_area(x: Column, y: Column, lon0: float = 0.0) -> tuple[Column, Column]:
    """Longitude and latitude of a place of :func:`polar_equal_area` (Snyder 1987, 3-18 and 24-29 to 24-32); null beyond the south pole.

    The series for the latitude is good to a ten-millionth of a degree."""
    q = Q_POLE - (x * x + y * y) / (A * A)
    beta = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), q / Q_POLE)))
    lat = beta + SERIES[0] * F.sin(2 * beta) + SERIES[1] * F.sin(4 * beta) + SERIES[2] * F.sin(6 * beta)
    there = q >= -Q_POLE
    return F.when(there, _longitude(x, y, lon0)), F.when(there, F.degrees(lat))


def inverse_polar_equidistant(x: Column, y: Column, lon0: float = 0.0) -> tuple[Column, Column]:
    """Longitude and latitude of a place of :func:`polar_equidistant`; null beyond the south pole."""
    lat = 90 - F.degrees(F.sqrt(x * x + y * y) / SPHERE)
    return F.when(lat >= -90, _longitude(x, y, lon0)), F.when(lat >= -90, lat)


def _longitude(x: Column, y: Column, lon0: float) -> Column:
    """From -180 up to, but not at, 180."""
    lon = F.degrees(F.atan2(x, -y)) + lon0
    return F.when(lon >= 180, lon - 360).when(lon < -180, lon + 360).otherwise(lon)


#: Authalic q at the pole, and the factors of the series from authalic to geodetic latitude.
Q_POLE = (1 - E2) * (1 / (1 - E2) - math.log((1 - E) / (1 + E)) / (2 * E))
SERIES = (E2 / 3 + 31 * E2**2 / 180 + 517 * E2**3 / 5040, 23 * E2**2 / 360 + 251 * E2**3 / 3780, 761 * E2**3 / 45360)
INVERSES = {"laea": inverse_polar_equal_area, "aeqd": inverse_polar_equidistant}
PROJECTIONS = {"laea": polar_equal_area, "aeqd": polar_equidistant}


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Distance in metres on a sphere."""
    half = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * SPHERE * F.asin(F.sqrt(F.least(F.lit(1.0), half)))
