"""Geodesy and angles as Column expressions.

Two earth radii are in use and must not be mixed: RADIUS_EQUATOR for the historical functions and
RADIUS_MEAN for the multi-view ones.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import geodesic

RADIUS_EQUATOR = 6378137.0
RADIUS_MEAN = 6371008.8
METRES_PER_DEGREE = 111111.0


def _half_chord(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    s1, s2 = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lng2 - lng1) / 2)
    return s1 * s1 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * s2 * s2


def haversine_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle metres on the equatorial radius."""
    a = _half_chord(lat1, lng1, lat2, lng2)
    return 2 * RADIUS_EQUATOR * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def haversine_mean_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle metres on the mean radius."""
    return 2 * RADIUS_MEAN * F.asin(F.sqrt(_half_chord(lat1, lng1, lat2, lng2)))


def spherical_dest(lat: Column, lng: Column, bearing: Column, distance: Column) -> tuple[Column, Column]:
    """The point at a distance and bearing on the equatorial sphere."""
    angle, b, phi = distance / RADIUS_EQUATOR, F.radians(bearing), F.radians(lat)
    phi2 = F.asin(F.sin(phi) * F.cos(angle) + F.cos(phi) * F.sin(angle) * F.cos(b))
    turn = F.atan2(F.sin(b) * F.sin(angle) * F.cos(phi), F.cos(angle) - F.sin(phi) * F.sin(phi2))
    return F.degrees(phi2), lng + F.degrees(turn)


def flat_dest(lat: Column, lng: Column, heading: Column, distance: Column) -> tuple[Column, Column]:
    """Flat-earth offset at METRES_PER_DEGREE."""
    h = F.radians(heading)
    return lat + distance * F.cos(h) / METRES_PER_DEGREE, lng + distance * F.sin(h) / (METRES_PER_DEGREE * F.cos(F.radians(lat)))


def wrap_keep_minus(x: Column) -> Column:
    """One turn at most, into [-180, 180]; -180 stays."""
    return F.when(x > 180, x - 360).when(x < -180, x + 360).otherwise(x)


def wrap_keep_plus(x: Column) -> Column:
    """One turn at most, into (-180, 180]; -180 becomes 180."""
    return F.when(x > 180, x - 360).when(x <= -180, x + 360).otherwise(x)


def wrap_floor(x: Column) -> Column:
    """Any number of turns, into [-180, 180)."""
    return floor_mod(x + 180, 360.0) - 180


def floor_mod(x: Column, m: float) -> Column:
    """The remainder with the divisor's sign, written so that every engine rounds alike."""
    return x - m * F.floor(x / m)


def to_heading(x: Column) -> Column:
    """Into [0, 360)."""
    return floor_mod(x, 360.0)


def local_east_north(lat: Column, lng: Column, lat0: Column, lng0: Column) -> tuple[Column, Column]:
    """Local metres on the mean radius."""
    return F.radians(lng - lng0) * F.cos(F.radians(lat0)) * RADIUS_MEAN, F.radians(lat - lat0) * RADIUS_MEAN


def camera_offset(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> tuple[Column, Column]:
    """Flat-earth east and north metres from the first to the second point at their mean latitude."""
    return (lng2 - lng1) * METRES_PER_DEGREE * F.cos(F.radians((lat1 + lat2) / 2)), (lat2 - lat1) * METRES_PER_DEGREE


def bearing_deg(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Forward azimuth of the WGS84 geodesic, in (-180, 180]; NULL in, NULL out."""
    return geodesic.azimuth(lat1, lng1, lat2, lng2)


def dest_point(lat: Column, lng: Column, bearing: Column, distance: Column) -> Column:
    """struct<lat, lng> at a distance and azimuth on the WGS84 ellipsoid."""
    return geodesic.destination(lat, lng, bearing, distance)


def latlng_error_m(estimator: int, lat: Column, lng: Column, heading: Column, distance: Column, true_lat: Column, true_lng: Column) -> Column:
    """Placement error; estimators 1 to 3 place on the flat earth, the others on the ellipsoid."""
    if estimator <= 3:
        placed = flat_dest(lat, lng, heading, distance)
    else:
        point = dest_point(lat, lng, heading, distance)
        placed = point["lat"], point["lng"]
    return haversine_m(true_lat, true_lng, *placed)


def degrees_per_metre() -> float:
    return math.degrees(1 / RADIUS_EQUATOR)
