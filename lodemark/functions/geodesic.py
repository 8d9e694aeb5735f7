"""Geodesics of the WGS84 ellipsoid (X03, X04), in Arrow batches.

Distances and longitudes are series in the third flattening on the auxiliary sphere, to sixth order. The direct problem
needs no iteration. The inverse one iterates on the spherical difference of longitude, which gains more than two digits
a step; where that does not settle, beyond NEAR_ANTIPODE of arc, it halves the range of the first azimuth, of which the
longitude reached is an increasing function. NULL in, NULL out. The same steps as Column expressions need lambdas for
what is computed once and used often; Spark interprets those, which took 131 s for 600,000 azimuths on eight cores.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

WGS84_A, WGS84_F = 6378137.0, 1 / 298.257223563
_B = WGS84_A * (1 - WGS84_F)
_N = WGS84_F / (2 - WGS84_F)
_SECOND = (2 - WGS84_F) * WGS84_F / (1 - WGS84_F) ** 2
#: Arc, in radians on the auxiliary sphere, beyond which azimuths are searched by halving.
NEAR_ANTIPODE = 3.0
STEPS, HALVINGS = 40, 56

# Coefficients of the series by powers of epsilon, from the first one named on in steps of the second.
_A1 = [1.0, 0.0, 1 / 4, 0.0, 1 / 64, 0.0, 1 / 256]
_C1 = [
    [0.0, -1 / 2, 0.0, 3 / 16, 0.0, -1 / 32],
    [0.0, 0.0, -1 / 16, 0.0, 1 / 32, 0.0, -9 / 2048],
    [0.0, 0.0, 0.0, -1 / 48, 0.0, 3 / 256],
    [0.0, 0.0, 0.0, 0.0, -5 / 512, 0.0, 3 / 512],
    [0.0, 0.0, 0.0, 0.0, 0.0, -7 / 1280],
    [0.0, 0.0, 0.0, 0.0, 0.0, 0.0, -7 / 2048],
]
_C1_BACK = [
    [0.0, 1 / 2, 0.0, -9 / 32, 0.0, 205 / 1536],
    [0.0, 0.0, 5 / 16, 0.0, -37 / 96, 0.0, 1335 / 4096],
    [0.0, 0.0, 0.0, 29 / 96, 0.0, -75 / 128],
    [0.0, 0.0, 0.0, 0.0, 539 / 1536, 0.0, -2391 / 2560],
    [0.0, 0.0, 0.0, 0.0, 0.0, 3467 / 7680],
    [0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 38081 / 61440],
]
_A3 = [1.0, -(1 / 2 - _N / 2), -(1 / 4 + _N / 8 - 3 * _N**2 / 8), -(1 / 16 + 3 * _N / 16 + _N**2 / 16), -(3 / 64 + _N / 32), -3 / 128]
_C3 = [
    [0.0, 1 / 4 - _N / 4, 1 / 8 - _N**2 / 8, 3 / 64 + 3 * _N / 64 - _N**2 / 64, 5 / 128 + _N / 64, 3 / 128],
    [0.0, 0.0, 1 / 16 - 3 * _N / 32 + _N**2 / 32, 3 / 64 - _N / 32 - 3 * _N**2 / 64, 3 / 128 + _N / 128, 5 / 256],
    [0.0, 0.0, 0.0, 5 / 192 - 3 * _N / 64 + 5 * _N**2 / 192, 3 / 128 - 5 * _N / 192, 7 / 512],
    [0.0, 0.0, 0.0, 0.0, 7 / 512 - 7 * _N / 256, 7 / 512],
    [0.0, 0.0, 0.0, 0.0, 0.0, 21 / 2560],
]


def _power_series(coefficients: list[float], x: np.ndarray) -> np.ndarray:
    return np.polynomial.polynomial.polyval(x, coefficients)


def _sines(series: list[list[float]], epsilon: np.ndarray, angle: np.ndarray) -> np.ndarray:
    """Sum of a term in sin(2 l angle) for each row of the series."""
    return sum(_power_series(c, epsilon) * np.sin(2 * k * angle) for k, c in enumerate(series, 1))


def _epsilon(cos_a0: np.ndarray) -> np.ndarray:
    k2 = _SECOND * cos_a0 * cos_a0
    return k2 / (2 * (1 + np.sqrt(1 + k2)) + k2)


def _lag(sin_a0: np.ndarray, epsilon: np.ndarray, sigma1: np.ndarray, sigma12: np.ndarray) -> np.ndarray:
    """By how much the ellipsoid's difference of longitude is behind the sphere's."""
    return WGS84_F * sin_a0 * _power_series(_A3, epsilon) * (sigma12 + _sines(_C3, epsilon, sigma1 + sigma12) - _sines(_C3, epsilon, sigma1))


def _reduced(lat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sine and cosine of the reduced latitude, and what they were divided by."""
    # the distance from the pole is exact where the cosine is small; at a pole it keeps the azimuth's direction
    c = np.where(np.abs(lat) > 45, np.maximum(np.sin(np.radians(90 - np.abs(lat))), 1e-150), np.cos(np.radians(lat)))
    s = (1 - WGS84_F) * np.sin(np.radians(lat))
    w = np.hypot(s, c)
    return s / w, c / w, w


def _half_turn(degrees: np.ndarray) -> np.ndarray:
    """Into (-180, 180]; a difference that is in it already stays as exact as it is."""
    return np.where((degrees > -180) & (degrees <= 180), degrees, 180 - np.mod(180 - degrees, 360))


def place(lat: np.ndarray, lng: np.ndarray, azimuth: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The direct problem."""
    sb, cb, _ = _reduced(lat)
    sa, ca = np.sin(np.radians(azimuth)), np.cos(np.radians(azimuth))
    sin_a0, cos_a0, along = sa * cb, np.hypot(ca, sa * sb), ca * cb
    e, sigma1 = _epsilon(cos_a0), np.arctan2(sb, along)
    tau = sigma1 + _sines(_C1, e, sigma1) + distance * (1 - e) / (_B * _power_series(_A1, e))
    sigma2 = tau + _sines(_C1_BACK, e, tau)
    turn = np.arctan2(sin_a0 * np.sin(sigma2), np.cos(sigma2)) - np.arctan2(sin_a0 * sb, along) - _lag(sin_a0, e, sigma1, sigma2 - sigma1)
    lat2 = np.arctan2(cos_a0 * np.sin(sigma2), (1 - WGS84_F) * np.hypot(cos_a0 * np.cos(sigma2), sin_a0))
    return np.degrees(lat2), _half_turn(lng + np.degrees(turn))


def _settled(lat1: np.ndarray, lat2: np.ndarray, span: np.ndarray) -> np.ndarray:
    """First azimuth in radians, by steps on the spherical difference of longitude."""
    (sb1, cb1, w1), (sb2, cb2, w2) = _reduced(lat1), _reduced(lat2)
    apart = (1 - WGS84_F) * np.sin(np.radians(lat2 - lat1)) / (w1 * w2)  # from the difference, so that short lines keep their digits
    goal = np.radians(span)
    omega = goal.copy()
    for _ in range(STEPS):
        x, y = cb2 * np.sin(omega), apart + 2 * sb1 * cb2 * np.sin(omega / 2) ** 2
        r = np.maximum(np.hypot(x, y), 1e-300)
        sin_a0, ca = x / r * cb1, y / r
        fresh = goal + _lag(sin_a0, _epsilon(np.hypot(ca, x / r * sb1)), np.arctan2(sb1, ca * cb1), np.arctan2(r, sb1 * sb2 + cb1 * cb2 * np.cos(omega)))
        done = np.abs(fresh - omega) <= 1e-15 * np.abs(fresh)
        omega = fresh
        if done.all():
            break
    return np.arctan2(cb2 * np.sin(omega), apart + 2 * sb1 * cb2 * np.sin(omega / 2) ** 2)


def _halved(lat1: np.ndarray, lat2: np.ndarray, span: np.ndarray) -> np.ndarray:
    """First azimuth in radians, by halving: from the latitude farther from the equator, taken as a southern one."""
    swap = np.abs(lat1) < np.abs(lat2)
    far, near = np.where(swap, lat2, lat1), np.where(swap, lat1, lat2)
    sign = np.where(far < 0, 1.0, -1.0)
    (sb1, cb1, _), (sb2, cb2, _) = _reduced(far * sign), _reduced(near * sign)
    goal = np.radians(np.abs(span))
    more = np.where(cb2 > cb1, (cb2 - cb1) * (cb2 + cb1), (sb1 - sb2) * (sb1 + sb2))

    def ends(alpha):
        along = np.cos(alpha) * cb1
        return np.sin(alpha) * cb1, along, np.sqrt(np.maximum(along * along + more, 0.0))

    low, high = np.zeros(len(goal)), np.full(len(goal), np.pi)
    for _ in range(HALVINGS):
        alpha = (low + high) / 2
        sin_a0, along, along2 = ends(alpha)
        sigma1 = np.arctan2(sb1, along)
        omega12 = np.arctan2(sin_a0 * sb2, along2) - np.arctan2(sin_a0 * sb1, along)
        reached = omega12 - _lag(sin_a0, _epsilon(np.hypot(np.cos(alpha), np.sin(alpha) * sb1)), sigma1, np.arctan2(sb2, along2) - sigma1)
        short = reached < goal
        low, high = np.where(short, alpha, low), np.where(short, high, alpha)
    sin_a0, along, along2 = ends((low + high) / 2)
    # seen from the near end the line runs the other way, with its east side on the same hand
    return np.arctan2(sin_a0 * np.where(span < 0, -1.0, 1.0), np.where(swap, -along2, along) * sign)


def first_azimuth(lat1: np.ndarray, lng1: np.ndarray, lat2: np.ndarray, lng2: np.ndarray) -> np.ndarray:
    """The inverse problem's azimuth at the first point, in degrees in (-180, 180]."""
    span = _half_turn(lng2 - lng1)
    (sb1, cb1, _), (sb2, cb2, _) = _reduced(lat1), _reduced(lat2)
    far = np.arccos(np.clip(sb1 * sb2 + cb1 * cb2 * np.cos(np.radians(span)), -1, 1)) > NEAR_ANTIPODE
    out = np.empty(len(span))
    for chosen, solve in ((~far, _settled), (far, _halved)):
        if chosen.any():
            out[chosen] = np.degrees(solve(lat1[chosen], lat2[chosen], span[chosen]))
    return np.where(out <= -180, 180.0, out)


def _known(columns: tuple[pd.Series, ...]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rows without a missing value, and the values of those."""
    values = [c.to_numpy(float) for c in columns]
    known = np.isfinite(values).all(axis=0)
    return known, [v[known] for v in values]


def destination(lat: Column, lng: Column, azimuth: Column, distance: Column) -> Column:
    """struct<lat, lng>, the point at a distance in metres along an azimuth in degrees."""

    @F.pandas_udf("lat double, lng double")
    def run(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.DataFrame:
        known, values = _known((a, b, c, d))
        out = pd.DataFrame({"lat": np.nan, "lng": np.nan}, index=range(len(known)))
        if known.any():
            out.loc[known, "lat"], out.loc[known, "lng"] = place(*values)
        return out

    point = run(lat, lng, azimuth, distance)
    return F.when(lat.isNotNull() & lng.isNotNull() & azimuth.isNotNull() & distance.isNotNull(), point)


def azimuth(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """The first azimuth of the shortest line, in degrees in (-180, 180]. Equal points give 0 or 180."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        known, values = _known((a, b, c, d))
        out = np.full(len(known), np.nan)
        if known.any():
            out[known] = first_azimuth(*values)
        return pd.Series(out).where(known)

    return run(lat1, lng1, lat2, lng2)
