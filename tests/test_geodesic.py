"""Geodesics against quadrature of their integrals in extended precision, antipodes and poles included."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodemark.functions import geo, geodesic

L = np.longdouble
A, FL = L(6378137), L(1) / L("298.257223563")
NODES, WEIGHTS = (x.astype(L) for x in np.polynomial.legendre.leggauss(80))
PI = L("3.14159265358979323846264338327950288")
D = PI / 180


def integral(f, a, b):
    return ((b - a) / 2 * WEIGHTS * f((b - a) / 2 * NODES + (a + b) / 2)).sum()


def line(lat1, azimuth, sigma12):
    """Distance, second latitude and longitude difference of the line that goes sigma12 on the auxiliary sphere."""
    beta = np.arctan2((1 - FL) * np.sin(lat1 * D), np.sin((90 - abs(lat1)) * D))
    sa, ca = np.sin(azimuth * D), np.cos(azimuth * D)
    sin_a0, cos_a0 = sa * max(np.sin((90 - abs(lat1)) * D), L("1e-30")) / np.hypot((1 - FL) * np.sin(lat1 * D), np.sin((90 - abs(lat1)) * D)), np.hypot(ca, sa * np.sin(beta))
    k2 = (FL * (2 - FL)) / (1 - FL) ** 2 * cos_a0**2
    near = max(np.cos(beta), L("1e-30"))
    s1 = np.arctan2(np.sin(beta), ca * near)
    s2 = s1 + sigma12
    root = lambda s: np.sqrt(1 + k2 * np.sin(s) ** 2)
    distance = A * (1 - FL) * integral(root, s1, s2)
    omega = np.unwrap(np.arctan2(sin_a0 * np.sin(np.linspace(s1, s2, 400)), np.cos(np.linspace(s1, s2, 400))).astype(float))
    turn = np.arctan2(sin_a0 * np.sin(s2), np.cos(s2)) - np.arctan2(sin_a0 * np.sin(s1), np.cos(s1))
    turn += 2 * PI * np.round((L(omega[-1] - omega[0]) - turn) / (2 * PI))
    turn -= FL * sin_a0 * integral(lambda s: (2 - FL) / (1 + (1 - FL) * root(s)), s1, s2)
    beta2 = np.arctan2(cos_a0 * np.sin(s2), np.hypot(cos_a0 * np.cos(s2), sin_a0))
    return distance, np.arctan2(np.sin(beta2), (1 - FL) * np.cos(beta2)) / D, turn / D


def cases():
    rng = np.random.default_rng(5)
    for _ in range(150):
        yield rng.uniform(-89, 89), rng.uniform(-180, 180), 10 ** rng.uniform(-5, 0.45)
    for lat in (90.0, -90.0, 89.9999999, 0.0, 1e-9, -45.0):
        for azimuth in (0.0, 33.0, 90.0, 180.0, -120.0):
            for sigma in (1e-5, 0.3, 2.0):
                yield lat, azimuth, sigma


def test_destinations_equal_quadrature(spark):
    # at a pole the quadrature's longitude is a matter of rounding: see the special points below
    rows = [(float(lat), float(az), *map(float, line(L(lat), L(az), L(s)))) for lat, az, s in cases() if abs(lat) < 90]
    df = spark.createDataFrame(rows, "lat double, az double, dist double, lat2 double, turn double")
    p = geodesic.destination(F.col("lat"), F.lit(20.0), F.col("az"), F.col("dist"))
    for r in df.select("*", p.alias("p")).collect():
        away = (r["p"]["lng"] - 20 - r["turn"] + 180) % 360 - 180
        assert abs(r["p"]["lat"] - r["lat2"]) < 1e-9 and abs(away) * np.cos(np.radians(r["lat2"])) < 1e-9, r


def test_azimuths_of_ordinary_lines_equal_quadrature(spark):
    rows = []
    for lat, az, s in cases():
        distance, lat2, turn = line(L(lat), L(az), L(s))
        # a degree of latitude in doubles is good to some 1e-14, which a short line turns by that over its length
        if abs(turn) < 179:
            rows.append((float(lat), float(az), float(lat2), float(turn), float(max(1e-9, 3e-14 / float(s) * 180 / np.pi / max(np.cos(np.radians(float(lat))), 1e-3)))))
    df = spark.createDataFrame(rows, "lat double, az double, lat2 double, turn double, tolerance double")
    for r in df.select("*", geodesic.azimuth(F.col("lat"), F.lit(0.0), F.col("lat2"), F.col("turn")).alias("a")).collect():
        away = abs((r["a"] - r["az"] + 180) % 360 - 180)
        if abs(r["lat"]) == 90:  # at a pole the azimuth is a matter of the longitude that it is seen from
            assert -180 < r["a"] <= 180
        else:
            assert away < r["tolerance"], r


def reach(lat1, lat2, azimuth):
    """Longitude that the line from lat1 (south, no nearer to the equator) reaches where it is at lat2, going north."""
    b1, b2 = (np.arctan2((1 - FL) * np.sin(x * D), np.cos(x * D)) for x in (lat1, lat2))
    sin_a0, ca = np.sin(azimuth * D) * np.cos(b1), np.cos(azimuth * D)
    s1 = np.arctan2(np.sin(b1), ca * np.cos(b1))
    s2 = np.arctan2(np.sin(b2), np.sqrt(max((ca * np.cos(b1)) ** 2 + np.cos(b2) ** 2 - np.cos(b1) ** 2, L(0))))
    return line(lat1, azimuth, s2 - s1)[2]


@pytest.mark.parametrize(("lat1", "lat2", "span"), [(-30.0, 29.9, 179.8), (-30.0, 29.9, 179.4), (-30.0, 30.0, 179.5), (-45.0, 44.7, -179.7), (-5.0, 4.9, 179.0), (-60.0, 59.99, 179.9), (-0.5, 0.5, 179.5), (-80.0, 79.5, 179.5)])
def test_azimuths_near_the_antipode(spark, lat1, lat2, span):
    low, high = L(0), L(180)
    for _ in range(70):
        middle = (low + high) / 2
        low, high = (middle, high) if reach(L(lat1), L(lat2), middle) < abs(span) else (low, middle)
    want = float(low) * np.sign(span)
    mirrored = 180 - abs(want)
    a, b, c = spark.range(1).select(
        geodesic.azimuth(F.lit(lat1), F.lit(10.0), F.lit(lat2), F.lit(10.0 + span)), geodesic.azimuth(F.lit(-lat1), F.lit(10.0), F.lit(-lat2), F.lit(10.0 + span)),
        geodesic.azimuth(F.lit(lat1), F.lit(10.0), F.lit(lat2), F.lit(10.0 - span)),
    ).first()
    assert abs(a - want) < 1e-9 and abs(abs(b) - mirrored) < 1e-9 and abs(c + want) < 1e-9


def test_symmetry_and_ends_of_near_antipodal_lines(spark):
    """The way back leaves the second point at the azimuth that the way there arrives with, less half a turn."""
    rng = np.random.default_rng(11)
    rows = [(float(a), float(-a + d), float(180 - e)) for a, d, e in zip(rng.uniform(-80, 80, 60), rng.uniform(-0.4, 0.4, 60), rng.uniform(-0.8, 0.8, 60), strict=True)]
    df = spark.createDataFrame(rows, "lat double, lat2 double, span double")
    there = geodesic.azimuth(F.col("lat"), F.lit(0.0), F.col("lat2"), F.col("span"))
    back = geodesic.azimuth(F.col("lat2"), F.col("span"), F.col("lat"), F.lit(0.0))
    for r in df.select("*", there.alias("t"), back.alias("b")).collect():
        # both azimuths have the same Clairaut constant
        c = [np.sin(np.radians(r[k])) * np.cos(np.arctan((1 - float(FL)) * np.tan(np.radians(r[p])))) for k, p in (("t", "lat"), ("b", "lat2"))]
        assert abs(c[0] + c[1]) < 1e-9, r


def test_special_points_and_nulls(spark):
    z = lambda *x: geodesic.azimuth(*(F.lit(v).cast("double") for v in x))
    found = spark.range(1).select(z(0, 0, 0, 10), z(0, 0, 0, -10), z(0, 0, 10, 0), z(10, 5, 0, 5), z(0, 0, 0, 180), z(-90, 0, 10, 40), z(90, 0, 10, 40), z(None, 0, 1, 1), z(0, 179, 0, -179), z(30, 0, -30, 180)).first()
    want = [90, -90, 0, 180, 0, 40, 140, None, 90, 0]
    assert all((g is None and w is None) or abs(g - w) < 1e-9 for g, w in zip(found, want, strict=True)), found
    p = spark.range(1).select(geodesic.destination(F.lit(0.0), F.lit(179.9999), F.lit(90.0), F.lit(1000.0)), geodesic.destination(F.lit(0.0), F.lit(None).cast("double"), F.lit(90.0), F.lit(1.0))).first()
    north, south = spark.range(1).select(*(geodesic.destination(F.lit(90.0), F.lit(20.0), F.lit(az), F.lit(1000.0)) for az in (0.0, 180.0))).first()
    assert abs(north["lng"] + 160) < 1e-9 and abs(south["lng"] - 20) < 1e-9 and abs(north["lat"] - south["lat"]) < 1e-12
    assert -180 < p[0]["lng"] < -179.9 and abs(p[0]["lat"]) < 1e-12 and p[1] is None


def test_placement_error_is_the_distance_between_the_places(spark):
    """On the ellipsoid, a point set out along the azimuth to the truth by the true distance has no error."""
    distance, lat2, turn = line(L(40), L(71), L(5) / L(6371000))
    got = spark.range(1).select(geo.latlng_error_m(7, *(F.lit(float(v)) for v in (40, -75, 71, distance, lat2, turn - 75)))).first()[0]
    assert got < 1e-6
