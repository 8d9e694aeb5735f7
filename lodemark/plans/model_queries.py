"""Queries for models (M) and the flagship query."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from lodemark.functions import geo
from lodemark.functions.numeric import mapped
from lodemark.operators import boosting, models
from lodemark.operators.aggregate import rounded
from lodemark.operators.models import Geometric
from lodemark.operators.quantiles import apart, beside, lad_slope, quantile, quantiles
from lodemark.plans.clicks import POV_SQL, SQL, clicks, with_angles
from lodemark.registry import query
from lodemark.session import discard, stored

WP = f"WITH {SQL}, {POV_SQL}"
TRAIN = "label_id % 5 <> 0"
_X, _Y = "tan(radians(dep))", "1 / greatest(truth_m, 1e0)"


def _rows(spark, pairs, schema):
    return spark.createDataFrame(pairs, schema)


def _lad_sql(name: str, by: str, where: str, value: str = f"({_Y}) / ({_X})", weight: str = f"abs({_X})") -> str:
    return f"""{name}_v AS (SELECT {by}, {value} AS v, sum({weight}) AS w FROM pov WHERE {where} GROUP BY {by}, {value}),
{name}_c AS (SELECT *, sum(w) OVER (PARTITION BY {by} ORDER BY v ROWS UNBOUNDED PRECEDING) AS c, sum(w) OVER (PARTITION BY {by}) AS t FROM {name}_v),
{name} AS (SELECT {by}, 1 / min(v) AS height_m FROM {name}_c WHERE c >= 0.5 * t GROUP BY {by})"""


def _blend_sql(h: str, dep: str, angle: float) -> str:
    a = math.radians(angle)
    line = f"{h} * {1 / math.tan(a)!r} - {h} * {math.radians(1) / math.sin(a) ** 2!r} * (greatest({dep}, 0e0) - {angle})"
    return f"least(greatest(CASE WHEN {dep} >= {angle} THEN {h} / tan(radians(greatest({dep}, 1e-9))) ELSE {line} END, 0e0), 50e0)"


_DIST = _blend_sql("height_m", "dep", 11.25)


@query(
    "flagship",
    f"""{WP}, {_lad_sql('hs', 'label_type', 'dep > 0')},
q AS (SELECT label_type, pano_lat, pano_lng, truth_m, radians(pov_heading) AS b, radians(pano_lat) AS f0, {_DIST} AS dist FROM pov JOIN hs USING (label_type)),
g AS (SELECT *, dist / 6378137e0 AS g1, truth_m / 6378137e0 AS g2 FROM q),
p AS (SELECT *, asin(sin(f0) * cos(g1) + cos(f0) * sin(g1) * cos(b)) AS f1, asin(sin(f0) * cos(g2) + cos(f0) * sin(g2) * cos(b)) AS f2 FROM g),
r AS (SELECT *, atan2(sin(b) * sin(g1) * cos(f0), cos(g1) - sin(f0) * sin(f1)) AS t1, atan2(sin(b) * sin(g2) * cos(f0), cos(g2) - sin(f0) * sin(f2)) AS t2 FROM p),
e AS (SELECT label_type, power(sin((f2 - f1) / 2), 2) + cos(f1) * cos(f2) * power(sin((t2 - t1) / 2), 2) AS a FROM r)
SELECT label_type, count(*) AS n, round(median(2 * 6378137e0 * atan2(sqrt(a), sqrt(1 - a))), 3) AS median_m, round(quantile_cont(2 * 6378137e0 * atan2(sqrt(a), sqrt(1 - a)), 0.9), 3) AS p90_m FROM e GROUP BY label_type""",
)
def flagship(spark, d):
    """Projection, camera height per type by least absolute deviations, blend prediction, placement, error by type."""
    view = with_angles(clicks(spark, d))
    fit = models.fit_cotangent(view, "l1", "label_type")
    model = Geometric("blend", fit.height_m, fit.height_by_type, 11.25)
    placed = view.select("label_type", "pano_lat", "pano_lng", "pov_heading", "truth_m", models.predict(model, F.col("dep"), F.col("label_type")).alias("dist"))
    a = geo.spherical_dest(*(F.col(c) for c in ("pano_lat", "pano_lng", "pov_heading", "dist")))
    b = geo.spherical_dest(*(F.col(c) for c in ("pano_lat", "pano_lng", "pov_heading", "truth_m")))
    errors = placed.select("label_type", geo.haversine_m(*a, *b).alias("e"))
    return quantiles(errors, ["label_type"], {"median_m": (F.col("e"), 0.5), "p90_m": (F.col("e"), 0.9)}, digits=3)


@query("m01_m03_medians", f"WITH {SQL}, g AS (SELECT median(truth_m) AS m FROM clicks WHERE {TRAIN}), t AS (SELECT label_type, median(truth_m) AS m FROM clicks WHERE {TRAIN} GROUP BY 1) SELECT label_id, 10e0 AS est1, round(g.m, 6) AS est2, round(t.m, 6) AS est3 FROM clicks JOIN t USING (label_type), g WHERE NOT ({TRAIN})")
def m01(spark, d):
    c = clicks(spark, d)
    train, test = c.where(TRAIN), c.where(f"NOT ({TRAIN})")
    overall = quantile(train, F.col("truth_m"), 0.5)
    by_type = quantiles(train, ["label_type"], {"m": (F.col("truth_m"), 0.5)}, digits=None)
    return beside(test, by_type, ["label_type"]).select("label_id", F.lit(10.0).alias("est1"), F.round(F.lit(overall), 6).alias("est2"), rounded(F.col("m"), "est3"))


def _cols(*names):
    return {n: F.col(n).cast("double") for n in names}


def _terms(spark, fits: dict, digits: int = 8):
    rows = [(r, t, float(round(c, digits))) for r, f in sorted(fits.items()) for t, c in zip(f.terms, f.coef, strict=True)]
    return _rows(spark, rows, "response string, term string, coef double")


_DET = "(var_samp(sv_image_y) * var_samp(canvas_y) - power(covar_samp(sv_image_y, canvas_y), 2))"
_B1 = f"(covar_samp(sv_image_y, truth_m) * var_samp(canvas_y) - covar_samp(canvas_y, truth_m) * covar_samp(sv_image_y, canvas_y)) / {_DET}"
_B2 = f"(covar_samp(canvas_y, truth_m) * var_samp(sv_image_y) - covar_samp(sv_image_y, truth_m) * covar_samp(sv_image_y, canvas_y)) / {_DET}"


@query("m07_per_zoom_ols", f"WITH {SQL}, f AS (SELECT zoom, avg(truth_m) AS my, avg(sv_image_y) AS m1, avg(canvas_y) AS m2, {_B1} AS b1, {_B2} AS b2 FROM clicks WHERE {TRAIN} GROUP BY zoom) SELECT zoom, round(my - b1 * m1 - b2 * m2, 6) AS intercept, round(b1, 6) AS sv_image_y, round(b2, 6) AS canvas_y FROM f")
def m07(spark, d):
    fits = models.least_squares(clicks(spark, d).where(TRAIN), _cols("sv_image_y", "canvas_y"), _cols("truth_m"), by=F.col("zoom"))
    return _rows(spark, [(z, *(round(c, 6) for c in f["truth_m"].coef)) for z, f in sorted(fits.items())], "zoom long, intercept double, sv_image_y double, canvas_y double")


def _plane_sql(name: str, y: str, within: str) -> str:
    """Intercept-free slopes of y on (sv_image_y, canvas_y) about the means of `within`, and those means."""
    c = {k: f"{k} - avg({k}) OVER (PARTITION BY {within})" for k in ("sv_image_y", "canvas_y", y)}
    return f"""{name}_c AS (SELECT {c['sv_image_y']} AS a, {c['canvas_y']} AS b, {c[y]} AS y FROM clicks WHERE {TRAIN}),
{name} AS (SELECT (sum(a * y) * sum(b * b) - sum(b * y) * sum(a * b)) / (sum(a * a) * sum(b * b) - sum(a * b) * sum(a * b)) AS ba,
(sum(b * y) * sum(a * a) - sum(a * y) * sum(a * b)) / (sum(a * a) * sum(b * b) - sum(a * b) * sum(a * b)) AS bb FROM {name}_c)"""


def _m04_sql() -> str:
    ctes, rows = [], []
    for y in ("truth_m", "noise"):
        means = f"(SELECT zoom, avg({y}) AS my, avg(sv_image_y) AS ma, avg(canvas_y) AS mb FROM clicks WHERE {TRAIN} GROUP BY zoom)"
        whole = f"(SELECT avg({y}) AS my, avg(sv_image_y) AS ma, avg(canvas_y) AS mb FROM clicks WHERE {TRAIN})"
        for est, within in (("est4", "1"), ("est5", "zoom")):
            f = f"{est}_{y}"
            ctes.append(_plane_sql(f, y, within))
            rows += [f"SELECT '{est} {y}' AS response, 'sv_image_y' AS term, round(ba, 8) AS coef FROM {f}", f"SELECT '{est} {y}', 'canvas_y', round(bb, 8) FROM {f}"]
            base = whole if est == "est4" else f"(SELECT * FROM {means} WHERE zoom = 1)"
            rows.append(f"SELECT '{est} {y}', '(Intercept)', round(my - ba * ma - bb * mb, 8) FROM {f}, {base}")
            if est == "est5":
                rows += [f"SELECT '{est} {y}', 'zoom{z}', round((m.my - ba * m.ma - bb * m.mb) - (o.my - ba * o.ma - bb * o.mb), 8) FROM {f}, (SELECT * FROM {means} WHERE zoom = {z}) m, (SELECT * FROM {means} WHERE zoom = 1) o" for z in (2, 3)]
    return f"WITH {SQL}, {', '.join(ctes)} {' UNION ALL '.join(rows)}"


@query("m04_m05_ols", _m04_sql())
def m04(spark, d):
    c = clicks(spark, d).where(TRAIN)
    zoom = {"zoom2": (F.col("zoom") == 2).cast("double"), "zoom3": (F.col("zoom") == 3).cast("double")}
    ys = _cols("truth_m", "noise")
    plain = models.least_squares(c, _cols("canvas_y", "sv_image_y"), ys)
    dummied = models.least_squares(c, _cols("canvas_y", "sv_image_y") | zoom, ys)
    return _terms(spark, {f"est4 {k}": v for k, v in plain.items()} | {f"est5 {k}": v for k, v in dummied.items()})


@query("m06_mixed_model")
def m06(spark, d):
    fixed, random, ratio = models.mixed_model(clicks(spark, d), _cols("canvas_y", "sv_image_y"), F.col("truth_m"), F.col("zoom"))
    rows = [("fixed", t, round(c, 8)) for t, c in zip(fixed.terms, fixed.coef, strict=True)] + [("zoom", str(k), round(v, 8)) for k, v in sorted(random.items())] + [("variance", "ratio", round(ratio, 10))]
    return _rows(spark, rows, "part string, term string, value double")


@query("m08_per_zoom_medians")
def m08(spark, d):
    """Rung A under the absolute loss: the median line of each zoom level."""
    fits = models.fit_per_zoom(clicks(spark, d).where(TRAIN), "l1", _cols("sv_image_y", "canvas_y"), F.col("truth_m"), F.col("zoom")).fits
    return _rows(spark, [(z, *(round(c, 6) for c in f.coef)) for z, f in sorted(fits.items())], "zoom long, intercept double, sv_image_y double, canvas_y double")


@query("m15_quantile_bands")
def m15(spark, d):
    view = with_angles(clicks(spark, d))
    found = models.quantile_bands(view.where(TRAIN), view.where(f"NOT ({TRAIN})"))
    return _rows(spark, [(k, round(v, 6)) for k, v in found.items()], "name string, value double")


_ANCHOR = "CASE WHEN dep <= 0 THEN 50e0 ELSE least(2.6e0 / tan(radians(greatest(dep, 1e-9))), 50e0) END"


@query("m09_m10_anchors", f"{WP} SELECT label_id, round({_ANCHOR}, 6) AS anchor, CASE WHEN pano_height = 8192 THEN round(least(greatest(2.31e0 / tan(radians(greatest(dep, 1e-9))), 0e0), 50e0), 6) END AS served FROM pov")
def m09(spark, d):
    view = with_angles(clicks(spark, d))
    panos = view.select("pano_id", F.when(F.col("pano_height") != 6656, F.col("pano_height") != 8192).alias("pinned"), F.lit(2.31).alias("height_m")).distinct()
    joined = view.join(models.served_heights(panos), "pano_id", "left")
    served = F.when(F.col("height_m").isNotNull(), F.least(F.greatest(F.col("height_m") / F.tan(F.radians(F.greatest(F.col("dep"), F.lit(1e-9)))), F.lit(0.0)), F.lit(50.0)))
    return joined.select("label_id", rounded(models.anchor(F.col("dep")), "anchor"), rounded(served, "served"))


@query(
    "m11_cotangent_heights",
    f"""{WP}, {_lad_sql('l1', 'label_type', f'dep > 0 AND {TRAIN}')}, o AS (SELECT label_type, sum({_X} * {_X}) / sum({_X} * ({_Y})) AS height_m FROM pov WHERE dep > 0 AND {TRAIN} GROUP BY label_type)
SELECT label_type, round(o.height_m, 6) AS ols_m, round(l1.height_m, 6) AS l1_m FROM o JOIN l1 USING (label_type)""",
)
def m11(spark, d):
    view = with_angles(clicks(spark, d)).where(TRAIN)
    ols, l1 = (models.fit_cotangent(view, loss, "label_type").height_by_type for loss in ("ols", "l1"))
    return _rows(spark, [(k, round(ols[k], 6), round(l1[k], 6)) for k in sorted(ols)], "label_type string, ols_m double, l1_m double")


_GRID = "(SELECT unnest(range(0, 45)) AS k)"
_BLINE = "(hh / tan(radians(a)) - hh * (pi() / 180) / power(sin(radians(a)), 2) * (greatest(dep, 0e0) - a))"


@query(
    "m12_m18_blend_profile",
    f"""{WP}, g AS (SELECT 1e0 + 0.25e0 * k AS a FROM {_GRID}), s AS (SELECT a, sum({_X} * {_X}) / sum({_X} * ({_Y})) AS hh FROM pov, g WHERE dep >= a AND {TRAIN} GROUP BY a),
l AS (SELECT a, any_value(hh) AS hh, avg(power(least(greatest(CASE WHEN dep >= a THEN hh / tan(radians(greatest(dep, 1e-9))) ELSE {_BLINE} END, 0e0), 50e0) - truth_m, 2)) AS loss FROM pov, s WHERE {TRAIN} GROUP BY a)
SELECT a AS blend_deg, round(hh, 6) AS height_m FROM l ORDER BY loss, a LIMIT 1""",
)
def m12(spark, d):
    m = models.fit_blend(with_angles(clicks(spark, d)).where(TRAIN), "ols")
    return _rows(spark, [(m.angle_deg, round(m.height_m, 6))], "blend_deg double, height_m double")


@query("m12_m14_m27_ladder")
def m27(spark, d):
    """All 22 fits: what they are, and their median and 90th percentile error on the test rows."""
    view = with_angles(clicks(spark, d)).withColumn("height_m", F.when(F.col("pano_height") == 8192, 2.31))
    fits = models.ladder(view.where(TRAIN))
    columns = _cols("dep", "zoom", "sv_image_y", "canvas_y", "height_m") | {"label_type": F.col("label_type")}
    errors = {k: F.abs(models.predict_any(m, columns) - F.col("truth_m")) for k, m in fits.items()}
    # Written, as the quantiles read them three times; all in one projection they are longer than the JVM compiles.
    test, path = stored(apart(view.where(f"NOT ({TRAIN})").select("truth_m", *columns), errors).select(*errors))
    found = quantiles(test, [], {f"{k}_{n}": (F.col(k), q) for k in errors for n, q in (("median", 0.5), ("p90", 0.9))}, digits=None).first()
    discard(spark, path)
    shape = {k: (getattr(m, "height_m", None), getattr(m, "angle_deg", None)) for k, m in fits.items()}
    rows = [(k, m.form, *shape[k], *(None if found[f"{k}_{n}"] is None else round(found[f"{k}_{n}"], 6) for n in ("median", "p90"))) for k, m in sorted(fits.items())]
    return _rows(spark, rows, "rung string, form string, height_m double, angle_deg double, median_m double, p90_m double")


_HS = "sum({x} * {x}) / sum({x} * ({y}))"


def _m18_sql() -> str:
    """Two saturating forms at fixed angles, one height each by least squares; the lower training median is chosen."""
    floor = "hf / tan(radians(greatest(dep, 3e0)))"
    return f"""{WP}, t AS (SELECT * FROM pov WHERE {TRAIN}), h AS (SELECT {_HS.format(x='tan(radians(greatest(dep, 3e0)))', y=_Y)} AS hf, sum(CASE WHEN dep >= 11.25 THEN {_X} * {_X} END) / sum(CASE WHEN dep >= 11.25 THEN {_X} * ({_Y}) END) AS hb FROM t),
e AS (SELECT median(abs(least(greatest({floor}, 0e0), 50e0) - truth_m)) AS f, median(abs({_blend_sql('hb', 'dep', 11.25)} - truth_m)) AS b FROM t, h)
SELECT CASE WHEN f <= b THEN 'D_floor' ELSE 'D_blend' END AS rung, round(least(f, b), 6) AS median_m FROM e"""


@query("m18_candidate", _m18_sql())
def m18(spark, d):
    train = with_angles(clicks(spark, d)).where(TRAIN)
    fits = {"D_floor": models._profile(train, "floor", [3.0, 99.0], "ols", None, "dep", "truth_m")[0], "D_blend": models._profile(train, "blend", [11.25, 99.0], "ols", None, "dep", "truth_m")[0]}
    chosen = models.candidate(train, fits | {"C": fits["D_floor"]})
    error = quantile(train, F.abs(models.predict(fits[chosen], F.col("dep")) - F.col("truth_m")), 0.5)
    return _rows(spark, [(chosen, round(error, 6))], "rung string, median_m double")


@query("m18_fitted_rungs")
def m18_fitted(spark, d):
    """The fitted D rungs under least squares, pooled and by type, their training medians, and the one chosen."""
    train = with_angles(clicks(spark, d)).where(TRAIN)
    fits = {}
    for form, grid in (("floor", models.FLOOR_GRID), ("blend", models.BLEND_GRID)):
        fits[f"D_{form}"], fits[f"D_{form}_type"] = models._profile(train, form, grid, "ols", "label_type", "dep", "truth_m")
    fits |= {"D_soft": models.fit_softcap(train, "ols"), "D_soft_type": models.fit_softcap(train, "ols", "label_type")}
    found = models.median_errors(train, fits)
    chosen = models.candidate(train, fits, medians=found)
    return _rows(spark, [(k, m.form, m.angle_deg, round(found[k], 6), k == chosen) for k, m in fits.items()], "rung string, form string, angle_deg double, train_median_m double, chosen boolean")


@query("m12_l1_floor")
def m12_l1(spark, d):
    m = models.fit_floor(with_angles(clicks(spark, d)).where(TRAIN), "l1")
    return _rows(spark, [(m.angle_deg, round(m.height_m, 6))], "dep_min_deg double, height_m double")


@query("m13_isotonic")
def m13(spark, d):
    m = models.fit_isotonic(with_angles(clicks(spark, d)))
    return _rows(spark, [(round(x, 6), round(y, 6)) for x, y in m.knots], "dep double, dist_m double")


def _m16_sql() -> str:
    """Slopes and their errors about the means of (zoom, city), for the two forms with two terms."""
    parts = []
    for form, x, term in (("a_sub", "sv_image_y", "sv_image_y"), ("b_norm", "sv_image_y * (6656e0 / pano_height)", "sv_norm")):
        parts.append(f"""{form}_c AS (SELECT zoom, city, ({x}) - avg({x}) OVER w AS a, canvas_y - avg(canvas_y) OVER w AS b, truth_m - avg(truth_m) OVER w AS y FROM clicks WHERE {TRAIN} AND pano_height IN (6656, 8192) WINDOW w AS (PARTITION BY zoom, city)),
{form}_s AS (SELECT zoom, count(*) AS n, count(DISTINCT city) AS k, sum(a * a) AS aa, sum(b * b) AS bb, sum(a * b) AS ab, sum(a * y) AS ay, sum(b * y) AS yb, sum(y * y) AS yy FROM {form}_c GROUP BY zoom),
{form}_f AS (SELECT *, (ay * bb - yb * ab) / (aa * bb - ab * ab) AS ca, (yb * aa - ay * ab) / (aa * bb - ab * ab) AS cb FROM {form}_s),
{form} AS (SELECT *, (yy - ca * ay - cb * yb) / (n - k - 2) AS s2 FROM {form}_f)""")
    rows = [f"SELECT '{form}' AS form, zoom, '{t}' AS term, round({c}, 8) AS coef, round(sqrt(s2 * {v} / (aa * bb - ab * ab)), 8) AS se FROM {form}" for form, term in (("a_sub", "sv_image_y"), ("b_norm", "sv_norm")) for t, c, v in ((term, "ca", "bb"), ("canvas_y", "cb", "aa"))]
    return f"WITH {SQL}, {', '.join(parts)} {' UNION ALL '.join(rows)}"


_HEIGHT_ROWS = "form string, zoom long, term string, coef double, se double"


def _rounded_rows(rows):
    return [(f, z, t, None if c is None else round(c, 8), None if s is None else round(s, 8)) for f, z, t, c, s in rows]


@query("m16_city_fixed_effects", _m16_sql())
def m16(spark, d):
    c = clicks(spark, d)
    rows = models.height_terms(c.where(TRAIN), c.where(f"NOT ({TRAIN})"))
    return _rows(spark, _rounded_rows(r for r in rows if r[0] in ("a_sub", "b_norm") and not r[2].startswith("error")), _HEIGHT_ROWS)


@query("m16_height_terms")
def m16_all(spark, d):
    """All four forms with their test errors."""
    c = clicks(spark, d)
    return _rows(spark, _rounded_rows(models.height_terms(c.where(TRAIN), c.where(f"NOT ({TRAIN})"))), _HEIGHT_ROWS)


@query("m16_l1_errors")
def m16_l1(spark, d):
    """Test errors of all four forms under the absolute loss."""
    c = clicks(spark, d)
    return _rows(spark, _rounded_rows(models.height_terms(c.where(TRAIN), c.where(f"NOT ({TRAIN})"), losses=("l1",))), _HEIGHT_ROWS)


@query("m17_apply_path", f"WITH {SQL} SELECT pano_height, count(*) AS n, round(median(abs(greatest(0e0, 18e0 + 0.012e0 * sv_image_y) - truth_m)), 6) AS raw_m, round(median(abs(greatest(0e0, 18e0 + 0.012e0 * (sv_image_y * 6656e0 / pano_height)) - truth_m)), 6) AS normal_m FROM clicks GROUP BY pano_height")
def m17(spark, d):
    def err(y):
        return F.abs(F.greatest(F.lit(0.0), 18 + 0.012 * y) - F.col("truth_m"))

    y = F.col("sv_image_y").cast("double")
    return quantiles(clicks(spark, d), ["pano_height"], {"raw_m": (err(y), 0.5), "normal_m": (err(y * 6656 / F.col("pano_height")), 0.5)})


@query("m19_structural_bound", f"WITH s AS (SELECT k / 400e0 - 90 AS dep, height_m FROM (SELECT unnest(range(0, 72001)) AS k), (SELECT unnest([2.1e0, 2.4e0, 2.6e0]) AS height_m)) SELECT round(max({_DIST}), 6) AS bound_m FROM s")
def m19(spark, d):
    m = Geometric("blend", 2.6, {"AF": 2.1, "NO": 2.4}, 11.25)
    return _rows(spark, [(round(models.structural_bound(m, spark, ["AF", "NO"]), 6),)], "bound_m double")


@query("m20_era_shift", f"WITH {SQL} SELECT round(avg(truth_m - noise), 6) AS shift FROM clicks WHERE {TRAIN}")
def m20(spark, d):
    return _rows(spark, [(round(models.era_shift(clicks(spark, d).where(TRAIN), F.col("truth_m"), F.col("noise")), 6),)], "shift double")


_TYPES = ["AF", "NF", "NO", "RF"]


def _boosting_view(view):
    """Clicks as the benchmark sees them: the height of the oldest panoramas is not known."""
    return view.withColumn("pano_height", F.when(F.col("pano_height") != 1664, F.col("pano_height")))


@query("m21_boosted_trees")
def m21(spark, d):
    """The thirteen models of the benchmark, at most 100 rounds, on the test rows; the ablations beside the full model."""
    view = _boosting_view(with_angles(clicks(spark, d)))
    features = boosting.benchmark_features(F.col("dep"))
    fits = boosting.fit_boosted(view.where(TRAIN), boosting.benchmark_specs(), features, {"label_type": _TYPES}, F.col("truth_m"), "label_id", rounds=100, stop=5, depth=3)
    scored = boosting.predict_boosted(view.where(f"NOT ({TRAIN})"), fits, features)
    place = {k: geo.haversine_m(F.col("lat"), F.col("lng"), *geo.spherical_dest(F.col("pano_lat"), F.col("pano_lng"), F.col("pov_heading"), F.col(k))) for k in fits}
    long = scored.select(*[F.abs(F.col(k) - F.col("truth_m")).alias(f"{k}_dist") for k in fits], *[place[k].alias(f"{k}_place") for k in fits])
    found = quantiles(long, [], {f"{k}_{e}_{n}": (F.col(f"{k}_{e}"), q) for k in fits for e in ("dist", "place") for n, q in (("median", 0.5), ("p90", 0.9))}, digits=None).first()
    rows = []
    for k, m in fits.items():
        own = [found[f"{k}_{e}_{n}"] for e in ("dist", "place") for n in ("median", "p90")]
        delta = own[0] - found["gbm_l1_dist_median"] if k.startswith("drop_") and own[0] is not None else None
        rows.append((k, m.best_round, found["n"], *own, delta))
    return _rows(spark, rows, "model string, rounds int, n long, dist_median_m double, dist_p90_m double, place_median_m double, place_p90_m double, delta_dist_median_m double")


@query("m21_gain_importances")
def m21_gains(spark, d):
    """What each feature's splits bring to the full model."""
    view = _boosting_view(with_angles(clicks(spark, d))).where(TRAIN)
    spec = boosting.Spec("gbm_l1", boosting.FEATURES)
    model = boosting.fit_boosted(view, [spec], boosting.benchmark_features(F.col("dep")), {"label_type": _TYPES}, F.col("truth_m"), "label_id", rounds=100, stop=5, depth=3)["gbm_l1"]
    total = sum(model.gains.values()) or 1.0
    return _rows(spark, [(f, model.gains.get(f, 0.0), model.gains.get(f, 0.0) / total) for f in spec.features], "feature string, gain double, gain_share double")


def site_members(view):
    """Members of sites: a ray from each camera, with its distance, in local metres."""
    e, n = geo.local_east_north(F.col("pano_lat"), F.col("pano_lng"), F.lit(40.5), F.lit(-74.5))
    turn = F.radians("pov_heading")
    return view.select(
        F.concat_ws("-", F.lit("q"), F.col("pano_id") % 40).alias("sequence_id"), (F.col("label_id") % 500).alias("site_id"), (e % 20).alias("e0"), (n % 20).alias("n0"), F.sin(turn).alias("ux"), F.cos(turn).alias("uy"), F.col("truth_m").alias("d0")
    )


@query("m22_sequence_scales")
def m22(spark, d):
    return models.sequence_scales(site_members(with_angles(clicks(spark, d)))).select("sequence_id", "n_members", "n_fit_members", rounded(F.col("k_rel"), "k_rel"))


@query("m23_scale_transfer")
def m23(spark, d):
    """Scales of one half of the sites on the other half, for five splits."""
    return models.scale_transfer(site_members(with_angles(clicks(spark, d))), [1, 2, 3, 4, 5])


_GATE = "deleted IS NOT TRUE AND tutorial IS NOT TRUE AND computation_method <> 'other'"


@query(
    "m25_final_coefficients",
    f"""{WP}, g AS (SELECT * FROM pov WHERE {_GATE}), h AS (SELECT median(truth_m * tan(radians(dep))) AS height_m, count(*) AS n_fit FROM g WHERE dep >= 5),
e AS (SELECT height_m, n_fit, {_DIST} - truth_m AS e FROM g, h) SELECT count(*) AS n, any_value(n_fit) AS n_fit, round(any_value(height_m), 6) AS height_m, round(median(abs(e)), 6) AS median_abs_m, round(median(e), 6) AS signed_m, round(quantile_cont(abs(e), 0.9), 6) AS p90_m FROM e""",
)
def m25(spark, d):
    """One flat height from all gated clicks, and its errors on them."""
    gated = with_angles(clicks(spark, d)).where(_GATE)
    steep = gated.where("dep >= 5")
    found = quantiles(steep, [], {"h": (F.col("truth_m") * F.tan(F.radians("dep")), 0.5)}, digits=None).first()
    e = models.predict(Geometric("blend", found["h"], {}, 11.25), F.col("dep")) - F.col("truth_m")
    out = quantiles(gated, [], {"median_abs_m": (F.abs(e), 0.5), "signed_m": (e, 0.5), "p90_m": (F.abs(e), 0.9)})
    return out.select("n", F.lit(found["n"]).alias("n_fit"), F.lit(round(found["h"], 6)).alias("height_m"), "median_abs_m", "signed_m", "p90_m")


@query("m24_m26_implied_heights", f"{WP} SELECT label_type, count(*) AS n, round(median(truth_m * tan(radians(dep))), 6) AS implied_height_m FROM pov WHERE dep >= 5 GROUP BY label_type HAVING count(*) >= 25")
def m26(spark, d):
    return models.implied_heights(with_angles(clicks(spark, d)), ["label_type"])


_ASSIGNED = "CASE label_type WHEN 'AF' THEN 2.1e0 WHEN 'NO' THEN 2.4e0 ELSE 2.6e0 END"


@query(
    "m24_remedy",
    f"""{WP}, i AS (SELECT median(truth_m * tan(radians(dep))) AS flat, median(truth_m * tan(radians(dep)) / ({_ASSIGNED})) AS k FROM pov WHERE dep >= 5 AND pano_id % 2 = 0),
t AS (SELECT dep, truth_m, flat, ({_ASSIGNED}) * k AS scaled, {_ASSIGNED} AS plain FROM pov, i WHERE pano_id % 2 = 1)
SELECT count(*) AS n, round(median(abs({_blend_sql('plain', 'dep', 11.25)} - truth_m)), 6) AS plain_m, round(median(abs({_blend_sql('scaled', 'dep', 11.25)} - truth_m)), 6) AS rescaled_m,
round(median(abs({_blend_sql('flat', 'dep', 11.25)} - truth_m)), 6) AS flat_m FROM t""",
)
def m24(spark, d):
    """The heights of one half of the panoramas, scored on the other: as assigned, all rescaled, and one flat height."""
    view = with_angles(clicks(spark, d))
    assigned = Geometric("blend", 2.6, {"AF": 2.1, "NO": 2.4}, 11.25)
    half = view.where("dep >= 5 AND pano_id % 2 = 0")
    implied = F.col("truth_m") * F.tan(F.radians("dep"))
    found = quantiles(half, [], {"flat": (implied, 0.5), "k": (implied / mapped(F.col("label_type"), assigned.height_by_type, assigned.height_m), 0.5)}, digits=None).first()
    arms = {"plain_m": assigned, "rescaled_m": models.rescaled(assigned, found["k"]), "flat_m": Geometric("blend", found["flat"], {}, 11.25)}
    errors = {k: (F.abs(models.predict(m, F.col("dep"), F.col("label_type")) - F.col("truth_m")), 0.5) for k, m in arms.items()}
    return quantiles(view.where("pano_id % 2 = 1"), [], errors)


@query("w05_lad_slope", f"{WP}, {_lad_sql('s', 'city', 'dep > 0')} SELECT city, round(1 / height_m, 8) AS slope FROM s")
def lad(spark, d):
    view = with_angles(clicks(spark, d)).where("dep > 0")
    return lad_slope(view, ["city"], F.tan(F.radians("dep")), 1 / F.greatest("truth_m", F.lit(1.0))).select("city", F.round("slope", 8).alias("slope"))
