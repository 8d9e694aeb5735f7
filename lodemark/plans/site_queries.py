"""Queries for diagnoses of sites, censuses, fidelity, tilt and nested summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodemark.functions import distances, pov
from lodemark.functions.numeric import closed_bin
from lodemark.operators import estimators, models, reports
from lodemark.operators.aggregate import error_metrics, rounded
from lodemark.operators.quantiles import quantiles
from lodemark.plans.clicks import POV_SQL, SQL, clicks, with_angles
from lodemark.plans.sampling_queries import _TAIL, _line_sql
from lodemark.registry import query

W = f"WITH {SQL}"
WP = f"WITH {SQL}, {POV_SQL}"

#: The four models in SQL over dep and pano_height.
_MODELS = {
    "a_status_quo": _line_sql("-dep / 180e0 * pano_height", "240e0", False), "b_normalized": _line_sql("-dep / 180e0 * 6656e0", "240e0", False),
    "c_cotangent": "2.6e0 / tan(radians(dep))", "d_blend": f"CASE WHEN dep >= 11.25 THEN 2.783e0 / tan(radians(dep)) ELSE least(greatest({_TAIL}, 0e0), 50e0) END",
}


# ------------------------------------------------------------------ V07

#: Members of sites: clicks below the horizon, their cameras within twenty metres.
_MEMBER = {"site_id": "label_id % 500", "e": "(pano_id * 37 % 2000) / 100e0", "n": "(pano_id * 53 % 2000) / 100e0", "bearing_deg": "pov_heading", "dep_deg": "dep", "pano_height": "pano_height"}


def _diagnosis_sql(model: str) -> str:
    return f"""{model}_p AS (SELECT site, h, ux, uy, d, e + d * ux AS px, n + d * uy AS py FROM (SELECT *, {_MODELS[model]} AS d FROM m)),
{model}_c AS (SELECT *, px - avg(px) OVER w AS ex, py - avg(py) OVER w AS ey, greatest(avg(d) OVER w, 0.5e0) AS mr FROM {model}_p WINDOW w AS (PARTITION BY site)),
{model}_a AS (SELECT site, h, d, ex * ex + ey * ey AS sq, ex * ux + ey * uy AS al, (ex * ux + ey * uy) / mr AS ar FROM {model}_c),
{model}_w AS (SELECT *, d - avg(d) OVER w AS dx, h - avg(h) OVER w AS hx, al - avg(al) OVER w AS ay, ar - avg(ar) OVER w AS ry FROM {model}_a WINDOW w AS (PARTITION BY site)),
{model}_s AS (SELECT count(*) AS n, count(DISTINCT site) AS k, sqrt(avg(sq)) / avg(d) AS rr, sum(dx * dx) AS dd, sum(dx * ay) AS da, sum(ay * ay) AS aa, sum(hx * hx) AS hh, sum(hx * ry) AS hr, sum(ry * ry) AS r2 FROM {model}_w)"""


def _diagnosis_row(model: str) -> str:
    dof = "greatest(n - k - 1, 1)"
    return f"""SELECT '{model}' AS model, k AS n_sites, n AS n_members, round(rr, 4) AS rms_over_range, round(da / dd, 4) AS range_slope, round(sqrt((aa - da * da / dd) / {dof} / dd), 4) AS range_se,
round(hr / hh, 4) AS height_slope, round(sqrt((r2 - hr * hr / hh) / {dof} / hh), 4) AS height_se FROM {model}_s"""


@query(
    "v07_site_models",
    f"{WP}, m AS (SELECT {_MEMBER['site_id']} AS site, {_MEMBER['e']} AS e, {_MEMBER['n']} AS n, sin(radians(pov_heading)) AS ux, cos(radians(pov_heading)) AS uy, dep, pano_height, pano_height / 6656e0 AS h FROM pov WHERE dep >= 1), "
    + ", ".join(map(_diagnosis_sql, _MODELS)) + " " + " UNION ALL ".join(map(_diagnosis_row, _MODELS)),
)
def v07_models(spark, d):
    return reports.site_diagnosis(with_angles(clicks(spark, d)).where("dep >= 1").selectExpr(*(f"{e} AS {c}" for c, e in _MEMBER.items())))


# ------------------------------------------------------------------ V06

#: Captures derived from lineitem: sequences that walk north in even steps, with raw and computed places.
_CAPTURE = {
    "pano_id": "l_orderkey * 10 + l_linenumber", "sequence_id": "concat('q', cast(l_orderkey % 97 AS varchar(4)))", "captured_at_ms": "(l_orderkey - l_orderkey % 97) * (20 + l_orderkey % 97 % 5 * 150) + l_linenumber * 7000",
    "lat": "40e0 + (l_orderkey - l_orderkey % 97 + l_linenumber * 3) * (1 + l_orderkey % 97 % 7 * 12) / 10000000e0", "lng": "-75e0 + (l_orderkey % 97) / 1000e0",
    "raw_lat": "40e0 + (l_orderkey - l_orderkey % 97 + l_linenumber * 3) * (1 + l_orderkey % 97 % 7 * 12) / 10000000e0 + (l_suppkey % 41 - 20) / 1000000e0", "raw_lng": "-75e0 + (l_orderkey % 97) / 1000e0 + (l_partkey % 37 - 18) / 1000000e0",
    "compass_angle": "CASE WHEN l_partkey % 11 = 0 THEN 0e0 ELSE (l_partkey % 3600) / 10e0 END", "computed_compass_angle": "((l_partkey + l_suppkey % 300) % 3600) / 10e0",
    "altitude": "CASE WHEN l_partkey % 29 = 0 THEN NULL ELSE (l_partkey % 500) / 10e0 END", "computed_altitude": "(l_partkey % 500) / 10e0 + (l_suppkey % 21 - 10) / 4e0",
    "camera_make": "CASE WHEN l_orderkey % 97 % 6 = 5 THEN NULL ELSE concat('make', cast(l_orderkey % 97 % 6 AS varchar(2))) END", "camera_model": "CASE WHEN l_suppkey % 9 = 0 THEN NULL ELSE concat('m', cast(l_orderkey % 97 % 4 AS varchar(2))) END",
    "width": "CASE WHEN l_suppkey % 5 = 0 THEN 4096 ELSE 8192 END", "height": "CASE WHEN l_suppkey % 5 = 0 THEN 2048 ELSE 4096 END", "members": "(l_partkey + l_linenumber) % 3",
}
_CAPTURES = "p AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in _CAPTURE.items()) + " FROM lineitem)"
_RIG = "concat_ws(' / ', coalesce(camera_make, '(none)'), coalesce(camera_model, '(none)'))"


def captures(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/lineitem.parquet").selectExpr(*(f"{e} AS {c}" for c, e in _CAPTURE.items()))


def _meters_sql(lat1: str, lng1: str, lat2: str, lng2: str) -> str:
    half = f"power(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * power(sin(radians({lng2} - {lng1}) / 2), 2)"
    return f"(2 * 6371008.8e0 * asin(sqrt({half})))"


_SEQUENCES = f"""{_CAPTURES}, l AS (SELECT sequence_id, members, captured_at_ms, lat, lng, lag(captured_at_ms) OVER w AS t0, lag(lat) OVER w AS lat0, lag(lng) OVER w AS lng0 FROM p WINDOW w AS (PARTITION BY sequence_id ORDER BY captured_at_ms, pano_id)),
st AS (SELECT sequence_id, members, (captured_at_ms - t0) / 1000e0 AS s, {_meters_sql('lat0', 'lng0', 'lat', 'lng')} AS m FROM l),
sa AS (SELECT sequence_id, count(*) AS n_panos, sum(members) AS n_members, count(*) FILTER (WHERE s > 0 AND s <= 60) AS k, median(m / s) FILTER (WHERE s > 0 AND s <= 60) AS frame, median(m) FILTER (WHERE s > 0 AND s <= 60) AS space,
sum(m) FILTER (WHERE s > 0 AND s <= 60) AS way, sum(s) FILTER (WHERE s > 0 AND s <= 60) AS took FROM st GROUP BY sequence_id),
sb AS (SELECT sequence_id, n_panos, n_members, CASE WHEN n_panos >= 3 AND k >= 2 THEN least(frame, way / took) END AS speed_mps, CASE WHEN n_panos >= 3 AND k >= 2 THEN space END AS spacing_m FROM sa),
sc AS (SELECT *, CASE WHEN speed_mps IS NULL THEN 'unknown' WHEN speed_mps > 5.5 OR spacing_m > 25 THEN 'vehicle' WHEN speed_mps < 2 AND spacing_m < 4 THEN 'on_foot' ELSE 'slow' END AS capture_mode FROM sb),
rg AS (SELECT sequence_id, rig FROM (SELECT sequence_id, {_RIG} AS rig, count(*) AS n FROM p GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY sequence_id ORDER BY n DESC, rig) = 1),
hg AS (SELECT sequence_id, height FROM (SELECT sequence_id, height, count(*) AS n FROM p GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY sequence_id ORDER BY n DESC, height) = 1)"""


@query("v06_sequence_table", f"WITH {_SEQUENCES} SELECT sequence_id, n_panos, n_members, round(speed_mps, 5) AS speed_mps, round(spacing_m, 5) AS spacing_m, capture_mode, rig, height FROM sc JOIN rg USING (sequence_id) JOIN hg USING (sequence_id)")
def v06_sequences(spark, d):
    s = reports.sequence_table(captures(spark, d))
    return s.select("sequence_id", "n_panos", "n_members", rounded(F.col("speed_mps"), "speed_mps", 5), rounded(F.col("spacing_m"), "spacing_m", 5), "capture_mode", "rig", "height")


@query("v06_capture_modes", f"WITH {_SEQUENCES} SELECT capture_mode, count(*) AS n_sequences, sum(n_panos) AS n_panos, sum(n_members) AS n_members FROM sc GROUP BY capture_mode")
def v06_modes(spark, d):
    return reports.mode_census(reports.sequence_table(captures(spark, d)))


@query(
    "v06_rigs",
    f"""WITH {_CAPTURES}, z AS (SELECT {_RIG} AS rig, sequence_id, members, concat(width, 'x', height) AS size FROM p), s AS (SELECT rig, size, count(*) AS n FROM z GROUP BY ALL),
m AS (SELECT rig, size, n FROM s QUALIFY row_number() OVER (PARTITION BY rig ORDER BY n DESC, size) = 1), a AS (SELECT rig, count(*) AS n_panos, count(DISTINCT sequence_id) AS n_sequences, sum(members) AS n_members, count(DISTINCT size) AS n_sizes FROM z GROUP BY rig)
SELECT rig, n_panos, n_sequences, n_members, n_sizes, size AS main_size, round(n / n_panos, 6) AS main_share FROM a JOIN m USING (rig)""",
)
def v06_rigs(spark, d):
    return reports.rig_census(captures(spark, d))


_TURN = "(computed_compass_angle - compass_angle)"


@query(
    "v06_position_shifts",
    f"""WITH {_CAPTURES}, s AS (SELECT {_RIG} AS rig, {_meters_sql('raw_lat', 'raw_lng', 'lat', 'lng')} AS m, abs(({_TURN} + 180) - 360e0 * floor(({_TURN} + 180) / 360e0) - 180) AS c, computed_altitude - altitude AS a, compass_angle, width, height FROM p)
SELECT rig, count(*) AS n, round(median(m), 3) AS shift_median, round(quantile_cont(m, 0.9), 3) AS shift_p90, round(max(m), 3) AS shift_max, round(median(c), 3) AS compass_median, round(quantile_cont(c, 0.9), 3) AS compass_p90,
round(quantile_cont(a, 0.1), 3) AS rise_p10, round(median(a), 3) AS rise_median, round(quantile_cont(a, 0.9), 3) AS rise_p90, count(*) FILTER (WHERE compass_angle = 0) AS compass_zero, bool_and(width = 2 * height) AS all_true_size FROM s GROUP BY rig""",
)
def v06_shifts(spark, d):
    found = reports.position_shifts(captures(spark, d).select("*", reports.rig().alias("rig")), ["rig"])
    names = ["shift_median", "shift_p90", "shift_max", "compass_median", "compass_p90", "rise_p10", "rise_median", "rise_p90"]
    return found.select("rig", "n", *[rounded(F.col(c), c, 3) for c in names], "compass_zero", "all_true_size")


# ------------------------------------------------------------------ V05

#: Older clicks on a tenth of the panoramas were stored with another camera heading; one panorama in fifty has no pixels.
_DRIFT = "CASE WHEN pano_id % 10 = 0 AND time_created < TIMESTAMP '1996-01-01' THEN 0.7e0 + (pano_id % 7) * 0.3e0 ELSE 0e0 END"


def _pixel_sql(camera: str) -> str:
    turn = f"(pov_heading - 360 * floor(pov_heading / 360) - (({camera} + 180) - 360 * floor(({camera} + 180) / 360)))"
    x = f"round_even(pano_width * {turn} / 360, 0)"
    return f"({x} - pano_width * floor({x} / pano_width))"


@query(
    "v05_replay_fidelity",
    f"""{WP}, a AS (SELECT city, pano_id, pano_width AS w, coalesce(time_created < TIMESTAMP '1996-01-01', true) AS early, {_pixel_sql('camera_heading')} AS x, {_pixel_sql(f'(camera_heading + {_DRIFT})')} AS sx, label_id FROM pov WHERE pano_id % 50 <> 7),
b AS (SELECT *, x - sx + w / 2e0 - w * floor((x - sx + w / 2e0) / w) - w / 2e0 AS dx, CASE WHEN label_id % 97 = 0 THEN 1 ELSE 0 END AS dy FROM a),
r AS (SELECT city, count(*) AS n, round(avg(cast(dy = 0 AS double)), 6) AS y_exact, round(avg(cast(dx = 0 AS double)), 6) AS x_exact, round(avg(cast(abs(dx) <= 1 AS double)), 6) AS x_within_1px,
round(avg(cast(dx = 0 AS double)) FILTER (WHERE early), 6) AS x_exact_early, round(avg(cast(dx = 0 AS double)) FILTER (WHERE NOT early), 6) AS x_exact_late FROM b GROUP BY city),
q AS (SELECT city, pano_id, avg(dx / w * 360) AS a, stddev_samp(dx / w * 360) AS s FROM b WHERE abs(dx) > 1 GROUP BY ALL),
t AS (SELECT city, round(median(s), 4) AS spread_within, round(stddev_samp(a), 4) AS spread_across, count(*) AS n_panos_off FROM q GROUP BY city) SELECT * FROM r LEFT JOIN t USING (city)""",
)
def v05_replay(spark, d):
    """Stored rows are one off on a label in 97."""
    view = with_angles(clicks(spark, d))
    w, h = (F.col(c).cast("double") for c in ("pano_width", "pano_height"))
    x, y = pov.pano_pixel(F.col("pov_heading"), F.col("pov_pitch"), F.col("camera_heading") + F.expr(_DRIFT.replace("TIMESTAMP '", "TIMESTAMP_NTZ '")), w, h)
    there = F.col("pano_id") % 50 != 7
    stored = view.select("*", F.when(there, x).alias("stored_x"), F.when(there, y + F.when(F.col("label_id") % 97 == 0, 1).otherwise(0)).alias("stored_y"))
    found = reports.replay_fidelity(stored, ["city"], "1996-01-01")
    return found.withColumns({c: F.round(c, 4) for c in ("spread_within", "spread_across")})


# ------------------------------------------------------------------ V10

_TILT_META = {"pano_id": "p_partkey", "yaw_deg": "((p_partkey * 59) % 3600) / 10e0", "pitch_deg": "((p_partkey * 7) % 101 - 50) / 10e0", "roll_deg": "((p_partkey * 13) % 41 + 340) % 360 / 1e0"}


@query(
    "v10_tilt_sinusoid",
    f"""{WP}, m AS (SELECT {', '.join(f'{e} AS {c}' for c, e in _TILT_META.items())} FROM part),
j AS (SELECT pano_id, radians(heading - yaw_deg) AS a, pitch_deg, CASE WHEN roll_deg > 180 THEN roll_deg - 360 ELSE roll_deg END AS roll, dep - degrees(atan2(2.6e0, truth_m)) AS y FROM pov JOIN m USING (pano_id)),
k AS (SELECT pano_id, cos(a) AS c, sin(a) AS s, pitch_deg * cos(a) + roll * sin(a) AS t, y FROM j), v AS (SELECT count(*) AS n, count(DISTINCT pano_id) AS n_panos, regr_slope(y, t) AS coef, corr(y, t) AS r, var_pop(c) AS cc, var_pop(s) AS ss, covar_pop(c, s) AS cs, covar_pop(c, y) AS cy, covar_pop(s, y) AS sy FROM k)
SELECT n, n_panos, round(coef, 6) AS coef, round(r, 6) AS r, round((cy * ss - sy * cs) / (cc * ss - cs * cs), 6) AS cos_deg, round((sy * cc - cy * cs) / (cc * ss - cs * cs), 6) AS sin_deg FROM v""",
)
def v10_tilt(spark, d):
    meta = spark.read.parquet(f"{d}/part.parquet").selectExpr(*(f"{e} AS {c}" for c, e in _TILT_META.items()))
    return reports.tilt_sinusoid(with_angles(clicks(spark, d)), meta, 2.6)


@query("v10_photographer_pitch", f"{WP}, e AS (SELECT city, pitch AS p, ({_MODELS['d_blend']}) - truth_m AS y FROM pov) SELECT city, count(*) AS n, round(corr(p, y), 6) AS r, round(regr_slope(y, p), 6) AS slope_m_per_deg FROM e GROUP BY city")
def v10_pitch(spark, d):
    residual = distances.model_distances(F.col("dep"), F.col("pano_height").cast("double"))["d_blend"] - F.col("truth_m")
    e = with_angles(clicks(spark, d)).select("city", F.col("pitch").alias("p"), residual.alias("y"))
    return e.groupBy("city").agg(F.count(F.lit(1)).alias("n"), rounded(F.corr("p", "y"), "r"), rounded(F.regr_slope("y", "p"), "slope_m_per_deg"))


# ------------------------------------------------------------------ V03, V09


@query("v03_zoom_residuals", f"{WP} SELECT zoom, count(*) AS n, round(median(({_MODELS['d_blend']}) - truth_m), 6) AS signed_m FROM pov GROUP BY zoom")
def v03_zoom(spark, d):
    blend = distances.model_distances(F.col("dep"), F.col("pano_height").cast("double"))["d_blend"]
    return quantiles(with_angles(clicks(spark, d)), ["zoom"], {"signed_m": (blend - F.col("truth_m"), 0.5)})


def _bounded(spark, d):
    """Clicks with the three models that have a bound."""
    view = with_angles(clicks(spark, d))
    found = distances.model_distances(F.col("dep"), F.col("pano_height").cast("double"))
    return view.select("city", "label_type", "dep", "truth_m", *[found[k].alias(k) for k in _BOUNDED])


_BOUNDED = ("a_status_quo", "b_normalized", "d_blend")


def _metrics_sql(source: str, by: str) -> str:
    parts = [
        f"round(median(abs({k} - truth_m)), 6) AS {k}_median, round(median({k} - truth_m), 6) AS {k}_signed, round(quantile_cont(abs({k} - truth_m), 0.9), 6) AS {k}_p90, round(regr_slope({k} - truth_m, truth_m), 6) AS {k}_slope" for k in _BOUNDED
    ]
    return f"SELECT {by}, count(*) AS n, {', '.join(parts)} FROM {source} WHERE {by} IS NOT NULL GROUP BY {by} HAVING count(*) >= 25"


_SCORED = f"s AS (SELECT city, label_type, dep, truth_m, {', '.join(f'{_MODELS[k]} AS {k}' for k in _BOUNDED)} FROM pov)"


@query("v09_models_by_type", f"{WP}, {_SCORED} {_metrics_sql('s', 'label_type')}")
def v09_types(spark, d):
    return error_metrics(_bounded(spark, d), ["label_type"], {k: F.col(k) for k in _BOUNDED}, F.col("truth_m"), 25)


_BIN = "CASE WHEN dep > -90 AND dep <= 0 THEN 0 WHEN dep > 0 AND dep <= 2 THEN 1 WHEN dep > 2 AND dep <= 5 THEN 2 WHEN dep > 5 AND dep <= 11.25 THEN 3 WHEN dep > 11.25 AND dep <= 90 THEN 4 END"


@query("v09_models_near_horizon", f"{WP}, {_SCORED}, b AS (SELECT *, {_BIN} AS bin FROM s) {_metrics_sql('b', 'bin')}")
def v09_bins(spark, d):
    rows = _bounded(spark, d).withColumn("bin", closed_bin(F.col("dep"), [-90.0, 0.0, 2.0, 5.0, 11.25, 90.0])).where("bin IS NOT NULL")
    return error_metrics(rows, ["bin"], {k: F.col(k) for k in _BOUNDED}, F.col("truth_m"), 25)


@query("v09_curb_sensitivity", f"{WP}, {_SCORED} SELECT label_type, count(*) AS n, round(median(d_blend - truth_m), 6) AS signed_m, round(median(d_blend - (truth_m - 0.15e0 * truth_m / 2.5e0)), 6) AS signed_corrected_m FROM s GROUP BY label_type")
def v09_curb(spark, d):
    return reports.curb_sensitivity(_bounded(spark, d), ["label_type"], F.col("d_blend"), F.col("truth_m"), 2.5)


# ------------------------------------------------------------------ V12

LEVELS = [(), ("city",), ("label_type",), ("city", "label_type"), ("city", "zoom")]


def _levels_sql() -> str:
    keys = ("city", "label_type", "zoom")
    parts = []
    for level in LEVELS:
        named = ", ".join(f"cast({k} AS varchar) AS {k}" if k in level else f"'(all)' AS {k}" for k in keys)
        parts.append(
            f"SELECT '{'/'.join(level) or 'all'}' AS level, {named}, count(*) AS n, count(*) FILTER (WHERE deleted) AS deleted, round(median(truth_m), 6) AS middle_m, round(quantile_cont(truth_m, 0.9), 6) AS p90_m, round(avg(noise), 6) AS mean_noise FROM clicks"
            + (f" GROUP BY {', '.join(level)}" if level else "")
        )
    return f"{W} {' UNION ALL '.join(parts)}"


@query("v12_summary_levels", _levels_sql())
def v12_levels(spark, d):
    c = clicks(spark, d)
    aggs = [F.count_if("deleted").alias("deleted"), rounded(F.avg("noise"), "mean_noise")]
    return reports.nested_summary(c, LEVELS, {"middle_m": (F.col("truth_m"), 0.5), "p90_m": (F.col("truth_m"), 0.9)}, aggs, ["truth_m", "noise", "deleted"])


# ------------------------------------------------------------------ V01, V02

TRAIN = "label_id % 5 <> 0"
_HD = "CASE WHEN pov_heading - heading > 180 THEN pov_heading - heading - 360 WHEN pov_heading - heading <= -180 THEN pov_heading - heading + 360 ELSE pov_heading - heading END"
_EST_KEYS = ["est1", "est2", "est3", "est4", "est5", "est7"]


def _frame_sql() -> str:
    """Fits by normal equations about the means (those of each zoom level for 5 and 7), then the errors of all estimators."""

    def plane(name: str, y: str, by: str) -> str:
        det = "(sum(a * a) * sum(b * b) - sum(a * b) * sum(a * b))"
        return f"""{name}_m AS (SELECT zoom, sv_image_y - avg(sv_image_y) OVER w AS a, canvas_y - avg(canvas_y) OVER w AS b, {y} - avg({y}) OVER w AS y FROM t WINDOW w AS (PARTITION BY {'zoom' if by else '1'})),
{name} AS (SELECT {'zoom, ' if by == 'own' else ''}(sum(a * y) * sum(b * b) - sum(b * y) * sum(a * b)) / {det} AS s, (sum(b * y) * sum(a * a) - sum(a * y) * sum(a * b)) / {det} AS c FROM {name}_m {'GROUP BY zoom' if by == 'own' else ''})"""

    def line(name: str, by: str) -> str:
        return f"""{name}_m AS (SELECT zoom, canvas_x - avg(canvas_x) OVER w AS a, hd - avg(hd) OVER w AS y FROM t WINDOW w AS (PARTITION BY zoom)),
{name} AS (SELECT {'zoom, ' if by == 'own' else ''}sum(a * y) / sum(a * a) AS x FROM {name}_m {'GROUP BY zoom' if by == 'own' else ''})"""

    flat = "lat, lng, pano_lat + {d} * cos(radians(heading)) / 111111e0 AS f2, pano_lng + {d} * sin(radians(heading)) / (111111e0 * cos(radians(pano_lat))) AS l2"
    parts = []
    for k in _EST_KEYS:
        d, h = f"d_{k}", f"(heading + h_{k})"
        if k in ("est1", "est2", "est3"):
            place = flat.format(d=d)
        else:
            phi = f"asin(sin(radians(pano_lat)) * cos({d} / 6378137e0) + cos(radians(pano_lat)) * sin({d} / 6378137e0) * cos(radians({h})))"
            place = f"lat, lng, degrees({phi}) AS f2, pano_lng + degrees(atan2(sin(radians({h})) * sin({d} / 6378137e0) * cos(radians(pano_lat)), cos({d} / 6378137e0) - sin(radians(pano_lat)) * sin({phi}))) AS l2"
        parts.append(f"SELECT '{k}' AS model, abs(truth_m - {d}) AS de, {place} FROM f")
    chord = "(power(sin(radians(f2 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(f2)) * power(sin(radians(l2 - lng) / 2), 2))"
    return f"""{WP}, v AS (SELECT *, {_HD} AS hd FROM pov), t AS (SELECT * FROM v WHERE {TRAIN}), {plane('d4', 'truth_m', '')}, {plane('h4', 'hd', '')}, {plane('d5', 'truth_m', 'zoom')}, {line('h5', 'zoom')}, {plane('d7', 'truth_m', 'own')}, {line('h7', 'own')},
tm AS (SELECT avg(truth_m) AS y, avg(hd) AS h, avg(sv_image_y) AS s, avg(canvas_y) AS c, median(truth_m) AS med FROM t), zm AS (SELECT zoom, avg(truth_m) AS y, avg(hd) AS h, avg(sv_image_y) AS s, avg(canvas_y) AS c, avg(canvas_x) AS x FROM t GROUP BY zoom),
ty AS (SELECT label_type, median(truth_m) AS med FROM t GROUP BY label_type),
f AS (SELECT v.*, 10e0 AS d_est1, tm.med AS d_est2, ty.med AS d_est3, greatest(0e0, tm.y + d4.s * (sv_image_y - tm.s) + d4.c * (canvas_y - tm.c)) AS d_est4, tm.h + h4.s * (sv_image_y - tm.s) + h4.c * (canvas_y - tm.c) AS h_est4,
greatest(0e0, zm.y + d5.s * (sv_image_y - zm.s) + d5.c * (canvas_y - zm.c)) AS d_est5, zm.h + h5.x * (canvas_x - zm.x) AS h_est5, greatest(0e0, zm.y + d7.s * (sv_image_y - zm.s) + d7.c * (canvas_y - zm.c)) AS d_est7, zm.h + h7.x * (canvas_x - zm.x) AS h_est7
FROM v JOIN ty USING (label_type) JOIN zm USING (zoom) JOIN d7 USING (zoom) JOIN h7 USING (zoom), tm, d4, h4, d5, h5 WHERE NOT ({TRAIN})),
e AS ({' UNION ALL '.join(parts)}), g AS (SELECT model, de, 2 * 6378137e0 * atan2(sqrt({chord}), sqrt(1 - {chord})) AS pe FROM e)
SELECT model, count(pe) AS n, {', '.join(f'round({fn.format(c)}, 5) AS {s}_{m}' for s, c in (('place', 'pe'), ('dist', 'de')) for m, fn in (('median', 'median({})'), ('p90', 'quantile_cont({}, 0.9)'), ('mean', 'avg({})'), ('sd', 'stddev_samp({})')))} FROM g GROUP BY model"""


def _estimator_view(spark, d):
    from lodemark.functions.geo import wrap_keep_plus

    view = with_angles(clicks(spark, d))
    return view.withColumn("heading_diff", wrap_keep_plus(F.col("pov_heading") - F.col("heading")))


@query("v01_error_frame", _frame_sql())
def v01_frame(spark, d):
    """Estimators 1 to 5 and 7 on the test rows, the later ones set out on the sphere as SQL can."""
    view = _estimator_view(spark, d)
    found = estimators.fit_estimators(view.where(TRAIN), mixed=False, geodesy=estimators.SPHERE)
    frame = estimators.error_frame(view.where(f"NOT ({TRAIN})"), found, ["label_id", "city"])
    return estimators.frame_metrics(frame, list(found), 5)


@query("v01_error_frame_ellipsoid")
def v01_ellipsoid(spark, d):
    """All seven estimators, 4 to 7 set out on the ellipsoid."""
    view = _estimator_view(spark, d)
    found = estimators.fit_estimators(view.where(TRAIN))
    return estimators.frame_metrics(estimators.error_frame(view.where(f"NOT ({TRAIN})"), found, ["label_id", "city"]), list(found))


@query("v02_ladder_frame")
def v02_frame(spark, d):
    """Every rung of the ladder with one heading for all, and estimator 7 in both conventions: the keys that the ladder is read by."""
    view = _estimator_view(spark, d).withColumn("height_m", F.when(F.col("pano_height") == 8192, 2.31))
    train, test = view.where(TRAIN), view.where(f"NOT ({TRAIN})")
    columns = {k: F.col(k) for k in ("dep", "zoom", "sv_image_y", "canvas_y", "height_m", "label_type")}
    found = estimators.rung_predictors(models.ladder(train), columns, F.col("heading_diff"))
    seven = estimators.fit_estimators(train, mixed=False)["est7"]
    found |= {"est7": seven, "est7_sph": estimators.Predictor(seven.distance, F.col("heading_diff"))}
    return estimators.metrics_by_parts(test, found, ["label_id", "city"])
