"""Queries for scalar functions (X), projections (P) and filters (F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodemark.functions import geo, numeric, pov
from lodemark.operators import clean
from lodemark.plans.clicks import POV_SQL, SQL, clicks, with_angles
from lodemark.registry import query

W = f"WITH {SQL}"
WP = f"WITH {SQL}, {POV_SQL}"


def _r(c, name):
    return F.round(c, 6).alias(name)


def _d(*names):
    return [F.col(n).cast("double") for n in names]


_HAV = "2 * 6378137e0 * atan2(sqrt(a), sqrt(1 - a))"
_CHORD = "power(sin(radians(lat - pano_lat) / 2), 2) + cos(radians(pano_lat)) * cos(radians(lat)) * power(sin(radians(lng - pano_lng) / 2), 2)"


@query("x01_haversine", f"{W}, t AS (SELECT label_id, {_CHORD} AS a FROM clicks WHERE lat IS NOT NULL) SELECT label_id, round({_HAV}, 6) AS dist_m FROM t")
def x01(spark, d):
    return clicks(spark, d).where("lat IS NOT NULL").select("label_id", _r(geo.haversine_m(*_d("pano_lat", "pano_lng", "lat", "lng")), "dist_m"))


@query("x02_haversine_mean_radius", f"{W}, t AS (SELECT label_id, {_CHORD} AS a FROM clicks) SELECT label_id, round(2 * 6371008.8e0 * asin(sqrt(a)), 6) AS dist_m FROM t")
def x02(spark, d):
    return clicks(spark, d).select("label_id", _r(geo.haversine_mean_m(*_d("pano_lat", "pano_lng", "lat", "lng")), "dist_m"))


@query("x03_geodesic_bearing")
def x03(spark, d):
    return clicks(spark, d).where("lat IS NOT NULL").select("label_id", _r(geo.bearing_deg(*_d("pano_lat", "pano_lng", "lat", "lng")), "bearing"))


@query("x04_geodesic_destination")
def x04(spark, d):
    p = geo.dest_point(*_d("pano_lat", "pano_lng", "heading", "truth_m"))
    return clicks(spark, d).select("label_id", p.alias("p")).select("label_id", F.round("p.lat", 9).alias("lat"), F.round("p.lng", 9).alias("lng"))


@query(
    "x05_spherical_destination",
    f"""{W}, t AS (SELECT label_id, pano_lng, truth_m / 6378137e0 AS g, radians(heading) AS b, radians(pano_lat) AS f FROM clicks),
u AS (SELECT *, asin(sin(f) * cos(g) + cos(f) * sin(g) * cos(b)) AS f2 FROM t)
SELECT label_id, round(degrees(f2), 9) AS lat, round(pano_lng + degrees(atan2(sin(b) * sin(g) * cos(f), cos(g) - sin(f) * sin(f2))), 9) AS lng FROM u""",
)
def x05(spark, d):
    lat, lng = geo.spherical_dest(*_d("pano_lat", "pano_lng", "heading", "truth_m"))
    return clicks(spark, d).select("label_id", F.round(lat, 9).alias("lat"), F.round(lng, 9).alias("lng"))


@query(
    "x06_flat_destination",
    f"""{W} SELECT label_id, round(pano_lat + truth_m * cos(radians(heading)) / 111111e0, 9) AS lat,
round(pano_lng + truth_m * sin(radians(heading)) / (111111e0 * cos(radians(pano_lat))), 9) AS lng FROM clicks""",
)
def x06(spark, d):
    lat, lng = geo.flat_dest(*_d("pano_lat", "pano_lng", "heading", "truth_m"))
    return clicks(spark, d).select("label_id", F.round(lat, 9).alias("lat"), F.round(lng, 9).alias("lng"))


@query("x07_placement_error")
def x07(spark, d):
    c = _d("pano_lat", "pano_lng", "heading", "truth_m", "lat", "lng")
    return clicks(spark, d).where("lat IS NOT NULL").select("label_id", _r(geo.latlng_error_m(1, *c), "flat_m"), _r(geo.latlng_error_m(7, *c), "ellipsoid_m"))


@query(
    "x08_x09_wraps",
    f"""{W}, t AS (SELECT label_id, heading - camera_heading AS x FROM clicks)
SELECT label_id, round(CASE WHEN x > 180 THEN x - 360 WHEN x < -180 THEN x + 360 ELSE x END, 6) AS keep_minus,
round(CASE WHEN x > 180 THEN x - 360 WHEN x <= -180 THEN x + 360 ELSE x END, 6) AS keep_plus,
round(x + 180 - 360 * floor((x + 180) / 360) - 180, 6) AS wrapped, round(x - 360 * floor(x / 360), 6) AS heading FROM t""",
)
def x08(spark, d):
    x = F.col("heading") - F.col("camera_heading")
    return clicks(spark, d).select("label_id", _r(geo.wrap_keep_minus(x), "keep_minus"), _r(geo.wrap_keep_plus(x), "keep_plus"), _r(geo.wrap_floor(x), "wrapped"), _r(geo.to_heading(x), "heading"))


@query("x10_x11_click_projection", f"{WP} SELECT label_id, round(pov_heading, 6) AS pov_heading, round(pov_pitch, 6) AS pov_pitch FROM pov")
def x11(spark, d):
    return with_angles(clicks(spark, d)).select("label_id", _r(F.col("pov_heading"), "pov_heading"), _r(F.col("pov_pitch"), "pov_pitch"))


@query(
    "x12_exact_heading_diff",
    f"""{WP}, t AS (SELECT label_id, dep, pov_heading - heading AS x FROM pov)
SELECT label_id, round(CASE WHEN x > 180 THEN x - 360 WHEN x <= -180 THEN x + 360 ELSE x END, 6) AS heading_diff, round(dep, 6) AS dep FROM t""",
)
def x12(spark, d):
    c = _d("canvas_x", "canvas_y", "heading", "pitch", "zoom")
    return clicks(spark, d).select("label_id", _r(pov.exact_heading_diff(*c), "heading_diff"), _r(pov.exact_depression(*c), "dep"))


@query("x13_era_heading_diff", f"{WP.replace('radians(heading) AS h', 'radians(trunc(heading)) AS h').replace('radians(pitch) AS p', 'radians(trunc(pitch)) AS p')}, t AS (SELECT label_id, pov_heading + 0.5 - heading AS x FROM pov) SELECT label_id, round(CASE WHEN x > 180 THEN x - 360 WHEN x <= -180 THEN x + 360 ELSE x END, 6) AS heading_diff FROM t")
def x13(spark, d):
    return clicks(spark, d).select("label_id", _r(pov.era_heading_diff(*_d("canvas_x", "canvas_y", "heading", "pitch", "zoom")), "heading_diff"))


@query(
    "x14_x15_pano_pixel",
    f"""{WP}, t AS (SELECT label_id, sv_image_y, pano_width AS w, pano_height AS ht, pov_pitch,
pov_heading - 360 * floor(pov_heading / 360) - ((camera_heading + 180) - 360 * floor((camera_heading + 180) / 360)) AS turn FROM pov),
u AS (SELECT label_id, sv_image_y, w, round_even(w * turn / 360, 0) AS x, ht / 2e0 - round_even(ht / 2e0 * (pov_pitch / 90), 0) AS pano_y FROM t),
v AS (SELECT *, x - w * floor(x / w) AS pano_x FROM u)
SELECT label_id, pano_x, pano_y, pano_x + sv_image_y + w / 2e0 - w * floor((pano_x + sv_image_y + w / 2e0) / w) - w / 2e0 AS seam FROM v""",
)
def x14(spark, d):
    w, h = _d("pano_width", "pano_height")
    x, y = pov.pano_pixel(F.col("pov_heading"), F.col("pov_pitch"), F.col("camera_heading"), w, h)
    return with_angles(clicks(spark, d)).select("label_id", x.alias("pano_x"), y.alias("pano_y"), pov.seam_difference(x + F.col("sv_image_y"), w).alias("seam"))


@query(
    "x16_x17_depressions",
    f"{W} SELECT label_id, round((canvas_y - pano_height / 2e0) * 180 / pano_height, 6) AS pixel_dep, round((canvas_y / 480e0 - 0.5) * 180, 6) AS normal_dep FROM clicks",
)
def x16(spark, d):
    y, h = _d("canvas_y", "pano_height")
    return clicks(spark, d).select("label_id", _r(pov.pixel_depression(y, h), "pixel_dep"), _r(pov.normal_depression(y / 480), "normal_dep"))


@query(
    "x18_x19_local_offsets",
    f"""{W} SELECT label_id, round(radians(lng - pano_lng) * cos(radians(pano_lat)) * 6371008.8e0, 6) AS east, round(radians(lat - pano_lat) * 6371008.8e0, 6) AS north,
round((lng - pano_lng) * 111111e0 * cos(radians((lat + pano_lat) / 2)), 6) AS flat_east, round((lat - pano_lat) * 111111e0, 6) AS flat_north FROM clicks""",
)
def x18(spark, d):
    e, n = geo.local_east_north(*_d("lat", "lng", "pano_lat", "pano_lng"))
    fe, fn = geo.camera_offset(*_d("pano_lat", "pano_lng", "lat", "lng"))
    return clicks(spark, d).select("label_id", _r(e, "east"), _r(n, "north"), _r(fe, "flat_east"), _r(fn, "flat_north"))


@query(
    "x20_x21_disparity",
    f"{WP} SELECT label_id, round(1 / greatest(truth_m, 1e0), 6) AS disparity, CASE WHEN truth_m < 1 THEN 1 ELSE 0 END AS capped, round(tan(radians(greatest(dep, 0.5e0))), 6) AS tan_dep FROM pov",
)
def x20(spark, d):
    return with_angles(clicks(spark, d)).select(
        "label_id", _r(numeric.disparity(F.col("truth_m"), 1.0), "disparity"), F.when(F.col("truth_m") < 1, 1).otherwise(0).alias("capped"), _r(numeric.tan_depression(F.col("dep"), 0.5), "tan_dep")
    )


@query("x24_curb_bias", f"{W} SELECT label_id, CASE WHEN pano_height > 2000 THEN round(0.15e0 * truth_m / (pano_height / 1000e0), 6) END AS bias FROM clicks")
def x24(spark, d):
    h = F.when(F.col("pano_height") > 2000, F.col("pano_height") / 1000)
    return clicks(spark, d).select("label_id", _r(numeric.curb_bias_m(F.col("truth_m"), h), "bias"))


@query("x25_float32_grid", f"{W} SELECT label_id, cast(cast(truth_m AS float) AS double) = truth_m AS on_grid FROM clicks")
def x25(spark, d):
    return clicks(spark, d).select("label_id", numeric.on_float32_grid(F.col("truth_m")).alias("on_grid"))


@query(
    "x26_x27_raster_cells",
    f"""{W}, t AS (SELECT label_id, cast(round_even(canvas_x / 720e0 * 512, 0) AS int) % 512 AS c, cast(least(greatest(round_even(canvas_y / 480e0 * 256, 0), 0), 255) AS int) AS r FROM clicks)
SELECT label_id, c AS col, r AS "row", 511 - c AS mirror_col, 511 - c AS turned_col, 255 - r AS turned_row, 255 - r AS flipped_row FROM t""",
)
def x26(spark, d):
    c, r = numeric.raster_cell(*_d("canvas_x", "canvas_y"), F.lit(720.0), F.lit(480.0))
    return clicks(spark, d).select(
        "label_id", c.alias("col"), r.alias("row"), numeric.control_cell("x_mirror", c, r)[0].alias("mirror_col"), *[x.alias(n) for x, n in zip(numeric.control_cell("rotate_180", c, r), ("turned_col", "turned_row"), strict=True)], numeric.control_cell("row_flip", c, r)[1].alias("flipped_row")
    )


@query("x30_dates", f"{W} SELECT label_id, time_created < TIMESTAMP '1996-06-01' AS early, cast(extract(year FROM time_created) AS int) AS year, strftime(time_created, '%Y-%m-%d') AS day FROM clicks")
def x30(spark, d):
    t = F.col("time_created")
    return clicks(spark, d).select("label_id", (t < F.lit("1996-06-01").cast("timestamp_ntz")).alias("early"), F.year(t).alias("year"), F.date_format(t, "yyyy-MM-dd").alias("day"))


@query("x31_base64", "SELECT event_id, replace(replace(rtrim(to_base64(encode(props)), '='), '+', '-'), '/', '_') AS urlsafe, props AS decoded FROM events")
def x31(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    urlsafe = F.translate(F.rtrim(F.base64("props"), F.lit("=")), "+/", "-_")
    return e.select("event_id", urlsafe.alias("urlsafe"), F.unbase64(F.translate(urlsafe, "-_", "+/")).cast("string").alias("decoded"))


@query(
    "x32_interpolation",
    f"""{W} SELECT label_id, round(CASE WHEN truth_m <= 2 THEN 10 WHEN truth_m <= 5 THEN 10 - (truth_m - 2) * 2 WHEN truth_m <= 20 THEN 4 - (truth_m - 5) / 15 ELSE 3 END, 6) AS y,
round(sqrt(truth_m * truth_m + noise * noise), 6) AS hyp FROM clicks""",
)
def x32(spark, d):
    return clicks(spark, d).select("label_id", _r(numeric.interpolate(F.col("truth_m"), [(2, 10), (5, 4), (20, 3)]), "y"), _r(F.hypot("truth_m", "noise"), "hyp"))


@query("x33_x34_text_arrays", "SELECT o_custkey, count(*) AS n, string_agg(DISTINCT lower(regexp_replace(o_orderpriority, '^[0-9]-', '')), ';' ORDER BY lower(regexp_replace(o_orderpriority, '^[0-9]-', ''))) AS kinds FROM orders GROUP BY o_custkey")
def x33(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_custkey", F.lower(F.regexp_replace("o_orderpriority", "^[0-9]-", "")).alias("k"))
    return o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.concat_ws(";", F.array_sort(F.collect_set("k"))).alias("kinds"))


@query("p01_p03_rename_derive_prune", f"{W} SELECT label_id AS id, pano_lat AS camera_lat, truth_m * 2 AS twice FROM clicks")
def p01(spark, d):
    return clicks(spark, d).select(F.col("label_id").alias("id"), F.col("pano_lat").alias("camera_lat"), (F.col("truth_m") * 2).alias("twice"))


@query(
    "p05_overwrite_rules",
    f"""{W} SELECT label_id, CASE WHEN truth_m IS NULL OR noise > 0.9 THEN 'unknown' WHEN truth_m > 30 THEN 'vehicle' WHEN truth_m > 10 THEN 'on_foot' ELSE 'slow' END AS mode FROM clicks""",
)
def p05(spark, d):
    t = F.col("truth_m")
    return clicks(spark, d).select("label_id", clean.last_rule_wins([(F.lit(True), "slow"), (t > 10, "on_foot"), (t > 30, "vehicle"), (t.isNull() | (F.col("noise") > 0.9), "unknown")]).alias("mode"))


@query("p06_clip", f"{W}, t AS (SELECT label_id, CASE WHEN label_id % 7 <> 0 THEN noise * 60 END AS x FROM clicks) SELECT label_id, round(CASE WHEN x IS NOT NULL THEN least(greatest(x, 0e0), 50e0) END, 6) AS clipped FROM t")
def p06(spark, d):
    x = F.when(F.col("label_id") % 7 != 0, F.col("noise") * 60)
    return clicks(spark, d).select("label_id", _r(numeric.clip(x, 0.0, 50.0), "clipped"))


@query("p07_p09_lookups", f"{W} SELECT label_id, CASE label_type WHEN 'AF' THEN 2.1e0 WHEN 'NO' THEN 2.4e0 ELSE 2.6e0 END AS height, CASE label_type WHEN 'AF' THEN 2.1e0 WHEN 'NO' THEN 2.4e0 END AS height_or_null, CASE zoom WHEN 1 THEN 18e0 WHEN 2 THEN 20e0 ELSE 21e0 END AS by_zoom FROM clicks")
def p07(spark, d):
    table = {"AF": 2.1, "NO": 2.4}
    return clicks(spark, d).select("label_id", numeric.mapped(F.col("label_type"), table, 2.6).alias("height"), numeric.mapped(F.col("label_type"), table).alias("height_or_null"), numeric.by_ordinal([18, 20, 21], F.col("zoom").cast("double")).alias("by_zoom"))


@query("p10_dummies", f"{W} SELECT label_id, cast(zoom = 2 AS double) AS zoom2, cast(zoom = 3 AS double) AS zoom3 FROM clicks")
def p10(spark, d):
    a, b = numeric.dummies(F.col("zoom"), [2, 3])
    return clicks(spark, d).select("label_id", a.alias("zoom2"), b.alias("zoom3"))


@query("p11_p15_text", "SELECT p_partkey, concat(coalesce(nullif(p_brand, 'Brand#11'), '(none)'), ' / ', coalesce(p_type, '(none)')) AS make, starts_with(p_type, 'S') AS starts_s, contains(p_type, 'E') AS has_e, substr(p_brand, 7, 2) AS brand_no FROM part")
def p11(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    brand = F.coalesce(F.when(F.col("p_brand") != "Brand#11", F.col("p_brand")), F.lit("(none)"))
    return p.select("p_partkey", F.concat_ws(" / ", brand, F.coalesce("p_type", F.lit("(none)"))).alias("make"), F.col("p_type").startswith("S").alias("starts_s"), F.col("p_type").contains("E").alias("has_e"), F.substring("p_brand", 7, 2).alias("brand_no"))


@query("p12_explode_list", "SELECT doc_id, unnest(regexp_split_to_array(source || ';' || lang || ';', ';')) AS part FROM documents QUALIFY part <> ''".replace(" QUALIFY part <> ''", ""))
def p12(spark, d):
    s = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.concat_ws("", "source", F.lit(";"), "lang", F.lit(";")).alias("s"))
    return s.select("doc_id", F.explode(F.split("s", ";")).alias("part"))


@query("p13_p14_constants_predicates", f"{W} SELECT label_id, 'depth' AS kind, cast(NULL AS int) AS missing, zoom = 3 AND NOT coalesce(deleted, false) AS close_up FROM clicks")
def p13(spark, d):
    return clicks(spark, d).select("label_id", F.lit("depth").alias("kind"), F.lit(None).cast("int").alias("missing"), ((F.col("zoom") == 3) & ~F.coalesce("deleted", F.lit(False))).alias("close_up"))


@query("f01_keep_null_cutoff", f"{W} SELECT label_id, time_created FROM clicks WHERE time_created IS NULL OR time_created < TIMESTAMP '1996-01-01'")
def f01(spark, d):
    return clicks(spark, d).where(clean.before_or_null(F.col("time_created"), "1996-01-01")).select("label_id", "time_created")


_VALID = "lat BETWEEN -90 AND 90 AND lng BETWEEN -180 AND 180 AND canvas_x > 0 AND canvas_y > 0 AND computation_method = 'depth' AND NOT coalesce(tutorial, false) AND NOT coalesce(deleted, false)"


@query("f02_validity", f"{W} SELECT label_id, city FROM clicks WHERE {_VALID}")
def f02(spark, d):
    return clicks(spark, d).where(clean.valid()).select("label_id", "city")


@query(
    "f03_f04_clean_clicks",
    f"""{W}, t AS (SELECT * FROM clicks WHERE (time_created IS NULL OR time_created < TIMESTAMP '1996-01-01') AND {_VALID}),
u AS (SELECT *, count(*) OVER (PARTITION BY pano_id) AS n, {_CHORD} AS a FROM t)
SELECT label_id, pano_id, round({_HAV}, 6) AS pano_dist FROM u WHERE n < 20 AND {_HAV} < 50""",
)
def f03(spark, d):
    return clean.clean_clicks(clicks(spark, d), "1996-01-01").select("label_id", "pano_id", _r(F.col("pano_dist"), "pano_dist"))


@query("f05_gates", f"{W} SELECT label_id, truth_m < 30 AS gate_cap, noise BETWEEN -0.5 AND 0.5 AS gate_ratio, truth_m < 30 AND noise BETWEEN -0.5 AND 0.5 AS gate_ok FROM clicks")
def f05(spark, d):
    return clean.gated(clicks(spark, d), {"gate_cap": F.col("truth_m") < 30, "gate_ratio": F.col("noise").between(-0.5, 0.5)}).select("label_id", "gate_cap", "gate_ratio", "gate_ok")


@query("f06_f07_finite", f"{W} SELECT label_id FROM clicks WHERE lat IS NOT NULL AND lng IS NOT NULL")
def f06(spark, d):
    return clicks(spark, d).dropna(subset=["lat", "lng"]).where(numeric.finite(F.col("lat"))).select("label_id")


@query("f08_membership", f"{W} SELECT label_id, city FROM clicks WHERE city IN ('c1', 'c3')")
def f08(spark, d):
    return clicks(spark, d).where(F.col("city").isin("c1", "c3")).select("label_id", "city")


@query(
    "f11_frame_census",
    f"""{W} SELECT count(*) AS n_rows, sum(CASE WHEN deleted THEN 1 ELSE 0 END) AS deleted, sum(CASE WHEN tutorial THEN 1 ELSE 0 END) AS tutorial,
sum(CASE WHEN coalesce(lat BETWEEN -90 AND 90 AND lng BETWEEN -180 AND 180 AND canvas_x > 0 AND canvas_y > 0, false) THEN 0 ELSE 1 END) AS bad_place,
sum(CASE WHEN computation_method <> 'depth' THEN 1 ELSE 0 END) AS not_depth, count(DISTINCT pano_id) AS panos FROM clicks""",
)
def f11(spark, d):
    place = F.coalesce(clean.valid_place(), F.lit(False))
    return clicks(spark, d).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("deleted").alias("deleted"), F.count_if("tutorial").alias("tutorial"), F.count_if(~place).alias("bad_place"), F.count_if(F.col("computation_method") != "depth").alias("not_depth"), F.countDistinct("pano_id").alias("panos"))


@query(
    "g21_attrition_funnel",
    f"""{W}, t AS (SELECT *, time_created IS NULL OR time_created < TIMESTAMP '1996-01-01' AS g1, coalesce({_VALID}, false) AS g2 FROM clicks)
SELECT 'raw' AS gate, 0 AS step, count(*) AS n FROM t UNION ALL SELECT 'cutoff', 1, count(*) FROM t WHERE g1 UNION ALL SELECT 'valid', 2, count(*) FROM t WHERE g1 AND g2
UNION ALL SELECT 'near', 3, count(*) FROM t WHERE g1 AND g2 AND truth_m < 20""",
)
def g21(spark, d):
    return clean.funnel(clicks(spark, d), [("cutoff", clean.before_or_null(F.col("time_created"), "1996-01-01")), ("valid", clean.valid()), ("near", F.col("truth_m") < 20)])
