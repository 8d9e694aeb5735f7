"""Queries on depth payloads (R), the pixel and lattice rules beside them (X25, X28, X29) and their checks.

Payloads are synthetic, one per city and zoom (those read cell by cell: one per supplier), and follow from a number
that both engines can compute.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lodemark.functions import geo, numeric
from lodemark.operators import depth, depth_cells
from lodemark.operators.aggregate import rounded
from lodemark.operators.quantiles import quantiles
from lodemark.plans.clicks import POV_SQL, SQL, clicks, with_angles
from lodemark.registry import query

W = f"WITH {SQL}"
WP = f"WITH {SQL}, {POV_SQL}"
_SEED = "(cast(substring(city, 2) AS int) * 100 + zoom * 17)"
#: A view of the clicks with their payload's number and cell.
_CELLS = f"cells AS (SELECT label_id, {_SEED} AS s, canvas_x % 512 AS c, canvas_y % 256 AS r, truth_m FROM clicks)"
_CONTROLS = "ctl AS (SELECT *, 'identity' AS control, c AS col, r AS row_ FROM cells UNION ALL SELECT *, 'x_mirror', 511 - c, r FROM cells UNION ALL SELECT *, 'rotate_180', 511 - c, 255 - r FROM cells UNION ALL SELECT *, 'row_flip', c, 255 - r FROM cells)"
_HITS = "hit AS (SELECT *, CASE WHEN row_ >= 132 THEN 'ground' WHEN row_ >= 80 AND col >= s * 37 % 400 AND col < s * 37 % 400 + 100 THEN 'facade' ELSE 'sky' END AS hit_class, (2 + s % 10 / 10e0) * tan((256 - row_ - 0.5e0) / 256 * pi()) AS far FROM ctl)"


def _view(spark, d):
    return clicks(spark, d).select(
        F.concat_ws("-", "city", "zoom").alias("pano_id"), F.expr(_SEED).alias("seed"), "label_id", "truth_m",
        (F.col("canvas_x") % 512).cast("int").alias("col"), (F.col("canvas_y") % 256).cast("int").alias("row"),
    )


def _payloads(spark, d):
    panos = _view(spark, d).select("pano_id", "seed").distinct()
    return panos.select("pano_id", "seed", depth.synthetic_payload(F.col("seed")).alias("b64"))


@query("r_depth_labels")
def r_depth(spark, d):
    """Payloads decoded and read at the clicks' cells."""
    found = depth.classify_labels(_payloads(spark, d), _view(spark, d))
    return found.select("pano_id", "label_id", "hit_class", rounded(F.col("range_m"), "range_m", 4), rounded(F.col("range_ratio"), "range_ratio", 4))


@query("r10_r11_hit_classes", f"{W}, {_CELLS}, {_CONTROLS}, {_HITS} SELECT control, hit_class, count(*) AS n FROM hit GROUP BY ALL")
def r11(spark, d):
    found = depth.classify_labels(_payloads(spark, d), _view(spark, d), controls=depth.CONTROLS)
    return found.groupBy("control", "hit_class").agg(F.count(F.lit(1)).alias("n"))


@query(
    "r12_control_sweep",
    f"""{W}, {_CELLS}, {_CONTROLS}, {_HITS}, g AS (SELECT *, hit_class = 'ground' AND far < 50 AS ok FROM hit)
SELECT control, count(*) AS n, round(avg(cast(hit_class = 'ground' AS double)), 6) AS ground_share, count(*) FILTER (WHERE ok) AS n_gated, round(median(abs(truth_m - far)) FILTER (WHERE ok), 3) AS median_m FROM g GROUP BY control""",
)
def r12(spark, d):
    found = depth.classify_labels(_payloads(spark, d), _view(spark, d), controls=depth.CONTROLS, carry=("truth_m",))
    return depth.control_sweep(found, "truth_m")


@query("r05_r09_payload_checks")
def r_checks(spark, d):
    """Camera height, plane inventory and flat-earth comparison of every payload."""
    return depth.payload_stats(_payloads(spark, d))


@query("r08_sky_rows", f"{W}, p AS (SELECT DISTINCT {_SEED} AS s, concat(city, '-', cast(zoom AS varchar)) AS pano_id FROM clicks), y AS (SELECT unnest(range(0, 256)) AS raster_row) SELECT pano_id, cast(raster_row AS int) AS raster_row, round((raster_row + 0.5e0) / 256 * 180 - 90, 6) AS dep, CASE WHEN raster_row < 80 THEN 1e0 WHEN raster_row < 132 THEN 1 - 100 / 512e0 ELSE 0e0 END AS sky_share FROM p, y")
def r08(spark, d):
    return depth.sky_rows(_payloads(spark, d)).select("pano_id", "raster_row", rounded(F.col("dep"), "dep"), "sky_share")


def _stored(spark, d):
    """Labels with legacy pixels and the place that they were stored with."""
    view = clicks(spark, d)
    return view.select(
        F.concat_ws("-", "city", "zoom").alias("pano_id"), F.xxhash64("label_id", "pano_id", "canvas_x", "canvas_y", "sv_image_y").alias("label_id"), (F.col("canvas_x") * 18).alias("sv_image_x"), (F.col("sv_image_y") / 2).cast("long").alias("sv_image_y"),
        "pano_lat", "pano_lng", "lat", "lng", F.col("heading").alias("heading_then"), (F.col("label_id") % 7 != 0).alias("cleaned"),
    )


@query("r04_relocated_labels")
def r04(spark, d):
    return depth.relocated(_payloads(spark, d), _stored(spark, d)).select("pano_id", "label_id", "status", "no_plane", "seam_wrap", "out_of_bounds", rounded(F.col("new_lat"), "new_lat"), rounded(F.col("new_lng"), "new_lng"))


@query("r13_pano_classes")
def r13(spark, d):
    """Panoramas gone, unreadable, without depth, with broken depth, and of each consistency class."""
    from lodemark.session import checkpointed

    k = F.pmod(F.col("seed"), F.lit(11))
    payloads = _payloads(spark, d).select("pano_id", "seed", F.when(k == 3, F.lit("CQAA")).when(k != 4, F.col("b64")).alias("b64"))
    labels = _stored(spark, d)
    found = checkpointed(depth.relocated(payloads, labels))
    # Some panoramas' labels were stored as they come out today, others not.
    today = found.select("label_id", F.col("new_lat").cast("float").cast("double").alias("a"), F.col("new_lng").cast("float").cast("double").alias("b"))
    same = F.xxhash64("label_id") % 5 < F.pmod(F.length("pano_id") + F.ascii(F.substring("pano_id", 2, 1)), F.lit(6))
    stored = labels.join(today, "label_id").select(*[c for c in labels.columns if c not in ("lat", "lng")], F.when(same, F.col("a")).otherwise(F.col("lat")).alias("lat"), F.when(same, F.col("b")).otherwise(F.col("lng")).alias("lng"))
    panos = payloads.select("pano_id", F.when(k != 1, k != 2).alias("meta_ok"), F.lit(40.5).alias("fresh_lat"), F.lit(-74.5).alias("fresh_lng"), F.lit(10.0).alias("fresh_heading"))
    return depth.pano_classes(panos, found, stored)


@query(
    "j10_r17_facade_separation",
    f"""{W}, p AS (SELECT DISTINCT city, zoom, {_SEED} AS s FROM clicks), w AS (SELECT city, zoom, cast(cast(cos(radians(s % 360)) AS float) AS double) AS nx, cast(cast(sin(radians(s % 360)) AS float) AS double) AS ny, 8e0 + s % 7 AS d FROM p),
m AS (SELECT a.city AS pair, a.nx * b.nx + a.ny * b.ny AS c, a.d AS da, b.d + b.nx * 1.5e0 - b.ny * 2e0 AS db FROM w a JOIN w b ON a.city = b.city AND a.zoom = 1 AND b.zoom = 2)
SELECT pair, 2 AS plane_a, round(abs(da - sign(c) * db), 6) AS separation_m FROM m WHERE abs(c) >= 0.9""",
)
def r17(spark, d):
    planes = depth.facade_planes(_payloads(spark, d))
    return depth.facade_separation(_pairs(spark, d), planes, least_cosine=0.9).select("pair", "plane_a", rounded(F.col("separation_m"), "separation_m"))


def _pairs(spark, d):
    cities = clicks(spark, d).select("city").distinct()
    return cities.select(F.col("city").alias("pair"), F.concat("city", F.lit("-1")).alias("a"), F.concat("city", F.lit("-2")).alias("b"), F.lit(1.5).alias("east"), F.lit(-2.0).alias("north"), F.lit(0.0).alias("up"))


@query("j15_r17_cross_vintage")
def j15(spark, d):
    return depth.cross_vintage(_pairs(spark, d), _payloads(spark, d))


def _supplier_payloads(spark, d):
    """A payload a supplier; those of odd keys are deflated."""
    keys = spark.read.parquet(f"{d}/supplier.parquet").select("s_suppkey")
    # Eight bytes a key become 175 KB of payload: dealt to all tasks before they grow.
    return depth.synthetic_payloads(keys.repartition(spark.sparkContext.defaultParallelism, "s_suppkey"), "s_suppkey")


@query(
    "r18_a_decoders",
    """SELECT s_suppkey AS pano_id, 131072 AS n_cells, 131072 AS n_same, 131072 - 104 * (100 - greatest(0, 100 - abs(2 * (s_suppkey * 37 % 400) - 412))) AS n_mirrored
FROM supplier WHERE s_suppkey % 2 = 0""",
)
def r18_a(spark, d):
    """Two decoders of the bare payloads cell by cell; mirrored, the wall's columns differ where it is not over its image."""
    return depth_cells.decoder_check(_supplier_payloads(spark, d))


@query(
    "r05_r06_plane_inventory",
    """WITH p AS (SELECT s_suppkey AS s, unnest([1, 2]) AS plane FROM supplier WHERE s_suppkey % 2 = 0)
SELECT s AS pano_id, plane, CASE plane WHEN 1 THEN 0e0 ELSE 90e0 END AS tilt_deg, round(cast(cast(CASE plane WHEN 1 THEN 2 + s % 10 / 10e0 ELSE 8e0 + s % 7 END AS float) AS double), 5) AS offset_m,
CASE plane WHEN 1 THEN 124 * 512 ELSE 52 * 100 END AS n_cells, CASE plane WHEN 1 THEN 124 * 512 ELSE 4 * 100 END AS n_below, plane = 1 AS is_ground FROM p""",
)
def r05_inventory(spark, d):
    found = depth_cells.plane_inventory(_supplier_payloads(spark, d))
    return found.withColumns({"tilt_deg": rounded(F.col("tilt_deg"), "tilt_deg"), "offset_m": rounded(F.col("offset_m"), "offset_m", 5)})


def _images(spark, d):
    return _payloads(spark, d).select("pano_id", "b64", depth.synthetic_image(F.col("seed")).alias("rgb"), F.lit(128).alias("width"), F.lit(64).alias("height"))


@query("r14_r15_registration")
def r14(spark, d):
    return depth.registration(_images(spark, d))


@query("r16_stitched_tiles")
def r16(spark, d):
    """Each image cut into four tiles and put together again: its size, and whether it is the image."""
    whole = _images(spark, d).select("pano_id", "rgb", "width", "height")
    half = [F.concat(*[F.substring("rgb", (y * 128 + x * 64) * 3 + 1, 64 * 3) for y in range(j * 32, j * 32 + 32)]) for j in (0, 1) for x in (0, 1)]
    places = F.array(*[F.struct(F.lit(k % 2).alias("tx"), F.lit(k // 2).alias("ty"), part.alias("rgb")) for k, part in enumerate(half)])
    tiles = whole.select("pano_id", "width", "height", F.lit(64).alias("tile_width"), F.lit(32).alias("tile_height"), F.inline(places))
    return depth.stitched(tiles).join(whole.select("pano_id", F.col("rgb").alias("own")), "pano_id").select("pano_id", "width", "height", (F.col("rgb") == F.col("own")).alias("same"))


# ------------------------------------------------------------------ pixels and the 32-bit lattice

_F32 = "abs(cast(cast(truth_m AS float) AS double))"


@query("x25_ulp32", f"{W} SELECT label_id, power(2e0, floor(log2({_F32})) - 23) AS ulp, round(abs(truth_m - cast(cast(truth_m AS float) AS double)) / power(2e0, floor(log2({_F32})) - 23), 6) AS steps FROM clicks")
def x25_ulp(spark, d):
    x = F.col("truth_m")
    return clicks(spark, d).select("label_id", numeric.ulp32(x).alias("ulp"), rounded(numeric.ulp32_distance(x, x.cast("float").cast("double")), "steps"))


_S = "0.038461538461538464e0"


@query(
    "x28_x29_label_pixels",
    f"""{W}, t AS (SELECT label_id, canvas_x * 18 * {_S} / 512 * 360 - camera_heading + 180 AS turn, (3328 - sv_image_y) * {_S} AS y, pano_width AS w, pano_height AS h, cast(ceil(canvas_x * 18 * {_S}) AS int) AS legacy_col, cast(ceil((3328 - sv_image_y) * {_S}) AS int) AS legacy_row FROM clicks)
SELECT label_id, least(greatest(cast(trunc((turn - 360 * floor(turn / 360)) / 360 * w) AS bigint), 0), w - 1) AS px, least(greatest(cast(trunc(y / 256 * h) AS bigint), 0), h - 1) AS py, legacy_col, legacy_row FROM t""",
)
def x28(spark, d):
    x, y = F.col("canvas_x") * 18, F.col("sv_image_y")
    col, row = depth.legacy_cell(x, y)
    px, py = depth.pixel_in_image(x, y, F.col("pano_width"), F.col("pano_height"), F.col("camera_heading"))
    return clicks(spark, d).select("label_id", px.cast("long").alias("px"), py.cast("long").alias("py"), col.alias("legacy_col"), row.alias("legacy_row"))


# ------------------------------------------------------------------ convention checks


def _described(df, name: str, value):
    """Median, quartiles, spread and the share within 60 degrees of a residual."""
    found = quantiles(df, [], {"middle": (value, 0.5), "q1": (value, 0.25), "q3": (value, 0.75)}, [rounded(F.stddev_samp(value), "sd", 4), rounded(F.avg((F.abs(value) < 60).cast("double")), "within_60")], 4)
    return found.select(F.lit(name).alias("frame"), "n", "middle", "q1", "q3", "sd", "within_60")


def _wrapped(x: str) -> str:
    return f"(({x}) + 180e0 - 360e0 * floor((({x}) + 180e0) / 360e0) - 180e0)"


_EAST = "(lng - pano_lng) * 111111e0 * cos(radians(pano_lat))"
_NORTH = "(lat - pano_lat) * 111111e0"


@query(
    "r18_b_bearing_frame",
    f"""{W}, b AS (SELECT degrees(atan2({_EAST}, {_NORTH})) AS bearing, heading, camera_heading FROM clicks WHERE lat IS NOT NULL),
r AS (SELECT 'compass' AS frame, {_wrapped('bearing - heading')} AS v FROM b UNION ALL SELECT 'heading_relative', {_wrapped('bearing - heading - (180 - camera_heading)')} FROM b)
SELECT frame, count(*) AS n, round(median(v), 4) AS middle, round(quantile_cont(v, 0.25), 4) AS q1, round(quantile_cont(v, 0.75), 4) AS q3, round(stddev_samp(v), 4) AS sd, round(avg(cast(abs(v) < 60 AS double)), 6) AS within_60 FROM r GROUP BY frame""",
)
def r18_b(spark, d):
    """Whether stored positions follow the compass heading of their clicks, or one turned by the panorama's yaw."""
    east, north = (F.col("lng") - F.col("pano_lng")) * geo.METRES_PER_DEGREE * F.cos(F.radians("pano_lat")), (F.col("lat") - F.col("pano_lat")) * geo.METRES_PER_DEGREE
    rows = clicks(spark, d).where("lat IS NOT NULL").select((F.degrees(F.atan2(east, north)) - F.col("heading")).alias("turn"), "camera_heading")

    def wrapped(x):
        return F.pmod(x + 180, F.lit(360.0)) - 180

    return _described(rows, "compass", wrapped(F.col("turn"))).unionByName(_described(rows, "heading_relative", wrapped(F.col("turn") - (180 - F.col("camera_heading")))))


@query(
    "r18_c_column_frames",
    f"""{WP}, t AS (SELECT pov_heading - 360 * floor(pov_heading / 360) AS u, (camera_heading + 180) - 360 * floor((camera_heading + 180) / 360) AS v, camera_heading, canvas_x * 18 / 13312e0 AS sx FROM pov),
f AS (SELECT (u - v) / 360 - sx AS delta, (180 - camera_heading) / 360 AS turn FROM t), g AS (SELECT (delta + 0.5) - floor(delta + 0.5) - 0.5 AS delta, (turn + 0.5) - floor(turn + 0.5) - 0.5 AS turn FROM f)
SELECT count(*) AS n, round(corr(delta, turn), 6) AS correlation, round(median(({_wrapped('(delta - turn) * 360')})), 4) AS middle_deg FROM g""",
)
def r18_c(spark, d):
    """Whether two columns are one point in two frames: their difference against the yaw's offset."""
    u, v = F.pmod("pov_heading", F.lit(360.0)), F.pmod(F.col("camera_heading") + 180, F.lit(360.0))
    share = [(u - v) / 360 - F.col("canvas_x") * 18 / 13312, (180 - F.col("camera_heading")) / 360]
    delta, turn = (F.pmod(x + 0.5, F.lit(1.0)) - 0.5 for x in share)
    rows = with_angles(clicks(spark, d)).select(delta.alias("delta"), turn.alias("turn"))
    left = F.pmod((F.col("delta") - F.col("turn")) * 360 + 180, F.lit(360.0)) - 180
    return quantiles(rows, [], {"middle_deg": (left, 0.5)}, [rounded(F.corr("delta", "turn"), "correlation")], 4)


def _links(spark, d):
    view = clicks(spark, d).select(F.concat_ws("-", "city", "zoom").alias("pano_id"), F.expr(_SEED).alias("seed")).distinct()
    return view.select("pano_id", F.pmod(F.col("seed") * 7, F.lit(360)).cast("double").alias("yaw"), F.explode(F.array(*[F.pmod(F.col("seed") * 3 + k, F.lit(360)).cast("double") for k in (0, 180)])).alias("bearing"))


@query("r18_d_road_share")
def r18_d(spark, d):
    return depth.road_share(_images(spark, d), _links(spark, d))


@query("r18_e_sightlines")
def r18_e(spark, d):
    found = depth.sightlines(_payloads(spark, d), _links(spark, d))
    known = found.dropna(subset=["a_m", "b_m", "base_m"])
    return known.agg(F.count(F.lit(1)).alias("links"), F.count_if(F.col("a_m") > F.col("base_m")).alias("a_exceeds"), F.count_if(F.col("b_m") > F.col("base_m")).alias("b_exceeds"))


@query("r18_f_payload_order")
def r18_f(spark, d):
    """The payload's order against its mirror image, where there is structure enough."""
    scores = depth.registration(_images(spark, d)).where("structure_share >= 0.02")
    wide = scores.groupBy("pano_id").pivot("control", ["identity", "x_mirror"]).agg(F.first("sky_violation")).dropna()
    a, b = F.col("identity"), F.col("x_mirror")
    return quantiles(wide, [], {"order_violation": (a, 0.5), "mirror_violation": (b, 0.5)}, [F.count_if(a < b).alias("order_better"), F.count_if(a > b).alias("mirror_better")])


@query("r18_g_frame_impact")
def r18_g(spark, d):
    """How far labels move if the lookup's column is turned by the panorama's yaw."""
    payloads, labels = _payloads(spark, d), _stored(spark, d)
    yaw = _links(spark, d).select("pano_id", "yaw").distinct()
    turned = labels.join(F.broadcast(yaw), "pano_id")  # a row per payload of the fixture
    shift = F.pmod(180 - F.col("yaw"), F.lit(360.0)) / 360 * 13312
    moved = turned.select("pano_id", "label_id", F.pmod(F.col("sv_image_x") + shift, F.lit(13312.0)).alias("sv_image_x"), "sv_image_y", "pano_lat", "pano_lng")
    level = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    far = [depth.relocated(payloads, x).where("NOT no_plane AND NOT out_of_bounds").select("label_id", level.alias(n)).where(F.col(n) < 80) for x, n in ((labels, "a"), (moved, "b"))]
    moves = F.abs(F.col("a") - F.col("b"))
    return quantiles(far[0].join(far[1], "label_id"), [], {"median_m": (moves, 0.5), "p90_m": (moves, 0.9), "p95_m": (moves, 0.95)}, [rounded(F.avg((moves < 1).cast("double")), "within_1m"), rounded(F.avg((moves > 3).cast("double")), "beyond_3m")], 4)
