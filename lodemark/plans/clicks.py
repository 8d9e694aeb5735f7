"""The click view: deterministic clicks derived from lineitem, in expressions both engines read alike.

Real click tables come through lodemark.sources; this view lets every operator run on TPC-H-like tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Column -> expression over lineitem. 1e0 literals keep the arithmetic in doubles.
COLUMNS = {
    "label_id": "l_orderkey * 10 + l_linenumber",
    "pano_id": "l_partkey",
    "city": "concat('c', cast(l_suppkey % 7 AS varchar(4)))",
    "label_type": "concat(l_returnflag, l_linestatus)",
    "canvas_x": "1 + (l_partkey * 37 + l_linenumber * 101 + l_orderkey * 13) % 719",
    "canvas_y": "1 + (l_suppkey * 53 + l_linenumber * 29 + l_orderkey * 7) % 479",
    "heading": "((l_orderkey * 73) % 3600) / 10e0",
    "pitch": "0e0 - ((l_partkey * 11) % 360) / 10e0",
    "zoom": "1 + l_linenumber % 3",
    "time_created": "CASE WHEN l_orderkey % 53 = 0 THEN NULL ELSE l_shipdate END",
    "deleted": "CASE WHEN l_orderkey % 17 = 0 THEN NULL ELSE l_orderkey % 11 = 0 END",
    "tutorial": "CASE WHEN l_suppkey % 19 = 0 THEN NULL ELSE l_partkey % 23 = 0 END",
    "computation_method": "CASE WHEN l_suppkey % 13 = 0 THEN 'other' ELSE 'depth' END",
    "pano_lat": "40e0 + (l_partkey % 997) / 1000e0",
    "pano_lng": "-75e0 + (l_partkey % 991) / 1000e0",
    "lat": "CASE WHEN l_orderkey % 101 = 0 THEN NULL ELSE 40e0 + (l_partkey % 997) / 1000e0 + ((l_suppkey * 17 + l_linenumber * 31 + l_orderkey) % 1200 - 600) / 1000000e0 END",
    "lng": "CASE WHEN l_orderkey % 101 = 0 THEN NULL ELSE -75e0 + (l_partkey % 991) / 1000e0 + ((l_suppkey * 29 + l_linenumber * 41 + l_orderkey * 3) % 1200 - 600) / 1000000e0 END",
    "truth_m": "1e0 + ((l_suppkey * 17 + l_orderkey * 3 + l_linenumber * 7) % 390) / 10e0",
    "sv_image_y": "0 - (l_suppkey * 7 + l_linenumber * 13 + l_orderkey) % 2000",
    "pano_height": "CASE l_partkey % 3 WHEN 0 THEN 6656 WHEN 1 THEN 8192 ELSE 1664 END",
    "pano_width": "CASE l_partkey % 3 WHEN 0 THEN 13312 WHEN 1 THEN 16384 ELSE 3328 END",
    "camera_heading": "((l_partkey * 59) % 3600) / 10e0",
    "noise": "((l_suppkey * 7919 + l_orderkey * 104729 + l_partkey * 31 + l_linenumber) % 2000 - 1000) / 1000e0",
}

#: The same view as a common table expression for the oracle.
SQL = "clicks AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in COLUMNS.items()) + " FROM lineitem)"

#: Angles of the view in SQL: pov_heading, pov_pitch and dep.
POV_SQL = """
pov0 AS (SELECT *, radians(heading) AS h, radians(pitch) AS p, canvas_x - 360e0 AS du, 240e0 - canvas_y AS dv,
    360e0 / tan(radians(CASE WHEN zoom <= 2 THEN 126.5e0 - 36.75e0 * zoom ELSE 195.93e0 / power(1.92e0, zoom) END) / 2) AS f FROM clicks),
pov1 AS (SELECT *, f * cos(p) * sin(h) + du * cos(h) - dv * sin(p) * sin(h) AS vx,
    f * cos(p) * cos(h) - du * sin(h) - dv * sin(p) * cos(h) AS vy, f * sin(p) + dv * cos(p) AS vz FROM pov0),
pov AS (SELECT *, degrees(atan2(vx, vy)) AS pov_heading, degrees(asin(vz / sqrt(vx * vx + vy * vy + vz * vz))) AS pov_pitch,
    -degrees(asin(vz / sqrt(vx * vx + vy * vy + vz * vz))) AS dep FROM pov1)
"""


def clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(*(f"{e} AS {n}" for n, e in COLUMNS.items()))


def with_angles(df: DataFrame) -> DataFrame:
    """pov_heading, pov_pitch and dep (degrees below the horizon) beside the click's columns.

    The angles pass through a generator of one row: a filter on them is then not moved below their projection, where
    it would hold their whole expression many times over, in a method too long for the JVM to compile.
    """
    from pyspark.sql import functions as F

    from lodemark.functions.pov import pov_if_centered

    c = [F.col(k).cast("double") for k in ("canvas_x", "canvas_y", "heading", "pitch", "zoom")]
    h, p = pov_if_centered(*c)
    angles = F.struct(h.alias("pov_heading"), p.alias("pov_pitch"), (-p).alias("dep"))
    return df.select("*", angles.alias("_angles")).select(*[F.col(f"`{k}`") for k in df.columns], F.inline(F.array("_angles")))
