"""Queries for sampling plans (T) and the deployed and candidate distances."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from lodemark.functions import distances, geo
from lodemark.operators import sampling
from lodemark.operators.aggregate import rounded
from lodemark.operators.quantiles import quantiles
from lodemark.operators.sampling import Stratum
from lodemark.plans.clicks import POV_SQL, SQL, clicks, with_angles
from lodemark.registry import query

WP = f"WITH {SQL}, {POV_SQL}"
TYPES = ["AF", "NF", "NO", "RF"]


def _md5(key: str, seed: int) -> str:
    return f"md5(concat_ws('|', cast({key} AS varchar), '{seed}'))"


# ------------------------------------------------------------------ distances

_PANO_Y = "(pano_height / 2e0 - round_even(pano_height / 2e0 * (pov_pitch / 90e0), 0))"


def _zoomed(values: list[float]) -> str:
    return f"CASE zoom WHEN 1 THEN {values[0]}e0 WHEN 2 THEN {values[1]}e0 ELSE {values[2]}e0 END"


def _line_sql(offset: str, canvas_y: str = "canvas_y", zoom: bool = True) -> str:
    a, b, c = (_zoomed(v) if zoom else f"{v[0]}e0" for v in (distances.INTERCEPT, distances.PANO_SLOPE, distances.CANVAS_SLOPE))
    return f"greatest(0e0, ({a}) + ({b}) * ({offset}) + ({c}) * {canvas_y})"


_DEPLOYED, _NORMALIZED = _line_sql(f"pano_height / 2e0 - {_PANO_Y}"), _line_sql("-dep / 180e0 * 6656e0")


def _pano_y():
    h = F.col("pano_height").cast("double")
    return h / 2 - F.rint(h / 2 * (F.col("pov_pitch") / 90))


def _own_distances():
    height, canvas, zoom = (F.col(c).cast("double") for c in ("pano_height", "canvas_y", "zoom"))
    return distances.deployed_distance(_pano_y(), height, canvas, zoom), distances.normalized_distance(F.col("dep"), canvas, zoom)


@query("x22_deployed_distances", f"{WP} SELECT label_id, round({_DEPLOYED}, 8) AS deployed, round({_NORMALIZED}, 8) AS normalized, round(CASE WHEN dep <= 0 THEN 50e0 ELSE least(2.6e0 / tan(radians(dep)), 50e0) END, 8) AS anchor FROM pov")
def x22(spark, d):
    deployed, normalized = _own_distances()
    return with_angles(clicks(spark, d)).select("label_id", rounded(deployed, "deployed", 8), rounded(normalized, "normalized", 8), rounded(distances.anchor_distance(F.col("dep")), "anchor", 8))


_TAIL = f"{2.783 / math.tan(math.radians(11.25))!r} + {2.783 * math.radians(1) / math.sin(math.radians(11.25)) ** 2!r} * (11.25e0 - greatest(dep, 0e0))"


@query(
    "x23_model_distances",
    f"""{WP} SELECT label_id, round({_line_sql('-dep / 180e0 * pano_height', '240e0', False)}, 6) AS a_status_quo, round({_line_sql('-dep / 180e0 * 6656e0', '240e0', False)}, 6) AS b_normalized,
round(CASE WHEN dep > 0 THEN 2.6e0 / tan(radians(dep)) END, 4) AS c_cotangent, dep <= 0 AS c_endless,
round(CASE WHEN dep >= 11.25 THEN 2.783e0 / tan(radians(greatest(dep, 1e-9))) ELSE least(greatest({_TAIL}, 0e0), 50e0) END, 6) AS d_blend FROM pov""",
)
def x23(spark, d):
    found = distances.model_distances(F.col("dep"), F.col("pano_height").cast("double"))
    c, endless = found["c_cotangent"], found["c_cotangent"] == math.inf
    others = [rounded(v, k) for k, v in found.items() if k != "c_cotangent"]
    return with_angles(clicks(spark, d)).select("label_id", *others, rounded(F.when(~endless, c), "c_cotangent", 4), endless.alias("c_endless"))


_HALF = "power(sin(radians(lat - pano_lat) / 2), 2) + cos(radians(pano_lat)) * cos(radians(lat)) * power(sin(radians(lng - pano_lng) / 2), 2)"


@query(
    "v08_circularity_guard",
    f"""{WP}, g AS (SELECT CASE WHEN time_created < TIMESTAMP '1996-01-01' THEN 'fixed_frame' ELSE 'real_pixels' END AS era, 2 * 6378137e0 * atan2(sqrt({_HALF}), sqrt(1 - ({_HALF}))) AS stored, {_DEPLOYED} AS dd, {_NORMALIZED} AS nd FROM pov WHERE lat IS NOT NULL),
h AS (SELECT era, stored - CASE era WHEN 'fixed_frame' THEN nd ELSE dd END AS own, stored - CASE era WHEN 'fixed_frame' THEN dd ELSE nd END AS cross_ FROM g)
SELECT era, count(*) AS n, round(median(abs(own)), 5) AS median_abs_m, round(quantile_cont(abs(own), 0.9), 5) AS p90_abs_m, round(avg(cast(abs(own) <= 0.5 AS double)), 6) AS echo, round(median(abs(cross_)), 5) AS wrong_era_m FROM h GROUP BY era""",
)
def v08(spark, d):
    """How far stored distances are from what their own era's formula gives, and from the other era's."""
    deployed, normalized = _own_distances()
    early = F.coalesce(F.col("time_created") < F.lit("1996-01-01").cast("timestamp_ntz"), F.lit(False))
    stored = geo.haversine_m(*(F.col(c) for c in ("pano_lat", "pano_lng", "lat", "lng")))
    g = with_angles(clicks(spark, d)).where("lat IS NOT NULL").select(
        F.when(early, "fixed_frame").otherwise("real_pixels").alias("era"), F.abs(stored - F.when(early, normalized).otherwise(deployed)).alias("own"), F.abs(stored - F.when(early, deployed).otherwise(normalized)).alias("other")
    )
    own = F.col("own")
    return quantiles(g, ["era"], {"median_abs_m": (own, 0.5), "p90_abs_m": (own, 0.9), "wrong_era_m": (F.col("other"), 0.5)}, [rounded(F.avg((own <= 0.5).cast("double")), "echo")], 5)


# ------------------------------------------------------------------ plans

_EDGES = {"edge_urgent": ("o_totalprice > 400000", 5), "edge_open": ("o_orderstatus = 'P'", 7)}


@query(
    "t03_edge_strata",
    f"""WITH t AS (SELECT o_orderkey, o_orderpriority, o_orderstatus, o_totalprice, {_md5('o_orderkey', 3)} AS o FROM orders),
q AS (SELECT o_orderpriority, o_orderstatus, greatest(1, cast(round(count(*) * (200e0 / (SELECT count(*) FROM orders))) AS int)) AS q FROM orders GROUP BY 1, 2),
a AS (SELECT o_orderkey, 'headline' AS sample FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority, o_orderstatus ORDER BY o, o_orderkey) AS k FROM t) JOIN q USING (o_orderpriority, o_orderstatus) WHERE k <= q),
b AS (SELECT o_orderkey, 'edge_urgent' AS sample FROM t WHERE o_totalprice > 400000 AND o_orderkey NOT IN (SELECT o_orderkey FROM a) ORDER BY o, o_orderkey LIMIT 5),
c AS (SELECT o_orderkey, 'edge_open' AS sample FROM t WHERE o_orderstatus = 'P' AND o_orderkey NOT IN (SELECT o_orderkey FROM a UNION ALL SELECT o_orderkey FROM b) ORDER BY o, o_orderkey LIMIT 7)
SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c""",
)
def t03_edges(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice")
    return sampling.with_edges(o, ["o_orderpriority", "o_orderstatus"], ["o_orderkey"], 200, {k: (F.expr(e), n) for k, (e, n) in _EDGES.items()}, 3)


def pano_table(spark, d):
    """One row per panorama: city, labels in all and by type, whether a machine made any, least depression."""
    view = with_angles(clicks(spark, d))
    types = [F.count_if(F.col("label_type") == t).alias(f"n_{t}") for t in TYPES]
    return view.groupBy("pano_id").agg(F.min("city").alias("city"), F.count(F.lit(1)).alias("n_labels"), F.bool_or(F.col("computation_method") == "other").alias("any_ai"), F.min("dep").alias("min_dep"), *types)


def _t04_sql() -> str:
    """The plan as a chain of subqueries; the type strata follow the rank of their availability."""
    parts = [
        WP,
        f"tab AS MATERIALIZED (SELECT pano_id, min(city) AS city, bool_or(computation_method = 'other') AS any_ai, min(dep) AS min_dep, {', '.join(f'count(*) FILTER (WHERE label_type = {t!r}) AS n_{t}' for t in TYPES)}, {_md5('pano_id', 17)} AS o FROM pov GROUP BY pano_id)",
        "s0 AS MATERIALIZED (SELECT pano_id, 'representative' AS stratum, row_number() OVER (ORDER BY o, pano_id) - 1 AS place, 0 AS step FROM (SELECT *, row_number() OVER (PARTITION BY city ORDER BY o, pano_id) AS k FROM tab WHERE NOT any_ai) WHERE k <= 8 ORDER BY o, pano_id LIMIT 40)",
        "s1 AS MATERIALIZED (SELECT pano_id, 'near_horizon' AS stratum, row_number() OVER (ORDER BY o, pano_id) - 1 AS place, 1 AS step FROM tab WHERE NOT any_ai AND min_dep <= 2 AND pano_id NOT IN (SELECT pano_id FROM s0) ORDER BY o, pano_id LIMIT 20)",
        "p1 AS MATERIALIZED (SELECT * FROM s0 UNION ALL SELECT * FROM s1)",
        "long AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT pano_id, any_ai, o, '{t}' AS t, n_{t} AS n FROM tab" for t in TYPES) + ")",
        "rare AS MATERIALIZED (SELECT t, row_number() OVER (ORDER BY sum(n), t) AS r FROM long GROUP BY t)",
    ]
    for k in range(1, len(TYPES) + 1):
        parts += [
            f"l{k} AS MATERIALIZED (SELECT long.* FROM long JOIN rare USING (t) WHERE r = {k})",
            f"h{k} AS MATERIALIZED (SELECT coalesce(sum(n), 0) AS have FROM l{k} WHERE pano_id IN (SELECT pano_id FROM p{k}))",
            f"c{k} AS MATERIALIZED (SELECT *, sum(n) OVER (ORDER BY n DESC, o, pano_id ROWS UNBOUNDED PRECEDING) AS s FROM l{k} WHERE NOT any_ai AND n > 0 AND pano_id NOT IN (SELECT pano_id FROM p{k}))",
            f"q{k} AS MATERIALIZED (SELECT pano_id, 'type:' || t AS stratum, row_number() OVER (ORDER BY n DESC, o, pano_id) - 1 AS place, {k + 1} AS step FROM c{k}, h{k} WHERE s - n < 300 - have)",
            f"p{k + 1} AS MATERIALIZED (SELECT * FROM p{k} UNION ALL SELECT * FROM q{k})",
        ]
    last = len(TYPES) + 1
    parts.append(f"ai AS (SELECT pano_id, 'ai' AS stratum, row_number() OVER (ORDER BY o, pano_id) - 1 AS place, {last + 1} AS step FROM tab WHERE any_ai AND pano_id NOT IN (SELECT pano_id FROM p{last}) ORDER BY o, pano_id LIMIT 15)")
    return ", ".join(parts) + f" SELECT * FROM p{last} UNION ALL SELECT * FROM ai"


@query("t04_ordered_plan", _t04_sql())
def t04(spark, d):
    """The ordered plan: a capped draw, a rare regime, type quotas with the rarest first, and the machine's own."""
    from lodemark.session import checkpointed

    panos = checkpointed(pano_table(spark, d))
    human = ~F.col("any_ai")
    strata = [Stratum("representative", human, 40, cap=("city", 8)), Stratum("near_horizon", human & (F.col("min_dep") <= 2), 20)]
    strata += [Stratum(f"type:{a[2:]}", human, 300, amount=a) for a in sampling.rarest_first(panos, [f"n_{t}" for t in TYPES])]
    return sampling.ordered_plan(panos, "pano_id", [*strata, Stratum("ai", F.col("any_ai"), 15)], 17)


_SHARES = {"1-URGENT": 0.35, "2-HIGH": 0.2, "5-LOW": 0.45}


@query(
    "t06_class_shares",
    f"""WITH t AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {_md5('o_orderkey', 11)}, o_orderkey) AS k FROM orders),
s AS (SELECT o_orderkey, o_orderpriority FROM t WHERE k <= CASE o_orderpriority WHEN '1-URGENT' THEN 52 WHEN '2-HIGH' THEN 30 WHEN '5-LOW' THEN 68 ELSE 0 END),
c AS (SELECT s.o_orderkey, count(*) AS n_labels FROM s JOIN lineitem ON l_orderkey = s.o_orderkey GROUP BY 1 ORDER BY n_labels DESC, s.o_orderkey LIMIT 25)
SELECT s.o_orderkey, o_orderpriority, n_labels FROM s LEFT JOIN c USING (o_orderkey)""",
)
def t06(spark, d):
    """Shares of classes, and which of the sample go to adjudication: those with the most labels."""
    orders = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_orderpriority")
    sample = sampling.share_sample(orders, "o_orderpriority", _SHARES, 150, "o_orderkey", 11)
    labels = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("o_orderkey"))
    return sample.join(sampling.most_labelled(sample, labels, "o_orderkey", 25), "o_orderkey", "left")


# ------------------------------------------------------------------ pivots, ratios and null samples


@query("g29_long_and_wide", f"WITH {SQL}, l AS (SELECT city, unnest(['truth_m', 'noise']) AS name, unnest([truth_m, abs(noise)]) AS v FROM clicks), s AS (SELECT city, name, avg(v) AS mean, max(v) AS high FROM l GROUP BY ALL) SELECT city, round(max(mean) FILTER (WHERE name = 'truth_m'), 6) AS truth_m_mean, round(max(high) FILTER (WHERE name = 'truth_m'), 6) AS truth_m_high, round(max(mean) FILTER (WHERE name = 'noise'), 6) AS noise_mean, round(max(high) FILTER (WHERE name = 'noise'), 6) AS noise_high FROM s GROUP BY city")
def g29_wide(spark, d):
    """Wide columns to long rows, summed up, and back to a column a name and statistic."""
    long = clicks(spark, d).select("city", "truth_m", F.abs("noise").alias("noise")).unpivot(["city"], ["truth_m", "noise"], "name", "v")
    wide = long.groupBy("city").pivot("name", ["truth_m", "noise"]).agg(F.avg("v").alias("mean"), F.max("v").alias("high"))
    return wide.select("city", *[rounded(F.col(c), c) for c in wide.columns if c != "city"])


@query(
    "g30_height_ratio",
    f"""{WP}, r AS (SELECT city, pano_height, median(-sv_image_y / 36.977e0 / dep) AS m, count(*) AS n FROM pov WHERE dep > 2 AND pano_height IN (6656, 8192) GROUP BY ALL)
SELECT a.city, a.n AS n_6656, b.n AS n_8192, round(a.m, 6) AS m_6656, round(b.m, 6) AS m_8192, round(b.m / a.m, 6) AS ratio FROM r a JOIN r b USING (city) WHERE a.pano_height = 6656 AND b.pano_height = 8192""",
)
def g30_ratio(spark, d):
    """Whether a stored pixel grows with the panorama's height: medians of implied over exact depression, and their ratio by city."""
    rows = with_angles(clicks(spark, d)).where("dep > 2 AND pano_height IN (6656, 8192)")
    groups = quantiles(rows, ["city", "pano_height"], {"m": (-F.col("sv_image_y") / 36.977 / F.col("dep"), 0.5)}, digits=None)
    wide = groups.groupBy("city").pivot("pano_height", [6656, 8192]).agg(F.first("n").alias("n"), F.first("m").alias("m")).dropna()
    return wide.select("city", F.col("6656_n").alias("n_6656"), F.col("8192_n").alias("n_8192"), rounded(F.col("6656_m"), "m_6656"), rounded(F.col("8192_m"), "m_8192"), rounded(F.col("8192_m") / F.col("6656_m"), "ratio"))


@query(
    "g27_null_rank",
    f"""WITH {SQL}, s AS (SELECT pano_id, round(avg(abs(noise)), 9) AS score FROM clicks GROUP BY pano_id), o AS (SELECT *, row_number() OVER (ORDER BY concat_ws('|', {_md5('pano_id', 9)}, cast(pano_id AS varchar))) - 1 AS place, count(*) OVER () AS total FROM s),
n AS (SELECT a.pano_id, a.score, b.score AS other FROM o a, (SELECT unnest([1, 2, 3, 4, 5, 6, 7, 8]) AS k) JOIN o b ON b.place = (a.place + k) % a.total)
SELECT pano_id, count(*) AS n_null, count(*) FILTER (WHERE other < score) AS below, round(count(*) FILTER (WHERE other < score) * 100e0 / count(*), 6) AS percentile FROM n GROUP BY pano_id""",
)
def g27_null(spark, d):
    """The rank of each panorama's score among those of eight others that a permutation gives it."""
    from lodemark.operators.joins import other_keys
    from lodemark.session import checkpointed

    scores = checkpointed(clicks(spark, d).groupBy("pano_id").agg(F.round(F.avg(F.abs("noise")), 9).alias("score")))
    pairs = other_keys(scores, "pano_id", 8, 9)
    null = pairs.join(scores, "pano_id").join(scores.select(F.col("pano_id").alias("other"), F.col("score").alias("other_score")), "other")
    below = F.count_if(F.col("other_score") < F.col("score"))
    return null.groupBy("pano_id").agg(F.count(F.lit(1)).alias("n_null"), below.alias("below"), rounded(below * 100 / F.count(F.lit(1)), "percentile"))


def _t07_sql() -> str:
    """The clicks moved by hashed noise, and the view's own angles over them; sigma 0 is the click as it is."""
    grid = "(SELECT 0e0 AS sigma, 0 AS draw UNION ALL SELECT * FROM (SELECT unnest([2e0, 5e0, 10e0]) AS sigma), (SELECT unnest([0, 1, 2, 3, 4]) AS draw))"
    blend = f"CASE WHEN dep >= 11.25 THEN 2.6e0 / tan(radians(greatest(dep, 1e-9))) ELSE {2.6 / math.tan(math.radians(11.25))!r} - {2.6 * math.radians(1) / math.sin(math.radians(11.25)) ** 2!r} * (greatest(dep, 0e0) - 11.25) END"
    moved = POV_SQL.replace("FROM clicks", "FROM moved")
    return f"""WITH {SQL}, h AS (SELECT clicks.*, sigma, draw, md5(concat_ws('|', cast(label_id AS varchar), cast(pano_id AS varchar), cast(draw AS varchar))) AS m FROM clicks, {grid}),
u AS (SELECT *, sqrt(-2 * ln((cast(('0x' || substr(m, 1, 7)) AS bigint) + 0.5e0) / 268435456e0)) * sigma AS reach, 2 * pi() * ((cast(('0x' || substr(m, 8, 7)) AS bigint) + 0.5e0) / 268435456e0) AS turn FROM h),
moved AS (SELECT * EXCLUDE (canvas_x, canvas_y, m), canvas_y AS own_y, least(greatest(canvas_x + reach * cos(turn), 0e0), 720e0) AS canvas_x, least(greatest(canvas_y + reach * sin(turn), 0e0), 480e0) AS canvas_y FROM u),
{moved}, e AS (SELECT sigma, draw, unnest(['blend', 'linear']) AS model, unnest([abs(least(greatest({blend}, 0e0), 50e0) - truth_m), abs(greatest(0e0, 30e0 - 0.05e0 * canvas_y) - truth_m)]) AS e FROM pov),
s AS (SELECT model, sigma, draw, median(e) AS md, quantile_cont(e, 0.9) AS p FROM e GROUP BY ALL), b AS (SELECT model, md AS m0, p AS p0 FROM s WHERE sigma = 0)
SELECT model, sigma, round(avg(md) - any_value(m0), 6) AS delta_median_m, round(avg(p) - any_value(p0), 6) AS delta_p90_m FROM s JOIN b USING (model) WHERE sigma > 0 GROUP BY model, sigma"""


@query("t07_feature_noise", _t07_sql())
def t07_features(spark, d):
    """Two predictors under the same noise: one of the depression, and one from outside that reads the canvas."""
    from lodemark.operators import models

    blend = models.Geometric("blend", 2.6, {}, 11.25)
    predictors = {"blend": lambda: models.predict(blend, F.col("dep")), "linear": lambda: F.greatest(F.lit(0.0), 30 - 0.05 * F.col("canvas_y"))}
    return sampling.noise_sweep(clicks(spark, d), predictors, "truth_m", ["label_id", "pano_id"])
