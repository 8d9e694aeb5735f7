"""Queries for reports (V): scored tables, censuses, diagnostics and the data behind figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodemark.functions.numeric import closed_bin
from lodemark.operators import aggregate as agg
from lodemark.operators.aggregate import rounded
from lodemark.operators.quantiles import quantiles, with_distinct
from lodemark.plans.clicks import POV_SQL, SQL, clicks, with_angles
from lodemark.registry import query

W = f"WITH {SQL}"
WP = f"WITH {SQL}, {POV_SQL}"
_EST = {"est1": "10e0", "est2": "18e0 + 0.012e0 * sv_image_y", "est3": "2.6e0 / tan(radians(greatest(dep, 3e0)))"}


def _long_sql(source: str) -> str:
    return " UNION ALL ".join(f"SELECT '{k}' AS model, city, label_type, dep, truth_m, abs(({e}) - truth_m) AS err FROM {source}" for k, e in _EST.items())


def _long(df):
    """Wide predictions in one select, then one row per model."""
    wide = df.select("city", "label_type", "dep", "truth_m", *[F.abs(F.expr(e) - F.col("truth_m")).alias(k) for k, e in _EST.items()])
    return wide.unpivot(["city", "label_type", "dep", "truth_m"], list(_EST), "model", "err")


@query("v01_v02_error_stats", f"{WP}, e AS ({_long_sql('pov')}) SELECT model, count(*) AS n, round(avg(err), 6) AS mean, round(median(err), 6) AS middle, round(stddev_samp(err), 6) AS sd, round(quantile_cont(err, 0.9), 6) AS p90 FROM e GROUP BY model ORDER BY middle")
def v01(spark, d):
    e = _long(with_angles(clicks(spark, d)))
    return quantiles(e, ["model"], {"middle": (F.col("err"), 0.5), "p90": (F.col("err"), 0.9)}, [rounded(F.avg("err"), "mean"), rounded(F.stddev_samp("err"), "sd")]).orderBy("middle")


@query(
    "v03_near_horizon",
    f"""{WP}, e AS ({_long_sql('pov')}), b AS (SELECT *, CASE WHEN dep > -90 AND dep <= 0 THEN 0 WHEN dep > 0 AND dep <= 2 THEN 1 WHEN dep > 2 AND dep <= 5 THEN 2 WHEN dep > 5 AND dep <= 11.25 THEN 3 WHEN dep > 11.25 AND dep <= 90 THEN 4 END AS bin FROM e)
SELECT model, bin, count(*) AS n, round(median(err), 6) AS middle FROM b WHERE bin IS NOT NULL GROUP BY model, bin""",
)
def v03(spark, d):
    e = _long(with_angles(clicks(spark, d))).select("model", "err", closed_bin(F.col("dep"), [-90.0, 0.0, 2.0, 5.0, 11.25, 90.0]).alias("bin")).where("bin IS NOT NULL")
    return quantiles(e, ["model", "bin"], {"middle": (F.col("err"), 0.5)})


_WRAP = "CASE WHEN {0} > 180 THEN {0} - 360 WHEN {0} <= -180 THEN {0} + 360 ELSE {0} END"


@query("v04_heading_summary", f"{WP}, h AS (SELECT zoom, abs({_WRAP.format('(pov_heading - heading)')}) AS e FROM pov) SELECT zoom, count(*) AS n, round(median(e), 6) AS middle, round(quantile_cont(e, 0.95), 6) AS p95 FROM h GROUP BY zoom")
def v04(spark, d):
    from lodemark.functions.geo import wrap_keep_plus

    e = F.abs(wrap_keep_plus(F.col("pov_heading") - F.col("heading")))
    return quantiles(with_angles(clicks(spark, d)), ["zoom"], {"middle": (e, 0.5), "p95": (e, 0.95)})


@query("v05_fidelity", f"{W} SELECT time_created < TIMESTAMP '1996-01-01' AS early, count(*) AS n, round(avg(cast(abs(noise) < 0.1 AS double)), 6) AS exact, round(avg(cast(abs(noise) <= 0.5 AS double)), 6) AS within_half FROM clicks GROUP BY 1")
def v05(spark, d):
    early = (F.col("time_created") < F.lit("1996-01-01").cast("timestamp_ntz")).alias("early")
    return clicks(spark, d).groupBy(early).agg(F.count(F.lit(1)).alias("n"), rounded(F.avg((F.abs("noise") < 0.1).cast("double")), "exact"), rounded(F.avg((F.abs("noise") <= 0.5).cast("double")), "within_half"))


@query(
    "v06_sequence_census",
    """WITH l AS (SELECT user_id, event_type, epoch_us(ts) // 1000 - lag(epoch_us(ts) // 1000) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events),
s AS (SELECT user_id, count(*) AS n, median(gap) / 1000e0 AS gap_s FROM l GROUP BY user_id)
SELECT user_id, n, round(gap_s, 6) AS gap_s, CASE WHEN n < 3 THEN 'unknown' WHEN gap_s > 40000 THEN 'vehicle' WHEN gap_s > 20000 THEN 'on_foot' ELSE 'slow' END AS mode FROM s""",
)
def v06(spark, d):
    from pyspark.sql import Window

    from lodemark.operators.clean import last_rule_wins

    e = spark.read.parquet(f"{d}/events.parquet").select("user_id", "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    gap = F.col("ms") - F.lag("ms").over(Window.partitionBy("user_id").orderBy("ms", "event_id"))
    s = quantiles(e.select("user_id", gap.alias("gap")), ["user_id"], {"gap_s": (F.col("gap") / 1000, 0.5)}, digits=None)
    g = F.col("gap_s")
    return s.select("user_id", "n", rounded(g, "gap_s"), last_rule_wins([(F.lit(True), "slow"), (g > 20000, "on_foot"), (g > 40000, "vehicle"), (F.col("n") < 3, "unknown")]).alias("mode"))


@query(
    "v07_site_diagnosis",
    f"""{WP}, p AS (SELECT pano_id AS site, truth_m AS dist, sin(radians(pov_heading)) AS ux, cos(radians(pov_heading)) AS uy FROM pov),
q AS (SELECT *, dist * ux AS px, dist * uy AS py FROM p), c AS (SELECT *, px - avg(px) OVER w AS ex, py - avg(py) OVER w AS ey FROM q WINDOW w AS (PARTITION BY site)),
s AS (SELECT count(*) AS n, avg(ex * ex + ey * ey) AS ms, avg(dist) AS md FROM c) SELECT n, round(sqrt(ms) / md, 4) AS rms_over_range FROM s""",
)
def v07(spark, d):
    turn, dist = F.radians("pov_heading"), F.col("truth_m")
    p = with_angles(clicks(spark, d)).select(F.col("pano_id").alias("site"), "truth_m", (dist * F.sin(turn)).alias("px"), (dist * F.cos(turn)).alias("py"))
    # Sum of squares about the site mean, from sums per site: no window, one shuffle.
    s = p.groupBy("site").agg(F.count(F.lit(1)).alias("n"), F.sum("truth_m").alias("d"), *[F.sum(c).alias(f"s{c}") for c in ("px", "py")], F.sum(F.col("px") * F.col("px") + F.col("py") * F.col("py")).alias("q"))
    left = F.col("q") - (F.col("spx") * F.col("spx") + F.col("spy") * F.col("spy")) / F.col("n")
    return s.agg(F.sum("n").alias("n"), F.sum(left).alias("l"), F.sum("d").alias("d")).select("n", rounded(F.sqrt(F.col("l") / F.col("n")) / (F.col("d") / F.col("n")), "rms_over_range", 4))


@query("v09_matrix", f"{WP}, e AS ({_long_sql('pov')}) SELECT model, city, label_type, count(*) AS n, round(median(err), 6) AS middle FROM e GROUP BY ALL HAVING count(*) >= 25")
def v09(spark, d):
    return quantiles(_long(with_angles(clicks(spark, d))), ["model", "city", "label_type"], {"middle": (F.col("err"), 0.5)}).where("n >= 25")


@query("v10_riders", f"{W} SELECT city, round(corr(pitch, noise), 6) AS r, round(avg(sin(radians(heading - camera_heading)) * noise) * 2, 6) AS tilt_sin, round(avg(cos(radians(heading - camera_heading)) * noise) * 2, 6) AS tilt_cos FROM clicks GROUP BY city")
def v10(spark, d):
    turn = F.radians(F.col("heading") - F.col("camera_heading"))
    return clicks(spark, d).groupBy("city").agg(rounded(F.corr("pitch", "noise"), "r"), rounded(F.avg(F.sin(turn) * F.col("noise")) * 2, "tilt_sin"), rounded(F.avg(F.cos(turn) * F.col("noise")) * 2, "tilt_cos"))


@query("v11_error_by_distance", f"{WP}, e AS ({_long_sql('pov')}) SELECT model, CASE WHEN truth_m < 5 THEN 0 WHEN truth_m < 10 THEN 1 WHEN truth_m < 20 THEN 2 ELSE 3 END AS bin, count(*) AS n, round(median(err), 6) AS middle FROM e GROUP BY ALL")
def v11(spark, d):
    e = _long(with_angles(clicks(spark, d))).select("model", "err", closed_bin(F.col("truth_m"), [0, 5, 10, 20, 50], right=False).alias("bin"))
    return quantiles(e, ["model", "bin"], {"middle": (F.col("err"), 0.5)})


@query("v12_nested_summary", f"{W} SELECT city, count(*) AS n, count(DISTINCT pano_id) AS panos, round(median(truth_m), 6) AS middle, count(*) FILTER (WHERE deleted) AS deleted FROM clicks GROUP BY city")
def v12(spark, d):
    c = clicks(spark, d)
    found = quantiles(c, ["city"], {"middle": (F.col("truth_m"), 0.5)}, [F.count_if("deleted").alias("deleted")])
    return with_distinct(found, c, ["city"], {"panos": F.col("pano_id")}).select("city", "n", "panos", "deleted", "middle")


@query("v13_cutoff_diagnosis", f"{W} SELECT city, CASE WHEN time_created >= TIMESTAMP '1996-01-01' THEN 'post' ELSE 'pre' END AS era, count(*) AS n, round(median(abs(noise)), 6) AS middle, round(avg(cast(abs(noise) < 0.05 AS double)), 6) AS tiny, count(*) FILTER (WHERE lat IS NULL) AS missing FROM clicks GROUP BY ALL")
def v13(spark, d):
    era = F.when(F.col("time_created") >= F.lit("1996-01-01").cast("timestamp_ntz"), "post").otherwise("pre").alias("era")
    return quantiles(clicks(spark, d).select("*", era), ["city", "era"], {"middle": (F.abs("noise"), 0.5)}, [rounded(F.avg((F.abs("noise") < 0.05).cast("double")), "tiny"), F.count_if(F.col("lat").isNull()).alias("missing")])


@query("v14_hexbin_yearly", f"{W} SELECT cast(floor(truth_m / 2) AS bigint) AS bx, cast(floor((noise + 1) * 10) AS bigint) AS b_y, cast(extract(year FROM time_created) AS int) AS year, count(*) AS n FROM clicks GROUP BY ALL HAVING count(*) >= 5")
def v14(spark, d):
    return clicks(spark, d).groupBy(F.floor(F.col("truth_m") / 2).alias("bx"), F.floor((F.col("noise") + 1) * 10).alias("b_y"), F.year("time_created").alias("year")).agg(F.count(F.lit(1)).alias("n")).where("n >= 5")


@query("w11_g25_figure_bands")
def bands(spark, d):
    return agg.bootstrap_median(clicks(spark, d).where("zoom = 3"), ["label_type"], "noise", "label_id")
