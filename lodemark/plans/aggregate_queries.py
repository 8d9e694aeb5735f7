"""Queries for aggregations (G)."""

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


@query(
    "g01_g06_basic_aggregates",
    f"""{W} SELECT label_type, count(*) AS n, round(sum(truth_m), 4) AS total, min(truth_m) AS low, max(truth_m) AS high, round(avg(truth_m), 6) AS mean,
round(median(truth_m), 6) AS middle, round(quantile_cont(truth_m, 0.9), 6) AS p90, round(stddev_samp(truth_m), 6) AS sd, count(DISTINCT pano_id) AS panos,
bool_or(deleted) AS any_deleted, bool_and(deleted) AS all_deleted FROM clicks GROUP BY label_type""",
)
def g01(spark, d):
    t = "truth_m"
    others = [
        rounded(F.sum(t), "total", 4), F.min(t).alias("low"), F.max(t).alias("high"), rounded(F.avg(t), "mean"), rounded(F.stddev_samp(t), "sd"),
        F.bool_or("deleted").alias("any_deleted"), F.bool_and("deleted").alias("all_deleted"),
    ]
    c = clicks(spark, d)
    found = quantiles(c, ["label_type"], {"middle": (F.col(t), 0.5), "p90": (F.col(t), 0.9)}, others)
    return with_distinct(found, c, ["label_type"], {"panos": F.col("pano_id")}).select("label_type", "n", "total", "low", "high", "mean", "sd", "panos", "any_deleted", "all_deleted", "middle", "p90")


@query("g07_first_value", f"{W} SELECT city, min(label_id) AS first_label, arg_min(truth_m, label_id * 1000000 + cast(truth_m * 10 AS bigint)) FILTER (WHERE lat IS NOT NULL) AS first_truth FROM clicks GROUP BY city")
def g07(spark, d):
    placed = F.when(F.col("lat").isNotNull(), F.col("truth_m"))
    order = F.col("label_id") * 1000000 + F.rint(F.col("truth_m") * 10).cast("long")
    return clicks(spark, d).select("city", "label_id", placed.alias("placed"), order.alias("o")).groupBy("city").agg(F.min("label_id").alias("first_label"), agg.first_by("placed", F.col("o")).alias("first_truth"))


@query(
    "g08_mode",
    f"""{W}, t AS (SELECT city, CASE WHEN pano_id % 4 = 0 THEN NULL ELSE zoom + pano_id % 3 END AS v FROM clicks), u AS (SELECT city, v, count(*) AS n FROM t GROUP BY city, v)
SELECT city, v, n FROM u QUALIFY row_number() OVER (PARTITION BY city ORDER BY n DESC, v ASC NULLS LAST) = 1""",
)
def g08(spark, d):
    v = F.when(F.col("pano_id") % 4 != 0, F.col("zoom") + F.col("pano_id") % 3)
    return agg.mode_per_group(clicks(spark, d).select("city", v.alias("v")), ["city"], "v")


@query("g09_value_counts", f"{W} SELECT deleted, count(*) AS n FROM clicks GROUP BY deleted")
def g09(spark, d):
    return clicks(spark, d).groupBy("deleted").agg(F.count(F.lit(1)).alias("n"))


@query("g10_g11_rates_conditional", f"{W} SELECT city, round(avg(cast(zoom = 3 AS double)), 6) AS close_rate, count(*) FILTER (WHERE truth_m > 20) AS far, count(*) FILTER (WHERE deleted) AS deleted FROM clicks GROUP BY city")
def g10(spark, d):
    return clicks(spark, d).groupBy("city").agg(rounded(F.avg((F.col("zoom") == 3).cast("double")), "close_rate"), F.count_if(F.col("truth_m") > 20).alias("far"), F.count_if("deleted").alias("deleted"))


_A, _B = "greatest(0e0, 18e0 + 0.012e0 * sv_image_y - 0.01e0 * canvas_y)", "greatest(0e0, 16e0 - 0.2e0 * dep)"


def _metrics_sql(by: str, least: int, source: str) -> str:
    parts = []
    for k, p in (("a", _A), ("b", _B)):
        e = f"({p} - truth_m)"
        parts.append(f"round(median(abs({e})), 6) AS {k}_median, round(median({e}), 6) AS {k}_signed, round(quantile_cont(abs({e}), 0.9), 6) AS {k}_p90, round(regr_slope({e}, truth_m), 6) AS {k}_slope")
    return f"{WP} SELECT {by}, count(*) AS n, {', '.join(parts)} FROM {source} GROUP BY {by} HAVING count(*) >= {least}"


def _models():
    low = F.lit(0.0)
    return {"a": F.greatest(low, 18 + 0.012 * F.col("sv_image_y") - 0.01 * F.col("canvas_y")), "b": F.greatest(low, 16 - 0.2 * F.col("dep"))}


@query("g12_g13_grouped_metrics", _metrics_sql("label_type", 25, "pov"))
def g12(spark, d):
    return agg.error_metrics(with_angles(clicks(spark, d)), ["label_type"], _models(), F.col("truth_m"), 25)


@query("g30_two_key_metrics", _metrics_sql("city, pano_height", 50, "pov"))
def g30(spark, d):
    return agg.error_metrics(with_angles(clicks(spark, d)), ["city", "pano_height"], _models(), F.col("truth_m"), 50)


@query("g14_g15_correlation_slope", f"{W} SELECT city, round(corr(truth_m, noise), 6) AS r, round(regr_slope(noise, truth_m), 6) AS slope, round(regr_intercept(noise, truth_m), 6) AS intercept FROM clicks GROUP BY city")
def g14(spark, d):
    return clicks(spark, d).groupBy("city").agg(rounded(F.corr("truth_m", "noise"), "r"), rounded(F.regr_slope("noise", "truth_m"), "slope"), rounded(F.regr_intercept("noise", "truth_m"), "intercept"))


@query(
    "g16_within_group_slope",
    f"""{W}, t AS (SELECT pano_id, truth_m - avg(truth_m) OVER (PARTITION BY pano_id) AS x, noise - avg(noise) OVER (PARTITION BY pano_id) AS y FROM clicks),
s AS (SELECT count(*) AS n, count(DISTINCT pano_id) AS g, sum(x * x) AS sxx, sum(x * y) AS sxy, sum(y * y) AS syy FROM t)
SELECT n, g AS "groups", round(sxy / sxx, 4) AS slope, round(sqrt((syy - sxy * sxy / sxx) / greatest(n - g - 1, 1) / sxx), 4) AS se FROM s""",
)
def g16(spark, d):
    return agg.within_slope(clicks(spark, d), "pano_id", F.col("truth_m"), F.col("noise"))


@query(
    "g17_fixed_bins",
    f"""{WP}, t AS (SELECT truth_m, CASE WHEN dep > -90 AND dep <= 0 THEN 0 WHEN dep > 0 AND dep <= 2 THEN 1 WHEN dep > 2 AND dep <= 5 THEN 2 WHEN dep > 5 AND dep <= 11.25 THEN 3 WHEN dep > 11.25 AND dep <= 90 THEN 4 END AS bin FROM pov)
SELECT bin, count(*) AS n, round(median(truth_m), 6) AS middle, round(quantile_cont(truth_m, 0.95), 6) AS p95, max(truth_m) AS high FROM t WHERE bin IS NOT NULL GROUP BY bin""",
)
def g17(spark, d):
    bins = closed_bin(F.col("dep"), [-90.0, 0.0, 2.0, 5.0, 11.25, 90.0])
    t = with_angles(clicks(spark, d)).select("truth_m", bins.alias("bin")).where("bin IS NOT NULL")
    return quantiles(t, ["bin"], {"middle": (F.col("truth_m"), 0.5), "p95": (F.col("truth_m"), 0.95)}, [F.max("truth_m").alias("high")])


@query(
    "g17_left_closed_bins",
    f"""{W}, t AS (SELECT noise, CASE WHEN truth_m >= 0 AND truth_m < 5 THEN 0 WHEN truth_m >= 5 AND truth_m < 10 THEN 1 WHEN truth_m >= 10 AND truth_m < 20 THEN 2 WHEN truth_m >= 20 AND truth_m < 50 THEN 3 END AS bin FROM clicks)
SELECT bin, count(*) AS n, round(median(abs(noise)), 6) AS middle FROM t GROUP BY bin""",
)
def g17_left(spark, d):
    t = clicks(spark, d).select("noise", closed_bin(F.col("truth_m"), [0, 5, 10, 20, 50], right=False).alias("bin"))
    return quantiles(t, ["bin"], {"middle": (F.abs("noise"), 0.5)})


@query("g18_equal_width_bins", f"{W}, t AS (SELECT cast(floor(truth_m / 2.5e0) AS bigint) AS b, truth_m, noise FROM clicks) SELECT b * 2.5e0 + 1.25e0 AS centre, count(*) AS n, round(median(noise), 6) AS middle FROM t GROUP BY b HAVING count(*) >= 30")
def g18(spark, d):
    t = clicks(spark, d).select(F.floor(F.col("truth_m") / 2.5).alias("b"), "noise")
    return quantiles(t, ["b"], {"middle": (F.col("noise"), 0.5)}).where("n >= 30").select((F.col("b") * 2.5 + 1.25).alias("centre"), "n", "middle")


@query(
    "g19_quantile_bins",
    "WITH t AS (SELECT l_quantity AS q, l_extendedprice AS v FROM lineitem), e AS (SELECT unnest(list_distinct(quantile_cont(q, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS edge FROM t), r AS (SELECT edge, row_number() OVER (ORDER BY edge) - 1 AS k FROM e)"
    " SELECT greatest((SELECT count(*) FROM r WHERE r.edge < t.q) - 1, 0) AS bin, count(*) AS n, round(median(v), 6) AS middle FROM t GROUP BY 1",
)
def g19(spark, d):
    t = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("v"))
    binned, _ = agg.quantile_bins(t, "q", 10)
    return quantiles(binned, ["bin"], {"middle": (F.col("v"), 0.5)})


@query("g20_means", f"{W} SELECT city, round(sum(truth_m * zoom) / sum(zoom), 6) AS weighted, round(exp(avg(ln(truth_m))), 6) AS geometric, round(sqrt(avg(noise * noise)), 6) AS rms, round(max(truth_m) - min(truth_m), 6) AS spread FROM clicks GROUP BY city")
def g20(spark, d):
    return clicks(spark, d).groupBy("city").agg(rounded(F.sum(F.col("truth_m") * F.col("zoom")) / F.sum("zoom"), "weighted"), rounded(F.exp(F.avg(F.ln("truth_m"))), "geometric"), rounded(F.sqrt(F.avg(F.col("noise") * F.col("noise"))), "rms"), rounded(F.max("truth_m") - F.min("truth_m"), "spread"))


@query("g22_g23_weighted_histogram", f"{WP} SELECT cast(floor(dep) AS bigint) AS bin, sum(zoom) AS weight FROM pov GROUP BY 1")
def g22(spark, d):
    return with_angles(clicks(spark, d)).groupBy(F.floor("dep").alias("bin")).agg(F.sum("zoom").alias("weight"))


@query("g24_mad", f"{W}, m AS (SELECT city, median(noise) AS md FROM clicks GROUP BY city) SELECT city, round(any_value(md), 6) AS median, round(median(abs(noise - md)), 6) AS mad FROM clicks JOIN m USING (city) GROUP BY city")
def g24(spark, d):
    return agg.mad(clicks(spark, d), ["city"], "noise")


@query("g25_bootstrap_median")
def g25(spark, d):
    return agg.bootstrap_median(clicks(spark, d), ["city"], "truth_m", "label_id")


@query("g26_g27_sign_test_rank", f"{WP} SELECT city, count(*) FILTER (WHERE abs({_A} - truth_m) < abs({_B} - truth_m)) AS better, count(*) FILTER (WHERE abs({_A} - truth_m) > abs({_B} - truth_m)) AS worse, count(*) FILTER (WHERE noise < 0.25) AS null_below, round(count(*) FILTER (WHERE noise < 0.25) * 100e0 / count(*), 6) AS percentile FROM pov GROUP BY city")
def g26(spark, d):
    m = _models()
    a, b = F.abs(m["a"] - F.col("truth_m")), F.abs(m["b"] - F.col("truth_m"))
    below = F.count_if(F.col("noise") < 0.25)
    return with_angles(clicks(spark, d)).groupBy("city").agg(F.count_if(a < b).alias("better"), F.count_if(a > b).alias("worse"), below.alias("null_below"), rounded(below * 100 / F.count(F.lit(1)), "percentile"))


@query(
    "g28_sweep_argmin",
    f"""{W}, s AS (SELECT city, shift, avg(abs(noise * 10 - shift)) AS score FROM clicks, (SELECT unnest([-4, -2, 0, 2, 4]) AS shift) GROUP BY city, shift)
SELECT city, round(min(score), 6) AS best, arg_min(shift, round(score, 9)) AS at_shift FROM s GROUP BY city""",
)
def g28(spark, d):
    s = clicks(spark, d).select("city", "noise", F.explode(F.array(*[F.lit(k) for k in (-4, -2, 0, 2, 4)])).alias("shift"))
    s = s.groupBy("city", "shift").agg(F.avg(F.abs(F.col("noise") * 10 - F.col("shift"))).alias("score"))
    return s.groupBy("city").agg(rounded(F.min("score"), "best"), F.min_by("shift", F.struct(F.round("score", 9), "shift")).alias("at_shift"))


@query("g29_pivot", f"{W} SELECT city, count(*) FILTER (WHERE zoom = 1) AS z1, count(*) FILTER (WHERE zoom = 2) AS z2, count(*) FILTER (WHERE zoom = 3) AS z3 FROM clicks GROUP BY city")
def g29(spark, d):
    wide = clicks(spark, d).groupBy("city").pivot("zoom", [1, 2, 3]).agg(F.count(F.lit(1)))
    return wide.select("city", *[F.coalesce(f"`{k}`", F.lit(0)).cast("long").alias(f"z{k}") for k in (1, 2, 3)])


@query("g31_across_within", f"{W}, p AS (SELECT city, pano_id, avg(noise) AS m, stddev_samp(noise) AS s FROM clicks GROUP BY city, pano_id) SELECT city, round(stddev_samp(m), 6) AS across, round(median(s), 6) AS within FROM p GROUP BY city")
def g31(spark, d):
    p = clicks(spark, d).groupBy("city", "pano_id").agg(F.avg("noise").alias("m"), F.stddev_samp("noise").alias("s"))
    return quantiles(p, ["city"], {"within": (F.col("s"), 0.5)}, [rounded(F.stddev_samp("m"), "across")]).drop("n")


@query("g32_dimension_histogram", f"{W} SELECT concat(cast(pano_width AS varchar(9)), 'x', cast(pano_height AS varchar(9))) AS dims, count(*) AS n, count(DISTINCT pano_id) AS panos FROM clicks GROUP BY 1")
def g32(spark, d):
    return clicks(spark, d).groupBy(F.concat_ws("x", "pano_width", "pano_height").alias("dims")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("pano_id").alias("panos"))


@query("g33_members_per_pano", "WITH m AS (SELECT l_partkey AS pano_id, count(*) AS n FROM lineitem WHERE coalesce(CASE WHEN l_linenumber = 1 THEN NULL ELSE l_linenumber % 2 = 0 END, true) GROUP BY 1) SELECT p_partkey AS pano_id, coalesce(n, 0) AS n FROM part LEFT JOIN m ON p_partkey = pano_id")
def g33(spark, d):
    sites = spark.read.parquet(f"{d}/lineitem.parquet").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_partkey").alias("pano_id"), F.when(F.col("l_linenumber") != 1, F.col("l_linenumber") % 2 == 0).alias("in_refit"))).alias("members"))
    seen = sites.select(F.explode("members").alias("m")).where(F.coalesce("m.in_refit", F.lit(True))).groupBy("m.pano_id").agg(F.count(F.lit(1)).alias("n"))
    part = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("pano_id"))
    return part.join(seen, "pano_id", "left").select("pano_id", F.coalesce("n", F.lit(0)).alias("n"))
