"""Queries for joins (J) and for the relational extractions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodemark.operators import joins
from lodemark.plans.clicks import SQL, clicks
from lodemark.registry import query

W = f"WITH {SQL}"


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


@query("j01_keys_with_cardinality", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 5 = 0")
def j01(spark, d):
    o = _t(spark, d, "orders")
    return joins.join_on_keys(o.select("o_orderkey", "o_totalprice"), o.where("o_orderkey % 5 = 0").select("o_orderkey"), ["o_orderkey"])


@query("j02_left_many_to_one", "SELECT o_orderkey, c_mktsegment FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey")
def j02(spark, d):
    c = _t(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return _t(spark, d, "orders").join(c, "o_custkey", "left").select("o_orderkey", "c_mktsegment")


@query("j03_one_to_one", "SELECT d.doc_id, quality, n_chars FROM documents d JOIN labels l USING (doc_id)")
def j03(spark, d):
    return joins.join_one_to_one(_t(spark, d, "documents").select("doc_id", "n_chars"), _t(spark, d, "labels").select("doc_id", "quality"), ["doc_id"]).select("doc_id", "quality", "n_chars")


@query("j04_one_to_many", "SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_mktsegment")
def j04(spark, d):
    c = _t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return c.join(_t(spark, d, "orders"), "o_custkey").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("j05_semi", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def j05(spark, d):
    o = _t(spark, d, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return _t(spark, d, "customer").join(o, "c_custkey", "left_semi").select("c_custkey")


@query("j06_u04_anti_split", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def j06(spark, d):
    o = _t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return _t(spark, d, "customer").join(o, "c_custkey", "left_anti").select("c_custkey")


@query("j07_lookup", "SELECT s_suppkey, coalesce(n_name, 'none') AS n_name FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON s_nationkey = n_nationkey")
def j07(spark, d):
    n = _t(spark, d, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return joins.lookup(_t(spark, d, "supplier"), n, "s_nationkey", "n_name", F.lit("none")).select("s_suppkey", "n_name")


@query(
    "j08_s12_inner_extraction",
    """SELECT o_orderkey AS label_id, o_orderpriority AS label_type, c_acctbal AS lat, n_name AS computation_method, o_orderdate AS time_created, starts_with(c_name, 'Customer#0000001') AS is_ai, r_name AS pano_source
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderdate > TIMESTAMP '1995-06-01' AND o_orderstatus <> 'P' AND c_acctbal IS NOT NULL ORDER BY label_id""",
)
def j08(spark, d):
    o = _t(spark, d, "orders").where((F.col("o_orderdate") > F.lit("1995-06-01").cast("timestamp_ntz")) & (F.col("o_orderstatus") != "P"))
    c = _t(spark, d, "customer").where("c_acctbal IS NOT NULL")
    n, r = _t(spark, d, "nation"), _t(spark, d, "region")
    joined = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    return joined.select(
        F.col("o_orderkey").alias("label_id"), F.col("o_orderpriority").alias("label_type"), F.col("c_acctbal").alias("lat"), F.col("n_name").alias("computation_method"),
        F.col("o_orderdate").alias("time_created"), F.col("c_name").startswith("Customer#0000001").alias("is_ai"), F.col("r_name").alias("pano_source"),
    ).orderBy("label_id")


@query(
    "s13_left_join_extraction",
    "SELECT o_orderkey AS label_id, 'modern' AS era, cast(o_totalprice AS bigint) AS pano_x, c_name, n_name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 5000) ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey",
)
def s13(spark, d):
    c = _t(spark, d, "customer").where("c_acctbal > 5000")
    o, n = _t(spark, d, "orders"), _t(spark, d, "nation")
    joined = o.join(c, o["o_custkey"] == c["c_custkey"], "left").join(n, c["c_nationkey"] == n["n_nationkey"], "left")
    return joined.select(F.col("o_orderkey").alias("label_id"), F.lit("modern").alias("era"), F.bround("o_totalprice", 0).cast("long").alias("pano_x"), "c_name", "n_name")


@query("j09_s14_existence_column", "SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AS tutorial, cast(NULL AS int) AS canvas_width FROM customer")
def j09(spark, d):
    o = _t(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return joins.flagged_members(_t(spark, d, "customer").select("c_custkey"), o, "c_custkey", "tutorial").select("c_custkey", "tutorial", F.lit(None).cast("int").alias("canvas_width"))


_PLANES = "SELECT vec_id AS id, cast(embedding[1] AS double) AS nx, cast(embedding[2] AS double) AS ny, cast(embedding[3] AS double) AS d FROM embeddings"


@query(
    "j10_nearest_parallel_plane",
    f"""WITH p AS ({_PLANES}), a AS (SELECT * FROM p WHERE id % 2 = 0), b AS (SELECT nx AS bx, ny AS by_, d AS bd FROM p WHERE id % 2 = 1),
m AS (SELECT id, abs(d - CASE WHEN nx * bx + ny * by_ >= 0 THEN bd ELSE -bd END) AS gap FROM a, b WHERE abs(nx * bx + ny * by_) / sqrt((nx * nx + ny * ny) * (bx * bx + by_ * by_)) >= 0.98)
SELECT id, round(min(gap), 6) AS gap FROM m GROUP BY id""",
)
def j10(spark, d):
    e = _t(spark, d, "embeddings")
    p = e.select(F.col("vec_id").alias("id"), *[F.col("embedding")[k].cast("double").alias(n) for k, n in enumerate(("nx", "ny", "d"))])
    return joins.nearest_parallel(p.where("id % 2 = 0"), p.where("id % 2 = 1"), 0.98).select("id", F.round("gap", 6).alias("gap"))


@query(
    "j11_permutation_pairs",
    """WITH o AS (SELECT s_suppkey, md5(concat_ws('|', cast(s_suppkey AS varchar), '9')) AS m FROM supplier), r AS (SELECT s_suppkey, row_number() OVER (ORDER BY m) - 1 AS spot, count(*) OVER () AS n FROM o)
SELECT a.s_suppkey, b.s_suppkey AS other FROM r a, (SELECT unnest([1, 2, 3, 4, 5]) AS step), r b WHERE b.spot = (a.spot + step) % a.n""",
)
def j11(spark, d):
    return joins.other_keys(_t(spark, d, "supplier"), "s_suppkey", 5, 9)


@query("j12_referential_integrity", "SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 10 <> 3) GROUP BY l_orderkey")
def j12(spark, d):
    owners = _t(spark, d, "orders").where("o_orderkey % 10 <> 3").select(F.col("o_orderkey").alias("l_orderkey"))
    return joins.unresolved(_t(spark, d, "lineitem").select("l_orderkey"), owners, "l_orderkey").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


@query(
    "j13_best_partner",
    """WITH p AS (SELECT o_custkey, o_orderkey, extract(year FROM o_orderdate) AS y, 1995 AS own FROM orders)
SELECT o_custkey, o_orderkey, cast(abs(y - own) AS int) AS gap FROM p WHERE abs(y - own) >= 2 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY abs(y - own) DESC, o_orderkey) = 1""",
)
def j13(spark, d):
    p = _t(spark, d, "orders").select("o_custkey", "o_orderkey", F.year("o_orderdate").alias("y"), F.lit(1995).alias("own"))
    return joins.best_partner(p, "o_custkey", "own", "y", "o_orderkey", 2).select("o_custkey", "o_orderkey", "gap")


@query("j14_greedy_spacing")
def j14(spark, d):
    p = clicks(spark, d).select("city", "pano_id", "pano_lat", "pano_lng").distinct()
    return joins.greedy_spacing(p, "city", "pano_id", "pano_lat", "pano_lng", 5000.0, 100, 1)


@query("s15_union_of_schemas", f"{W} SELECT city, count(*) AS n FROM clicks WHERE city NOT IN ('c0', 'c5') GROUP BY city")
def s15(spark, d):
    from lodemark.sources.readers import union_of

    c = clicks(spark, d)
    parts = {f"c{k}": c.where(F.col("city") == f"c{k}") for k in range(7)}
    return union_of(parts, exclude={"c0", "c5"}).groupBy("city").agg(F.count(F.lit(1)).alias("n"))
