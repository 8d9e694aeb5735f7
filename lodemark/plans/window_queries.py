"""Queries for windows (W), orders (O), sets (U) and sampling (T)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodemark.operators import aggregate as agg
from lodemark.operators import windows
from lodemark.operators.aggregate import rounded
from lodemark.operators.quantiles import quantiles, weighted_median
from lodemark.plans.clicks import SQL, clicks
from lodemark.registry import query

W = f"WITH {SQL}"


def _li(spark, d):
    return spark.read.parquet(f"{d}/lineitem.parquet")


@query("w01_w02_group_size_mean", f"{W} SELECT label_id, count(*) OVER (PARTITION BY pano_id) AS n, round(avg(noise) OVER (PARTITION BY pano_id), 6) AS centre FROM clicks")
def w01(spark, d):
    w = Window.partitionBy("pano_id")
    return clicks(spark, d).select("label_id", F.count(F.lit(1)).over(w).alias("n"), rounded(F.avg("noise").over(w), "centre"))


@query("w03_group_distinct", f"{W}, s AS (SELECT pano_id, count(DISTINCT city) AS n_cities FROM clicks GROUP BY pano_id) SELECT label_id, n_cities FROM clicks JOIN s USING (pano_id)")
def w03(spark, d):
    c = clicks(spark, d)
    return c.join(c.groupBy("pano_id").agg(F.countDistinct("city").alias("n_cities")), "pano_id").select("label_id", "n_cities")


_PLACES = ("40e0 + (event_id % 100) / 10000e0 AS lat", "-75e0 + (event_id % 77) / 10000e0 AS lng")


@query(
    "w04_consecutive_differences",
    f"""WITH e AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS ms, {', '.join(_PLACES)} FROM events),
l AS (SELECT *, lag(ms) OVER w AS pm, lag(lat) OVER w AS pla, lag(lng) OVER w AS pln FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ms, event_id))
SELECT event_id, round((ms - pm) / 1000e0, 6) AS dt_s, round(2 * 6371008.8e0 * asin(sqrt(power(sin(radians(lat - pla) / 2), 2) + cos(radians(pla)) * cos(radians(lat)) * power(sin(radians(lng - pln) / 2), 2))), 6) AS step_m FROM l""",
)
def w04(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").selectExpr("user_id", "event_id", "unix_millis(cast(ts AS timestamp)) AS ms", *_PLACES)
    return windows.consecutive(e, "user_id", "ms", "event_id", "lat", "lng").select("event_id", rounded(F.col("dt_s"), "dt_s"), rounded(F.col("step_m"), "step_m"))


@query(
    "w05_weighted_median",
    f"""{W}, v AS (SELECT label_type, truth_m AS v, sum(zoom) AS w FROM clicks GROUP BY label_type, truth_m),
c AS (SELECT *, sum(w) OVER (PARTITION BY label_type ORDER BY v ROWS UNBOUNDED PRECEDING) AS c, sum(w) OVER (PARTITION BY label_type) AS t FROM v)
SELECT label_type, min(v) AS median FROM c WHERE c >= 0.5 * t GROUP BY label_type""",
)
def w05(spark, d):
    return weighted_median(clicks(spark, d), ["label_type"], F.col("truth_m"), F.col("zoom"))


_TOP = "l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_quantity"


@query("w06_top_per_group", f"SELECT l_suppkey, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY {_TOP}) <= 3")
def w06(spark, d):
    order = [F.desc("l_extendedprice"), *[F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")]]
    return windows.top_per_group(_li(spark, d), ["l_suppkey"], order, 3).select("l_suppkey", "l_extendedprice")


@query("w07_first_pick_wins", "SELECT l_partkey, min(CASE WHEN l_quantity > 45 THEN 0 WHEN l_discount > 0.08 THEN 1 ELSE 2 END) AS stratum FROM lineitem GROUP BY l_partkey")
def w07(spark, d):
    s = _li(spark, d).select("l_partkey", F.when(F.col("l_quantity") > 45, 0).when(F.col("l_discount") > 0.08, 1).otherwise(2).alias("stratum"))
    return windows.first_pick_wins(s, "l_partkey", "stratum", [])


@query("w08_take_until_quota", "WITH t AS (SELECT o_custkey, o_orderkey, o_totalprice, sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS s FROM orders) SELECT o_custkey, o_orderkey FROM t WHERE s - o_totalprice < 300000")
def w08(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    return windows.take_until(o, ["o_custkey"], [F.col("o_orderkey")], "o_totalprice", 300000).select("o_custkey", "o_orderkey")


@query("w09_running_minimum", "SELECT o_orderkey, min(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS floor_price FROM orders")
def w09(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.min("o_totalprice").over(w).alias("floor_price"))


@query("w10_row_numbers", "SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) - 1 AS place FROM customer")
def w10(spark, d):
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", (F.row_number().over(w) - 1).cast("long").alias("place"))


@query("w11_ecdf", f"{W}, v AS (SELECT truth_m, count(*) AS n FROM clicks GROUP BY truth_m) SELECT truth_m, n, round(sum(n) OVER (ORDER BY truth_m) * 1e0 / sum(n) OVER (), 6) AS share FROM v")
def w11(spark, d):
    c = clicks(spark, d)
    whole = c.where("truth_m IS NOT NULL").count()
    return windows.running_counts(c, "truth_m").select("truth_m", "n", rounded(F.col("upto") / whole, "share"))


@query(
    "w12_gaps_and_islands",
    """WITH t AS (SELECT user_id, event_type AS v, row_number() OVER w AS spot, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
n AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY spot ROWS UNBOUNDED PRECEDING) AS run FROM t)
SELECT user_id, run, any_value(v) AS event_type, min(spot) AS start, count(*) AS length FROM n GROUP BY user_id, run""",
)
def w12(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return windows.runs(e, ["user_id"], [F.col("ts"), F.col("event_id")], "event_type").select("user_id", "run", "event_type", F.col("start").cast("long").alias("start"), "length")


_GRID = "(l_orderkey % 64) AS r, (l_partkey % 128) AS c, min(l_suppkey % 5) AS v"


@query(
    "w13_neighbourhood_median",
    f"""WITH g AS (SELECT {_GRID} FROM lineitem GROUP BY 1, 2), o AS (SELECT * FROM (SELECT unnest([-1, 0, 1]) AS dr), (SELECT unnest([-1, 0, 1]) AS dc))
SELECT a.r, a.c, median(b.v) AS middle FROM g a, o, g b WHERE b.r = a.r + dr AND b.c = a.c + dc GROUP BY a.r, a.c""",
)
def w13(spark, d):
    g = _li(spark, d).selectExpr("l_orderkey % 64 AS r", "l_partkey % 128 AS c", "l_suppkey % 5 AS s").groupBy("r", "c").agg(F.min("s").alias("v"))
    steps = F.array(*[F.struct(F.lit(i).alias("dr"), F.lit(j).alias("dc")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    # Every cell sends its value to its nine neighbours; no join and no window over the grid.
    sent = g.select("r", "c", "v", F.explode(steps).alias("o")).select((F.col("r") + F.col("o.dr")).alias("r"), (F.col("c") + F.col("o.dc")).alias("c"), "v")
    return sent.groupBy("r", "c").agg(F.percentile("v", 0.5).alias("middle")).join(g.select("r", "c"), ["r", "c"], "left_semi")


@query("w14_w15_edges_skyline", f"WITH g AS (SELECT {_GRID} FROM lineitem GROUP BY 1, 2), e AS (SELECT r, c, v, v <> coalesce(lead(v) OVER (PARTITION BY r ORDER BY c), v) OR v <> coalesce(lead(v) OVER (PARTITION BY c ORDER BY r), v) AS edge FROM g) SELECT c, max(r) FILTER (WHERE v = 0) AS skyline, count(*) FILTER (WHERE edge) AS edges FROM e GROUP BY c")
def w14(spark, d):
    g = _li(spark, d).selectExpr("l_orderkey % 64 AS r", "l_partkey % 128 AS c", "l_suppkey % 5 AS s").groupBy("r", "c").agg(F.min("s").alias("v"))
    right, below = (F.coalesce(F.lead("v").over(Window.partitionBy(a).orderBy(b)), F.col("v")) for a, b in (("r", "c"), ("c", "r")))
    e = g.select("r", "c", "v", ((F.col("v") != right) | (F.col("v") != below)).alias("edge"))
    return e.groupBy("c").agg(F.max(F.when(F.col("v") == 0, F.col("r"))).alias("skyline"), F.count_if("edge").alias("edges"))


@query("o01_o05_orders_topk", "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey ORDER BY n DESC, l_suppkey LIMIT 10")
def o01(spark, d):
    return _li(spark, d).groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "l_suppkey").limit(10)


@query("o04_argmin", f"{W} SELECT city, arg_min(label_type, m) AS best FROM (SELECT city, label_type, round(avg(abs(noise)), 9) AS m FROM clicks GROUP BY city, label_type) GROUP BY city")
def o04(spark, d):
    m = clicks(spark, d).groupBy("city", "label_type").agg(F.round(F.avg(F.abs("noise")), 9).alias("m"))
    return m.groupBy("city").agg(F.min_by("label_type", F.struct("m", "label_type")).alias("best"))


@query("u01_u05_sets", "SELECT 'union_all' AS op, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) UNION ALL SELECT 'intersect', count(*) FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'union', count(*) FROM (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier) UNION ALL SELECT 'except', count(*) FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_nationkey < 10)")
def u01(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_nationkey").alias("k"))
    s = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_nationkey").alias("k"))
    parts = {"union_all": c.unionByName(s), "intersect": c.intersect(s), "union": c.unionByName(s).distinct(), "except": c.subtract(s.where("k < 10"))}
    out = None
    for name, df in parts.items():
        row = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("op"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@query("u05_first_seen_distinct", "SELECT user_id, arg_min(event_type, event_id) AS first_type, min(event_id) AS first_id FROM events GROUP BY user_id")
def u05(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").groupBy("user_id").agg(F.min_by("event_type", "event_id").alias("first_type"), F.min("event_id").alias("first_id"))


@query("t02_exact_split", "WITH t AS (SELECT o_orderkey, md5(concat_ws('|', cast(o_orderkey AS varchar), '7')) AS o FROM orders) SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY o) <= round_even((SELECT count(*) FROM orders) * 0.8, 0) THEN 'train' ELSE 'test' END AS part FROM t")
def t02(spark, d):
    return windows.exact_share(spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey"), ["o_orderkey"], 0.8, 7)


@query(
    "t03_proportional_sample",
    """WITH t AS (SELECT o_orderkey, o_orderpriority, o_orderstatus, md5(concat_ws('|', cast(o_orderkey AS varchar), '3')) AS o FROM orders),
q AS (SELECT o_orderpriority, o_orderstatus, greatest(1, cast(round(count(*) * (200e0 / (SELECT count(*) FROM orders))) AS int)) AS q FROM orders GROUP BY 1, 2)
SELECT o_orderkey, o_orderpriority, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority, o_orderstatus ORDER BY o, o_orderkey) AS k FROM t) JOIN q USING (o_orderpriority, o_orderstatus) WHERE k <= q""",
)
def t03(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return windows.proportional_sample(o, ["o_orderpriority", "o_orderstatus"], ["o_orderkey"], 200, 3)


@query("t05_half_split_by_group", f"{W}, k AS (SELECT DISTINCT pano_id FROM clicks), r AS (SELECT pano_id, row_number() OVER (ORDER BY md5(concat_ws('|', cast(pano_id AS varchar), '5')), pano_id) AS n FROM k) SELECT label_id, pano_id, CASE WHEN n <= ((SELECT count(*) FROM k) + 1) // 2 THEN 'A' ELSE 'B' END AS half FROM clicks JOIN r USING (pano_id)")
def t05(spark, d):
    return windows.half_split(clicks(spark, d).select("label_id", "pano_id"), "pano_id", 5)


@query(
    "t07_click_noise_sweep",
    f"""{W}, g AS (SELECT * FROM (SELECT unnest([2, 5, 10]) AS sigma), (SELECT unnest([0, 1, 2, 3, 4]) AS draw)),
h AS (SELECT city, sigma, draw, truth_m, md5(concat_ws('|', cast(label_id AS varchar), cast(pano_id AS varchar), cast(draw AS varchar))) AS m FROM clicks, g),
u AS (SELECT *, (cast(('0x' || substr(m, 1, 7)) AS bigint) + 0.5e0) / 268435456e0 AS u1, (cast(('0x' || substr(m, 8, 7)) AS bigint) + 0.5e0) / 268435456e0 AS u2 FROM h)
SELECT city, sigma, round(median(abs(sqrt(-2 * ln(u1)) * cos(2 * pi() * u2) * sigma)), 6) AS shift, count(*) AS n FROM u GROUP BY city, sigma""",
)
def t07(spark, d):
    grid = F.array(*[F.struct(F.lit(s).alias("sigma"), F.lit(k).alias("draw")) for s in (2, 5, 10) for k in range(5)])
    h = clicks(spark, d).select("city", "label_id", "pano_id", F.explode(grid).alias("g")).select("city", "g.sigma", windows.md5_order(F.col("label_id"), F.col("pano_id"), F.col("g.draw")).alias("m"))
    u1, u2 = ((F.conv(F.substring("m", a, 7), 16, 10).cast("long") + 0.5) / 268435456 for a in (1, 8))
    z = F.sqrt(-2 * F.ln(u1)) * F.cos(2 * F.pi() * u2) * F.col("sigma")
    return quantiles(h, ["city", "sigma"], {"shift": (F.abs(z), 0.5)})
