"""Window-shaped operators, written so that no partition of a window grows with the whole input
where a grouped aggregate can carry the work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def md5_order(*parts: Column) -> Column:
    """A pseudo-random order that every engine and partitioning agrees on."""
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))


def top_per_group(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.select("*", F.row_number().over(w).alias("_k")).where(F.col("_k") <= n).drop("_k")


def first_pick_wins(df: DataFrame, key: str, stratum: str, order: list[Column]) -> DataFrame:
    """Each key once, in its first stratum."""
    return top_per_group(df, [key], [F.col(stratum), *order], 1)


def take_until(df: DataFrame, by: list[str], order: list[Column], amount: str, quota: float) -> DataFrame:
    """Rows in order until the quota is reached; the row that crosses it is included."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.select("*", F.sum(amount).over(w).alias("_s")).where(F.col("_s") - F.col(amount) < quota).drop("_s")


def running_counts(df: DataFrame, value: str) -> DataFrame:
    """(value, n, upto): how many rows have this value, and at most this value.

    Distinct values are counted first and then cut into ranges; a range knows the rows before it from one
    small total per range, so that no order over all values is made in one task. The ranges are written before
    they are read: their edges are sampled, and sampled anew would not be those of the totals.
    """
    from lodemark.session import checkpointed

    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    ranged = checkpointed(counts.repartitionByRange(value).select("*", F.spark_partition_id().alias("_r")))
    totals = {r["_r"]: r["t"] for r in ranged.groupBy("_r").agg(F.sum("n").alias("t")).collect()}
    before, so_far = [], 0
    for r in range(max(totals, default=-1) + 1):
        before.append(so_far)
        so_far += totals.get(r, 0)
    w = Window.partitionBy("_r").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    start = F.element_at(F.array(*[F.lit(b).cast("long") for b in before]), F.col("_r") + 1) if before else F.lit(0)
    return ranged.select(value, "n", (F.sum("n").over(w) + start).alias("upto"))


def runs(df: DataFrame, by: list[str], order: list[Column], value: str) -> DataFrame:
    """Gaps and islands: one row per run of equal consecutive values (missing equals missing)."""
    w = Window.partitionBy(*by).orderBy(*order)
    change = F.when(F.col(value).eqNullSafe(F.lag(value).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    marked = df.select("*", change.alias("_c"), F.row_number().over(w).alias("_at"))
    numbered = marked.select("*", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("run"))
    return numbered.groupBy(*by, "run").agg(F.first(value).alias(value), F.min("_at").alias("start"), F.count(F.lit(1)).alias("length"))


def nth_hash(df: DataFrame, column: str, n: int) -> str | None:
    """The n-th (from 0) value of a column of hex hashes in order; None beyond the end.

    Counts by the first four digits, at most 65,536, tell which rows it is among; only those are sorted.
    """
    head = F.substring(column, 1, 4)
    counts = df.groupBy(head.alias("h")).agg(F.count(F.lit(1)).alias("n")).collect()
    before = 0
    for r in sorted(counts, key=lambda r: r["h"]):
        if before + r["n"] > n:
            return df.where(head == r["h"]).select(column).orderBy(column).offset(n - before).limit(1).first()[0]
        before += r["n"]
    return None


def half_split(df: DataFrame, group: str, seed: int) -> DataFrame:
    """Every group falls whole into half A or B by the order of its hash."""
    keys = df.select(group).distinct()
    order = keys.select(group, md5_order(F.col(group), F.lit(seed)).alias("_o"))
    cut = nth_hash(order, "_o", (keys.count() + 1) // 2)
    side = F.lit("A") if cut is None else F.when(F.col("_o") < cut, "A").otherwise("B")
    return df.join(order.select(group, side.alias("half")), group)


def exact_share(df: DataFrame, keys: list[str], share: float, seed: int) -> DataFrame:
    """round(n * share) rows are `train`, by the order of a hash of the keys; the rest `test`.

    Rows that share all keys share a hash and fall on one side together.
    """
    order = df.select("*", md5_order(*[F.col(k) for k in keys], F.lit(seed)).alias("_o"))
    cut = nth_hash(order, "_o", round(df.count() * share))
    return order.select(*df.columns, (F.lit("train") if cut is None else F.when(F.col("_o") < cut, "train").otherwise("test")).alias("part"))


def proportional_sample(df: DataFrame, strata: list[str], keys: list[str], n: int, seed: int) -> DataFrame:
    """max(1, round(n * share)) rows of each stratum, by the order of a hash."""
    total = df.count()
    sizes = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("_s"))
    quota = sizes.select(*strata, F.greatest(F.lit(1), F.round(F.col("_s") * (n / max(total, 1))).cast("int")).alias("_q"))
    w = Window.partitionBy(*strata).orderBy("_o", *keys)
    ranked = df.select("*", md5_order(*[F.col(k) for k in keys], F.lit(seed)).alias("_o")).select("*", F.row_number().over(w).alias("_k"))
    return ranked.join(quota, strata).where(F.col("_k") <= F.col("_q")).select(*df.columns)


def consecutive(df: DataFrame, sequence: str, time: str, tie: str, lat: str, lng: str) -> DataFrame:
    """Seconds, metres and speed from the frame before in each sequence."""
    from lodemark.functions.geo import haversine_mean_m

    w = Window.partitionBy(sequence).orderBy(time, tie)
    before = {c: F.lag(c).over(w) for c in (time, lat, lng)}
    seconds = (F.col(time) - before[time]) / 1000
    metres = haversine_mean_m(before[lat], before[lng], F.col(lat), F.col(lng))
    return df.select("*", seconds.alias("dt_s"), metres.alias("step_m"))
