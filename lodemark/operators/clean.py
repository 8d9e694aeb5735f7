"""Cleaning: filters with their missing-value rules, gates that flag instead of drop, and the funnel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodemark.functions.geo import haversine_m

MAX_PER_PANO = 20
MAX_DISTANCE_M = 50.0


def before_or_null(time: Column, cutoff: str) -> Column:
    """a row without a time is kept."""
    return time.isNull() | (time < F.lit(cutoff).cast("timestamp_ntz"))


def not_set(flag: str) -> Column:
    """A missing flag is not set."""
    return ~F.coalesce(F.col(flag), F.lit(False))


def valid_place() -> Column:
    """Coordinates on the globe and a click on the canvas; NaN is on no globe."""
    return F.col("lat").between(-90, 90) & F.col("lng").between(-180, 180) & (F.col("canvas_x") > 0) & (F.col("canvas_y") > 0)


def valid() -> Column:
    """F02."""
    return valid_place() & (F.col("computation_method") == "depth") & not_set("tutorial") & not_set("deleted")


def small_groups(df: DataFrame, key: str, most: int = MAX_PER_PANO, inclusive: bool = False) -> DataFrame:
    """rows of groups with fewer than `most` rows (or at most, if inclusive).

    The group sizes are pre-aggregated and joined back, so that a hot group never gathers in one task.
    """
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    keep = sizes.where(F.col("_n") <= most if inclusive else F.col("_n") < most).select(key)
    return df.join(keep, key, "left_semi")


def clean_clicks(df: DataFrame, cutoff: str) -> DataFrame:
    """F01, F02, F03 (counted after the validity filters) and F04 in this order; adds pano_dist."""
    kept = small_groups(df.where(before_or_null(F.col("time_created"), cutoff)).where(valid()), "pano_id")
    distance = haversine_m(*(F.col(c) for c in ("pano_lat", "pano_lng", "lat", "lng")))
    return kept.select("*", distance.alias("pano_dist")).where(F.col("pano_dist") < MAX_DISTANCE_M)


def gated(df: DataFrame, gates: dict[str, Column], name: str = "gate_ok") -> DataFrame:
    """every row with a flag per gate, and their conjunction."""
    every = F.lit(True)
    for g in gates.values():
        every = every & g
    return df.select("*", *[g.alias(k) for k, g in gates.items()], every.alias(name))


def funnel(df: DataFrame, gates: list[tuple[str, Column]]) -> DataFrame:
    """Rows left after each gate in turn, all in one pass: (gate, step, n)."""
    passed, counts = F.lit(True), [F.count(F.lit(1)).alias("g0")]
    for k, (_, gate) in enumerate(gates, 1):
        passed = passed & F.coalesce(gate, F.lit(False))
        counts.append(F.count_if(passed).alias(f"g{k}"))
    rows = [F.struct(F.lit(name).alias("gate"), F.lit(k).alias("step"), F.col(f"g{k}").alias("n")) for k, name in enumerate(["raw", *[n for n, _ in gates]])]
    return df.agg(*counts).select(F.inline(F.array(*rows)))


def last_rule_wins(rules: list[tuple[Column, str]]) -> Column:
    """Of the rules that hold the last one decides."""
    out = None
    for test, value in reversed(rules):
        out = F.when(test, value) if out is None else out.when(test, value)
    return out


def dense_keys(df: DataFrame, key: str, order: str) -> DataFrame:
    """First row of each key in the given order."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_k = 1").drop("_k")
