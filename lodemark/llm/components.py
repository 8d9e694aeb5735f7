"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is one grouped minimum and one join. A vertex of any degree is pre-aggregated before it shuffles,
and the links of a hub, which would meet in one task of the join, stay where they are: the minima of vertices
with a large share of the links are broadcast (see join_by_key). Lineage ends with a checkpoint after every
round. Nothing but two counters per round comes to the driver. The rounds go on until nothing changes, which
alternating steps reach after a number that grows with the square of the logarithm of the links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, join_by_key


def _star(edges: DataFrame, larger: bool, total: int) -> DataFrame:
    """Links the larger (else the smaller) neighbours of each vertex to its least neighbour. total: the links, about."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if larger:
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count(F.lit(1)).alias("size"))
    joined = join_by_key(both, least, "u", "size", total)
    if larger:
        return joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    return joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(vertex, component): the least vertex that each linked vertex reaches. Unlinked vertices are absent.

    Loops and repeated edges are harmless; edges with a null end are dropped.
    """
    tidy = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(F.col("a") != F.col("b")).distinct()
    now = checkpointed(tidy)
    sign = F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
    seen = now.agg(F.count(F.lit(1)), sign).first()
    if not seen[0]:
        return now.select(F.col("a").alias("vertex"), F.col("b").alias("component"))
    while True:
        large = checkpointed(_star(now, True, 2 * seen[0]).where(F.col("a") != F.col("b")).distinct())
        now = checkpointed(_star(large, False, seen[0]).where(F.col("a") != F.col("b")).distinct())
        found = now.agg(F.count(F.lit(1)), sign).first()
        if found == seen:
            break
        seen = found
    roots = now.select(F.col("b").alias("vertex"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("vertex"), F.col("b").alias("component")).unionByName(roots)
