"""Passes that the ladder makes over its rows: bins by search, rounds over blocks."""

import math

import numpy as np
from pyspark.sql import functions as F

from lodemark.functions.numeric import closed_bin
from lodemark.operators import aggregate, models


def test_many_bins_are_searched_and_not_branches(spark):
    """As branches, 200 bins were longer than the JVM compiles."""
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(float(round(v, 2)),) for v in rng.normal(size=700)] + [(None,)], "x double").repartition(3)
    binned, edges = aggregate.quantile_bins(df, "x", 60)
    assert len(edges) > aggregate.MOST_BRANCHES and "CASE WHEN" not in binned._jdf.queryExecution().optimizedPlan().toString()
    both = binned.select("x", "bin", closed_bin(F.col("x"), edges, include_lowest=True).alias("want")).collect()
    assert len(both) == 701 and all(r["bin"] == r["want"] for r in both) and {r["bin"] for r in both if r["x"] is None} == {None}


def test_a_round_of_quantile_regression_by_numpy(spark):
    rng = np.random.default_rng(5)
    rows = [(float(a), float(b), float(y), z) for a, b, y, z in zip(rng.normal(size=300), rng.normal(size=300), rng.normal(size=300), rng.integers(1, 4, 300).tolist(), strict=True)]
    df = spark.createDataFrame(rows, "x0 double, x1 double, y double, g long").repartition(3)
    coef = np.array([[0.1, 0.2, 0.3], [0.0, -1.0, 1.0], [0.5, 0.5, 0.5]])
    got = models._weighted_moments(models._design_blocks(df, 3, [1, 2, 3]), coef, 0.25)
    data = np.array(rows)
    for g, (n, m) in enumerate(got, 1):
        own = data[data[:, 3] == g]
        z = np.column_stack([np.ones(len(own)), own[:, :3]])
        r = z[:, 3] - z[:, :3] @ coef[g - 1]
        assert n == len(own) and np.allclose(m, (z * (np.where(r >= 0, 0.25, 0.75) / np.abs(r))[:, None]).T @ z)


def test_groups_of_any_kind_keep_their_lines(spark):
    df = spark.createDataFrame([(float(x), 2.0 * x + (1 if g == "a" else 5), g) for x in range(40) for g in ("a", "b")] + [(None, 1.0, "a"), (math.nan, 1.0, "b")], "x double, y double, g string")
    fits = models.quantile_regression(df, {"x": F.col("x")}, F.col("y"), by=F.col("g"))
    assert {g: [round(c, 6) for c in f.coef] for g, f in fits.items()} == {"a": [1.0, 2.0], "b": [5.0, 2.0]} and {f.n for f in fits.values()} == {40}
