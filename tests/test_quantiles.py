"""Exact quantiles and weighted medians against NumPy, at limits that make every path run."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodemark.operators import quantiles as qs


def frame(spark, n=6000, seed=1):
    rng = np.random.default_rng(seed)
    group = np.where(rng.random(n) < 0.6, "hot", rng.choice(["a", "b", "c"], n))
    value = np.where(rng.random(n) < 0.3, 2.5, rng.standard_cauchy(n))
    rows = [(g if g != "c" else None, float(v) if k % 11 else None, float(w)) for k, (g, v, w) in enumerate(zip(group, value, rng.random(n) + 0.01, strict=True))]
    return rows, spark.createDataFrame([*rows, ("empty", None, 1.0)], "g string, v double, w double").repartition(7)


@pytest.mark.parametrize(("whole", "accuracy", "few"), [(200_000, 50_000, 10_000), (100_000, 50_000, 10_000), (50, 400, 10_000), (50, 400, 1)])
def test_quantiles_are_exact(spark, monkeypatch, whole, accuracy, few):
    monkeypatch.setattr(qs, "WHOLE", whole)
    if whole <= 100_000:
        monkeypatch.setattr(qs, "DIRECT", 0)
    monkeypatch.setattr(qs, "ACCURACY", accuracy)
    monkeypatch.setattr(qs, "FEW", few)
    rows, df = frame(spark)
    shares = [0.0, 0.1, 0.5, 0.9, 1.0]
    wanted = {f"q{k}": (F.col("v"), q) for k, q in enumerate(shares)} | {"size": (F.abs("v"), 0.5)}
    got = {r["g"]: r for r in qs.quantiles(df, ["g"], wanted, [F.sum("w").alias("weight")], None).collect()}
    want = pd.DataFrame(rows, columns=["g", "v", "w"])
    assert set(got) == {"hot", "a", "b", None, "empty"} and got["empty"]["q2"] is None
    for g, own in want.groupby("g", dropna=False):
        r, v = got[None if pd.isna(g) else g], own.v.dropna().to_numpy()
        assert np.allclose([r[f"q{k}"] for k in range(5)], np.quantile(v, shares)) and np.isclose(r["size"], np.median(np.abs(v))) and np.isclose(r["weight"], own.w.sum())
    assert np.isclose(qs.quantile(df, F.col("v"), 0.25), np.quantile(want.v.dropna(), 0.25))
    many = [k / 40 for k in range(41)]
    assert np.allclose(qs.quantile(df, F.col("v"), many), np.quantile(want.v.dropna(), many))


@pytest.mark.parametrize(("whole", "cells"), [(200_000, 4096), (100_000, 4096), (20, 8)])
def test_weighted_medians_are_exact(spark, monkeypatch, whole, cells):
    monkeypatch.setattr(qs, "WHOLE", whole)
    if whole <= 100_000:
        monkeypatch.setattr(qs, "DIRECT", 0)
    monkeypatch.setattr(qs, "CELLS", cells)
    rows, df = frame(spark, seed=2)
    got = {r["g"]: r["median"] for r in qs.weighted_median(df, ["g"], F.col("v"), F.col("w")).collect()}
    for g, own in pd.DataFrame(rows, columns=["g", "v", "w"]).dropna(subset=["v"]).groupby("g", dropna=False):
        own = own.sort_values("v")
        assert got[None if pd.isna(g) else g] == own.v.to_numpy()[np.searchsorted(own.w.cumsum().to_numpy(), 0.5 * own.w.sum())]
    assert len(got) == 4


@pytest.mark.parametrize("whole", [200_000, 100_000, 50])
def test_infinite_and_missing_values(spark, monkeypatch, whole):
    """Infinite values have their ranks, NaN has none, and the search ends."""
    monkeypatch.setattr(qs, "WHOLE", whole)
    if whole <= 100_000:
        monkeypatch.setattr(qs, "DIRECT", 0)
    monkeypatch.setattr(qs, "ACCURACY", 400 if whole == 50 else 50_000)
    inf, nan = float("inf"), float("nan")
    rng = np.random.default_rng(4)
    base = [float(v) for v in rng.normal(size=1000)]
    groups = {"up": [*base, inf], "down": [*base, -inf, -inf], "nan": [*base, nan], "top": [inf] * 700 + base[:300], "both": [inf] * 400 + [-inf] * 300 + base[:300], "wide": [1.7e308, -1.7e308, *base], "all": [inf] * 200, "none": [nan] * 90}
    df = spark.createDataFrame([(g, v, 1.0) for g, vs in groups.items() for v in vs] + [("up", 5.0, nan)], "g string, v double, w double").repartition(3)
    got = {r["g"]: r["median"] for r in qs.weighted_median(df, ["g"], F.col("v"), F.col("w")).collect()}
    for g, vs in groups.items():
        known = sorted(v for v in vs if v == v)
        assert (got[g] == known[(len(known) - 1) // 2]) if known else g not in got, g
    even = {r["g"]: r["m"] for r in qs.quantiles(df, ["g"], {"m": (F.col("v"), 0.5)}, digits=None).collect()}
    assert even["none"] is None and np.isclose(even["nan"], np.median(base)) and even["top"] == inf


def test_no_rows_give_no_groups(spark):
    none = spark.createDataFrame([], "g string, v double, w double")
    assert qs.weighted_median(none, ["g"], F.col("v"), F.col("w")).count() == 0
    assert qs.quantiles(none, ["g"], {"m": (F.col("v"), 0.5)}).count() == 0 and qs.quantile(none, F.col("v"), 0.5) is None and qs.quantile(none, F.col("v"), [0.5, 1.0]) == [None, None]
