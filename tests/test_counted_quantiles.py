"""Quantiles of few large groups: ranges by counted cells, and by summaries where a cell holds too many values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodemark.operators import quantiles as qs


@pytest.fixture
def small(monkeypatch):
    for name, limit in {"DIRECT": 0, "WHOLE": 50, "ACCURACY": 400}.items():
        monkeypatch.setattr(qs, name, limit)


def test_few_groups_need_no_summaries(spark, small, monkeypatch):
    rng = np.random.default_rng(5)
    values = {"wide": rng.normal(0, 1e6, 801), "ties": np.repeat([0.5, 1.5, 0.0], [300, 201, 100]), None: rng.standard_cauchy(700), "ends": np.array([-math.inf, -0.0, 2.0, math.inf])}
    rows = [(g, float(x), 1) for g, xs in values.items() for x in xs] + [("wide", None, 1), ("wide", math.nan, 1), ("none", None, 1)]
    df = spark.createDataFrame(rows, "g string, x double, n int").repartition(5)
    summaries = []
    monkeypatch.setattr(qs.F, "percentile_approx", lambda *a, real=F.percentile_approx: summaries.append(a) or real(*a))
    wanted = {"m": (F.col("x"), 0.5), "p": (F.col("x"), 0.9), "size": (F.abs("x"), 0.3)}
    got = {r["g"]: r for r in qs.quantiles(df, ["g"], wanted, [F.sum("n").alias("rows")], None).collect()}
    for g in ("wide", "ties", None):
        own = values[g]
        assert [got[g]["m"], got[g]["p"], got[g]["size"]] == [pytest.approx(np.quantile(v, q), rel=1e-12) for v, q in ((own, 0.5), (own, 0.9), (np.abs(own), 0.3))]
    assert (got["ends"]["m"], got["ends"]["p"], got["none"]["m"], got["wide"]["rows"], got["wide"]["n"], got["none"]["n"]) == (1.0, math.inf, None, 803, 803, 1)
    assert len(got) == 5 and not summaries


def test_values_of_one_cell_are_told_apart_by_summaries(spark, small):
    values = 1 + np.random.default_rng(6).permutation(3000) * 1e-9
    df = spark.createDataFrame([(float(v),) for v in values], "x double").repartition(3)
    wide = df.select(F.col("x").alias("_v0"), F.lit(0).alias("_all"))
    assert qs._counted_edges(wide, ["_all"], 1, [("m", 0, 0.5)]) is None
    assert qs.quantiles(df, [], {"m": (F.col("x"), 0.5)}, digits=None).first()["m"] == pytest.approx(np.median(values), rel=1e-13)
