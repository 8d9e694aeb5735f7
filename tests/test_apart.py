"""Long expressions in operators of their own, quantiles by counted cells, and medians that are read once."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodemark.operators import estimators, models
from lodemark.operators.models import Geometric
from lodemark.operators.quantiles import apart, cell_quantiles, quantiles

MARKS = ("1111.5", "2222.5", "3333.5")


def _shared(df) -> list[str]:
    """Projections of the plan that hold more than one mark."""
    lines = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    return [line for line in lines if "Project" in line and sum(m in line for m in MARKS) > 1]


def test_expressions_stay_apart_and_keep_missing_values(spark):
    rows = spark.createDataFrame([(1.0, 2), (None, 3)], "`a.b` double, c int")
    out = apart(rows, {f"v{m[0]}": F.col("`a.b`") * float(m) for m in MARKS})
    assert not _shared(out.where("v1 > 0 OR v2 IS NULL"))
    got = {r["c"]: r for r in out.collect()}
    assert out.columns == ["a.b", "c", "v1", "v2", "v3"] and got[2]["v3"] == 3333.5 and got[3]["v1"] is None and got[3]["c"] == 3


def test_quantiles_of_several_expressions_stay_apart(spark, monkeypatch):
    from lodemark.operators import quantiles as own

    monkeypatch.setattr(own, "DIRECT", 10)
    rows = spark.range(1000).select(F.col("id").cast("double").alias("x"))
    out = quantiles(rows, [], {f"v{m[0]}": (F.col("x") * float(m), 0.5) for m in MARKS}, digits=None)
    assert not _shared(out)
    assert [out.first()[f"v{m[0]}"] for m in MARKS] == [499.5 * float(m) for m in MARKS]


def test_predictors_of_an_error_frame_stay_apart(spark):
    rows = spark.createDataFrame([(40.0, -75.0, 10.0, 40.0001, -75.0, 5.0, 3.0)], "pano_lat double, pano_lng double, heading double, lat double, lng double, truth_m double, x double")
    frame = estimators.error_frame(rows, {f"e{m[0]}": estimators.Predictor(F.col("x") * float(m), F.lit(0.0)) for m in MARKS}, ["x"])
    assert not _shared(frame) and frame.first()["dist_error_e1"] == pytest.approx(3 * 1111.5 - 5)


def test_cell_quantiles_are_exact(spark):
    rng = np.random.default_rng(7)
    values = {"wide": rng.normal(0, 1e6, 501), "ties": np.repeat([0.5, 1.5], [300, 201]), "ends": np.array([-math.inf, 1.0, 2.0, math.inf])}
    rows = [(g, float(x)) for g, xs in values.items() for x in xs] + [("wide", None), ("wide", math.nan), ("none", None)]
    got = {r["g"]: r for r in cell_quantiles(spark.createDataFrame(rows, "g string, x double").repartition(5), ["g"], "x", {"m": 0.5, "p": 0.9}).collect()}
    for g in ("wide", "ties"):
        assert [got[g]["m"], got[g]["p"]] == [pytest.approx(np.quantile(values[g], q), rel=1e-12) for q in (0.5, 0.9)]
    assert got["ends"]["m"] == 1.5 and got["none"]["m"] is None and len(got) == 4


def test_known_medians_choose_without_reading(spark):
    fits = {"D_a": Geometric("floor", 2.0, {}, 3.0), "D_b": Geometric("floor", 2.6, {}, 3.0)}
    rows = spark.createDataFrame([(10.0, 2.6 / math.tan(math.radians(10)), "x")], "dep double, truth_m double, label_type string")
    found = models.median_errors(rows, fits)
    assert found["D_b"] == pytest.approx(0, abs=1e-9) and models.candidate(None, fits, medians=found) == models.candidate(rows, fits) == "D_b"
