"""Estimators and their error frame against plain fits and places."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodemark.operators import estimators as es
from lodemark.operators import models

R = 6378137.0


def rows(n, seed):
    rng = np.random.default_rng(seed)
    f = pd.DataFrame({
        "label_id": np.arange(n), "label_type": rng.choice(["A", "B", "C"], n), "zoom": rng.integers(1, 4, n), "canvas_x": rng.integers(1, 720, n), "canvas_y": rng.integers(1, 480, n),
        "sv_image_y": -rng.integers(0, 2000, n), "heading": rng.uniform(0, 360, n), "pano_lat": 40 + rng.uniform(0, 1, n), "pano_lng": -75 + rng.uniform(0, 1, n),
    })
    f["truth_m"] = 18 + 0.006 * f.sv_image_y + 0.01 * f.canvas_y + 2 * f.zoom + (f.label_type == "B") + rng.normal(0, 1, n)
    f["heading_diff"] = (f.canvas_x - 360) * 0.1 / f.zoom + rng.normal(0, 1, n)
    f["lat"], f["lng"] = sphere(f.pano_lat, f.pano_lng, f.heading + f.heading_diff, f.truth_m)
    return f


def sphere(lat, lng, bearing, dist):
    p, b, g = np.radians(lat), np.radians(bearing), dist / R
    q = np.arcsin(np.sin(p) * np.cos(g) + np.cos(p) * np.sin(g) * np.cos(b))
    return np.degrees(q), lng + np.degrees(np.arctan2(np.sin(b) * np.sin(g) * np.cos(p), np.cos(g) - np.sin(p) * np.sin(q)))


def metres(a, b, c, d):
    h = np.sin(np.radians(c - a) / 2) ** 2 + np.cos(np.radians(a)) * np.cos(np.radians(c)) * np.sin(np.radians(d - b) / 2) ** 2
    return 2 * R * np.arctan2(np.sqrt(h), np.sqrt(1 - h))


def plain(train, test):
    """distance, turn and whether on the flat earth, by least squares on whole design matrices."""

    def fit(cols, y, at):
        design = lambda f: np.column_stack([np.ones(len(f)), *[(f.zoom == int(c[-1])) if c.startswith("zoom") else f[c] for c in cols]]).astype(float)
        return design(at) @ np.linalg.lstsq(design(train), train[y].to_numpy(float), rcond=None)[0]

    zero = np.zeros(len(test))
    by_type = train.groupby("label_type").truth_m.median()
    out = {"est1": (zero + 10, zero, True), "est2": (zero + train.truth_m.median(), zero, True), "est3": (test.label_type.map(by_type).to_numpy(float), zero, True)}
    out["est4"] = (fit(["canvas_y", "sv_image_y"], "truth_m", test), fit(["canvas_y", "sv_image_y"], "heading_diff", test), False)
    out["est5"] = (fit(["sv_image_y", "canvas_y", "zoom2", "zoom3"], "truth_m", test), fit(["canvas_x", "zoom2", "zoom3"], "heading_diff", test), False)
    d, h = zero.copy(), zero.copy()
    for z in (1, 2, 3):
        x = test.zoom == z
        own = train[train.zoom == z]
        for target, cols, y in ((d, ["sv_image_y", "canvas_y"], "truth_m"), (h, ["canvas_x"], "heading_diff")):
            b = np.linalg.lstsq(np.column_stack([np.ones(len(own)), own[cols]]).astype(float), own[y].to_numpy(float), rcond=None)[0]
            target[x] = np.column_stack([np.ones(x.sum()), test[x][cols]]).astype(float) @ b
    out["est7"] = (d, h, False)
    return {k: (np.where(np.isnan(v[0]), np.nan, np.maximum(v[0], 0)), *v[1:]) for k, v in out.items()}


def spark_frame(spark, f):
    return spark.createDataFrame(f.astype(object).where(f.notna(), None).values.tolist(), "label_id long, label_type string, zoom long, canvas_x long, canvas_y long, sv_image_y long, heading double, pano_lat double, pano_lng double, truth_m double, heading_diff double, lat double, lng double")


@pytest.mark.parametrize("geodesy", [es.SPHERE, es.ELLIPSOID])
def test_estimators_equal_plain_fits(spark, geodesy):
    train, test = rows(600, 1), rows(200, 2)
    test.loc[0, "label_type"] = "unseen"
    test.loc[1, "lat"] = np.nan
    found = es.fit_estimators(spark_frame(spark, train), geodesy=geodesy)
    assert list(found) == [f"est{k}" for k in range(1, 8)]
    got = es.error_frame(spark_frame(spark, test), found, ["label_id"]).toPandas().sort_values("label_id")
    for k, (dist, turn, flat) in plain(train, test).items():
        assert np.allclose(got[f"dist_pred_{k}"], dist, equal_nan=True) and np.allclose(got[f"dist_error_{k}"], np.abs(test.truth_m - dist), equal_nan=True)
        if flat:
            h = np.radians(test.heading)
            place = test.pano_lat + dist * np.cos(h) / 111111, test.pano_lng + dist * np.sin(h) / (111111 * np.cos(np.radians(test.pano_lat)))
        else:
            place = sphere(test.pano_lat, test.pano_lng, test.heading + turn, dist)
        # the ellipsoid is within half a percent of the sphere at these distances
        assert np.allclose(got[f"error_{k}"], metres(test.lat, test.lng, *place), atol=1e-5 if flat or geodesy == es.SPHERE else 0.2, equal_nan=True)
    assert np.isnan(got.dist_pred_est3.iloc[0]) and got[[f"error_est{k}" for k in range(1, 8)]].iloc[1].isna().all()


def test_metrics_count_what_scored(spark):
    df = spark.createDataFrame([(1.0, 2.0, None, 1.0), (3.0, None, None, 1.0), (None, 4.0, None, 1.0)], "error_a double, dist_error_a double, error_b double, dist_error_b double")
    got = es.frame_metrics(df, ["a", "b"]).collect()
    assert [r["model"] for r in got] == ["a", "b"] and (got[0]["n"], got[0]["place_median"], got[0]["dist_median"], got[0]["place_p90"]) == (2, 2.0, 3.0, 2.8)
    assert (got[1]["n"], got[1]["place_median"], got[1]["dist_median"]) == (0, None, 1.0)


def test_rungs_share_one_heading(spark):
    f = rows(400, 3)
    f["dep"] = np.degrees(np.arctan2(2.6, f.truth_m))
    df = spark_frame(spark, f.drop(columns="dep")).withColumn("dep", F.degrees(F.atan2(F.lit(2.6), F.col("truth_m"))))
    fits = {"C": models.fit_cotangent(df, "ols"), "anchor": models.Geometric("anchor", 2.6, {}, 0.0)}
    columns = {k: F.col(k) for k in ("dep", "zoom", "sv_image_y", "canvas_y", "label_type")}
    frame = es.error_frame(df, es.rung_predictors(fits, columns, F.col("heading_diff")), ["label_id"])
    r = frame.agg(*[F.max(c).alias(c) for c in frame.columns if c != "label_id"]).first()
    assert r["error_anchor"] < 1e-6 and r["dist_error_anchor"] < 1e-9 and r["error_C"] < 1e-6


def test_noise_takes_one_hash_a_click_and_draw(spark, monkeypatch):
    """The sigmas of a draw share its hash; one was made for each of them."""
    from lodemark.operators import sampling

    plans = []
    monkeypatch.setattr(sampling, "cell_quantiles", lambda df, *a, own=sampling.cell_quantiles: plans.append(df) or own(df, *a))
    rows = [(k, k % 3, float(20 + k * 13 % 600), float(10 + k * 7 % 400), float(k % 360), -10.0, 1 + k % 3, 5.0 + k % 20, -100.0) for k in range(60)]
    df = spark.createDataFrame(rows, "label_id long, pano_id long, canvas_x double, canvas_y double, heading double, pitch double, zoom long, truth_m double, sv_image_y double")
    got = sampling.noise_sweep(df, {"linear": lambda: F.greatest(F.lit(0.0), 30 - 0.05 * F.col("canvas_y"))}, "truth_m", ["label_id", "pano_id"]).collect()
    assert {r["sigma"] for r in got} == {2.0, 5.0, 10.0}
    own = plans[0].groupBy("sigma", "draw").count().collect()
    assert len(own) == 16 and {r["count"] for r in own} == {60}
    text = plans[0]._jdf.queryExecution().optimizedPlan().toString()
    at = text.index("md5(")
    assert "[0,1,2,3,4]" in text[at:] and "sigma" not in text[at:]


def test_metrics_by_parts_are_those_of_one_frame(spark, monkeypatch):
    """All rungs in one frame did not compile; a few at a time give the same rows in the same order."""
    from lodemark.operators import estimators as est

    rows = [(k, "c", 40.0 + k / 1e4, -75.0, float(k * 37 % 360), 40.0 + k / 1e4 + 1e-4, -75.0 + 1e-4, 5.0 + k % 20) for k in range(50)]
    df = spark.createDataFrame(rows, "label_id long, city string, pano_lat double, pano_lng double, heading double, lat double, lng double, truth_m double")
    made = {f"m{k}": est.Predictor(F.col("truth_m") + k, F.lit(0.0)) for k in (3, 1, 2, 5, 4)}
    frames = []
    monkeypatch.setattr(est, "error_frame", lambda test, some, keep, own=est.error_frame: frames.append(len(some)) or own(test, some, keep))
    want = est.frame_metrics(est.error_frame(df, made, ["label_id"]), list(made)).collect()
    assert est.metrics_by_parts(df, made, ["label_id"], at_once=2).collect() == want and frames == [5, 2, 2, 1]
