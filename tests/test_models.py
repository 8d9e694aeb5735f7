"""Parameter recovery, invariants and guards of the models on generated clicks."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodemark.operators import aggregate, joins, models, quantiles
from lodemark.operators.models import Geometric

HEIGHTS = {"a": 2.0, "b": 2.5, "c": 3.0}


@pytest.fixture(scope="module")
def clicks(spark):
    rng = np.random.default_rng(0)
    kind = rng.choice(list(HEIGHTS), 900)
    dep = rng.uniform(4, 35, 900)
    truth = np.array([HEIGHTS[k] for k in kind]) / np.tan(np.radians(dep))
    return spark.createDataFrame(pd.DataFrame({"label_type": kind, "dep": dep, "truth_m": truth})).cache()


@pytest.mark.parametrize("loss", ["ols", "l1"])
def test_heights_are_recovered(clicks, loss):
    found = models.fit_cotangent(clicks, loss, "label_type").height_by_type
    assert {k: round(v, 6) for k, v in found.items()} == HEIGHTS


def test_floor_and_blend_keep_the_heights(clicks):
    for fit in (models.fit_floor, models.fit_blend):
        found = fit(clicks, "ols", "label_type")
        assert {k: round(v, 4) for k, v in found.height_by_type.items()} == HEIGHTS


def test_slope_is_the_lower_weighted_median_of_the_ratios(spark):
    # g, x, y. Group 1: ratios 1, 2, 4 with weights 3, 1, 2, so half of the weight is reached at 1. Group 2: equal
    # ratios add up (2 + 2 of 7) and -3 comes before them. Group 3: x = 0 has no ratio. Group 4 has none at all.
    rows = [(1, 3.0, 3.0), (1, -1.0, -2.0), (1, 2.0, 8.0), (2, 2.0, 3.0), (2, 2.0, 3.0), (2, 3.0, -9.0), (3, 0.0, 5.0), (3, 1.0, 7.0), (4, 0.0, 1.0)]
    frame = spark.createDataFrame(rows, "g long, x double, y double")
    assert {tuple(r) for r in quantiles.lad_slope(frame, ["g"], F.col("x"), F.col("y")).collect()} == {(1, 1.0), (2, 1.5), (3, 7.0)}


def test_bootstrap_draws_every_resample(spark, monkeypatch):
    rng = np.random.default_rng(9)
    data = pd.DataFrame({"g": np.where(np.arange(9000) % 3 == 0, "a", "b"), "v": rng.exponential(2, 9000).round(3), "k": np.arange(9000)})
    frame = spark.createDataFrame(data).repartition(5)
    got = {r["g"]: (r["low"], r["middle"], r["high"]) for r in aggregate.bootstrap_median(frame, ["g"], "v", "k", 300).collect()}
    keys = {r["k"]: r["h"] for r in frame.selectExpr("k", "xxhash64(k) AS h").collect()}
    for g, own in data.groupby("g"):
        own = own.sort_values("v")
        weights = aggregate.poisson_weights(np.array([keys[k] for k in own.k]), np.arange(300))
        upto = np.cumsum(weights, axis=0)
        medians = own.v.to_numpy()[(2 * upto >= upto[-1]).argmax(axis=0)]
        assert np.allclose(got[g], np.quantile(medians, (0.025, 0.5, 0.975)).round(6))
    assert abs(weights.mean() - 1) < 0.01 and abs(weights.var() - 1) < 0.02


def test_predictions_are_bounded_monotone_and_fall_back(spark):
    forms = [
        Geometric("cotangent", 2.6, {"a": 2.0}), Geometric("floor", 2.6, {"a": 2.0}, 3.0), Geometric("blend", 2.6, {"a": 2.0}, 5.0),
        Geometric("softcap", c0=0.03, c1=0.4, c1_by_type={"a": 0.5}), Geometric("isotonic", knots=((1.0, 30.0), (5.0, 20.0), (30.0, 4.0))),
    ]
    sweep = spark.range(721).select((F.col("id") / 4 - 90).alias("dep"))
    for m in forms:
        for kind in ("a", "unseen"):
            got = np.array([r[0] for r in sweep.select(models.predict(m, F.col("dep"), F.lit(kind)).alias("p"), "dep").orderBy("dep").select("p").collect()])
            assert (got >= 0).all() and (got <= 50).all()
            assert (np.diff(got) <= 1e-9).all()
    unseen, plain = (spark.range(1).select(models.predict(forms[0], F.lit(20.0), k)).first()[0] for k in (F.lit("unseen"), None))
    assert unseen == plain
    assert spark.range(1).select(models.predict(forms[0], F.lit(None).cast("double"))).first()[0] is None
    with pytest.raises(ValueError):
        models.predict(Geometric("nothing"), F.lit(1.0))


def test_blend_is_smooth_at_its_angle(spark):
    m = Geometric("blend", 2.6, {}, 11.25)
    a, b, c = spark.range(1).select(*[models.predict(m, F.lit(11.25 + e)) for e in (-1e-5, 0.0, 1e-5)]).first()
    assert abs((b - a) - (c - b)) < 1e-7


def test_quantile_regression_beats_least_squares_on_absolute_loss(spark):
    rng = np.random.default_rng(1)
    x = rng.uniform(0, 10, 400)
    y = 1 + 2 * x + rng.standard_t(1.5, 400)
    frame = spark.createDataFrame(pd.DataFrame({"x": x, "y": y}))
    l1 = models.quantile_regression(frame, {"x": F.col("x")}, F.col("y")).coef
    l2 = models.least_squares(frame, {"x": F.col("x")}, {"y": F.col("y")})["y"].coef
    loss = [np.abs(y - c[0] - c[1] * x).sum() for c in (l1, l2)]
    assert loss[0] < loss[1]
    assert np.allclose(l2, np.linalg.lstsq(np.column_stack([np.ones(400), x]), y, rcond=None)[0])


def test_within_slope_without_variation_is_null(spark):
    frame = spark.createDataFrame([(1, 2.0, 1.0), (1, 2.0, 3.0), (2, 5.0, 2.0), (2, 5.0, 9.0)], "g long, x double, y double")
    row = aggregate.within_slope(frame, "g", F.col("x"), F.col("y")).first()
    assert row["slope"] is None and row["se"] is None


def test_mode_ties_take_the_smallest_and_count_nulls(spark):
    frame = spark.createDataFrame([(1, 3), (1, 2), (2, None), (2, None), (2, 7)], "g long, v long")
    assert {(r["g"], r["v"], r["n"]) for r in aggregate.mode_per_group(frame, ["g"], "v").collect()} == {(1, 2, 1), (2, None, 2)}


def test_join_guards(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y")], "k long, v string")
    with pytest.raises(joins.CardinalityError):
        joins.require_unique(a, ["k"])
    with pytest.raises(joins.CardinalityError):
        joins.join_on_keys(a, spark.createDataFrame([(1,), (9,)], "k long").union(spark.createDataFrame([(8,)], "k long")), ["k"])


# ---- fits against plain versions


def noisy(spark, n=240, seed=5, partitions=3):
    rng = np.random.default_rng(seed)
    dep = np.concatenate([rng.uniform(-2, 35, n - 20), np.repeat(rng.uniform(3, 20, 4), 5)])  # repeated depressions
    kind = rng.choice(["a", "b"], n)
    truth = np.clip(np.where(kind == "a", 2.2, 2.9) / np.tan(np.radians(np.maximum(dep, 2.5))) + rng.normal(0, 0.8, n), 0.5, 60)
    data = pd.DataFrame({"dep": dep, "truth_m": truth, "label_type": kind, "zoom": rng.integers(1, 4, n), "sv_image_y": rng.integers(-900, 0, n), "canvas_y": rng.integers(0, 480, n)})
    return data, spark.createDataFrame(data).repartition(partitions)


def plain_lad(x, y):
    x, y = x[x != 0], y[x != 0]
    order = np.argsort(y / x, kind="stable")
    w = np.abs(x)[order]
    return (y / x)[order][np.searchsorted(np.cumsum(w), 0.5 * w.sum())]


def plain_predict(form, h, a, dep):
    if form == "floor":
        out = h / np.tan(np.radians(np.maximum(dep, a)))
    else:
        r = np.radians(a)
        line = h / np.tan(r) - h * np.radians(1) / np.sin(r) ** 2 * (np.maximum(dep, 0) - a)
        out = np.where(dep >= a, h / np.tan(np.radians(np.maximum(dep, 1e-9))), line)
    return np.clip(out, 0, 50)


@pytest.mark.parametrize(("form", "loss"), [("floor", "ols"), ("blend", "ols"), ("floor", "l1")])
def test_profiles_by_brute_force(spark, form, loss):
    data, frame = noisy(spark, 120, partitions=1)
    dep, y = data.dep.to_numpy(), 1 / np.maximum(data.truth_m.to_numpy(), 1)
    best = {}
    for typed in (None, "label_type"):
        scores = []
        for a in models.FLOOR_GRID if form == "floor" else models.BLEND_GRID:
            x = np.tan(np.radians(np.maximum(dep, a if form == "floor" else 0)))
            use = np.full(len(dep), True) if form == "floor" else dep >= a
            fit = (lambda m: (x[m] @ y[m]) / (x[m] @ x[m])) if loss == "ols" else (lambda m: plain_lad(x[m], y[m]))  # noqa: B023
            pooled = 1 / fit(use)
            heights = np.array([1 / fit(use & (data.label_type == k).to_numpy()) for k in data.label_type]) if typed else pooled
            e = plain_predict(form, heights, a, dep) - data.truth_m.to_numpy()
            scores.append(((e * e).mean() if loss == "ols" else np.abs(e).mean(), a, pooled))
        best[typed] = min(scores)
    found = models._profile(frame, form, models.FLOOR_GRID if form == "floor" else models.BLEND_GRID, loss, "label_type", "dep", "truth_m")
    for got, (_, a, pooled) in zip(found, best.values(), strict=True):
        assert got.angle_deg == a and math.isclose(got.height_m, pooled, rel_tol=1e-9)


def plain_isotonic(y, w):
    """Pool adjacent violators, decreasing."""
    blocks = []
    for v, k in zip(y, w, strict=True):
        blocks.append([v, k, 1])
        while len(blocks) > 1 and blocks[-2][0] < blocks[-1][0]:
            (a, m, i), (b, n, j) = blocks[-2:]
            blocks[-2:] = [[(a * m + b * n) / (m + n), m + n, i + j]]
    return np.concatenate([[b[0]] * b[2] for b in blocks])


def test_isotonic_by_brute_force(spark):
    data, frame = noisy(spark)
    near = np.geomspace(0.001, 0.5, 11)
    shares = np.unique(np.concatenate([[0.0, 1.0], near, 1 - near]))
    points = data.groupby("dep").truth_m.agg(["mean", "size"]).reset_index()
    fitted = plain_isotonic(points["mean"], points["size"])
    at = np.unique(np.quantile(data.dep, shares))  # of all rows, repeated depressions count
    got = np.array(models.fit_isotonic(frame).knots)
    assert np.allclose(got[:, 0], at) and np.allclose(got[:, 1], np.minimum.accumulate(np.interp(at, points.dep, fitted)))
    bins = pd.qcut(data.dep, 200, duplicates="drop")
    binned = data.groupby(bins, observed=True).agg(x=("dep", "median"), y=("truth_m", "median"), w=("dep", "size"))
    fitted = plain_isotonic(binned.y, binned.w)
    at = np.unique(np.quantile(binned.x, shares))
    got = np.array(models.fit_isotonic(frame, "l1").knots)
    assert np.allclose(got[:, 0], at) and np.allclose(got[:, 1], np.minimum.accumulate(np.interp(at, binned.x, fitted)))


def test_medians_of_planes_reach_the_least_loss(spark):
    """Quantile regression against every line through as many points as it has terms, per group."""
    rng = np.random.default_rng(11)
    x, g = rng.uniform(0, 4, 60), rng.integers(1, 3, 60)
    y = 1 + g * x + rng.standard_t(2, 60)
    frame = spark.createDataFrame(pd.DataFrame({"x": x, "y": y, "g": g}))
    for q in (0.8,):
        fits = models.quantile_regression(frame.coalesce(1), {"x": F.col("x")}, F.col("y"), q, by=F.col("g"))

        def loss(a, b, own, q=q):
            r = y[own] - a - b * x[own]
            return np.maximum(q * r, (q - 1) * r).sum()

        for k in (1, 2):
            own = np.flatnonzero(g == k)
            least = min(loss(y[i] - (y[j] - y[i]) / (x[j] - x[i]) * x[i], (y[j] - y[i]) / (x[j] - x[i]), own) for i in own for j in own if i < j)
            assert loss(*fits[k].coef, own) <= least * (1 + 1e-3)


def test_softcap_is_bounded_least_squares(spark):
    data, frame = noisy(spark)
    t, y = np.tan(np.radians(np.maximum(data.dep, 0))), 1 / np.maximum(data.truth_m, 1)
    got = models.fit_softcap(frame, "ols")
    grid = [(c0, max((t @ (y - c0)) / (t @ t), 0)) for c0 in np.linspace(0.02, 0.2, 2000)]
    c0, c1 = min(grid, key=lambda c: ((y - c[0] - c[1] * t) ** 2).sum())
    assert abs(got.c0 - c0) < 2e-4 and abs(got.c1 - c1) < 2e-3 and got.c0 >= 0.02
    typed = models.fit_softcap(frame, "ols", "label_type")
    assert typed.c0 >= 0.02 and typed.c1_by_type["a"] > typed.c1_by_type["b"] > 0


def test_mixed_model_is_the_best_restricted_likelihood(spark):
    rng = np.random.default_rng(2)
    g = np.arange(48) % 6
    x = rng.normal(0, 1, 48)
    y = 3 + 2 * x + rng.normal(0, 1.5, 6)[g] + rng.normal(0, 1, 48)
    fixed, random, ratio = models.mixed_model(spark.createDataFrame(pd.DataFrame({"g": g, "x": x, "y": y})), {"x": F.col("x")}, F.col("y"), F.col("g"))
    design, same = np.column_stack([np.ones(48), x]), (g[:, None] == g).astype(float)

    def restricted(r):
        inverse = np.linalg.inv(np.eye(48) + r * same)
        gram = design.T @ inverse @ design
        coef = np.linalg.solve(gram, design.T @ inverse @ y)
        left = y - design @ coef
        return -0.5 * (46 * np.log(left @ inverse @ left) + np.linalg.slogdet(np.eye(48) + r * same)[1] + np.linalg.slogdet(gram)[1]), coef, inverse @ left

    value, coef, weighted = restricted(ratio)
    assert np.allclose(fixed.coef, coef) and value >= max(restricted(ratio * f)[0] for f in (0.7, 0.95, 1.05, 1.4))
    assert all(math.isclose(random[k], ratio * weighted[g == k].sum(), rel_tol=1e-6) for k in range(6))


def plain_scales(data, rounds=200):
    seen = data.groupby("site_id").sequence_id.nunique()
    sub = data[data.site_id.isin(seen[seen >= 2].index)]
    k = pd.Series(1.0, index=sorted(sub.sequence_id.unique()))
    for _ in range(rounds):
        own = sub.assign(k=sub.sequence_id.map(k))
        own["px"], own["py"] = own.e0 + own.k * own.d0 * own.ux, own.n0 + own.k * own.d0 * own.uy
        centre = own.groupby("site_id")[["px", "py"]].transform("mean")
        own["above"] = own.d0 * ((centre.px - own.e0) * own.ux + (centre.py - own.n0) * own.uy)
        own["below"] = own.d0**2
        sums = own.groupby("sequence_id")[["above", "below"]].sum()
        fresh = sums.above / sums.below
        moved, k = (fresh - k).abs().max(), fresh
        if moved < 1e-10:
            break
    whole = pd.Series(1.0, index=sorted(data.sequence_id.unique()))
    whole.update(k)
    n = data.groupby("sequence_id").size()
    return whole / np.exp((np.log(whole) * n).sum() / n.sum())


@pytest.mark.parametrize("most", [1_000_000, 1])
def test_sequence_scales_converge_to_the_plain_rounds(spark, monkeypatch, most):
    monkeypatch.setattr(models, "MOST_PAIRS", most)
    rng = np.random.default_rng(7)
    sites, true = rng.uniform(0, 40, (30, 2)), {f"s{k}": v for k, v in enumerate([0.8, 1.0, 1.3, 1.1])}
    rows = []
    for k in range(160):
        s, site = f"s{rng.integers(4)}", int(rng.integers(30))
        camera = sites[site] + rng.uniform(-12, 12, 2)
        ray = sites[site] - camera
        rows.append((s, site, *camera, *(ray / np.hypot(*ray)), np.hypot(*ray) / true[s]))
    rows.append(("alone", 99, 0.0, 0.0, 1.0, 0.0, 5.0))
    data = pd.DataFrame(rows, columns=["sequence_id", "site_id", "e0", "n0", "ux", "uy", "d0"])
    rounds = 200 if most > 1 else 3  # the distributed rounds are the same ones
    got = {r["sequence_id"]: r["k_rel"] for r in models.sequence_scales(spark.createDataFrame(data), rounds).collect()}
    want = plain_scales(data, rounds)
    assert all(math.isclose(got[s], v, rel_tol=1e-7) for s, v in want.items()) and len(got) == 5
    if most > 1:
        assert abs(got["s2"] / got["s0"] - 1.3 / 0.8) < 0.02


def test_ladder_has_all_rungs_and_a_choice(spark):
    _, frame = noisy(spark, 120, partitions=1)
    fits = models.ladder(frame, losses=("ols",))
    forms = [f"{k}{t}" for k in ("C", "D_floor", "D_blend", "D_soft") for t in ("", "_type")]
    assert set(fits) == {f"{k}_{loss}" for k in ("A", *forms, "E") for loss in ("ols",)} | {"anchor", "anchor_served"}
    columns = {c: F.col(c) for c in ("dep", "label_type", "zoom", "sv_image_y", "canvas_y")} | {"height_m": F.lit(2.4)}
    out = frame.select("truth_m", *[models.predict_any(m, columns).alias(k) for k, m in fits.items()]).toPandas()
    assert out.notna().all().all() and (out >= 0).all().all() and (out.drop(columns="truth_m") <= 50).all().all()
    medians = {k: (out[k] - out.truth_m).abs().median() for k in fits if k.startswith("D_")}
    assert math.isclose(medians[models.candidate(frame, fits)], min(medians.values()))


def test_height_terms(spark):
    rng = np.random.default_rng(6)
    n = 400
    data = pd.DataFrame({"city": rng.choice(["x", "y", "z"], n), "zoom": rng.integers(1, 3, n), "pano_height": rng.choice([6656, 8192, 1664], n), "sv_image_y": rng.integers(-900, 0, n), "canvas_y": rng.integers(0, 480, n)})
    data["truth_m"] = 20 + 0.01 * data.sv_image_y + data.city.map({"x": 0, "y": 1, "z": 3}) + rng.normal(0, 0.1, n)
    frame = spark.createDataFrame(data).repartition(2)
    rows = {(f, z, t): (c, s) for f, z, t, c, s in models.height_terms(frame, frame, losses=("ols",))}
    assert len(rows) == 2 * (2 + 2 + 3 + 3) + 2 * 4
    for z in (1, 2):
        coef, se = rows[("b_interact", z, "sv_interact")]
        assert abs(rows[("a_sub", z, "sv_image_y")][0] - 0.01) < 1e-3 and abs(coef) < 4 * se
        assert rows[("a_sub", z, "error_ols")][0] < 0.12 and rows[("b_norm", z, "error_ols")][0] > rows[("a_sub", z, "error_ols")][0]


def test_height_terms_under_the_absolute_loss_ignore_outliers(spark):
    rng = np.random.default_rng(12)
    rows = []
    for k in range(240):
        y, canvas, zoom, height, city = -int(rng.integers(0, 2000)), int(rng.integers(1, 480)), 1 + k % 2, (6656, 8192)[k % 2 if k % 3 else 0], "ab"[k % 2]
        rows.append((y, canvas, zoom, height, city, 18 + 0.006 * y + 0.01 * canvas + (300.0 if k % 9 == 0 else 0.0)))
    df = spark.createDataFrame(rows, "sv_image_y long, canvas_y long, zoom long, pano_height long, city string, truth_m double")
    test = df.where("truth_m < 100")
    got = {(r[0], r[1], r[2]): r[3] for r in models.height_terms(df, test, losses=("l1", "ols")) if r[2].startswith("error")}
    for zoom in (1, 2):
        assert got["a_sub", zoom, "error_l1"] < 0.01 < 1 < got["a_sub", zoom, "error_ols"]
