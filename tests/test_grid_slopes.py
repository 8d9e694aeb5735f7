"""Median slopes at the angles of a grid against NumPy, row by row."""

import math

import numpy as np
import pytest

from lodemark.operators import grid_slopes, models


def _clicks(spark, n=900):
    rng = np.random.default_rng(8)
    dep, dist = rng.uniform(-5, 89, n), np.round(rng.uniform(0.2, 60, n), 1)
    rows = [(float(d), float(m), (None, "a", "b", "c")[k % 4]) for k, (d, m) in enumerate(zip(dep, dist, strict=True))]
    return rows, spark.createDataFrame(rows, "dep double, truth_m double, label_type string").repartition(3)


def _median(x, y):
    """The lower median of y/x weighted by |x|."""
    v = y / x
    order = np.argsort(v, kind="stable")
    return v[order][np.searchsorted(np.cumsum(np.abs(x[order])), 0.5 * np.abs(x).sum())]


@pytest.mark.parametrize(("form", "bits", "at_once"), [("floor", 12, 8), ("blend", 12, 8), ("floor", 3, 1), ("blend", 3, 2)])
def test_slopes_and_losses_by_brute_force(spark, monkeypatch, form, bits, at_once):
    monkeypatch.setattr(grid_slopes, "BITS", bits)
    monkeypatch.setattr(grid_slopes, "TYPES_AT_ONCE", at_once)
    rows, df = _clicks(spark)
    grid, cap = [1.0, 8.5, 30.0], models.CAP_M
    kept, base = models._narrow(df, "dep", "truth_m", "label_type")
    got, typed = grid_slopes.median_slopes(base, form, grid, ["a", "b", "c"])
    heights = [1 / s for s in got]
    by_type = [{t: 1 / s for t, s in own.items()} for own in typed]
    losses = grid_slopes.mean_losses(base, form, grid, heights, by_type, cap)
    kept.unpersist()
    d, m, kind = (np.array([r[k] for r in rows]) for k in range(3))
    y = 1 / np.maximum(m, 1)
    for k, a in enumerate(grid):
        x = np.tan(np.radians(np.maximum(d, a if form == "floor" else 0)))
        use = np.full(len(d), True) if form == "floor" else d >= a
        assert math.isclose(got[k], _median(x[use], y[use]), rel_tol=1e-12)
        for t in "abc":
            assert math.isclose(typed[k][t], _median(x[use & (kind == t)], y[use & (kind == t)]), rel_tol=1e-12)
        for one, own in ((True, losses[0]), (False, losses[1])):
            h = np.array([heights[k] if one or t is None else by_type[k][t] for t in kind])
            steep = d >= a
            line = h * (1 / math.tan(math.radians(a)) - math.radians(1) / math.sin(math.radians(a)) ** 2 * (np.maximum(d, 0) - a))
            e = np.where(steep, h / np.where(steep, x, 1), line) if form == "blend" else h / x
            assert math.isclose(own[k], np.abs(np.clip(e, 0, cap) - m).mean(), rel_tol=1e-9)


def test_profiles_make_no_row_an_angle_and_bear_missing_types(spark, monkeypatch):
    """Slopes over rows repeated for every angle did not fit in memory, and a missing type was no key of a map."""
    monkeypatch.setattr(models, "lad_slope", None)
    _, df = _clicks(spark)
    for form, grid in (("floor", models.FLOOR_GRID), ("blend", models.BLEND_GRID)):
        pooled, typed = models._profile(df, form, grid, "l1", "label_type", "dep", "truth_m")
        assert pooled.angle_deg in grid and not pooled.height_by_type and set(typed.height_by_type) == {"a", "b", "c"}


def test_keys_keep_the_order_of_values():
    v = np.array([-np.inf, -1e300, -2.0, -1e-310, 0.0, 5e-324, 1.0, 1.0000000000000002, 1e300, np.inf])
    keys = grid_slopes._keys(v)
    assert (np.diff(keys) > 0).all() and (grid_slopes._values(keys) == v).all() and grid_slopes._keys(np.array([-0.0]))[0] == keys[4]
