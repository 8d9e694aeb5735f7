"""Report operators at their edges; their queries are compared with SQL in test_oracle.py."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lodemark.operators import reports
from lodemark.operators.aggregate import within_slope, within_slopes


def test_sites_of_one_height_have_no_height_slope(spark):
    rng = np.random.default_rng(3)
    rows = [(k % 9, float(a), float(b), float(c), float(d), 6656) for k, (a, b, c, d) in enumerate(zip(rng.uniform(0, 20, 200), rng.uniform(0, 20, 200), rng.uniform(0, 360, 200), rng.uniform(2, 30, 200), strict=True))]
    schema = "site_id long, e double, n double, bearing_deg double, dep_deg double, pano_height long"
    got = {r["model"]: r for r in reports.site_diagnosis(spark.createDataFrame(rows, schema)).collect()}
    assert len(got) == 4 and all(r["height_slope"] is None and r["height_se"] is None and (r["n_sites"], r["n_members"]) == (9, 200) for r in got.values())
    f = pd.DataFrame(rows, columns=["s", "e", "n", "b", "d", "h"])
    dist, ux, uy = 2.6 / np.tan(np.radians(f.d)), np.sin(np.radians(f.b)), np.cos(np.radians(f.b))
    px, py = f.e + dist * ux, f.n + dist * uy
    ex, ey = px - px.groupby(f.s).transform("mean"), py - py.groupby(f.s).transform("mean")
    along = ex * ux + ey * uy
    x, y = dist - dist.groupby(f.s).transform("mean"), along - along.groupby(f.s).transform("mean")
    slope = (x * y).sum() / (x * x).sum()
    c = got["c_cotangent"]
    assert np.isclose(c["range_slope"], slope, atol=1e-4) and np.isclose(c["rms_over_range"], np.sqrt((ex**2 + ey**2).mean()) / dist.mean(), atol=1e-4)
    assert np.isclose(c["range_se"], np.sqrt(((y - slope * x) ** 2).sum() / (200 - 9 - 1) / (x * x).sum()), atol=1e-4)
    assert reports.site_diagnosis(spark.createDataFrame([], schema)).count() == 0


def test_slopes_of_many_pairs_are_those_of_each(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(int(g), float(a), float(b)) for g, a, b in zip(rng.integers(0, 7, 300), rng.normal(size=300), rng.normal(size=300), strict=True)], "g int, a double, b double")
    both = within_slopes(df, "g", {"p": (F.col("a"), F.col("b")), "q": (F.col("b"), F.col("a") * 2)}, {"total": F.col("a")}).first()
    for k, (x, y) in {"p": (F.col("a"), F.col("b")), "q": (F.col("b"), F.col("a") * 2)}.items():
        one = within_slope(df, "g", x, y).first()
        assert (one["slope"], one["se"]) == (round(both[f"{k}_slope"], 4), round(both[f"{k}_se"], 4))
    assert np.isclose(both["total"], df.agg(F.sum("a")).first()[0])


def test_sequences_that_hardly_move_or_lack_times(spark):
    rows = [("two", "a", 0, 40.0, -75.0), ("two", "b", 1000, 40.001, -75.0)]
    rows += [("gaps", str(k), k * 100_000, 40.0 + k, -75.0) for k in range(5)]  # every step is longer than a minute
    rows += [("walk", str(k), k * 1000, 40.0 + k * 1e-5, -75.0) for k in range(5)] + [("same", str(k), 7, 40.0, -75.0) for k in range(4)] + [(None, "x", None, None, None)]
    df = spark.createDataFrame([(*r, None if k % 2 else "make", None, 4096 if r[0] else None, 8192, 1) for k, r in enumerate(rows)], "sequence_id string, pano_id string, captured_at_ms long, lat double, lng double, camera_make string, camera_model string, height int, width int, members int")
    got = {r["sequence_id"]: r for r in reports.sequence_table(df.where("sequence_id IS NOT NULL")).collect()}
    assert {k: r["capture_mode"] for k, r in got.items()} == {"two": "unknown", "gaps": "unknown", "same": "unknown", "walk": "on_foot"}
    assert np.isclose(got["walk"]["speed_mps"], 6371008.8 * np.radians(1e-5), rtol=1e-6) and got["walk"]["n_members"] == 5
    rigs = {r["rig"]: r for r in reports.rig_census(df).collect()}
    assert set(rigs) == {"make / (none)", "(none) / (none)"} and sum(r["n_panos"] for r in rigs.values()) == len(rows)


def test_fidelity_without_stored_pixels(spark):
    schema = "city string, pano_id long, pov_heading double, pov_pitch double, camera_heading double, pano_width int, pano_height int, stored_x double, stored_y double, time_created timestamp_ntz"
    assert reports.replay_fidelity(spark.createDataFrame([("dc", 1, 1.0, 1.0, 1.0, None, None, None, None, None)], schema), ["city"], "2021-01-01").count() == 0
    # a panorama whose heading drifted by one degree, seen across the seam
    rows = [("ny", 1, float(h), 0.0, 180.0, 360, 180, float((h + 1) % 360), 90.0, None) for h in range(0, 360, 30)] + [("ny", 2, 5.0, 0.0, 180.0, 360, 180, 5.0, 90.0, None)] + [("ny", 3, float(h), 0.0, 180.0, 360, 180, float((h + 5) % 360), 91.0, None) for h in (0, 358)]
    r = reports.replay_fidelity(spark.createDataFrame(rows, schema), ["city"], "2021-01-01").first()
    assert (r["n"], r["x_exact"], r["x_within_1px"], r["x_exact_late"], r["spread_within"], r["n_panos_off"]) == (15, round(1 / 15, 6), round(13 / 15, 6), None, 0.0, 1)
    assert r["y_exact"] == round(13 / 15, 6)


def test_roll_and_tilt(spark):
    assert [r[0] for r in spark.createDataFrame([(v,) for v in (0.0, 180.0, 181.0, 359.0, None)], "r double").select(reports.roll_unwrapped(F.col("r"))).collect()] == [0.0, 180.0, -179.0, -1.0, None]
    rng = np.random.default_rng(9)
    meta = [(k, float(rng.uniform(0, 360)), 2.0, 357.0) for k in range(20)]
    rows = []
    for k in range(400):
        p, yaw, pitch, roll = meta[k % 20]
        heading, dist = float(rng.uniform(0, 360)), float(rng.uniform(3, 30))
        a = np.radians(heading - yaw)
        rows.append((p, heading, float(np.degrees(np.arctan2(2.6, dist)) + pitch * np.cos(a) + (roll - 360) * np.sin(a)), dist))
    r = reports.tilt_sinusoid(spark.createDataFrame(rows, "pano_id long, heading double, dep double, truth_m double"), spark.createDataFrame(meta, "pano_id long, yaw_deg double, pitch_deg double, roll_deg double"), 2.6).first()
    assert (r["n"], r["n_panos"], r["coef"], r["r"], r["cos_deg"], r["sin_deg"]) == (400, 20, 1.0, 1.0, 2.0, -3.0)


def test_nested_summary_folds_into_dictionaries(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 4.0), (None, 1, 6.0)], "city string, zoom int, v double")
    levels = [(), ("city",), ("city", "zoom")]
    rows = reports.nested_summary(df, levels, {"middle": (F.col("v"), 0.5)}, [F.max("v").alias("most")], ["v"]).collect()
    assert reports.folded(rows, levels) == {
        "all": {"n": 3, "middle": 4.0, "most": 6.0}, "city": {"a": {"n": 2, "middle": 3.0, "most": 4.0}, "(none)": {"n": 1, "middle": 6.0, "most": 6.0}},
        "city/zoom": {"a": {"1": {"n": 1, "middle": 2.0, "most": 2.0}, "2": {"n": 1, "middle": 4.0, "most": 4.0}}, "(none)": {"1": {"n": 1, "middle": 6.0, "most": 6.0}}},
    }
