"""Angles of clicks: what a filter on them holds, and the columns beside them."""

import re

from lodemark.plans.clicks import clicks, with_angles


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_filter_on_an_angle_does_not_hold_its_expression(spark, sf):
    view = with_angles(clicks(spark, sf))
    filters = [line for line in _plan(view.where("dep >= 5 AND pov_heading < 90").groupBy("city").count()).splitlines() if re.match(r"[\s:+-]*Filter", line)]
    assert filters and not any("ASIN" in f or "ATAN2" in f for f in filters)


def test_angles_keep_columns_and_missing_values(spark):
    row = spark.createDataFrame([(1, 10.0, 20.0, 30.0, -5.0, 1.0, "a b"), (2, 10.0, None, 30.0, -5.0, 1.0, None)], "id int, canvas_x double, canvas_y double, heading double, pitch double, zoom double, `a.b` string")
    got = {r["id"]: r for r in with_angles(row).collect()}
    assert list(got[1].asDict()) == [*row.columns, "pov_heading", "pov_pitch", "dep"] and got[1]["dep"] == -got[1]["pov_pitch"]
    assert got[2]["dep"] is None and got[2]["pov_heading"] is None and got[1]["a.b"] == "a b"
