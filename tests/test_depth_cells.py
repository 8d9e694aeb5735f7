"""The decoder in built-in expressions against the one in Python, on hand-made and random payloads."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodemark.functions import numeric
from lodemark.operators import depth, depth_cells


def some(seed, width=40, height=24, n=6):
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 3, (n, 4)).astype(np.float32)
    table[1:3, 2] = [-0.99, 1.0]
    table[:, 3] = rng.choice(np.array([0.0, -0.0, 1e-42, -3.5, 3e38, np.inf, -np.inf, 2.3], np.float32), n)
    return rng.integers(0, n, (height, width)), table


@pytest.fixture(scope="module")
def payloads(spark):
    rows = [(f"p{k}", depth.encode(*some(k, width, height))) for k, (width, height) in enumerate([(40, 24), (1, 1), (7, 3), (64, 33)])]
    bad = [("squeezed", depth.encode(*some(9), squeeze=True)), ("null", None), ("empty", ""), ("short", rows[0][1][:-8]), ("odd", "C"), ("text", "not base64!"), ("broken", rows[0][1][:40] + "!" + rows[0][1][41:]), ("CQ", "CQAA")]
    return spark.createDataFrame(rows + bad, "pano_id string, b64 string"), {k: depth.decode(t) for k, t in rows}


def test_cells_and_planes_are_the_other_decoders(payloads):
    frame, want = payloads
    got = depth_cells.cells(frame).toPandas()
    assert set(got.pano_id) == set(want)
    for key, part in got.groupby("pano_id"):
        grid = part.sort_values(["row", "col"]).plane.to_numpy().reshape(want[key].cells.shape)
        assert (grid == want[key].cells).all()
    got = depth_cells.planes(frame).toPandas()
    assert set(got.pano_id) == set(want)
    for key, part in got.groupby("pano_id"):
        part = part.sort_values("plane")
        assert np.array_equal(part[["nx", "ny", "nz"]].to_numpy(), want[key].normals.astype(float), equal_nan=True)
        assert np.array_equal(part.offset_m.to_numpy(), want[key].offsets.astype(float), equal_nan=True)


def test_floats_by_their_bits(spark):
    bits = [0, 1, 0x7FFFFF, 0x800000, 0x3F800000, 0x7F7FFFFF, 0x7F800000, 0x7FC00000, 0x80000001, 0xBF800001, 0xFF800000]
    got = [r[0] for r in spark.createDataFrame([(b,) for b in bits], "b long").select(depth_cells.float_of(depth_cells.F.col("b"))).collect()]
    assert np.array_equal(got, np.array(bits, np.uint32).view(np.float32).astype(float), equal_nan=True)


def test_inventory_counts_what_the_raster_counts(payloads):
    frame, want = payloads
    got = depth_cells.plane_inventory(frame).toPandas()
    for key, part in got.groupby("pano_id"):
        r, part = want[key], part.sort_values("plane")
        assert part.n_cells.tolist() == r.used[1:].tolist() and part.n_below.tolist() == r.below[1:].tolist()
        assert np.allclose(part.tilt_deg, r.tilt[1:])
        assert part.plane[part.is_ground].tolist() == ([r.ground] if r.ground > 0 else [])


def test_decoders_agree_in_payload_order_only(payloads):
    frame, want = payloads
    got = depth_cells.decoder_check(frame).toPandas().set_index("pano_id")
    assert set(got.index) == set(want)
    for key, r in want.items():
        assert got.n_cells[key] == got.n_same[key] == r.cells.size
        assert got.n_mirrored[key] == (r.cells == r.cells[:, ::-1]).sum()


def test_no_payloads(spark):
    none = spark.createDataFrame([], "pano_id string, b64 string")
    assert all(f(none).count() == 0 for f in (depth_cells.cells, depth_cells.planes, depth_cells.plane_inventory, depth_cells.decoder_check))


def test_check_joins_no_lines_and_decodes_a_payload_once(spark, payloads):
    plan = depth_cells.decoder_check(payloads[0])._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    for line in plan.splitlines():
        assert not ("lambda" in line and "to_binary" in line)


def test_fixture_payloads_come_in_small_frames(spark):
    got = depth.synthetic_payloads(spark.range(0, 40, 1, 1), "id").toPandas()
    one = spark.range(40).select("id", depth.synthetic_payload(depth_cells.F.col("id")).alias("b64")).toPandas()
    assert got.pano_id.tolist() == one.id.tolist() and got.b64.tolist() == one.b64.tolist()


def test_labels_travel_once_whatever_the_controls(spark):
    """Each control had rows of its own in the shuffle; missing columns and rows keep their meaning under all."""
    payloads = spark.range(2).select(F.concat(F.lit("p"), "id").alias("pano_id"), depth.synthetic_payload(F.col("id") * 7 + 3).alias("b64"))
    rows = [(f"p{k % 3}", k, None if k % 17 == 0 else k * 37 % 512, None if k % 13 == 0 else k * 11 % 256) for k in range(200)]
    labels = spark.createDataFrame(rows, "pano_id string, label_id long, col int, row int")
    found = depth.classify_labels(payloads, labels, controls=depth.CONTROLS)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "inline" not in plan and found.columns[:4] == ["pano_id", "label_id", "control", "status"]
    got = {(r["control"], r["label_id"]): (r["status"], r["hit_class"], r["horizontal_m"]) for r in found.collect()}
    assert len(got) == 4 * len(rows)
    for control in depth.CONTROLS:
        cells = labels.select("pano_id", "label_id", *[x.cast("int").alias(n) for n, x in zip(("col", "row"), numeric.control_cell(control, F.col("col"), F.col("row")), strict=True)])
        assert {(control, r["label_id"]): (r["status"], r["hit_class"], r["horizontal_m"]) for r in depth.classify_labels(payloads, cells).collect()}.items() <= got.items()
