"""Depth rasters on hand-made payloads; readers and sinks on small files."""

import base64
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodemark.functions import geo, numeric
from lodemark.operators import depth
from lodemark.sinks import writers
from lodemark.sources import readers, schemas


def ground(height=2.2, hole=False):
    cells = np.zeros((256, 512), np.uint8)
    cells[128:] = 1
    if hole:
        cells[128:, 100:110] = 0
    return cells, np.array([[0, 0, 0, 0], [0, 0, -1, height]])


@pytest.mark.parametrize("squeeze", [False, True])
def test_decode_round_trip(squeeze):
    r = depth.decode(depth.encode(*ground(), squeeze))
    assert (r.width, r.height, r.was_compressed, r.ground) == (512, 256, squeeze, 1)
    wrong = base64.urlsafe_b64encode(zlib.compress(b"\x07" + bytes(8))).decode().rstrip("=")
    with pytest.raises(ValueError, match="header of 7 bytes"):
        depth.decode(wrong)


def test_ground_range_is_the_cotangent_and_holes_are_nowhere():
    r = depth.decode(depth.encode(*ground(2.2, True)))
    found = depth.hits(r, [300, 105, 512, 512, 5], [200, 200, 255, 199, 10], 2.2)
    assert found.hit_class.tolist() == ["ground", "sky", "out_of_bounds", "ground", "sky"] and found.plane.tolist() == [1, 0, -1, 1, 0]
    assert math.isclose(found.horizontal_m[0], 2.2 / math.tan(r.depression[200]), rel_tol=1e-6) and abs(found.flat_excess_m[0]) < 1e-4
    assert abs(found.above_ground_m[0]) < 1e-5 and abs(found.range_ratio[0] - 1) < 0.01 and found.range_m[1:3].isna().all()
    assert r.cloud[200, 105, 0] == np.float32(1e19) and np.isnan(r.distance[200, 105])


def scene():
    """Ground, a terrace, a wall and a slope in four quarters of the turn, sky above."""
    cells = np.zeros((256, 512), np.uint8)
    cells[128:] = 1
    cells[140:170, 100:200] = 2
    cells[90:150, 250:300] = 3
    cells[100:190, 400:450] = 4
    slope = math.sqrt(0.5)
    return cells, np.array([[0, 0, 0, 0], [0, 0, -1, 2.4], [0.02, 0, -0.9998, 1.4], [0.6, 0.8, 0, 9], [slope, 0, -slope, 5]])


def test_hits_of_a_scene_cell_by_cell():
    """Every measure of hits() from the definitions, one cell after another."""
    r = depth.decode(depth.encode(*scene()))
    cells, planes = scene()
    planes = planes.astype(np.float32).astype(float)
    rng = np.random.default_rng(4)
    cols, rows = rng.integers(-2, 514, 400), rng.integers(-1, 257, 400)
    found = depth.hits(r, cols, rows, 2.4)

    def reach(col, row):
        polar, turn = (256 - row - 0.5) / 256 * np.pi, (512 - col - 0.5) / 512 * 2 * np.pi + np.pi / 2
        ray = np.array([np.sin(polar) * np.cos(turn), np.sin(polar) * np.sin(turn), np.cos(polar)])
        normal, d = planes[cells[row, col], :3], planes[cells[row, col], 3]
        return abs(d / (ray @ normal)) * ray

    for k, (col, row) in enumerate(zip(cols.tolist(), rows.tolist(), strict=True)):
        place = col + 512 * row
        if not 0 <= place < 256 * 512:
            assert found.hit_class[k] == "out_of_bounds"
            continue
        y, x = divmod(place, 512)
        if cells[y, x] == 0:
            assert found.hit_class[k] == "sky" and found.loc[k, "range_m":].isna().all()
            continue
        assert found.hit_class[k] == {1: "ground", 2: "terrain", 3: "facade", 4: "oblique"}[cells[y, x]]
        point = reach(x, y)
        assert np.allclose(found.loc[k, ["range_m", "horizontal_m", "above_ground_m"]].astype(float), [np.linalg.norm(point), np.hypot(*point[:2]), 2.4 - point[2]], rtol=1e-5)
        near = [np.linalg.norm(reach(j, i)) for i in range(max(row - 1, 0), min(row + 2, 256)) for j in range(max(col - 1, 0), min(col + 2, 512)) if cells[i, j]]
        if near:
            assert math.isclose(found.range_ratio[k], np.linalg.norm(point) / np.median(near), rel_tol=1e-5)
    flat = depth.flat_earth(r, 2.4)
    assert flat["off_facade"] > 0 and flat["off_terrain"] > 0 and math.isclose(flat["off_facade"] + flat["off_terrain"] + flat["off_other"], 1)


def test_labels_of_broken_and_missing_payloads_have_a_status(spark):
    payloads = spark.createDataFrame([("a", depth.encode(*scene())), ("b", None), ("c", "CQAA")], "pano_id string, b64 string")
    labels = spark.createDataFrame([(p, k, k * 40, 200) for p in "abcd" for k in range(12)], "pano_id string, label_id long, col int, row int")
    got = depth.classify_labels(payloads, labels, controls=depth.CONTROLS).toPandas()
    assert got.groupby("pano_id").status.first().to_dict() == {"a": "ok", "b": "no_depth", "c": "decode_error", "d": "no_depth"}
    assert len(got) == 4 * 12 * 4 and got[got.pano_id != "a"].hit_class.isna().all()
    whole = depth.decode(depth.encode(*scene()))
    for control, own in got[got.pano_id == "a"].groupby("control"):
        turned = depth.controlled(whole.cells, control)
        own = own.sort_values("label_id")
        assert own.plane.astype(int).tolist() == [turned[200, k * 40] for k in range(12)]


def test_relocated_labels_and_classes(spark):
    payloads = spark.createDataFrame([(p, depth.encode(*scene())) for p in "abcd"] + [("e", None), ("f", "CQAA")], "pano_id string, b64 string")
    labels = spark.createDataFrame([(p, n * 10 + k, 26 * 40 * k + 5, -800, 40.0, -75.0) for n, p in enumerate("abcdefg") for k in range(4)] + [("a", 99, 13312, -800, 40.0, -75.0)], "pano_id string, label_id long, sv_image_x long, sv_image_y long, pano_lat double, pano_lng double")
    found = depth.relocated(payloads, labels)
    got = {r["label_id"]: r for r in found.collect()}
    r = depth.decode(depth.encode(*scene()))
    for k in range(4):
        x, y = math.ceil((26 * 40 * k + 5) * (1 / 26)), math.ceil((3328 + 800) * (1 / 26))
        point = r.cloud[y, x].astype(float)
        assert math.isclose(got[k]["new_lat"], 40 + point[1] / 111111) and math.isclose(got[k]["new_lng"], -75 + point[0] / (111111 * math.cos(math.radians(40))))
    assert got[99]["seam_wrap"] and not got[0]["seam_wrap"] and got[40]["status"] == "no_depth" and got[50]["status"] == "decode_error"
    # a: all as today; b: three of four; c: none; d: no label cleaned; e: no depth; f: broken; g: gone; h: unreadable
    off = {"b": (3,), "c": (0, 1, 2, 3)}
    stored = [(r["pano_id"], r["label_id"], *(float(np.float32(r[f"new_{c}"])) + 1e-3 * (r["label_id"] % 10 in off.get(r["pano_id"], ())) if r["new_lat"] else 1.0 for c in ("lat", "lng")), 40.0, -75.0, 350.0, r["pano_id"] != "d") for r in got.values() if r["label_id"] != 99]
    stored = spark.createDataFrame(stored, "pano_id string, label_id long, lat double, lng double, pano_lat double, pano_lng double, heading_then double, cleaned boolean")
    panos = spark.createDataFrame([(p, None if p == "g" else p != "h", 40.0, -74.999, 10.0) for p in "abcdefgh"], "pano_id string, meta_ok boolean, fresh_lat double, fresh_lng double, fresh_heading double")
    out = {r["pano_id"]: r for r in depth.pano_classes(panos, found.where("label_id <> 99"), stored).collect()}
    assert {p: (r["status"], r["pano_class"]) for p, r in out.items()} == {
        "a": ("ok", "unchanged"), "b": ("ok", "mostly_unchanged"), "c": ("ok", "changed"), "d": ("ok", "no_comparable_labels"), "e": ("no_depth", None), "f": ("decode_error", None), "g": ("gone", None), "h": ("parse_error", None),
    }
    assert abs(out["a"]["pano_shift_m"] - 85.27) < 0.1 and out["a"]["heading_shift_deg"] == 20 and out["b"]["n_consistent"] == 3


def test_cameras_that_see_the_same_ground_and_walls_agree(spark):
    cells, planes = scene()
    moved = planes.copy()
    east, north = 1.5, -2.0  # the first camera from the second's
    moved[3, 3] = planes[3, 3] - planes[3, 0] * east - planes[3, 1] * north
    payloads = spark.createDataFrame([("a", depth.encode(cells, planes)), ("b", depth.encode(cells, moved)), ("x", None)], "pano_id string, b64 string")
    pairs = spark.createDataFrame([(1, "a", "b", east, north, 0.0), (2, "a", "a", 0.0, 0.0, 0.0), (3, "a", "x", 0.0, 0.0, 0.0)], "pair long, a string, b string, east double, north double, up double")
    walls = {r["pair"]: r["separation_m"] for r in depth.facade_separation(pairs, depth.facade_planes(payloads)).collect()}
    assert set(walls) == {1, 2} and abs(walls[1]) < 1e-5 and walls[2] == 0
    ground_only = np.where(np.arange(256)[:, None] >= 128, 1, 0) * np.ones((1, 512), int)
    flat = spark.createDataFrame([("a", depth.encode(ground_only, planes)), ("b", depth.encode(ground_only, planes))], "pano_id string, b64 string")
    left = {r["pair"]: r for r in depth.cross_vintage(pairs.where("pair < 3"), flat, stride=16).collect()}
    assert left[2]["n"] > 100 and left[2]["median_m"] < 0.02 and left[1]["median_m"] < 0.5
    assert depth.cross_vintage(pairs.where("pair = 3"), payloads).first()["n"] == 0
    same = depth.cross_vintage(pairs.where("pair = 2"), payloads, stride=4).first()
    raster = depth.decode(depth.encode(cells, planes))
    level = np.isin(raster.cells, np.flatnonzero(np.append(False, raster.tilt[1:] <= depth.LEVEL_DEG))) & (raster.distance < 20)
    assert same["n"] == level[128::4, ::4].sum() > 0 and same["p90_m"] < 1e-6  # a camera finds its own cells


def test_registration_tells_the_frames_apart(spark):
    frame = spark.createDataFrame([(7,), (8,)], "seed int").select(F.col("seed").alias("pano_id"), depth.synthetic_payload(F.col("seed")).alias("b64"), depth.synthetic_image(F.col("seed")).alias("rgb"), F.lit(128).alias("width"), F.lit(64).alias("height"))
    for r in frame.collect():
        raster, rgb = depth.decode(r["b64"]), np.frombuffer(r["rgb"], np.uint8).reshape(64, 128, 3)
        sky = depth.sky_mask(rgb)
        for own in depth.registration(frame.where(F.col("pano_id") == r["pano_id"])).collect():
            grid = depth.controlled(raster.cells, own["control"])
            empty = np.array([[grid[i * 4, j * 4] == 0 for j in range(128)] for i in range(64)])
            assert math.isclose(own["sky_violation"], (sky & ~empty).sum() / sky.sum()) and math.isclose(own["sky_iou"], (sky & empty).sum() / (sky | empty).sum())
            assert (own["control"] != "identity") == (own["sky_violation"] > 0) and own["best_shift"] == 0


def test_road_links_are_read_in_both_frames(spark):
    images = spark.createDataFrame([("a", bytes([10, 10, 10, 200, 10, 10, 10, 10, 10, 200, 10, 10] * 100 * 25), 100, 100)], "pano_id string, rgb binary, width int, height int")
    links = spark.createDataFrame([("a", 180.0, 90.0), ("a", 0.0, 90.0)], "pano_id string, yaw double, bearing double")
    got = depth.road_share(images, links).collect()
    assert len(got) == 2 and all(0.3 <= r["a_share"] <= 0.7 and r["bearing"] == 90 for r in got)
    payloads = spark.createDataFrame([("a", depth.encode(*scene()))], "pano_id string, b64 string")
    seen = depth.sightlines(payloads, links).collect()
    r = depth.decode(depth.encode(*scene()))
    strip = r.distance[132:150]
    columns = (128 + np.arange(-6, 7)) % 512
    assert all(math.isclose(s["a_m"], np.nanmedian(strip[:, columns])) and math.isclose(s["base_m"], np.nanmedian(strip)) for s in seen)


def test_checks_of_a_default_payload():
    qc = depth.height_check(depth.decode(depth.encode(*ground(2.5))))
    assert qc["is_default"] and math.isclose(qc["height_m"], 2.5) and abs(qc["band_m"] - 2.5) < 1e-5
    assert not depth.height_check(depth.decode(depth.encode(*ground(2.4))))["is_default"]


def test_controls_and_sky():
    grid = np.arange(12).reshape(3, 4)
    assert (depth.controlled(grid, "rotate_180") == grid[::-1, ::-1]).all()
    with pytest.raises(ValueError):
        depth.controlled(grid, "sideways")
    rgb = np.zeros((20, 20, 3), np.uint8)
    rgb[:12] = 200
    rgb[16:] = 200  # bright, but not joined to the top
    mask = depth.sky_mask(rgb, erode=1)
    assert mask[5, 5] and not mask[17, 5] and not mask[11, 5]


def test_decoding_never_fails_a_task(spark):
    rows = [("a", depth.encode(*ground())), ("b", None), ("c", "CQAA")]
    got = {r["pano_id"]: r["status"] for r in depth.decoded(spark.createDataFrame(rows, "pano_id string, b64 string")).collect()}
    assert got == {"a": "ok", "b": "no_depth", "c": "decode_error"}


def test_geodesics_agree_with_the_sphere_nearby(spark):
    row = spark.range(1).select(
        geo.dest_point(F.lit(40.0), F.lit(-75.0), F.lit(0.0), F.lit(1000.0)).alias("p"), geo.bearing_deg(F.lit(40.0), F.lit(-75.0), F.lit(40.001), F.lit(-75.0)).alias("b"), geo.bearing_deg(F.lit(40.0), F.lit(-75.0), F.lit(40.0), F.lit(-74.999)).alias("e")
    ).first()
    assert abs(row["p"]["lat"] - 40.0090061) < 1e-5 and abs(row["p"]["lng"] + 75) < 1e-12
    assert abs(row["b"]) < 1e-9 and abs(row["e"] - 90) < 1e-3


def test_clip_keeps_missing_values(spark):
    rows = spark.createDataFrame([(None,), (-3.0,), (70.0,), (float("nan"),)], "x double").select(numeric.clip(F.col("x"), 0.0, 50.0)).collect()
    assert rows[0][0] is None and rows[1][0] == 0 and rows[2][0] == 50 and math.isnan(rows[3][0])


def test_readers(spark, tmp_path):
    header = ",".join(c.split()[0] for c in schemas.MODERN.split(", "))
    line = "{0},Ramp,1,2,3,4,5,6,1,10,20,depth,p{0},2023-05-01 00:00:00+00,{1},100,50,1,2,,,,2022-01-01,gsv"
    for city, flags in (("x", "tf"), ("y", "ff")):
        (tmp_path / f"modern-labels-{city}.csv").write_text("\n".join([header, *(line.format(k, f) for k, f in enumerate(flags))]) + "\n")
    got = readers.modern_labels(spark, str(tmp_path))
    assert sorted(r["label_uid"] for r in got.select("label_uid").collect()) == ["x:0", "x:1", "y:0", "y:1"]
    (tmp_path / "modern-labels-z.csv").write_text("\n".join([header, line.format(1, "TRUE")]) + "\n")
    with pytest.raises(Exception, match="neither t nor f"):
        readers.modern_labels(spark, str(tmp_path)).collect()
    empty = readers.optional(lambda: readers.payloads(spark, str(tmp_path / "none.jsonl")), spark, schemas.PAYLOADS)
    assert empty.count() == 0 and "depth_b64" in empty.columns


def test_imported_panoramas_have_every_column(spark):
    import json

    full = {"pano": {"panorama_id": "a", "width": 10, "lat": 1.5, "source_metadata": {"captured_at": 7, "geometry": {"coordinates": [-75.0, 40.0]}, "computed_rotation": [1, 2, 3], "camera_parameters": [0.5, 0, 1], "creator": {"username": "u", "id": 3}}}, "detections": [{}, {}]}
    rows = [json.dumps(full), json.dumps({"pano": {"panorama_id": "b", "source_metadata": None}, "detections": None})]
    got = {r["pano_id"]: r for r in readers.pano_rows(spark.createDataFrame([(r,) for r in rows], "value string"), "r1").collect()}
    a, b = got["a"].asDict(), got["b"].asDict()
    assert len(a) == 34 and (a["raw_lat"], a["raw_lng"], a["computed_rotation_z"], a["creator_id"], a["n_detections"], a["captured_at_ms"], a["camera_parameters"]) == (40.0, -75.0, 3.0, "3", 2, 7, "[0.5,0,1]")
    assert {k for k, v in b.items() if v is not None} == {"run", "pano_id", "n_detections"} and b["n_detections"] == 0
    with pytest.raises(Exception, match="no panorama id"):
        readers.pano_rows(spark.createDataFrame([("{}",)], "value string"), "r1").collect()


@pytest.mark.parametrize("rounds", [64, 2])
def test_greedy_spacing_keeps_what_a_plain_loop_keeps(spark, monkeypatch, rounds):
    """In one round, and in rounds so small that groups need many; a group alone at the pole, and null places."""
    from lodemark.operators import joins

    monkeypatch.setattr(joins, "ROUND", rounds)
    rng = np.random.default_rng(1)
    rows = [(f"c{k % 3}", k, 40 + float(v), -75 + float(w)) for k, (v, w) in enumerate(rng.uniform(0, 0.01, (300, 2)))]
    rows += [("pole", 1000 + k, 90 - float(v), float(w)) for k, (v, w) in enumerate(rng.uniform(0, 1, (200, 2)) * [0.004, 360])]
    rows += [("turn", 2000 + k, float(v), (179.999 + float(w) + 180) % 360 - 180) for k, (v, w) in enumerate(rng.uniform(0, 0.003, (100, 2)))]
    kind = "city string, k long, lat double, lng double"
    df = spark.createDataFrame([*rows, ("c0", 9000, None, 1.0), (None, 9001, 1.0, 1.0)], kind)
    got = joins.greedy_spacing(df, "city", "k", "lat", "lng", 150.0, 12, 5)
    order = {r["k"]: r["o"] for r in spark.createDataFrame(rows, kind).selectExpr("k", "md5(concat_ws('|', cast(k AS string), '5')) AS o").collect()}
    kept = {}
    for city, k, lat, lng in sorted(rows, key=lambda r: (order[r[1]], r[1])):
        own = kept.setdefault(city, [])

        def metres(p, q):
            (a, b), (c, e) = np.radians(p), np.radians(q)
            return 2 * 6378137.0 * np.arcsin(np.sqrt(np.sin((c - a) / 2) ** 2 + np.cos(a) * np.cos(c) * np.sin((e - b) / 2) ** 2))

        if len(own) < 12 and all(metres((lat, lng), q[1:]) >= 150 for q in own):
            own.append((k, lat, lng))
    assert sorted(r["k"] for r in got.collect()) == sorted(q[0] for own in kept.values() for q in own)
    assert got.columns == df.columns and joins.greedy_spacing(df.limit(0), "city", "k", "lat", "lng").count() == 0


@pytest.mark.parametrize("least", [0.98, 0.3])
def test_nearest_parallel_is_the_least_of_all_pairs(spark, least):
    """Faces turned either way, outliers, repeated planes, planes that no other is parallel to, nulls."""
    from lodemark.operators import joins

    rng = np.random.default_rng(4)

    def planes(n, ids):
        turn, d = rng.uniform(-np.pi, np.pi, n), rng.normal(0, 20, n)
        d[:3] = [1e7, -1e7, 0.0]
        rows = [(ids + k, float(np.cos(t)) * 2, float(np.sin(t)) * 2, float(v)) for k, (t, v) in enumerate(zip(turn, d, strict=True))]
        return [*rows, (ids + n, -1.0, 0.0, 5.0), (ids + n + 1, 1.0, 0.0, -5.25), (ids + n + 2, None, 1.0, 1.0), (ids + n + 3, 0.0, 0.0, 1.0), (ids + n + 4, 1.0, 1.0, None)]

    a, b = planes(120, 0), planes(60, 1000)
    b = [*b, *[(2000 + k, *b[7][1:]) for k in range(40)]]
    want = {}
    for i, x, y, d in a:
        for _, p, q, e in b:
            if None not in (x, y, d, p, q, e) and (x or y) and (p or q):
                dot = x * p + y * q
                if abs(dot) / np.sqrt((x * x + y * y) * (p * p + q * q)) >= least:
                    want[i] = min(want.get(i, np.inf), abs(d - (e if dot >= 0 else -e)))
    kind = "id long, nx double, ny double, d double"
    left, right = spark.createDataFrame(a, kind), spark.createDataFrame(b, kind)
    got = {r["id"]: r["gap"] for r in joins.nearest_parallel(left, right, least).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)
    assert joins.nearest_parallel(left, right.limit(0), least).count() == 0 and joins.nearest_parallel(left.limit(0), right, least).count() == 0


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, "a"), (2, "c")], "k long, v string")
    writers.sorted_csv(df, str(tmp_path / "csv"), ["k", "v"], single=True)
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "csv"), header=True, inferSchema=False).collect()] == [("1", "a"), ("2", "b"), ("2", "c")]
    writers.unique_jsonl(df, str(tmp_path / "jsonl"), "k", ["v"])
    assert {(r["k"], r["v"]) for r in spark.read.json(str(tmp_path / "jsonl")).collect()} == {(1, "a"), (2, "b")}
    assert writers.guarded_overwrite(df, str(tmp_path / "g")) == 3
    with pytest.raises(writers.ShrinkError):
        writers.guarded_overwrite(df.limit(1), str(tmp_path / "g"))
    assert writers.summary(df.where("k = 1"), ["k"]) == {"1": {"v": "a"}}


def test_stream_counts_late_rows_in(spark, sf, tmp_path):
    from lodemark.streaming.sequences import stream_of, windowed_counts

    events = spark.read.parquet(f"{sf}/events.parquet")
    events.limit(500).repartition(2).write.parquet(str(tmp_path / "in"))
    stream = windowed_counts(stream_of(spark, str(tmp_path / "in"), "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string", 10), "3650 days")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT sum(n) FROM counts").first()[0] == 500


def test_a_task_holds_one_group_of_labels_at_a_time(spark):
    """Many payloads in one task: Python is handed them one by one, and labels without one stay."""
    payloads = spark.range(40).select(F.col("id").alias("pano_id"), F.lit(depth.encode(np.ones((8, 16), int), np.array([[0, 0, 0, 0], [0, 0, -1, 2.5]], np.float32))).alias("b64"))
    labels = spark.range(200).select((F.col("id") % 50).alias("pano_id"), (F.col("id") + (1 << 60) + 1).alias("label_id"), F.lit(3).alias("col"), F.lit(6).alias("row"))
    found = depth.classify_labels(payloads, labels)
    assert "MapInPandas" not in found._jdf.queryExecution().executedPlan().toString()
    got = found.toPandas().set_index("label_id")
    assert sorted(got.index) == [k + (1 << 60) + 1 for k in range(200)]
    assert (got.status == "no_depth").sum() == 40 and (got.hit_class == "ground").sum() == 160
