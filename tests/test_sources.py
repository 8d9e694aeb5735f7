"""Readers and sinks on real files, catalogs of two schema versions, and JPEG tiles."""

import base64
import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodemark.operators import depth
from lodemark.sinks import writers
from lodemark.sources import readers, schemas


def names(schema):
    return [c.split()[0].strip("`") for c in schema.split(", ")]


def csv_line(schema, **values):
    return ",".join(str(values.get(n, "")) for n in names(schema))


# ------------------------------------------------------------------ S01 to S11


def test_historical_labels(spark, tmp_path):
    rows = [dict(label_id=1, label_type="Ramp", lat=1.5, deleted="t", tutorial="F", time_created="2018-03-04 05:06:07", heading="NaN"), dict(label_id=2, deleted="maybe", pano_height=6656)]
    for city, part in (("dc", rows[:1]), ("new-york", rows[1:])):
        with gzip.open(tmp_path / f"labels-{city}-latlng.csv.gz", "wt") as out:
            out.write("\n".join([",".join(names(schemas.HISTORICAL)), *(csv_line(schemas.HISTORICAL, **r) for r in part)]) + "\n")
    got = {r["label_id"]: r for r in readers.historical_labels(spark, [str(p) for p in sorted(tmp_path.glob("*.gz"))]).collect()}
    assert (got[1]["city"], got[1]["deleted"], got[1]["tutorial"], got[1]["heading"], got[1]["lat"]) == ("dc", True, False, None, 1.5)
    assert (got[2]["city"], got[2]["deleted"], got[2]["pano_height"], got[2]["time_created"]) == ("new-york", None, 6656, None)
    (tmp_path / "labels-bad-latlng.csv").write_text(",".join(names(schemas.HISTORICAL)) + "\n" + csv_line(schemas.HISTORICAL, label_id="x") + "\n")
    with pytest.raises(Exception, match=r"MALFORMED|Malformed|FAILED_READ"):
        readers.historical_labels(spark, [str(tmp_path / "labels-bad-latlng.csv")]).collect()


def test_panos_keep_identifiers_as_text_and_key_lists(spark, tmp_path):
    (tmp_path / "p.csv").write_text("pano_id,sequence_id,height\n007,0010,4096\n,,\n")
    got = readers.panos(spark, str(tmp_path / "p.csv"), "pano_id string, sequence_id string, height long").collect()
    assert [tuple(r) for r in got] == [("007", "0010", 4096), (None, None, None)]
    (tmp_path / "k.csv").write_text("label_id,city\n3,dc\n4,ny\n")
    assert sorted(tuple(r) for r in readers.key_list(spark, str(tmp_path / "k.csv")).collect()) == [(3, "dc"), (4, "ny")]
    (tmp_path / "m.csv").write_text("pano_id,yaw_deg,pitch_deg,roll_deg,link_bearings_deg\n00a,1.5,,359,10.000;20.000\n")
    assert tuple(readers.panos(spark, str(tmp_path / "m.csv"), schemas.PANO_META).first()) == ("00a", 1.5, None, 359.0, "10.000;20.000")


def test_sites_payloads_and_tiles(spark, tmp_path):
    site = {"site_id": "s1", "members": [{"pano_id": "p", "y_normalized": 0.6, "bearing_deg": 10, "range_m": 5, "lat": 1, "lng": 2}, {"pano_id": "q", "in_refit": False}]}
    (tmp_path / "sites.jsonl").write_text(json.dumps(site) + "\n" + json.dumps({"site_id": "s2", "members": []}) + "\n")
    got = {r["pano_id"]: r for r in readers.members(readers.sites(spark, str(tmp_path / "sites.jsonl"))).collect()}
    assert len(got) == 2 and got["p"]["in_refit"] is True and got["q"]["in_refit"] is False and got["q"]["lat"] is None and got["p"]["place"] == 0
    with gzip.open(tmp_path / "payloads.jsonl.gz", "wt") as out:
        out.write(json.dumps({"pano_id": "p", "part": "a", "depth_b64": "AAAA", "capture_year": 2019}) + "\n")
    row = readers.payloads(spark, str(tmp_path / "payloads.jsonl.gz")).first()
    assert (row["pano_id"], row["depth_b64"], row["capture_year"], row["city"]) == ("p", "AAAA", 2019, None)
    for name, zoom in (("t1.jsonl", 1), ("t2.jsonl", 2)):
        (tmp_path / name).write_text("\n".join(json.dumps({"pano_id": p, "set": "x", "zoom": zoom * k, "tiles": [{"x": 0, "y": 0, "b64": "QQ=="}]}) for p, k in (("p", 1), ("p", 10), (f"only{zoom}", 5))) + "\n")
    got = {r["pano_id"]: r["zoom"] for r in readers.tiles(spark, str(tmp_path / "t*.jsonl")).collect()}
    assert got == {"p": 20, "only1": 5, "only2": 10}  # the last line of the last file


def test_coefficients_of_newer_and_older_summaries():
    blend = {"blend_deg": 11.25, "height_m": 2.7}
    assert readers.coefficients(json.dumps({"final": {"blend": blend}, "blend": {"blend_deg": 1, "height_m": 1}})) == blend
    assert readers.coefficients(json.dumps({"candidate": {"params": {**blend, "height_by_type_m": {}}}})) == {**blend, "height_by_type_m": {}}
    assert readers.coefficients(json.dumps(blend)) == blend
    for bad in ({}, {"blend": {"blend_deg": 3}}, {"final": []}):
        with pytest.raises(ValueError, match="no blend"):
            readers.coefficients(json.dumps(bad))


# ------------------------------------------------------------------ S16 to S18


def photo(**without):
    """A photo document with the levels that are read, less some."""
    sizes = [[[208, 416]], [[416, 832]], [[3, 5, 7]], [[6656, 13312]]]
    place = [[None, None, 40.5, -75.25], [12.5], [200.0, 88.0, 1.5]]
    scene = [None, place]
    planes = [None, [None, None, "cGF5bG9hZA=="]]
    pano = [None, [2, "pano-1"], [None, None, None, [sizes, [512, 256]]], None, None, [[None, scene[1], None, None, None, planes]], [None, None, None, None, None, [None, None, "launch"], None, [2019, 7]]]
    document = [[0], [pano]]
    for k, v in without.items():
        if k == "no_pano":
            document = v
        elif k == "no_place":
            pano[5][0][1] = v
        elif k == "no_sizes":
            pano[2] = v
        elif k == "no_date":
            pano[6] = v
    return json.dumps(document)


def test_photo_documents(spark, tmp_path):
    odd = {"null": "null", "scalar": "5", "text": "no json", "empty": "", "object": "{}", "short": "[[0]]", "wrong": photo(no_place="text"), "lists": photo(no_place=[[], [], []]), "undated": photo(no_date=None), "sizeless": photo(no_sizes=[None, None, None, None])}
    for folder, documents in (("fresh", {"full": photo(), **odd}), ("old", {"full": photo(no_pano=[]), "kept": photo()})):
        (tmp_path / folder).mkdir()
        for name, text in documents.items():
            (tmp_path / folder / f"{name}.json").write_text(text)
    documents = readers.cached_documents(spark, [str(tmp_path / "fresh"), str(tmp_path / "old")])
    got = {r["key"]: r for r in documents.select("key", readers.depth_b64(F.col("document")).alias("b64"), *readers.photo_meta(F.col("document"))).collect()}
    assert set(got) == {"full", "kept", *odd} - ({"empty"} - set(got))
    assert got["full"].asDict() == {
        "key": "full", "b64": "cGF5bG9hZA==", "pano_id": "pano-1", "lat": 40.5, "lng": -75.25, "elevation_m": 12.5, "heading_deg": 200.0, "roll_deg": 1.5, "capture_year": 2019, "capture_month": 7,
        "source": "launch", "pitch_deg": 2.0, "image_sizes": "416x208;832x416;5x3;13312x6656",
    }
    for name in ("null", "scalar", "text", "object", "short"):
        assert all(v is None for k, v in got[name].asDict().items() if k != "key"), name
    for name in ("wrong", "lists"):
        assert (got[name]["lat"], got[name]["heading_deg"], got[name]["pitch_deg"], got[name]["pano_id"], got[name]["capture_year"]) == (None, None, None, "pano-1", 2019)
    assert got["undated"]["capture_year"] is None and got["undated"]["lat"] == 40.5 and got["sizeless"]["image_sizes"] is None
    grid = documents.where("key IN ('full', 'sizeless')").select("key", *readers.tile_grid(F.col("document"), F.lit(3))).collect()
    assert {r["key"]: tuple(r)[1:] for r in grid} == {"full": (13312, 6656, 512, 256, 26, 26), "sizeless": (None,) * 6}


def test_flat_metadata_in_radians(spark):
    text = json.dumps({"yaw": np.pi, "pitch": 0.0, "links": [0.0, np.pi / 2]})
    row = spark.createDataFrame([(text,), ("{}",)], "d string").select(*readers.pano_meta(F.col("d"))).collect()
    assert (row[0]["yaw_deg"], row[0]["roll_deg"], row[0]["link_bearings_deg"]) == (180.0, None, "0.000;90.000") and row[1]["yaw_deg"] is None


# ------------------------------------------------------------------ S15


LEGACY = readers.Branch("legacy", {"point": {"label_id", "sv_image_x"}, "label": {"label_id", "panorama"}}, lambda t: t["point"].join(t["label"], "label_id").select("label_id", F.col("panorama").alias("pano_id"), F.lit(None).cast("int").alias("width")))
MODERN = readers.Branch(
    "modern", {"point": {"label_id", "pano_x"}, "label": {"label_id", "pano_id"}, "pano": {"pano_id", "width"}},
    lambda t: t["point"].where("pano_x IS NOT NULL").join(t["label"], "label_id").join(t["pano"], "pano_id", "left").select("label_id", "pano_id", "width"),
)


@pytest.fixture
def catalog(spark):
    made = ["walk_dc", "walk_old_backup", "walk_ny", "other"]
    for d in made:
        spark.sql(f"CREATE DATABASE {d}")
    put = lambda d, t, rows, schema: spark.createDataFrame(rows, schema).write.saveAsTable(f"{d}.{t}")
    put("walk_dc", "point", [(1, 5), (2, 6)], "label_id long, sv_image_x int")
    put("walk_dc", "label", [(1, "a"), (2, "b")], "label_id long, panorama string")
    for d in ("walk_ny", "other", "walk_old_backup"):
        put(d, "point", [(1, 5), (2, None), (3, 7)], "label_id long, pano_x int")
        put(d, "label", [(1, "p"), (2, "q"), (3, "r")], "label_id long, pano_id string")
        put(d, "pano", [("p", 100)], "pano_id string, width int")
    yield spark
    for d in made:
        spark.sql(f"DROP DATABASE {d} CASCADE")


def test_catalog_discovery_with_two_versions(catalog):
    exclude = {"walk_old_backup"}
    assert readers.discovered(catalog, "walk_*", exclude) == ["walk_dc", "walk_ny"]
    rows = readers.extract_catalog(catalog, "walk_*", [LEGACY, MODERN], "walk_", exclude)
    assert sorted(rows.select("city", "schema_version", "label_id", "pano_id", "width").collect()) == [("dc", "legacy", 1, "a", None), ("dc", "legacy", 2, "b", None), ("ny", "modern", 1, "p", 100), ("ny", "modern", 3, "r", None)]
    plan = rows.where("label_id = 3")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("EqualTo(label_id,3)") == 4  # both tables with ids of both cities
    assert "ReadSchema: struct<label_id:bigint>" in plan  # what the union does not need is not read
    with pytest.raises(readers.NoBranch, match="walk_dc"):
        readers.extract_catalog(catalog, "walk_*", [MODERN], "walk_", exclude)


# ------------------------------------------------------------------ K04, K05, K06, K10


def test_sinks_on_files(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"abc")
    assert [tuple(r) for r in readers.sha256_of_files(spark, str(tmp_path / "a.bin")).collect()] == [("a.bin", "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad")]
    row = spark.createDataFrame([([1, 2], None, True)], "l array<int>, n double, b boolean").select(writers.csv_cell(F.col("l"), "array<int>").alias("l"), writers.csv_cell(F.col("n"), "double").alias("n"), writers.csv_cell(F.col("b"), "boolean").alias("b")).first()
    assert tuple(row) == ("[1,2]", "", "true")
    tiles = spark.createDataFrame([("p", x, y, "z", 2, 2) for x in (0, 1) for y in (0, 1)] + [("q", 0, 0, "z", 2, 2), ("q", 0, 0, "z", 2, 2)], "pano_id string, x int, y int, b64 string, c int, r int")
    got = writers.complete_tiles(tiles, ["pano_id"], "c", "r").collect()
    assert [r["pano_id"] for r in got] == ["p"] and [(t["x"], t["y"]) for t in got[0]["tiles"]] == [(0, 0), (0, 1), (1, 0), (1, 1)]


def test_an_overwrite_may_read_what_it_replaces(spark, tmp_path):
    path = str(tmp_path / "t")
    assert writers.guarded_overwrite(spark.range(5), path) == 5
    grown = spark.read.parquet(path).unionByName(spark.range(5, 8))
    assert writers.guarded_overwrite(grown, path) == 8 and spark.read.parquet(path).count() == 8
    with pytest.raises(writers.ShrinkError):
        writers.guarded_overwrite(spark.read.parquet(path).where("id < 3"), path)
    assert spark.read.parquet(path).count() == 8 and not list(tmp_path.glob("t.*"))


# ------------------------------------------------------------------ R16


def write_jpeg(spark, path, image):
    """A picture as a JPEG file, by the JVM's own encoder."""
    jvm = spark._jvm
    height, width = image.shape[:2]
    picture = jvm.java.awt.image.BufferedImage(width, height, 1)
    flat = (image[..., 0].astype(int) << 16 | image[..., 1].astype(int) << 8 | image[..., 2]).ravel().tolist()
    numbers = spark.sparkContext._gateway.new_array(jvm.int, len(flat))
    for k, v in enumerate(flat):
        numbers[k] = v
    picture.setRGB(0, 0, width, height, numbers, 0, width)
    path.parent.mkdir(parents=True, exist_ok=True)
    assert jvm.javax.imageio.ImageIO.write(picture, "jpg", jvm.java.io.File(str(path)))


def test_jpeg_tiles_become_the_panorama(spark, tmp_path):
    y, x = np.mgrid[0:40, 0:72]
    whole = {p: np.stack([x * 3 + s, y * 5, 255 - x * 2 - y], axis=-1).clip(0, 255).astype(np.uint8) for p, s in (("pano-a", 0), ("pano_b", 30))}
    for p, image in whole.items():
        for tx in range(3):
            for ty in range(2):
                write_jpeg(spark, tmp_path / p / f"{tx}_{ty}.jpg", image[ty * 32 : ty * 32 + 32, tx * 32 : tx * 32 + 32])  # the last ones are smaller
    sizes = spark.createDataFrame([(p, 72, 40, 32, 32) for p in (*whole, "no-files")], "pano_id string, width int, height int, tile_width int, tile_height int")
    got = {r["pano_id"]: r for r in depth.stitched_images(readers.image_tiles(spark, str(tmp_path / "*")), sizes).collect()}
    assert set(got) == set(whole)
    for p, image in whole.items():
        seen = np.frombuffer(got[p]["rgb"], np.uint8).reshape(40, 72, 3).astype(int)
        assert np.abs(seen - image).mean() < 3 and np.abs(seen - image).max() < 40  # the codec's error
    (tmp_path / "pano-a" / "3_0.jpg").write_bytes(base64.b64decode("AAAA"))
    with pytest.raises(Exception, match="no image"):
        readers.image_tiles(spark, str(tmp_path / "*")).collect()


def test_grey_images_and_alpha(spark):
    rows = [("g", 0, 0, 2, 1, 1, bytearray([7, 9])), ("a", 0, 0, 1, 1, 4, bytearray([1, 2, 3, 255]))]
    df = spark.createDataFrame(rows, "pano_id string, tx int, ty int, tile_width int, tile_height int, channels int, pixels binary")
    assert {r["pano_id"]: list(r["rgb"]) for r in depth.bgr_to_rgb(df).collect()} == {"g": [7, 7, 7, 9, 9, 9], "a": [3, 2, 1]}
