"""Sources. Every reader declares its schema, so that nothing is inferred, and goes through Spark's own
file systems, so that any store works."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas


def flag(name: str) -> Column:
    """t, f, true and false in any case; anything else is missing."""
    text = F.lower(F.trim(F.col(name)))
    return F.when(text.isin("t", "true"), True).when(text.isin("f", "false"), False)


def strict_flag(name: str) -> Column:
    """t or f; anything else is an error."""
    return F.when(F.col(name) == "t", True).when(F.col(name) == "f", False).otherwise(F.raise_error(F.concat(F.lit(f"{name} is neither t nor f: "), F.coalesce(F.col(name), F.lit("NULL")))).cast("boolean"))


def no_nan(df: DataFrame) -> DataFrame:
    """Every NaN of a double column becomes NULL."""
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def file_part(pattern: str) -> Column:
    """A value from the name of the file that a row came from."""
    return F.regexp_extract(F.col("_metadata.file_name"), pattern, 1)


def historical_labels(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Gz CSV files labels-<city>-latlng.csv(.gz) in one scan; city from the file name."""
    raw = spark.read.csv(paths, schema=schemas.HISTORICAL, header=True, mode="FAILFAST", enforceSchema=False)
    raw = raw.select("*", file_part(r"labels-(.+)-latlng").alias("city"))
    return no_nan(raw.withColumns({"deleted": flag("deleted"), "tutorial": flag("tutorial"), "time_created": F.to_timestamp("time_created")}))


def modern_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Modern-labels-<city>.csv(.gz); adds city and the key label_uid, which must be unique."""
    from lodemark.operators.joins import require_unique

    raw = spark.read.csv(f"{folder}/modern-labels-*.csv*", schema=schemas.MODERN, header=True, mode="FAILFAST", enforceSchema=False)
    raw = raw.select("*", file_part(r"modern-labels-(.+?)\.csv").alias("city"))
    out = no_nan(raw.withColumns({"is_ai": strict_flag("is_ai"), "time_created": F.to_timestamp("time_created"), "label_uid": F.concat_ws(":", "city", "label_id")}))
    return require_unique(out, ["label_uid"])


def panos(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with an explicit schema in which identifiers are strings."""
    return spark.read.csv(path, schema=schema, header=True, mode="FAILFAST", enforceSchema=False)


def sites(spark: SparkSession, path: str) -> DataFrame:
    """Nested sites."""
    return spark.read.json(path, schema=schemas.SITES)


def members(sites_df: DataFrame) -> DataFrame:
    """One row per site member; a missing in_refit counts as true."""
    return sites_df.select("site_id", F.posexplode("members").alias("place", "m")).select("site_id", "place", "m.*").withColumn("in_refit", F.coalesce("in_refit", F.lit(True)))


def payloads(spark: SparkSession, path: str, schema: str = schemas.PAYLOADS) -> DataFrame:
    """base64 depth payloads; decode with operators.depth.decoded."""
    return spark.read.json(path, schema=schema)


def tiles(spark: SparkSession, path: str) -> DataFrame:
    """Tile records; of repeated (pano_id, set) the last line of the last file wins."""
    raw = spark.read.json(path, schema=schemas.TILES).select("*", F.col("_metadata.file_name").alias("_f"), F.monotonically_increasing_id().alias("_n"))
    last = F.max_by(F.struct(*[c for c in raw.columns if not c.startswith("_")]), F.struct("_f", "_n"))
    return raw.groupBy("pano_id", "set").agg(last.alias("r")).select("r.*")


def optional(read, spark: SparkSession, schema: str) -> DataFrame:
    """What read() gives, or an empty table of the schema where the path is missing."""
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def key_list(spark: SparkSession, path: str) -> DataFrame:
    """The keys of a fixed split."""
    return spark.read.csv(path, schema="label_id long, city string", header=True, mode="FAILFAST", enforceSchema=False)


def coefficients(text: str) -> dict:
    """Blend parameters from a JSON summary: the newest place first, then the older ones."""
    whole = json.loads(text)
    places = [("final", "blend"), ("candidate", "params"), ("blend",), ()]
    for place in places:
        found = reduce(lambda at, k: at.get(k) if isinstance(at, dict) else None, place, whole)
        if isinstance(found, dict) and "blend_deg" in found and ("height_m" in found or "height_by_type_m" in found):
            return found
    raise ValueError("the summary holds no blend parameters")


def jdbc(spark: SparkSession, url: str, tables: list[str], schema: str, properties: dict | None = None) -> dict[str, DataFrame]:
    """Tables of one database schema; filters and columns are pushed down by the joins on them."""
    return {t: spark.read.jdbc(url, f"{schema}.{t}", properties=properties or {}) for t in tables}


class NoBranch(ValueError):
    """A schema has the columns of no known version."""


@dataclass(frozen=True)
class Branch:
    """A version of a city's schema: the columns that tell it, by table, and the extraction from its tables.

    Of several versions whose columns are all there the first in the list is taken.
    """

    name: str
    needs: dict[str, set[str]]
    build: Callable[[dict[str, DataFrame]], DataFrame]

    def fits(self, columns: dict[str, set[str]]) -> bool:
        return all(need <= columns.get(table, set()) for table, need in self.needs.items())


def discovered(spark: SparkSession, like: str, exclude: set[str] = frozenset()) -> list[str]:
    """The schemas of the current catalog whose names match a pattern (* and |), but the excluded ones, by name."""
    return sorted(d.name for d in spark.catalog.listDatabases(like) if d.name not in exclude)


def catalog_columns(spark: SparkSession, database: str) -> dict[str, set[str]]:
    """The tables of a schema and the columns of each, from the catalog alone."""
    return {t.name: {c.name for c in spark.catalog.listColumns(f"{database}.{t.name}")} for t in spark.catalog.listTables(database) if not t.isTemporary}


def jdbc_columns(spark: SparkSession, url: str, like: str, properties: dict | None = None) -> dict[str, dict[str, set[str]]]:
    """The same of a database's information_schema, for all schemas LIKE a pattern in one small read."""
    query = f"(SELECT table_schema AS s, table_name AS t, column_name AS c FROM information_schema.columns WHERE table_schema LIKE '{like}') AS found"
    out: dict[str, dict[str, set[str]]] = {}
    for r in spark.read.jdbc(url, query, properties=properties or {}).collect():  # one row a column of the schemas
        out.setdefault(r["s"], {}).setdefault(r["t"], set()).add(r["c"])
    return out


def extracted(columns: dict[str, dict[str, set[str]]], branches: list[Branch], table: Callable[[str, str], DataFrame], prefix: str = "", exclude: set[str] = frozenset()) -> DataFrame:
    """One row set of all schemas: each read by the first branch that its columns fit, with its city (the name
    without the prefix) and the branch's name, put together by column name.

    table(schema, name) gives a table; filters of a branch, and of whoever reads the result, reach its source.
    """
    parts = {}
    for schema, own in columns.items():
        if schema in exclude:
            continue
        branch = next((b for b in branches if b.fits(own)), None)
        if branch is None:
            raise NoBranch(f"{schema} has the columns of no known version")
        rows = branch.build({t: table(schema, t) for t in branch.needs})
        parts[schema] = rows.select("*", F.lit(schema.removeprefix(prefix)).alias("city"), F.lit(branch.name).alias("schema_version"))
    return union_of(parts)


def extract_catalog(spark: SparkSession, like: str, branches: list[Branch], prefix: str = "", exclude: set[str] = frozenset()) -> DataFrame:
    """S15 over the session's catalog."""
    columns = {d: catalog_columns(spark, d) for d in discovered(spark, like, exclude)}
    return extracted(columns, branches, lambda d, t: spark.table(f"{d}.{t}"), prefix)


def union_of(parts: dict[str, DataFrame], exclude: set[str] = frozenset()) -> DataFrame:
    """All listed parts but the excluded ones, by column name; columns that some lack are NULL there."""
    kept = [df for name, df in sorted(parts.items()) if name not in exclude]
    if not kept:
        raise ValueError("no part is left")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), kept)


def cached_documents(spark: SparkSession, folders: list[str]) -> DataFrame:
    """JSON documents by file name; of several folders the first that has one."""
    parts = [spark.read.text(f"{f}/*.json", wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"(.+)\.json", 1).alias("key"), F.lit(k).alias("place"), "value") for k, f in enumerate(folders)]
    return reduce(DataFrame.unionByName, parts).groupBy("key").agg(F.min_by("value", "place").alias("document"))


def json_at(document: Column, path: str, kind: str) -> Column:
    """A value deep in a JSON document of arrays by position; NULL where a level is missing, is of another shape or is not
    of the kind, and where the document is no JSON."""
    return F.try_variant_get(F.try_parse_json(document), path, kind)


def depth_b64(document: Column) -> Column:
    """The payload deep in a document; NULL where a level is missing or there is no text."""
    found = json_at(document, "$[1][0][5][0][5][1][2]", "string")
    return F.when(found != "", found)


#: Where a photo document keeps its metadata, by position, and their types.
PHOTO_PATHS = {
    "pano_id": ("$[1][0][1][1]", "string"), "lat": ("$[1][0][5][0][1][0][2]", "double"), "lng": ("$[1][0][5][0][1][0][3]", "double"), "elevation_m": ("$[1][0][5][0][1][1][0]", "double"),
    "heading_deg": ("$[1][0][5][0][1][2][0]", "double"), "tilt_deg": ("$[1][0][5][0][1][2][1]", "double"), "roll_deg": ("$[1][0][5][0][1][2][2]", "double"),
    "capture_year": ("$[1][0][6][7][0]", "int"), "capture_month": ("$[1][0][6][7][1]", "int"), "source": ("$[1][0][6][5][2]", "string"),
}
PHOTO_SIZES = "$[1][0][2][3][0]"
PHOTO_TILE = ("$[1][0][2][3][1][0]", "$[1][0][2][3][1][1]")


def photo_meta(document: Column) -> list[Column]:
    """The flat metadata of a photo document: id, place, angles in degrees, capture date, and the sizes of its
    images as a `;` list of width x height. Pitch is what the tilt from straight down leaves over the horizon.

    A document with missing levels has NULL for what they hold.
    """
    found = {n: json_at(document, p, k) for n, (p, k) in PHOTO_PATHS.items()}
    found["pitch_deg"] = 90 - found.pop("tilt_deg")
    sizes = json_at(document, PHOTO_SIZES, "array<array<array<int>>>")
    text = F.array_join(F.transform(F.filter(sizes, lambda s: (F.size(s) > 0) & (F.size(s[0]) > 1)), lambda s: F.concat(s[0][1], F.lit("x"), s[0][0])), ";")
    return [*[c.alias(n) for n, c in found.items()], F.when(text != "", text).alias("image_sizes")]


def tile_grid(document: Column, zoom: Column) -> list[Column]:
    """Image and tile size at a zoom level, and the columns and rows of tiles that cover it."""
    sizes = json_at(document, PHOTO_SIZES, "array<array<array<int>>>")
    height, width = F.get(F.get(F.get(sizes, zoom), F.lit(0)), F.lit(0)), F.get(F.get(F.get(sizes, zoom), F.lit(0)), F.lit(1))
    tile_width, tile_height = (json_at(document, p, "int") for p in PHOTO_TILE)
    grid = {"width": width, "height": height, "tile_width": tile_width, "tile_height": tile_height, "columns": F.ceil(F.try_divide(width, tile_width)).cast("int"), "rows": F.ceil(F.try_divide(height, tile_height)).cast("int")}
    return [c.alias(n) for n, c in grid.items()]


def image_tiles(spark: SparkSession, path: str, place: str = r"([^/]+)/(\d+)_(\d+)\.jpe?g$") -> DataFrame:
    """Image files as decoded tiles: pano_id, tx, ty, tile_width, tile_height, channels, pixels (rows of blue, green, red).

    Spark's image source decodes in the JVM. `place` finds panorama, tx and ty in a file's path; a file that is no image
    is an error here, since a hole in a panorama would pass for a black one.
    """
    raw = spark.read.format("image").option("dropInvalid", False).load(path).select("image.*")
    size = F.when(F.col("width") > 0, F.col("width")).otherwise(F.raise_error(F.concat(F.lit("no image: "), "origin")).cast("int"))
    parts = {n: F.regexp_extract("origin", place, k).cast(t) for k, (n, t) in enumerate((("pano_id", "string"), ("tx", "int"), ("ty", "int")), 1)}
    return raw.select(*[c.alias(n) for n, c in parts.items()], size.alias("tile_width"), F.col("height").alias("tile_height"), F.col("nChannels").alias("channels"), F.col("data").alias("pixels"))


def pano_meta(document: Column) -> list[Column]:
    """Yaw, pitch and roll in degrees and the link bearings as a `;` list."""
    angle = [F.degrees(F.get_json_object(document, f"$.{k}").cast("double")).alias(f"{k}_deg") for k in ("yaw", "pitch", "roll")]
    links = F.from_json(F.get_json_object(document, "$.links"), "array<double>")
    return [*angle, F.concat_ws(";", F.transform(links, lambda x: F.format_string("%.3f", F.degrees(x)))).alias("link_bearings_deg")]


#: The columns of an imported panorama, their types, and where each is in its record.
PANO_COLUMNS = {
    "source": ("string", "pano.source"), "pano_id": ("string", "pano.panorama_id"), "sequence_id": ("string", "pano.sequence_id"),
    "capture_date": ("string", "pano.capture_date"), "captured_at_ms": ("long", "pano.source_metadata.captured_at"),
    "width": ("long", "pano.width"), "height": ("long", "pano.height"), "lat": ("double", "pano.lat"), "lng": ("double", "pano.lng"),
    "camera_heading": ("double", "pano.camera_heading"), "camera_pitch": ("double", "pano.camera_pitch"), "camera_roll": ("double", "pano.camera_roll"),
    "camera_make": ("string", "pano.camera_make"), "camera_model": ("string", "pano.camera_model"), "camera_type": ("string", "pano.camera_type"),
    "camera_parameters": ("string", "pano.source_metadata.camera_parameters"), "quality_score": ("double", "pano.quality_score"),
    "altitude": ("double", "pano.source_metadata.altitude"), "computed_altitude": ("double", "pano.source_metadata.computed_altitude"),
    "atomic_scale": ("double", "pano.source_metadata.atomic_scale"), "compass_angle": ("double", "pano.source_metadata.compass_angle"),
    "computed_compass_angle": ("double", "pano.source_metadata.computed_compass_angle"),
    "raw_lat": ("double", "pano.source_metadata.geometry.coordinates[1]"), "raw_lng": ("double", "pano.source_metadata.geometry.coordinates[0]"),
    "computed_rotation_x": ("double", "pano.source_metadata.computed_rotation[0]"), "computed_rotation_y": ("double", "pano.source_metadata.computed_rotation[1]"),
    "computed_rotation_z": ("double", "pano.source_metadata.computed_rotation[2]"), "creator_username": ("string", "pano.source_metadata.creator.username"),
    "creator_id": ("string", "pano.source_metadata.creator.id"), "exif_orientation": ("long", "pano.source_metadata.exif_orientation"),
    "merge_cc": ("long", "pano.source_metadata.merge_cc"), "copyright": ("string", "pano.copyright"),
}


def pano_rows(records: DataFrame, run: str, value: str = "value") -> DataFrame:
    """34 flat columns from nested JSON records (a column of text); missing levels are NULL. A record without a
    panorama id is an error."""
    found = {c: F.get_json_object(value, f"$.{path}").cast(kind) for c, (kind, path) in PANO_COLUMNS.items()}
    found["pano_id"] = F.coalesce(found["pano_id"], F.raise_error(F.lit("a record has no panorama id")).cast("string"))
    detections = F.coalesce(F.json_array_length(F.get_json_object(value, "$.detections")), F.lit(0))
    return records.select(F.lit(run).alias("run"), *[c.alias(n) for n, c in found.items()], detections.alias("n_detections"))


def sha256_of_files(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of whole files."""
    return spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_name").alias("file"), F.sha2("content", 256).alias("sha256"))
