"""Bare depth payloads as relations: a second decoder, in built-in expressions alone, and what is counted from its cells.

A bare payload is URL-safe base64 without padding of a header, one byte a cell and four 32-bit floats a plane.
Deflated payloads, NULLs and texts that are no whole payload give no row here; `depth.decode` reads deflated ones.
Keys name one payload each.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import depth

#: Bytes of the header, as its first byte says, and the places (from 1) of its numbers.
HEADER, PLANES_AT, WIDTH_AT, HEIGHT_AT, OFFSET_AT = 8, 2, 4, 6, 8
PLANE_BYTES = 16
#: Least |z| of a level plane's normal.
LEVEL_Z = 0.95


def number_at(raw: Column, at: Column | int, n: int) -> Column:
    """The unsigned little-endian number of n bytes at a place (from 1) of a binary column."""
    at = F.lit(at) if isinstance(at, int) else at
    turned = F.concat(*[F.substring(raw, at + k, 1) for k in reversed(range(n))])
    return F.conv(F.hex(turned), 16, 10).cast("long")


def float_of(bits: Column) -> Column:
    """The double equal to the 32-bit float with these bits."""
    power, rest = F.shiftright(bits, 23).bitwiseAND(F.lit(255)), bits.bitwiseAND(F.lit((1 << 23) - 1))
    size = (
        F.when(power == 0, rest * F.pow(F.lit(2.0), F.lit(-149.0)))
        .when(power < 255, (rest + (1 << 23)) * F.pow(F.lit(2.0), (power - 150).cast("double")))
        .when(rest == 0, F.lit(float("inf")))
        .otherwise(F.lit(float("nan")))
    )
    return F.when(bits >= 1 << 31, -size).otherwise(size)


def _binary(text: Column) -> Column:
    """The bytes of URL-safe base64 without padding; NULL where it is none."""
    plain = F.replace(F.replace(text, F.lit("-"), F.lit("+")), F.lit("_"), F.lit("/"))
    return F.try_to_binary(F.rpad(plain, (F.ceil(F.length(text) / 4) * 4).cast("int"), F.lit("=")), F.lit("base64"))


def bare(payloads: DataFrame, key: str = "pano_id", *carry: str) -> DataFrame:
    """key, columns to carry, raw, n_planes, width, height, at (the place of the first cell, from 1) of the bare payloads.

    The header is read from the first twelve characters and the size from the text's length, so that filters, which
    Catalyst moves below the projection, decode no whole payload to test a header. The bytes leave a generator of one
    row, so that what reads them line by line does not decode the payload for every line.
    """
    head = payloads.select(key, *carry, "b64", _binary(F.substring("b64", 1, 12)).alias("head"))
    numbers = {"n_planes": PLANES_AT, "width": WIDTH_AT, "height": HEIGHT_AT, "at": OFFSET_AT}
    is_bare = (F.length("head") > HEADER) & (F.hex(F.substring("head", 1, 1)) == f"{HEADER:02X}")
    read = head.where(is_bare).select(key, *carry, "b64", *[number_at(F.col("head"), at, 2).alias(name) for name, at in numbers.items()])
    end = F.col("at") + F.col("width") * F.col("height") + F.col("n_planes") * PLANE_BYTES
    whole = read.where((F.floor(F.length("b64") * 3 / 4) >= end) & (F.col("width") > 0) & (F.col("height") > 0))
    numbered = whole.select(key, *carry, "b64", "n_planes", "width", "height", (F.col("at") + 1).alias("at"))
    return numbered.select(key, *carry, F.explode(F.array(_binary(F.col("b64")))).alias("raw"), "n_planes", "width", "height", "at").where("raw IS NOT NULL")


def lines(payloads: DataFrame, key: str = "pano_id") -> DataFrame:
    """key, width, height, row and the bytes of each row of cells."""
    cut = F.transform(F.sequence(F.lit(0).cast("long"), F.col("height") - 1), lambda r: F.substring(F.col("raw"), (F.col("at") + r * F.col("width")).cast("int"), F.col("width").cast("int")))
    return bare(payloads, key).select(key, "width", "height", F.posexplode(cut).alias("row", "line"))


def cells(payloads: DataFrame, key: str = "pano_id") -> DataFrame:
    """key, width, height, row, col, plane: a row a cell."""
    each = lines(payloads, key).select(key, "width", "height", "row", "line", F.explode(F.sequence(F.lit(0), F.col("width").cast("int") - 1)).alias("col"))
    return each.select(key, "width", "height", "row", "col", number_at(F.col("line"), F.col("col") + 1, 1).cast("int").alias("plane"))


def planes(payloads: DataFrame, key: str = "pano_id") -> DataFrame:
    """key, plane, nx, ny, nz, offset_m: a row a plane, plane 0 (none) included."""
    first = F.col("at") + F.col("width") * F.col("height")
    kept = bare(payloads, key).select(key, F.substring(F.col("raw"), first.cast("int"), (F.col("n_planes") * PLANE_BYTES).cast("int")).alias("table"), "n_planes")
    each = kept.where("n_planes > 0").select(key, "table", F.explode(F.sequence(F.lit(0), F.col("n_planes").cast("int") - 1)).alias("plane"))
    return each.select(key, "plane", *[float_of(number_at(F.col("table"), F.col("plane") * PLANE_BYTES + 4 * k + 1, 4)).alias(name) for k, name in enumerate(("nx", "ny", "nz", "offset_m"))])


def plane_inventory(payloads: DataFrame, key: str = "pano_id") -> DataFrame:
    """Key, plane, tilt_deg, offset_m, n_cells, n_below, is_ground for every plane but 0.

    Cells are counted in the tasks; only counts are shuffled. The ground is the level plane with the most
    cells below the horizon, the first of equals; a payload without one has none.
    """
    below = F.col("row") >= F.floor(F.col("height") / 2)
    counted = cells(payloads, key).groupBy(key, "plane").agg(F.count(F.lit(1)).alias("n_cells"), F.count_if(below).alias("n_below"))
    zero = F.lit(0).cast("long")
    found = planes(payloads, key).where("plane > 0").join(counted, [key, "plane"], "left")
    found = found.withColumns({"n_cells": F.coalesce("n_cells", zero), "n_below": F.coalesce("n_below", zero)})
    level = F.when((F.abs("nz") > LEVEL_Z) & ~F.isnan("nz"), F.col("n_below")).otherwise(zero)
    best = F.max(F.struct(level.alias("n"), (-F.col("plane")).alias("p"))).over(Window.partitionBy(key))
    tilt = F.degrees(F.acos(F.least(F.abs("nz"), F.lit(1.0))))
    return found.withColumn("best", best).select(key, "plane", tilt.alias("tilt_deg"), "offset_m", "n_cells", "n_below", ((F.col("best.n") > 0) & (F.col("best.p") == -F.col("plane"))).alias("is_ground"))


def _with_cells(payloads: DataFrame, key: str) -> DataFrame:
    """key, b64 and the other decoder's cells, as they are and with columns mirrored; a payload at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for k, text in frame.itertuples(index=False):
                _, r = depth._status(text)
                if r is not None:
                    yield pd.DataFrame({key: [k], "b64": [text], "other": [r.cells.tobytes()], "turned": [r.cells[:, ::-1].tobytes()]})

    return payloads.select(key, "b64").mapInPandas(run, f"`{key}` {dict(payloads.dtypes)[key]}, b64 string, other binary, turned binary")


def decoder_check(payloads: DataFrame, key: str = "pano_id") -> DataFrame:
    """R18, check A: the two decoders cell by cell, in payload order and with columns mirrored.

    key, n_cells, n_same, n_mirrored (cells equal to the other decoder's at the same column, and at the mirrored one).
    The other decoder's cells travel with their payload, so that no side is shuffled or broadcast. Equal lines are counted
    whole, others cell by cell; only counts are shuffled.
    """
    width = F.col("width").cast("int")

    def line(raw: str, first: Column, r: Column) -> Column:
        return F.substring(F.col(raw), (first + r * F.col("width")).cast("int"), width)

    first = F.lit(1).cast("long")
    cut = F.transform(F.sequence(F.lit(0).cast("long"), F.col("height") - 1), lambda r: F.struct(line("raw", F.col("at"), r).alias("line"), line("other", first, r).alias("other"), line("turned", first, r).alias("turned")))
    each = bare(_with_cells(payloads, key), key, "other", "turned").select(key, "width", F.inline(cut))
    whole = (F.col("line") == F.col("other")) & (F.col("line") == F.col("turned"))
    places = F.when(whole, F.array(F.lit(0))).otherwise(F.sequence(F.lit(1), width))
    cells_of = each.select(key, "width", "line", "other", "turned", F.explode(places).alias("col"))
    own = F.substring("line", F.col("col"), F.lit(1))
    # Column 0 stands for a whole line that is equal both ways.
    n = F.when(F.col("col") == 0, F.col("width")).otherwise(1)
    same = [F.when(F.col("col") == 0, F.col("width")).when(own == F.substring(c, F.col("col"), F.lit(1)), 1).otherwise(0) for c in ("other", "turned")]
    return cells_of.groupBy(key).agg(F.sum(n).alias("n_cells"), F.sum(same[0]).alias("n_same"), F.sum(same[1]).alias("n_mirrored"))
