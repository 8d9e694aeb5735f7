"""Sinks: deterministic files, summaries, guarded overwrites."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ShrinkError(RuntimeError):
    """A guarded overwrite would lose rows."""


def contract(df: DataFrame, columns: list[tuple[str, str]]) -> DataFrame:
    """The columns of a contract in its order; absent ones are NULL."""
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in columns])


def sorted_csv(df: DataFrame, path: str, keys: list[str], single: bool = False) -> None:
    """Rows in key order. One file only for small results (single); else ranges in order."""
    ordered = df.orderBy(*[F.asc_nulls_last(k) for k in keys])
    (ordered.coalesce(1) if single else ordered).write.mode("overwrite").csv(path, header=True, compression="gzip")


def unique_jsonl(df: DataFrame, path: str, key: str, order: list[str]) -> None:
    """One line per key, the first in order."""
    rest = [c for c in df.columns if c != key]
    first = df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(key, "r.*")
    first.select(*df.columns).orderBy(key).write.mode("overwrite").json(path, compression="gzip")


def summary(rows: DataFrame, keys: list[str], most: int = 100_000) -> dict:
    """Nested dict of a small long-format result. An error beyond `most` rows, nothing is cut off."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"a summary holds at most {most} rows")
    out: dict = {}
    for r in found:
        at = out
        for k in keys:
            at = at.setdefault(str(r[k]), {})
        at.update({c: r[c] for c in rows.columns if c not in keys})
    return out


def summary_json(rows: DataFrame, keys: list[str]) -> str:
    return json.dumps(summary(rows, keys), indent=1, sort_keys=True, default=str)


def guarded_overwrite(df: DataFrame, path: str) -> int:
    """Writes df over path unless it has fewer rows than what is there. Returns the rows written.

    The new table is written beside the old one and counted there, so df may read path, and what is at path is whole
    at any time but between two renames, when the old table is at path + ".old".
    """
    spark = df.sparkSession
    place, fresh, old = (spark._jvm.org.apache.hadoop.fs.Path(path + end) for end in ("", ".new", ".old"))
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    exists = store.exists(place)
    df.write.mode("overwrite").parquet(path + ".new")
    new, before = spark.read.schema(df.schema).parquet(path + ".new").count(), spark.read.parquet(path).count() if exists else 0
    if new < before:
        store.delete(fresh, True)
        raise ShrinkError(f"{path} has {before} rows, the new table {new}")
    store.delete(old, True)
    if exists and not store.rename(place, old) or not store.rename(fresh, place):
        raise OSError(f"cannot move the new table to {path}")
    store.delete(old, True)
    return new


def csv_cell(value: Column, kind: str) -> Column:
    """Text of a cell: lists as compact JSON, missing as empty."""
    return F.coalesce(F.to_json(value) if kind.startswith(("array", "struct", "map")) else value.cast("string"), F.lit(""))


def complete_tiles(tiles: DataFrame, key: list[str], columns: str, rows: str) -> DataFrame:
    """Per key the tiles in order; keys that lack a tile are dropped."""
    packed = tiles.groupBy(*key, columns, rows).agg(F.array_sort(F.collect_set(F.struct("x", "y", "b64"))).alias("tiles"))
    return packed.where(F.size("tiles") == F.col(columns) * F.col(rows))
