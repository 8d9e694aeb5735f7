"""Aggregations beyond the built-ins, and the ordering rules that make them deterministic."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodemark.session import checkpointed

from .quantiles import beside, quantile, quantiles

#: Bins beyond this number are found by binary search: as branches they are longer than the JVM compiles.
MOST_BRANCHES = 32


def rounded(c: Column, name: str, digits: int = 6) -> Column:
    return F.round(c, digits).alias(name)


def error_metrics(df: DataFrame, by: list[str], models: dict[str, Column], truth: Column, least: int = 1) -> DataFrame:
    """Per group and model the median absolute, signed median and 90th percentile absolute error
    and the slope of the error on the truth, for all models in one pass; groups under `least` rows are left out."""
    wanted, slopes = {}, []
    for k, p in models.items():
        e = p - truth
        wanted |= {f"{k}_median": (F.abs(e), 0.5), f"{k}_signed": (e, 0.5), f"{k}_p90": (F.abs(e), 0.9)}
        slopes.append(rounded(F.regr_slope(e, truth), f"{k}_slope"))
    return quantiles(df, by, wanted, slopes).where(F.col("n") >= least)


def mode_per_group(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """The most frequent value; of equal counts the smallest, a missing value counts and comes last."""
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    best = F.min_by(F.struct(value, "n"), F.struct((-F.col("n")).alias("c"), F.col(value).isNull().alias("z"), F.col(value).alias("v")))
    return counts.groupBy(*by).agg(best.alias("b")).select(*by, F.col("b")[value].alias(value), F.col("b")["n"].alias("n"))


def first_by(value: str, order: Column) -> Column:
    """The first non-missing value in a given order."""
    return F.min_by(value, F.when(F.col(value).isNotNull(), order))


def within_slopes(df: DataFrame, group: str, pairs: dict[str, tuple[Column, Column]], sums: dict[str, Column] | None = None) -> DataFrame:
    """Slopes of y on x, both less their group mean, with standard errors, for all pairs (x, y) at once: n, groups, and for
    each pair <name>_slope and <name>_se; sums over all rows come along. One row.

    Group sums come first, so that only a row per group is gathered. Without real variation of x within
    groups slope and error are NULL.
    """
    wide = df.select(group, *[c.cast("double").alias(f"{a}_{k}") for k, xy in pairs.items() for a, c in zip("xy", xy, strict=True)], *[c.cast("double").alias(f"s_{k}") for k, c in (sums or {}).items()])
    moments = []
    for k in pairs:
        x, y = F.col(f"x_{k}"), F.col(f"y_{k}")
        moments += [F.sum(v).alias(f"{m}_{k}") for m, v in (("x", x), ("y", y), ("xx", x * x), ("xy", x * y), ("yy", y * y))]
    g = wide.groupBy(group).agg(F.count(F.lit(1)).alias("n"), *moments, *[F.sum(f"s_{k}").alias(f"s_{k}") for k in sums or {}])
    totals = []
    for k in pairs:
        for m, (a, b) in {"xx": "xx", "xy": "xy", "yy": "yy"}.items():
            totals.append(F.sum(F.col(f"{m}_{k}") - F.col(f"{a}_{k}") * F.col(f"{b}_{k}") / F.col("n")).alias(f"{m}_{k}"))
    s = g.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("groups"), *totals, *[F.sum(f"s_{k}").alias(k) for k in sums or {}])
    out = []
    for k in pairs:
        xx, xy, yy = (F.col(f"{m}_{k}") for m in ("xx", "xy", "yy"))
        real = xx >= F.col("n") * 1e-8
        slope = F.when(real, F.try_divide(xy, xx))
        dof = F.greatest(F.col("n") - F.col("groups") - 1, F.lit(1))
        out += [slope.alias(f"{k}_slope"), F.when(real, F.sqrt(F.try_divide(F.greatest(yy - slope * xy, F.lit(0.0)) / dof, xx))).alias(f"{k}_se")]
    return s.select("n", "groups", *out, *(sums or {}))


def within_slope(df: DataFrame, group: str, x: Column, y: Column) -> DataFrame:
    """Slope of y on x, both less their group mean, with its standard error; one row."""
    return within_slopes(df, group, {"one": (x, y)}).select("n", "groups", F.round("one_slope", 4).alias("slope"), F.round("one_se", 4).alias("se"))


def mad(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Median and median absolute deviation from it."""
    middle = quantiles(df, by, {"_m": (F.col(value), 0.5)}, digits=None)
    joined = beside(df, middle, by)
    return quantiles(joined, by, {"mad": (F.abs(F.col(value) - F.col("_m")), 0.5)}, [rounded(F.max("_m"), "median")]).select(*by, "median", "mad")


def quantile_bins(df: DataFrame, value: str, n: int) -> tuple[DataFrame, list[float]]:
    """Right-closed bins at n equal quantiles, equal edges dropped; the lowest value is in the first."""
    from lodemark.functions.numeric import closed_bin

    edges = sorted({e for e in quantile(df, F.col(value), [k / n for k in range(n + 1)]) if e is not None})
    if len(edges) < 2:
        return df.select("*", F.lit(0).alias("bin")), edges
    if len(edges) > MOST_BRANCHES:
        return _searched_bins(df, value, edges), edges
    return df.select("*", closed_bin(F.col(value), edges, include_lowest=True).alias("bin")), edges


def _searched_bins(df: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """df with the right-closed bin of a value by binary search; NULL outside the edges."""

    def run(batches):
        for batch in batches:
            column = batch.column(value).cast(pa.float64())
            x = column.fill_null(math.nan).to_numpy(zero_copy_only=False)
            bins = np.maximum(np.searchsorted(edges, x, side="left") - 1, 0).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bins, mask=~((x >= edges[0]) & (x <= edges[-1])))], [*batch.schema.names, "bin"])

    return df.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), "bin int"]))


#: Half-widths of the rank ranges that may hold the medians of all resamples; 0.5 is everything.
_HALVES = [0.5, 0.25, 0.12, 0.06, 0.03, 0.015, 0.008, 0.004, 0.002, 0.001]


def poisson_weights(keys: np.ndarray, resamples: np.ndarray) -> np.ndarray:
    """Poisson(1) weights of rows (their 64-bit keys) in resamples, by a hash of both."""
    steps = np.cumsum(np.exp(-1.0) / np.array([math.factorial(k) for k in range(12)]))
    x = keys.astype(np.uint64)[:, None] ^ (resamples.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(factor)
    x ^= x >> np.uint64(33)
    return np.searchsorted(steps, (x >> np.uint64(11)) / 2.0**53, side="right")


def bootstrap_median(df: DataFrame, by: list[str], value: str, key: str, resamples: int = 1000) -> DataFrame:
    """95 % interval of the lower median, from Poisson(1) weights by a hash of (key, resample).

    Same rows, same answer, however they are partitioned: a row's weights depend on its key alone. The medians
    of all resamples lie within eight standard errors of rank n/2, so each task adds up its weights per
    resample, in all and below that range, and only the rows within the range, 16 sqrt(n) or so, are gathered.
    """
    import pandas as pd

    known = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"), F.xxhash64(key).alias("_k"))
    shares = [s for h in _HALVES[1:] for s in (0.5 - h, 0.5 + h)]
    edges = known.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("_v", shares, 10_000).alias("_e"))
    low, high = F.lit(-math.inf), F.lit(math.inf)
    for k, h in enumerate(_HALVES[1:]):
        fits = 8 / F.sqrt("n") / 2 + 2e-4 < h
        low, high = F.when(fits, F.get("_e", 2 * k)).otherwise(low), F.when(fits, F.get("_e", 2 * k + 1)).otherwise(high)
    groups = checkpointed(edges.select(*by, "n", low.alias("_low"), high.alias("_high")))
    rows = beside(known, groups, by)
    everyone = np.arange(resamples)

    def totals(batches):
        found: dict = {}
        for batch in batches:
            names = list(zip(*[batch.column(c).to_pylist() for c in by], strict=True)) if by else [()] * batch.num_rows
            index = {g: k for k, g in enumerate(dict.fromkeys(names))}
            code = np.fromiter(map(index.__getitem__, names), np.int64, len(names))
            below = batch.column("_v").to_numpy() < batch.column("_low").to_numpy()
            keys = batch.column("_k").to_numpy()
            for g, k in index.items():
                own = found.setdefault(g, np.zeros((2, resamples), np.int64))
                mine = np.flatnonzero(code == k)
                for i in range(0, len(mine), 2048):
                    w = poisson_weights(keys[mine[i : i + 2048]], everyone)
                    own += np.stack([w.sum(axis=0), w[below[mine[i : i + 2048]]].sum(axis=0)])
        columns = [pa.array([g[k] for g in found]) for k in range(len(by))]
        yield pa.RecordBatch.from_arrays([*columns, *[pa.array([x[k].tolist() for x in found.values()], pa.list_(pa.int64())) for k in (0, 1)]], [*by, "_total", "_below"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in known.select(*by).dtypes)
    per_task = rows.select(*by, "_v", "_k", "_low").mapInArrow(totals, f"{kinds}, _total array<long>, _below array<long>")
    spread = per_task.select(*by, F.posexplode(F.arrays_zip("_total", "_below")).alias("b", "s"))
    sums = spread.groupBy(*by, "b").agg(F.sum("s._total").alias("total"), F.sum("s._below").alias("below"))
    near = rows.where((F.col("_v") >= F.col("_low")) & (F.col("_v") <= F.col("_high"))).select(*by, "_v", "_k")

    def medians(group: tuple, values: pd.DataFrame, weights: pd.DataFrame) -> pd.DataFrame:
        values, weights = values.sort_values(["_v", "_k"]), weights.sort_values("b")
        v, keys, out = values["_v"].to_numpy(), values["_k"].to_numpy(), []
        total, below = weights["total"].to_numpy(), weights["below"].to_numpy()
        for block in np.array_split(everyone, max(1, len(keys) * resamples // 4_000_000)):
            upto = np.cumsum(poisson_weights(keys, block), axis=0) + below[block]
            reached = 2 * upto >= total[block]
            if not (reached[-1] & (2 * below[block] < total[block]) | (total[block] == 0)).all():
                raise ValueError("a resample's median lies beyond its range")
            out.append(v[reached.argmax(axis=0)][total[block] > 0])
        found = np.concatenate(out)
        return pd.DataFrame([(*group, *(np.quantile(found, (0.025, 0.5, 0.975)).round(6) if len(found) else [None] * 3))], columns=[*by, "low", "middle", "high"])

    return near.groupBy(*by).cogroup(sums.groupBy(*by)).applyInPandas(medians, f"{kinds}, low double, middle double, high double")
