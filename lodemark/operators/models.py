"""Distance and heading models: fits are aggregates over the whole table whose results are a few numbers,
solved on the driver; predictions are Column expressions.

Fitted models are frozen dataclasses. Missing predictions stay missing.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodemark.functions.numeric import clip, disparity, interpolate, mapped, tan_depression

from .grid_slopes import mean_losses, median_slopes
from .quantiles import lad_slope, quantile, quantiles

CAP_M = 50.0
ANCHOR_HEIGHT_M = 2.6
#: Groups whose moment matrices the driver takes.
MOST_GROUPS = 100_000
FLOOR_GRID = [0.5 + 0.25 * k for k in range(47)]
BLEND_GRID = [1.0 + 0.25 * k for k in range(45)]


# ------------------------------------------------------------------ least squares


@dataclass(frozen=True)
class Linear:
    """Coefficients by term (the intercept is first), with standard errors."""

    terms: tuple[str, ...]
    coef: tuple[float, ...]
    se: tuple[float, ...]
    n: int

    def predict(self, columns: dict[str, Column], low: float | None = None, high: float | None = None) -> Column:
        out = F.lit(self.coef[0])
        for t, c in zip(self.terms[1:], self.coef[1:], strict=True):
            out = out + columns[t] * c
        return clip(out, low, high)


def _moments(df: DataFrame, x: list[Column], ys: list[Column], weight: Column | None = None, by: Column | None = None):
    """Per group the sums of products of (1, x..., y...), from one aggregation pass."""
    names = [f"_c{k}" for k in range(len(x) + len(ys))]
    known = F.lit(True)
    for c in names:
        known = known & F.col(c).isNotNull()
    # Columns of their own, so that no product computes an expression anew.
    source = df.select(*[c.cast("double").alias(n) for n, c in zip(names, [*x, *ys], strict=True)], (F.lit(1.0) if weight is None else weight).alias("_w"), *([by.alias("g")] if by is not None else [])).where(known)
    cols = [F.lit(1.0), *map(F.col, names)]
    k = len(cols)
    sums = [F.sum(F.col("_w") * cols[i] * cols[j]).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k)]
    rows = (source.groupBy("g") if by is not None else source.groupBy()).agg(F.count(F.lit(1)).alias("n"), *sums).collect()
    out = {}
    for r in rows:
        m = np.zeros((k, k))
        for i in range(k):
            for j in range(i, k):
                m[i, j] = m[j, i] = r[f"m{i}_{j}"] if r[f"m{i}_{j}"] is not None else 0.0
        out[r["g"] if by is not None else None] = (r["n"], m)
    return out


def _solve(n: int, m: np.ndarray, p: int, y: int, terms: tuple[str, ...]) -> Linear:
    gram, right = m[:p, :p], m[:p, p + y]
    scale = 1 / np.sqrt(np.maximum(np.diag(gram), 1e-300))
    inverse = np.linalg.pinv(gram * np.outer(scale, scale)) * np.outer(scale, scale)
    coef = inverse @ right
    left = max(m[p + y, p + y] - coef @ right, 0.0)
    se = np.sqrt(np.maximum(np.diag(inverse), 0) * left / max(n - p, 1))
    return Linear(terms, tuple(map(float, coef)), tuple(map(float, se)), n)


def least_squares(df: DataFrame, x: dict[str, Column], ys: dict[str, Column], by: Column | None = None) -> dict:
    """Ordinary least squares with an intercept, all responses (and groups) in one pass.

    Returns {response: Linear}, or {group: {response: Linear}}. Rows with a missing value are left out.
    """
    found = _moments(df, list(x.values()), list(ys.values()), by=by)
    terms, p = ("(Intercept)", *x), len(x) + 1
    fits = {g: {name: _solve(n, m, p, k, terms) for k, name in enumerate(ys)} for g, (n, m) in found.items()}
    return fits if by is not None else fits.get(None, {})


def per_zoom(fits: dict, response: str, zoom: Column, columns: dict[str, Column]) -> Column:
    """Each zoom level's own line, within 0 .. CAP_M."""
    out = F.lit(None).cast("double")
    for z, own in sorted(fits.items()):
        out = F.when(zoom == z, own[response].predict(columns)).otherwise(out)
    return clip(out, 0.0, CAP_M)


def quantile_regression(df: DataFrame, x: dict[str, Column], y: Column, q: float = 0.5, rounds: int = 40, tolerance: float = 1e-7, by: Column | None = None):
    """Quantile regression by iteratively reweighted least squares, one aggregation a round for all groups.

    The optimum need not be unique; the loss is what converges. Returns a Linear, or one per group (a few groups).
    """
    terms = ("(Intercept)", *x)
    rows = df.select(*[c.cast("double").alias(f"x{k}") for k, c in enumerate(x.values())], y.cast("double").alias("y"), (by if by is not None else F.lit(0)).alias("g")).dropna()
    named = {name: F.col(f"x{k}") for k, name in enumerate(x)}
    fits = {g: f["y"] for g, f in least_squares(rows, named, {"y": F.col("y")}, by=F.col("g")).items()}
    groups = list(fits)
    blocks = _design_blocks(rows, len(terms), groups).persist()
    try:
        for _ in range(rounds):
            fresh = {g: _solve(n, m, len(terms), 0, terms) for g, (n, m) in zip(groups, _weighted_moments(blocks, np.array([fits[g].coef for g in groups]).reshape(len(groups), len(terms)), q), strict=True)}
            step = max((abs(a - b) for g, f in fresh.items() for a, b in zip(fits[g].coef, f.coef, strict=True)), default=0.0)
            fits = fresh
            if step < tolerance:
                break
        return fits if by is not None else fits[0]
    finally:
        blocks.unpersist()


def _design_blocks(rows: DataFrame, terms: int, groups: list) -> DataFrame:
    """Blocks of rows: a matrix with the number of the group, 1, x0 ..., y as its rows; what a round reads is copied, not converted."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                at = pa.compute.index_in(batch.column("g"), value_set=pa.array(groups, batch.column("g").type))
                columns = [batch.column(f"x{k}").to_numpy() for k in range(terms - 1)]
                block = np.stack([at.to_numpy(zero_copy_only=False).astype(np.float64), np.ones(batch.num_rows), *columns, batch.column("y").to_numpy()])
                yield pa.RecordBatch.from_arrays([pa.array([block.tobytes()], pa.binary())], ["block"])

    return rows.mapInArrow(run, "block binary")


def _weighted_moments(blocks: DataFrame, coef: np.ndarray, q: float) -> list[tuple[int, np.ndarray]]:
    """Of each group its rows and the sums of products of (1, x0 ..., y), weighted for a round of quantile regression."""
    n_groups, terms = coef.shape
    size = (terms + 1) ** 2

    def run(batches):
        sums, count = np.zeros((n_groups, size)), np.zeros(n_groups)
        for batch in batches:
            for cell in batch.column(0):
                block = np.frombuffer(cell.as_buffer(), np.float64).reshape(terms + 2, -1)
                for g in range(n_groups):
                    own = block[1:, block[0] == g] if n_groups > 1 else block[1:]
                    r = own[-1] - coef[g] @ own[:-1]
                    w = np.where(r >= 0, q, 1 - q) / np.maximum(np.abs(r), 1e-6)
                    sums[g] += ((own * w) @ own.T).ravel()
                    count[g] += own.shape[1]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n_groups * (size + 1))), pa.array(np.hstack([sums, count[:, None]]).ravel())], ["place", "total"])

    out = np.zeros(n_groups * (size + 1))
    for r in blocks.mapInArrow(run, "place long, total double").groupBy("place").agg(F.sum("total").alias("total")).collect():
        out[r["place"]] = r["total"]
    return [(int(own[-1]), own[:-1].reshape(terms + 1, terms + 1)) for own in out.reshape(n_groups, -1)]


def mixed_model(df: DataFrame, x: dict[str, Column], y: Column, group: Column) -> tuple[Linear, dict, float]:
    """Random intercept by group, by restricted maximum likelihood.

    Returns the fixed part, the groups' intercepts and the variance ratio (group to residual). Only a
    matrix of moments per group comes to the driver; the ratio is a one-dimensional search.
    """
    if df.select(group.alias("g")).distinct().limit(MOST_GROUPS + 1).count() > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups: their moments would not fit on the driver")
    found = _moments(df, list(x.values()), [y], by=group)
    p = len(x) + 1
    terms = ("(Intercept)", *x)

    def profile(ratio: float):
        gram, right, square, logs, n_all = np.zeros((p, p)), np.zeros(p), 0.0, 0.0, 0
        for n, m in found.values():
            shrink = ratio / (1 + n * ratio)
            sx, sy = m[0, :p], m[0, p]
            gram += m[:p, :p] - shrink * np.outer(sx, sx)
            right += m[:p, p] - shrink * sx * sy
            square += m[p, p] - shrink * sy * sy
            logs += math.log1p(n * ratio)
            n_all += n
        coef = np.linalg.solve(gram, right)
        left = max(square - coef @ right, 1e-12)
        return -0.5 * ((n_all - p) * math.log(left) + logs + np.linalg.slogdet(gram)[1]), coef, gram, left, n_all

    low, high = -12.0, 8.0
    for _ in range(80):  # golden section on the log of the ratio
        a, b = high - 0.6180339887 * (high - low), low + 0.6180339887 * (high - low)
        low, high = (low, b) if profile(math.exp(a))[0] > profile(math.exp(b))[0] else (a, high)
    ratio = math.exp((low + high) / 2)
    _, coef, gram, left, n_all = profile(ratio)
    se = np.sqrt(np.diag(np.linalg.inv(gram)) * left / max(n_all - p, 1))
    random = {g: float(ratio / (1 + n * ratio) * (m[0, p] - m[0, :p] @ coef)) for g, (n, m) in found.items()}
    return Linear(terms, tuple(map(float, coef)), tuple(map(float, se)), n_all), random, ratio


# ------------------------------------------------------------------ geometric forms


@dataclass(frozen=True)
class Geometric:
    """A distance model of one of the forms in FORMS."""

    form: str
    height_m: float | None = None
    height_by_type: dict = field(default_factory=dict)
    angle_deg: float | None = None
    c0: float | None = None
    c1: float | None = None
    c1_by_type: dict = field(default_factory=dict)
    knots: tuple = ()


def _height(model: Geometric, label_type: Column | None) -> Column:
    if model.height_by_type and label_type is not None:
        return mapped(label_type, model.height_by_type, model.height_m)
    return F.lit(model.height_m)


def _cotangent(m: Geometric, dep: Column, kind: Column | None) -> Column:
    return _height(m, kind) / tan_depression(dep, 1e-9)


def _floor(m: Geometric, dep: Column, kind: Column | None) -> Column:
    return _height(m, kind) / tan_depression(dep, m.angle_deg)


def _blend(m: Geometric, dep: Column, kind: Column | None) -> Column:
    """Cotangent from the blend angle up; below it the line that touches it there, level from the horizon up."""
    h, a = _height(m, kind), math.radians(m.angle_deg)
    line = h * (1 / math.tan(a)) - h * (math.radians(1) / math.sin(a) ** 2) * (F.greatest(dep, F.lit(0.0)) - m.angle_deg)
    return F.when(dep >= m.angle_deg, h / tan_depression(dep, 1e-9)).otherwise(line)


def _soft(m: Geometric, dep: Column, kind: Column | None) -> Column:
    slope = mapped(kind, m.c1_by_type, m.c1) if m.c1_by_type and kind is not None else F.lit(m.c1)
    return 1 / (m.c0 + slope * tan_depression(dep, 0.0))


def _isotonic(m: Geometric, dep: Column, kind: Column | None) -> Column:
    return interpolate(dep, list(m.knots))


FORMS: dict[str, Callable] = {"cotangent": _cotangent, "floor": _floor, "blend": _blend, "softcap": _soft, "isotonic": _isotonic}


def predict(model: Geometric, dep: Column, label_type: Column | None = None) -> Column:
    """Distance of a click dep degrees below the horizon, within 0 .. CAP_M; NULL in, NULL out."""
    if model.form not in FORMS:
        raise ValueError(f"unknown form {model.form!r}")
    return F.when(dep.isNotNull(), clip(FORMS[model.form](model, dep, label_type), 0.0, CAP_M))


def anchor(dep: Column, height: float = ANCHOR_HEIGHT_M) -> Column:
    """No parameter; clicks on or above the horizon get the cap."""
    return F.when(dep <= 0, F.lit(CAP_M)).otherwise(clip(height / tan_depression(dep, 1e-9), 0.0, CAP_M))


def served_heights(panos: DataFrame) -> DataFrame:
    """(pano_id, height_m) of panoramas whose served height is not pinned; an unknown pin is one."""
    return panos.where(~F.coalesce("pinned", F.lit(True)) & F.col("height_m").isNotNull()).select("pano_id", "height_m")


def slope_ols(df: DataFrame, by: list[str], x: Column, y: Column) -> DataFrame:
    return df.groupBy(*by).agg((F.sum(x * y) / F.sum(x * x)).alias("slope"))


def _narrow(df: DataFrame, dep: str, dist: str, label_type: str | None) -> tuple[DataFrame, DataFrame]:
    """(what is persisted, the frame to fit on): depression, distance, type, tangent and disparity of the clicks that
    have them. A depression is often a long expression: it is computed once, before anything filters by it."""
    kind = F.col(label_type) if label_type else F.lit("")
    kept = df.select(F.col(dep).cast("double").alias("_d"), F.col(dist).cast("double").alias("_m"), kind.alias("_t")).persist()
    return kept, kept.where(F.col("_d").isNotNull() & F.col("_m").isNotNull()).select("*", tan_depression(F.col("_d"), 0.0).alias("_x"), disparity(F.col("_m"), 1.0).alias("_y"))


def fit_cotangent(df: DataFrame, loss: str = "l1", label_type: str | None = None, dep: str = "dep", dist: str = "truth_m") -> Geometric:
    """Camera heights in disparity space, over clicks below the horizon; per type with a pooled fallback."""
    kept, base = _narrow(df, dep, dist, label_type)
    try:
        rows = base.where("_d > 0")
        if loss == "ols":  # the sums of the types add up to the pooled ones
            sums = rows.groupBy("_t").agg(F.sum(F.col("_x") * F.col("_y")).alias("p"), F.sum(F.col("_x") * F.col("_x")).alias("q")).collect()
            top, low = sum(r["p"] for r in sums), sum(r["q"] for r in sums)
            pooled, slopes = top / low if low else None, {r["_t"]: r["p"] / r["q"] for r in sums if r["q"]}
        else:
            found = lad_slope(rows.select(F.lit(0).alias("_all"), "_x", "_y"), ["_all"], F.col("_x"), F.col("_y"), persisted=True).first()
            pooled = found["slope"] if found else None
            slopes = {r["_t"]: r["slope"] for r in lad_slope(rows, ["_t"], F.col("_x"), F.col("_y"), persisted=True).collect()} if label_type else {}
        if not pooled:
            raise ValueError("no click below the horizon to fit on")
        return Geometric("cotangent", 1 / pooled, {t: 1 / s for t, s in slopes.items() if s} if label_type else {})
    finally:
        kept.unpersist()


def _profile(df: DataFrame, form: str, grid: list[float], loss: str, label_type: str | None, dep: str, dist: str) -> tuple[Geometric, Geometric | None]:
    """The models of the grid angle with the least loss in metres: with one height, and with one per type.

    No loss needs a row per angle: for least squares sums per cell between two grid angles add up to those of every
    angle, absolute errors are counted for all angles at once.
    """
    kept, base = _narrow(df, dep, dist, label_type)
    try:
        heights: list[dict] = [{} for _ in grid]
        pooled: list[float | None] = [None] * len(grid)
        if loss == "ols":
            # cell k: at or above k grid angles, below the next
            cell = F.greatest(F.lit(0), F.least(F.lit(len(grid)), F.floor((F.col("_d") - grid[0]) / (grid[1] - grid[0])) + 1)).cast("int")
            sums = base.groupBy("_t", cell.alias("k")).agg(F.sum(F.col("_x") * F.col("_y")).alias("p"), F.sum(F.col("_x") * F.col("_x")).alias("q"), F.sum("_y").alias("y"), F.count(F.lit(1)).alias("n")).collect()
            for k, a in enumerate(grid):
                t, parts = math.tan(math.radians(a)), {}
                for r in sums:
                    p, q = (r["p"], r["q"]) if r["k"] > k else (t * r["y"], t * t * r["n"]) if form == "floor" else (0.0, 0.0)
                    before = parts.get(r["_t"], (0.0, 0.0))
                    parts[r["_t"]] = (before[0] + p, before[1] + q)
                heights[k] = {kind: q / p for kind, (p, q) in parts.items() if p > 0 and q > 0}
                top, low = (sum(x[i] for x in parts.values()) for i in (0, 1))
                pooled[k] = low / top if top > 0 else None
        else:
            types = [r["_t"] for r in kept.select("_t").distinct().dropna().orderBy("_t").collect()] if label_type else []
            slopes, by_type = median_slopes(base, form, grid, types)
            pooled = [1 / s if s else None for s in slopes]
            heights = [{t: 1 / s for t, s in own.items() if s} for own in by_type]
        used = [k for k in range(len(grid)) if pooled[k]]
        if not used:
            raise ValueError("no click to fit on")
        losses = mean_losses(base, form, *[[x[k] for k in used] for x in (grid, pooled, heights)], CAP_M, loss)
        out: list[Geometric | None] = []
        for typed in (False, True):
            if typed and not label_type:
                out.append(None)
                continue
            models = [Geometric(form, pooled[k], heights[k] if typed else {}, grid[k]) for k in used]
            out.append(models[min(range(len(models)), key=lambda k: (losses[typed][k], k))])
        return out[0], out[1]
    finally:
        kept.unpersist()


def fit_floor(df: DataFrame, loss: str = "l1", label_type: str | None = None, dep: str = "dep", dist: str = "truth_m") -> Geometric:
    """The depression is kept at a profiled least angle."""
    return _profile(df, "floor", FLOOR_GRID, loss, label_type, dep, dist)[bool(label_type)]


def fit_blend(df: DataFrame, loss: str = "l1", label_type: str | None = None, dep: str = "dep", dist: str = "truth_m") -> Geometric:
    """Cotangent above a profiled angle, its tangent line below."""
    return _profile(df, "blend", BLEND_GRID, loss, label_type, dep, dist)[bool(label_type)]


def _bounded(gram: np.ndarray, right: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Least squares with lower bounds, by cyclic coordinate descent on the moments."""
    c = np.maximum(np.linalg.lstsq(gram, right, rcond=None)[0], low)
    for _ in range(5000):
        before = c.copy()
        for k in range(len(c)):
            if gram[k, k] > 0:
                c[k] = max(low[k], c[k] + (right[k] - gram[k] @ c) / gram[k, k])
        if np.abs(c - before).max() < 1e-14:
            break
    return c


def fit_softcap(df: DataFrame, loss: str = "l1", label_type: str | None = None, dep: str = "dep", dist: str = "truth_m") -> Geometric:
    """disparity = c0 + c1 tan(dep) with c0 >= 1/CAP_M and c1 >= 0; c1 per type with a pooled fallback."""
    t, y = tan_depression(F.col(dep), 0.0), disparity(F.col(dist), 1.0)
    types = sorted(r[0] for r in df.select(label_type).distinct().collect() if r[0] is not None) if label_type else []
    x = {k: F.when(F.col(label_type) == k, t).otherwise(0.0) for k in types} if types else {"t": t}
    least = 1 / CAP_M
    if loss == "ols":
        _, m = _moments(df, list(x.values()), [y])[None]
        p = len(x) + 1
        c = _bounded(m[:p, :p], m[:p, p], np.array([least] + [0.0] * len(x)))
    else:
        c = np.array(quantile_regression(df, x, y).coef)
        if c[0] < least:
            slopes = lad_slope(df.select("*", (F.col(label_type) if types else F.lit("t")).alias("_k")), ["_k"], t, y - least)
            by = {r["_k"]: r["slope"] for r in slopes.collect()}
            c = np.array([least, *[by.get(k, 0.0) for k in x]])
        c[1:] = np.maximum(c[1:], 0.0)
    c0 = float(max(c[0], least))
    if not types:
        return Geometric("softcap", c0=c0, c1=float(c[1]))
    one = df.select("*", F.lit(0).alias("_all"))
    pooled = (slope_ols if loss == "ols" else lad_slope)(one, ["_all"], t, y - c0).first()["slope"]
    return Geometric("softcap", c0=c0, c1=max(float(pooled), 0.0), c1_by_type=dict(zip(types, map(float, c[1:]), strict=True)))


def fit_isotonic(df: DataFrame, loss: str = "l2", knots: int = 24, dep: str = "dep", dist: str = "truth_m") -> Geometric:
    """Distance never grows with depression. l2: all rows; l1: medians of 200 quantile bins, by their size.

    The fit is cut down to at most `knots` points at quantiles that are dense at both ends.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import IsotonicRegression

    from lodemark.session import checkpointed, discard, stored

    from .aggregate import quantile_bins

    rows = df.where(F.col(dep).isNotNull() & F.col(dist).isNotNull()).select(F.col(dep).cast("double").alias("x"), F.col(dist).cast("double").alias("y"))
    near = [float(v) for v in np.geomspace(0.001, 0.5, knots // 2 - 1)]
    shares = sorted({0.0, 1.0, *near, *[1 - v for v in near]})
    if loss == "l1":
        binned, path = stored(quantile_bins(rows, "x", 200)[0])
        points = checkpointed(quantiles(binned, ["bin"], {"x": (F.col("x"), 0.5), "y": (F.col("y"), 0.5)}, digits=None).select("x", "y", F.col("n").cast("double").alias("w")))
        discard(df.sparkSession, path)
        at = points.agg(F.percentile("x", shares)).first()[0]  # of 200 points
    else:  # equal depressions are one point, by their mean; the knots are quantiles of the rows
        points = rows.groupBy("x").agg(F.avg("y").alias("y"), F.count(F.lit(1)).cast("double").alias("w"))
        at = quantile(rows, F.col("x"), shares)
    fitted = IsotonicRegression(isotonic=False, labelCol="y", weightCol="w", featuresCol="f").fit(VectorAssembler(inputCols=["x"], outputCol="f").transform(points))
    bounds, values = fitted.boundaries.toArray(), fitted.predictions.toArray()
    at = np.unique(at)
    y = np.minimum.accumulate(np.interp(at, bounds, values))
    return Geometric("isotonic", knots=tuple(zip(map(float, at), map(float, y), strict=True)))


def structural_bound(model: Geometric, spark, types: list[str]) -> float:
    """The largest answer over -90 .. 90 degrees in 72,001 steps, for every type and an unseen one."""
    sweep = spark.range(72001).select((F.col("id") / 400 - 90).alias("dep"), F.explode(F.array(*[F.lit(t) for t in [*types, "(unseen)"]])).alias("kind"))
    return sweep.agg(F.max(predict(model, F.col("dep"), F.col("kind")))).first()[0]


def median_errors(df: DataFrame, models: dict[str, Geometric], dep: str = "dep", dist: str = "truth_m", label_type: str = "label_type") -> dict[str, float]:
    """The median absolute error of each model, all in one pass."""
    e = {k: F.abs(predict(m, F.col(dep), F.col(label_type)) - F.col(dist)) for k, m in models.items()}
    return quantiles(df, [], {k: (v, 0.5) for k, v in e.items()}, digits=None).first().asDict()


def choose(df: DataFrame, models: dict[str, Geometric], dep: str = "dep", dist: str = "truth_m", label_type: str = "label_type") -> str:
    """The model with the least median error on the training rows; the first of equals."""
    found = median_errors(df, models, dep, dist, label_type)
    return min(models, key=lambda k: found[k])


@dataclass(frozen=True)
class PerZoom:
    """Rung A: each zoom level's own line."""

    fits: dict
    form: str = "per_zoom_linear"


def fit_per_zoom(df: DataFrame, loss: str, x: dict[str, Column], y: Column, zoom: Column) -> PerZoom:
    """The lines of all zoom levels, by least squares or medians."""
    if loss == "ols":
        return PerZoom({z: f["y"] for z, f in least_squares(df, x, {"y": y}, by=zoom).items()})
    return PerZoom(quantile_regression(df, x, y, by=zoom))


@dataclass(frozen=True)
class Served:
    """The height that each panorama is served with; NULL elsewhere."""

    form: str = "cotangent_served"


def predict_any(model, columns: dict[str, Column]) -> Column:
    """Distance by any rung. columns: dep, label_type, and for rung A zoom and its terms; for Served height_m."""
    if isinstance(model, PerZoom):
        return per_zoom({z: {"y": f} for z, f in model.fits.items()}, "y", columns["zoom"], columns)
    if isinstance(model, Served):
        return F.when(columns["height_m"].isNotNull(), clip(columns["height_m"] / tan_depression(columns["dep"], 1e-9), 0.0, CAP_M))
    if model.form == "anchor":
        return anchor(columns["dep"], model.height_m)
    return predict(model, columns["dep"], columns["label_type"])


def ladder(df: DataFrame, label_type: str = "label_type", dep: str = "dep", dist: str = "truth_m", zoom: str = "zoom", terms: tuple[str, ...] = ("sv_image_y", "canvas_y"), losses: tuple[str, ...] = ("ols", "l1")) -> dict:
    """Ten rungs under each loss and the two anchors, over a frame that is read once.

    Rung A under least squares is checked against the per-zoom estimator that it must equal.
    """
    kept = df.select(dep, dist, label_type, zoom, *terms).persist()
    x, y, z = {t: F.col(t).cast("double") for t in terms}, F.col(dist), F.col(zoom)
    try:
        out: dict = {}
        for loss in losses:
            out[f"A_{loss}"] = fit_per_zoom(kept, loss, x, y, z)
            typed = fit_cotangent(kept, loss, label_type, dep, dist)
            out[f"C_{loss}"], out[f"C_type_{loss}"] = replace(typed, height_by_type={}), typed
            for name, form, grid in (("D_floor", "floor", FLOOR_GRID), ("D_blend", "blend", BLEND_GRID)):
                out[f"{name}_{loss}"], out[f"{name}_type_{loss}"] = _profile(kept, form, grid, loss, label_type, dep, dist)
            out[f"D_soft_{loss}"] = fit_softcap(kept, loss, None, dep, dist)
            out[f"D_soft_type_{loss}"] = fit_softcap(kept, loss, label_type, dep, dist)
            out[f"E_{loss}"] = fit_isotonic(kept, "l2" if loss == "ols" else "l1", 24, dep, dist)
        if "ols" in losses:
            for level, own in least_squares(kept, x, {"y": y}, by=z).items():
                if max(abs(a - b) for a, b in zip(own["y"].coef, out["A_ols"].fits[level].coef, strict=True)) > 1e-9:
                    raise AssertionError(f"rung A differs from the per-zoom estimator at zoom {level}")
        return out | {"anchor": Geometric("anchor", ANCHOR_HEIGHT_M), "anchor_served": Served()}
    finally:
        kept.unpersist()


def candidate(df: DataFrame, fits: dict, dep: str = "dep", dist: str = "truth_m", label_type: str = "label_type", medians: dict[str, float] | None = None) -> str:
    """Of the saturating rungs (D) the one with the least median error on the training rows; those errors if they are known."""
    rungs = {k: m for k, m in fits.items() if k.startswith("D_")}
    return choose(df, rungs, dep, dist, label_type) if medians is None else min(rungs, key=lambda k: medians[k])


def quantile_bands(train: DataFrame, test: DataFrame, dep: str = "dep", dist: str = "truth_m", shares: tuple[float, float] = (0.1, 0.9)) -> dict[str, float]:
    """The disparity line at two quantiles, and the median and 90th percentile of the distance between them."""
    t = tan_depression(F.col(dep), 0.0)
    out, bands = {}, []
    for q in shares:
        c0, c1 = quantile_regression(train, {"t": t}, disparity(F.col(dist), 1.0), q).coef
        out |= {f"c0_{q}": max(c0, 1 / CAP_M), f"c1_{q}": c1}
        bands.append(clip(1 / (out[f"c0_{q}"] + c1 * t), 0.0, CAP_M))
    found = quantiles(test, [], {"width_median_m": (F.abs(bands[0] - bands[1]), 0.5), "width_p90_m": (F.abs(bands[0] - bands[1]), 0.9)}, digits=None).first()
    return out | {k: found[k] for k in ("width_median_m", "width_p90_m")}


#: What a height term could add to the linear model, as columns of a frame with sv_image_y, canvas_y, pano_height.
HEIGHT_FORMS = {
    "a_sub": {"sv_image_y": "sv_image_y", "canvas_y": "canvas_y"},
    "b_norm": {"sv_norm": "sv_image_y * (6656e0 / pano_height)", "canvas_y": "canvas_y"},
    "b_log": {"sv_image_y": "sv_image_y", "canvas_y": "canvas_y", "log_h": "ln(pano_height / 6656e0)"},
    "b_interact": {"sv_image_y": "sv_image_y", "canvas_y": "canvas_y", "sv_interact": "sv_image_y * (6656e0 / pano_height - 1)"},
}


def height_terms(train: DataFrame, test: DataFrame, dist: str = "truth_m", city: str = "city", zoom: str = "zoom", losses: tuple[str, ...] = ("ols",)) -> list[tuple]:
    """(form, zoom, term, coef, se) of the four forms with fixed effects of cities, over panoramas of the two
    main heights, and per loss a row (form, zoom, `error_<loss>`, median error of test, NULL)."""
    train, test = (x.where("pano_height IN (6656, 8192)") for x in (train, test))
    cities = sorted(r[0] for r in train.select(city).distinct().collect())[1:]
    effects = {f"city_{c}": (F.col(city) == c).cast("double") for c in cities}
    out: list[tuple] = []
    for form, terms in HEIGHT_FORMS.items():
        x = {k: F.expr(e).cast("double") for k, e in terms.items()} | effects
        y, z = F.col(dist).cast("double"), F.col(zoom)
        for loss in losses:
            fits = {k: f["y"] for k, f in least_squares(train, x, {"y": y}, by=z).items()} if loss == "ols" else quantile_regression(train, x, y, by=z)
            if loss == "ols":
                out += [(form, k, t, c, s) for k, f in fits.items() for t, c, s in zip(f.terms, f.coef, f.se, strict=True) if t in terms]
            guess = per_zoom({k: {"y": f} for k, f in fits.items()}, "y", z, x)
            found = quantiles(test, [zoom], {"m": (F.abs(guess - y), 0.5)}, digits=None).collect()
            out += [(form, r[zoom], f"error_{loss}", r["m"], None) for r in found]
    return out


def era_shift(df: DataFrame, target: Column, era: Column) -> float:
    """Mean of target less era on the training rows."""
    return df.agg(F.avg(target - era)).first()[0] or 0.0


def rescaled(model: Geometric, k: float) -> Geometric:
    """The same form with every height times k."""
    return replace(model, height_m=model.height_m * k, height_by_type={t: h * k for t, h in model.height_by_type.items()})


def implied_heights(df: DataFrame, by: list[str], dep: str = "dep", dist: str = "truth_m", least_deg: float = 5.0, least_n: int = 25) -> DataFrame:
    """Median of truth * tan(dep) over clicks of least_deg or more, for groups of least_n or more."""
    rows = df.where(F.col(dep) >= least_deg)
    return quantiles(rows, by, {"implied_height_m": (F.col(dist) * F.tan(F.radians(dep)), 0.5)}).where(F.col("n") >= least_n)


#: Pairs of sequences whose sums the driver takes; beyond, each round is a join.
MOST_PAIRS = 1_000_000


def sequence_scales(members: DataFrame, rounds: int = 200, tolerance: float = 1e-10) -> DataFrame:
    """One distance scale per sequence, by alternating least squares over sites of two or more sequences.

    members: sequence_id, site_id, e0, n0 (camera, metres), ux, uy (unit ray), d0 (distance). A round sets every
    site to the mean of its members and every scale to its best fit to the sites, which is linear in the scales:
    its sums over pairs of sequences that share a site come from one pass over the members, whatever the number of
    rounds. Many pairs stay distributed, and a round is one join and one sum over them.
    """
    from lodemark.session import checkpointed

    seen = members.groupBy("site_id").agg(F.countDistinct("sequence_id").alias("_s"), F.count(F.lit(1)).alias("_n"), F.avg("e0").alias("_e"), F.avg("n0").alias("_q")).where("_s >= 2")
    rays = members.select("sequence_id", "site_id", "e0", "n0", "d0", (F.col("d0") * F.col("ux")).alias("px"), (F.col("d0") * F.col("uy")).alias("py"))
    # along each ray: d * u . (mean camera - own camera) does not depend on the scales
    own = rays.join(seen, "site_id").withColumn("_b", F.col("px") * (F.col("_e") - F.col("e0")) + F.col("py") * (F.col("_q") - F.col("n0")))
    per_site = checkpointed(own.groupBy("site_id", "sequence_id").agg(F.first("_n").alias("_n"), F.sum("px").alias("px"), F.sum("py").alias("py"), F.sum("_b").alias("b"), F.sum(F.col("d0") * F.col("d0")).alias("below"), F.count(F.lit(1)).alias("n_fit")))
    fixed = checkpointed(per_site.groupBy("sequence_id").agg(F.sum("b").alias("b"), F.sum("below").alias("below"), F.sum("n_fit").alias("n_fit")))
    other = per_site.select("site_id", F.col("sequence_id").alias("other"), F.col("px").alias("qx"), F.col("py").alias("qy"))
    pairs = checkpointed(per_site.join(other, "site_id").groupBy("sequence_id", "other").agg(F.sum((F.col("px") * F.col("qx") + F.col("py") * F.col("qy")) / F.col("_n")).alias("a")))

    if pairs.count() <= MOST_PAIRS:
        known, links = fixed.collect(), pairs.collect()
        at = {r["sequence_id"]: k for k, r in enumerate(known)}
        row, col = (np.array([at[r[c]] for r in links], np.int64) for c in ("sequence_id", "other"))
        a, b, below = np.array([r["a"] for r in links], float), np.array([r["b"] for r in known], float), np.array([r["below"] for r in known], float)
        k = np.ones(len(known))
        for _ in range(rounds):
            fresh = np.where(below > 0, (np.bincount(row, a * k[col], len(k)) + b) / np.maximum(below, 1e-12), 1.0) if len(k) else k
            moved, k = np.abs(fresh - k).max(initial=0), fresh
            if moved < tolerance:
                break
        scale = members.sparkSession.createDataFrame([(r["sequence_id"], float(v)) for r, v in zip(known, k, strict=True)], f"sequence_id {dict(members.dtypes)['sequence_id']}, k double")
    else:
        scale = checkpointed(fixed.select("sequence_id", F.lit(1.0).alias("k")))
        for _ in range(rounds):
            above = pairs.join(scale.select(F.col("sequence_id").alias("other"), "k"), "other").groupBy("sequence_id").agg(F.sum(F.col("a") * F.col("k")).alias("above"))
            fresh = fixed.join(above, "sequence_id").join(scale.select("sequence_id", F.col("k").alias("old")), "sequence_id")
            scale = checkpointed(fresh.select("sequence_id", "old", F.when(F.col("below") > 0, (F.col("above") + F.col("b")) / F.greatest("below", F.lit(1e-12))).otherwise(1.0).alias("k")))
            if scale.agg(F.max(F.abs(F.col("k") - F.col("old")))).first()[0] < tolerance:
                break
    counts = members.groupBy("sequence_id").agg(F.count(F.lit(1)).alias("n_members"))
    every_k = counts.join(scale.select("sequence_id", "k"), "sequence_id", "left").join(fixed.select("sequence_id", "n_fit"), "sequence_id", "left")
    every_k = checkpointed(every_k.select("sequence_id", "n_members", F.coalesce("n_fit", F.lit(0)).alias("n_fit_members"), F.coalesce("k", F.lit(1.0)).alias("k")))
    mean = every_k.agg(F.exp(F.sum(F.ln(F.greatest("k", F.lit(1e-6))) * F.col("n_members")) / F.sum("n_members"))).first()[0]
    return every_k.select("sequence_id", "n_members", "n_fit_members", (F.col("k") / (mean or 1.0)).alias("k_rel"))


def scale_transfer(members: DataFrame, seeds: list[int]) -> DataFrame:
    """Per seed, the median distance of the members of one half of the sites from their site's mean, with the scales
    that the other half gives and without (scale 1 where a sequence has none)."""
    from .windows import half_split

    out = None
    for seed in seeds:
        halves = half_split(members, "site_id", seed)
        fitted = sequence_scales(halves.where("half = 'A'").drop("half")).select("sequence_id", "k_rel")
        held = halves.where("half = 'B'").join(fitted, "sequence_id", "left")
        arms = []
        for name, k in (("scaled", F.coalesce("k_rel", F.lit(1.0))), ("plain", F.lit(1.0))):
            arms += [(F.col("e0") + k * F.col("d0") * F.col("ux")).alias(f"{name}_x"), (F.col("n0") + k * F.col("d0") * F.col("uy")).alias(f"{name}_y")]
        placed = held.select("site_id", *arms)
        centres = placed.groupBy("site_id").agg(*[F.avg(c).alias(f"c_{c}") for c in ("scaled_x", "scaled_y", "plain_x", "plain_y")])
        off = {f"{n}_m": (F.hypot(F.col(f"{n}_x") - F.col(f"c_{n}_x"), F.col(f"{n}_y") - F.col(f"c_{n}_y")), 0.5) for n in ("scaled", "plain")}
        row = quantiles(placed.join(centres, "site_id"), [], off).select(F.lit(seed).alias("seed"), "n", "scaled_m", "plain_m")
        out = row if out is None else out.unionByName(row)
    return out
