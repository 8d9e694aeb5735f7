"""Sampling plans over many strata: first pick wins, caps, shares and quotas.

A plan is small (as many rows as its quotas allow), whatever the candidates: each stratum is a top-n of a hash
order, and what earlier strata took is anti-joined as a small table.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodemark.functions.pov import CANVAS_HEIGHT, CANVAS_WIDTH, pov_if_centered

from .quantiles import apart, cell_quantiles
from .windows import md5_order, top_per_group

#: Pixels of the stored frame for a degree of pitch.
PIXELS_PER_DEGREE = 6656 / 180


@dataclass(frozen=True)
class Stratum:
    """A step of a plan: candidates that meet `where`, `n` of them in hash order.

    cap: at most so many of each value of a column; amount: instead of n rows, the rows with the most of a
    column first until its sum over all that is picked so far reaches n.
    """

    name: str
    where: Column
    n: int
    cap: tuple[str, int] | None = None
    amount: str | None = None


def ordered_plan(candidates: DataFrame, key: str, strata: list[Stratum], seed: int) -> DataFrame:
    """(key, stratum, place, step): every key in the first stratum that takes it. Keys must be unique.

    place is the place within the stratum (from 0), in the order of the plan; step the stratum's own.
    """
    from lodemark.session import checkpointed

    ordered = candidates.select("*", md5_order(F.col(key), F.lit(seed)).alias("_o"))
    picked: DataFrame | None = None
    for step, s in enumerate(strata):
        pool, n, order = ordered.where(s.where), s.n, [F.col("_o"), F.col(key)]
        if s.cap:
            pool = top_per_group(pool, [s.cap[0]], order, s.cap[1])
        if picked is not None:
            pool = pool.join(F.broadcast(picked.select(key)), key, "left_anti")  # the plan so far: its quotas' size
        if s.amount:
            if picked is not None:
                have = candidates.join(F.broadcast(picked.select(key)), key).agg(F.sum(s.amount)).first()[0]
                n -= int(have or 0)
            if n <= 0:
                continue
            # Each row that is taken adds one at least, so n rows are enough to look at.
            order = [F.desc(s.amount), *order]
            few = pool.where(F.col(s.amount) > 0).orderBy(*order).limit(n)
            upto = F.sum(s.amount).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
            pool = few.select("*", upto.alias("_s")).where(F.col("_s") - F.col(s.amount) < n)
        else:
            pool = pool.orderBy(*order).limit(n)
        place = (F.row_number().over(Window.orderBy(*order)) - 1).alias("place")  # n rows
        taken = checkpointed(pool.select(key, F.lit(s.name).alias("stratum"), place, F.lit(step).alias("step")))
        picked = taken if picked is None else checkpointed(picked.unionByName(taken))
    return picked


def rarest_first(candidates: DataFrame, amounts: list[str]) -> list[str]:
    """The columns in order of their sums, one pass; equal sums by name."""
    found = candidates.agg(*[F.sum(a).alias(a) for a in amounts]).first()
    return sorted(amounts, key=lambda a: (found[a] or 0, a))


def share_sample(df: DataFrame, stratum: str, shares: dict[str, float], n: int, key: str, seed: int) -> DataFrame:
    """Of each stratum round(n * share) rows (half to even), or all if there are fewer, in hash order."""
    wanted = {k: round(n * s) for k, s in shares.items()}
    quota = F.lit(0)
    for k, q in wanted.items():
        quota = F.when(F.col(stratum) == k, q).otherwise(quota)
    most = max(wanted.values(), default=0)
    w = Window.partitionBy(stratum).orderBy("_o", key)
    ranked = df.where(F.col(stratum).isin(list(shares))).select("*", md5_order(F.col(key), F.lit(seed)).alias("_o")).select("*", F.row_number().over(w).alias("_k"))
    return ranked.where((F.col("_k") <= most) & (F.col("_k") <= quota)).select(*df.columns)


def most_labelled(sample: DataFrame, labels: DataFrame, key: str, n: int) -> DataFrame:
    """The n keys of the sample with the most labels; of equals the smaller key."""
    counts = labels.join(F.broadcast(sample.select(key)), key).groupBy(key).agg(F.count(F.lit(1)).alias("n_labels"))  # a sample's size
    return counts.orderBy(F.desc("n_labels"), key).limit(n)


def with_edges(df: DataFrame, strata: list[str], keys: list[str], n: int, edges: dict[str, tuple[Column, int]], seed: int) -> DataFrame:
    """A proportional sample over strata (`headline`), and then per edge condition up to its number of other rows."""
    from lodemark.session import checkpointed

    from .windows import proportional_sample

    out = checkpointed(proportional_sample(df, strata, keys, n, seed).select(*keys, F.lit("headline").alias("sample")))
    order = [md5_order(*[F.col(k) for k in keys], F.lit(seed)), *keys]
    for name, (test, most) in edges.items():
        more = df.where(test).join(F.broadcast(out.select(*keys)), keys, "left_anti").orderBy(*order).limit(most)
        out = checkpointed(out.unionByName(more.select(*keys, F.lit(name).alias("sample"))))
    return out


def noise_sweep(clicks: DataFrame, predictors: dict[str, Callable[[], Column]], truth: str, keys: list[str], sigmas: tuple[float, ...] = (2.0, 5.0, 10.0), draws: int = 5) -> DataFrame:
    """(model, sigma, delta_median_m, delta_p90_m): what pixel noise on the clicks does to each model's errors.

    Noise is Gaussian by a hash of the row's keys and the draw, so it is the same whatever the partitions and the
    models; clicks stay on the canvas. canvas_x, canvas_y, dep and sv_image_y are derived anew from the moved
    click before a predictor sees the row; any Column of these can be one. Deltas are means over the draws less the
    errors without noise.
    """
    angle = [F.col(c).cast("double") for c in ("heading", "pitch", "zoom")]
    x, y = F.col("canvas_x").cast("double"), F.col("canvas_y").cast("double")
    # One hash a click and draw: the sigmas of a draw share it. Each step passes through a generator, so that it is made once for what follows.
    rows = apart(clicks.withColumn("draw", F.explode(F.array(*[F.lit(k) for k in range(draws)]))), {"_m": md5_order(*[F.col(k) for k in keys], F.col("draw"))})
    digits = F.conv(F.substring("_m", 1, 14), 16, 10).cast("long")
    rows = apart(rows, {"_digits": digits}).drop("_m")
    u, v = ((c + 0.5) / 268435456 for c in (F.shiftright("_digits", 28), F.col("_digits").bitwiseAND(268435455)))
    turn = 2 * F.pi() * v
    far = F.sqrt(-2 * F.ln(u))
    # Without noise a click is there once, beside its first draw.
    grid = [F.array(*[F.struct(F.lit(float(s)).alias("sigma"), far.alias("_far"), F.cos(turn).alias("_cos"), F.sin(turn).alias("_sin")) for s in own]) for own in ((0.0, *sigmas), sigmas)]
    rows = rows.select("*", pov_if_centered(x, y, *angle)[1].alias("_pitch"), F.inline(F.when(F.col("draw") == 0, grid[0]).otherwise(grid[1]))).drop("_digits")
    reach = F.col("_far") * F.col("sigma")
    moved = rows.withColumns({"canvas_x": F.least(F.greatest(x + reach * F.col("_cos"), F.lit(0.0)), F.lit(float(CANVAS_WIDTH))), "canvas_y": F.least(F.greatest(y + reach * F.col("_sin"), F.lit(0.0)), F.lit(float(CANVAS_HEIGHT)))})
    moved = moved.withColumn("dep", -pov_if_centered(F.col("canvas_x"), F.col("canvas_y"), *angle)[1])
    moved = moved.withColumn("sv_image_y", F.col("sv_image_y") + (-F.col("dep") - F.col("_pitch")) * PIXELS_PER_DEGREE)
    errors = moved.select("sigma", "draw", *[F.abs(p() - F.col(truth)).alias(k) for k, p in predictors.items()]).unpivot(["sigma", "draw"], list(predictors), "model", "e")
    each = cell_quantiles(errors, ["model", "sigma", "draw"], "e", {"m": 0.5, "p": 0.9})
    means = each.groupBy("model", "sigma").agg(F.avg("m").alias("m"), F.avg("p").alias("p"))
    base = means.where("sigma = 0").select("model", F.col("m").alias("m0"), F.col("p").alias("p0"))
    return means.where("sigma > 0").join(base, "model").select("model", "sigma", F.round(F.col("m") - F.col("m0"), 6).alias("delta_median_m"), F.round(F.col("p") - F.col("p0"), 6).alias("delta_p90_m"))
