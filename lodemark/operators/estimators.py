"""The estimators of label places and the error frame they are scored in.

An estimator gives a distance and a heading beside the click's; its fit is a few moments or medians of the training rows.
The frame holds every estimator's predicted distance, error of place and error of distance in one projection, and its
metrics come from one pass of quantiles, whatever the number of estimators.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodemark.functions import geo
from lodemark.functions.numeric import dummies, mapped
from lodemark.session import checkpointed, discard, stored

from . import models
from .quantiles import apart, quantile, quantiles

#: How a place is set out: on the flat earth, on the sphere or on the ellipsoid.
FLAT, SPHERE, ELLIPSOID = "flat", "sphere", "ellipsoid"


@dataclass(frozen=True)
class Predictor:
    """A distance, an angle to add to the click's heading, and how the place is set out."""

    distance: Column
    turn: Column
    geodesy: str = SPHERE


def _at_least_zero(x: Column) -> Column:
    return F.when(x.isNotNull(), F.greatest(x, F.lit(0.0)))


def fit_estimators(train: DataFrame, mixed: bool = True, geodesy: str = ELLIPSOID) -> dict[str, Predictor]:
    """Estimators 1 to 7 from training rows with canvas_x, canvas_y, sv_image_y, zoom, label_type, heading_diff and truth_m.

    1 is ten metres, 2 the median distance, 3 that of the label type (NULL for an unseen one), all straight ahead on the
    flat earth; 4 one plane for both halves, 5 with a step a zoom level, 6 with a random one (left out unless `mixed`), 7 a
    line of each zoom level's own.
    """
    c = {k: F.col(k).cast("double") for k in ("canvas_x", "canvas_y", "sv_image_y")}
    zoom, dist, turn = F.col("zoom"), F.col("truth_m"), F.col("heading_diff")
    steps = dict(zip(("zoom2", "zoom3"), dummies(zoom, [2, 3]), strict=True))
    ahead = F.lit(0.0)
    by_type = {r["label_type"]: r["m"] for r in quantiles(train, ["label_type"], {"m": (dist, 0.5)}, digits=None).collect() if r["m"] is not None and r["label_type"] is not None}
    out = {
        "est1": Predictor(F.lit(10.0), ahead, FLAT), "est2": Predictor(F.lit(quantile(train, dist, 0.5)).cast("double"), ahead, FLAT),
        "est3": Predictor(mapped(F.col("label_type"), by_type), ahead, FLAT),
    }
    plane = {k: c[k] for k in ("canvas_y", "sv_image_y")}
    four = models.least_squares(train, plane, {"d": dist, "h": turn})
    out["est4"] = Predictor(_at_least_zero(four["d"].predict(plane)), four["h"].predict(plane), geodesy)
    xd, xh = {"sv_image_y": c["sv_image_y"], "canvas_y": c["canvas_y"], **steps}, {"canvas_x": c["canvas_x"], **steps}
    five = models.least_squares(train, xd, {"d": dist})["d"], models.least_squares(train, xh, {"h": turn})["h"]
    out["est5"] = Predictor(_at_least_zero(five[0].predict(xd)), five[1].predict(xh), geodesy)
    if mixed:
        halves = []
        for x, y in ((plane, dist), ({"canvas_x": c["canvas_x"]}, turn)):
            fixed, random, _ = models.mixed_model(train, x, y, zoom)
            halves.append(fixed.predict(x) + mapped(zoom, random))
        out["est6"] = Predictor(_at_least_zero(halves[0]), halves[1], geodesy)
    x7 = {"sv_image_y": c["sv_image_y"], "canvas_y": c["canvas_y"]}
    lines = models.least_squares(train, x7, {"d": dist}, by=zoom), models.least_squares(train, {"canvas_x": c["canvas_x"]}, {"h": turn}, by=zoom)
    halves = []
    for fits, x, name in ((lines[0], x7, "d"), (lines[1], {"canvas_x": c["canvas_x"]}, "h")):
        found = F.lit(None).cast("double")
        for z, own in sorted(fits.items()):
            found = F.when(zoom == z, own[name].predict(x)).otherwise(found)
        halves.append(found)
    out["est7"] = Predictor(_at_least_zero(halves[0]), halves[1], geodesy)
    return out


def rung_predictors(fits: dict, columns: dict[str, Column], turn: Column) -> dict[str, Predictor]:
    """The rungs of the ladder: their distances with one heading for all, set out on the sphere."""
    return {k: Predictor(models.predict_any(m, columns), turn) for k, m in fits.items()}


def error_frame(test: DataFrame, predictors: dict[str, Predictor], keep: list[str]) -> DataFrame:
    """keep, and for every predictor dist_pred_<key>, error_<key> (metres from the true place) and dist_error_<key>.

    test has pano_lat, pano_lng, heading, lat, lng and truth_m. A missing prediction or place leaves its errors missing.
    """
    known, out = apart(test, {f"dist_pred_{k}": p.distance for k, p in predictors.items()}), []
    for k, p in predictors.items():
        d = F.col(f"dist_pred_{k}")
        start = F.col("pano_lat"), F.col("pano_lng")
        heading = F.col("heading") + p.turn
        if p.geodesy == FLAT:
            place = geo.flat_dest(*start, F.col("heading"), d)
        elif p.geodesy == SPHERE:
            place = geo.spherical_dest(*start, heading, d)
        else:
            point = geo.dest_point(*start, heading, d)
            place = point["lat"], point["lng"]
        known = apart(known, {f"error_{k}": geo.haversine_m(F.col("lat"), F.col("lng"), *place)})
        out += [d, F.col(f"error_{k}"), F.abs(F.col("truth_m") - d).alias(f"dist_error_{k}")]
    return known.select(*keep, *out)


def frame_metrics(frame: DataFrame, keys: list[str], digits: int = 6) -> DataFrame:
    """A row a key, best median error of place first: n (rows with an error), mean, sd, median and 90th percentile of
    the errors of place and of distance."""
    wanted, aggs = {}, []
    for k in keys:
        for short, c in (("place", f"error_{k}"), ("dist", f"dist_error_{k}")):
            wanted |= {f"{short}_median_{k}": (F.col(c), 0.5), f"{short}_p90_{k}": (F.col(c), 0.9)}
            aggs += [F.avg(c).alias(f"{short}_mean_{k}"), F.stddev_samp(c).alias(f"{short}_sd_{k}")]
        aggs.append(F.count(f"error_{k}").alias(f"n_{k}"))
    wide = quantiles(frame, [], wanted, aggs, digits=None)
    names = [f"{short}_{m}" for short in ("place", "dist") for m in ("median", "p90", "mean", "sd")]
    rows = [F.struct(F.lit(k).alias("model"), F.col(f"n_{k}").alias("n"), *[F.round(f"{m}_{k}", digits).alias(m) for m in names]) for k in keys]
    return wide.select(F.inline(F.array(*rows))).orderBy(F.asc_nulls_last("place_median"), "model")


def metrics_by_parts(test: DataFrame, predictors: dict[str, Predictor], keep: list[str], at_once: int = 8, digits: int = 6) -> DataFrame:
    """frame_metrics of many predictors: a few at a time have a frame, which is written once for its metrics.

    All of them in one frame are more operators, and more aggregates, than the JVM compiles.
    """
    parts, names = None, list(predictors)
    for i in range(0, len(names), at_once):
        some = names[i : i + at_once]
        frame, path = stored(error_frame(test, {k: predictors[k] for k in some}, keep))
        found = checkpointed(frame_metrics(frame, some, digits))
        discard(test.sparkSession, path)
        parts = found if parts is None else parts.unionByName(found)
    return parts.orderBy(F.asc_nulls_last("place_median"), "model")
