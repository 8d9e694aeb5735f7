"""Reports (V): diagnoses of sites, censuses of captures, fidelity of stored pixels, tilt, and nested summaries.

Each is a few grouped aggregates; what per-row work needs of its group (a centroid, a mean) is aggregated first and
joined back, so that no group is gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodemark.functions import distances, geo, pov

from .aggregate import mode_per_group, within_slopes
from .clean import last_rule_wins
from .quantiles import beside, quantiles

FRAME_HEIGHT = 6656.0
#: Limits of the capture modes (metres a second, metres, seconds).
ON_FOOT_SPEED, VEHICLE_SPEED, ON_FOOT_SPACING, VEHICLE_SPACING, LONGEST_STEP_S = 2.0, 5.5, 4.0, 25.0, 60.0


# ------------------------------------------------------------------ sites


def site_diagnosis(members: DataFrame, least_range: float = 0.5) -> DataFrame:
    """How well each model's placements of a site's members agree; one row a model.

    members: site_id, e and n (the camera, local metres), bearing_deg, dep_deg, pano_height. Every member is placed along
    its ray at the model's distance; its residual about the site's mean place is taken along that ray. range_slope is
    the slope of the residual on the distance, height_slope that of the residual as a share of the site's mean distance
    (at least `least_range`) on the image height, both within sites and with standard errors.
    """
    from lodemark.session import checkpointed

    turn = F.radians("bearing_deg")
    models = distances.model_distances(F.col("dep_deg"), F.col("pano_height").cast("double"))
    rays = members.select("site_id", "e", "n", F.sin(turn).alias("ux"), F.cos(turn).alias("uy"), (F.col("pano_height") / FRAME_HEIGHT).alias("height"), *[d.alias(f"d_{k}") for k, d in models.items()])
    spots = {k: (F.col("e") + F.col(f"d_{k}") * F.col("ux"), F.col("n") + F.col(f"d_{k}") * F.col("uy")) for k in models}
    means = rays.groupBy("site_id").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"{a}_{k}") for k, xy in spots.items() for a, c in zip("xy", xy, strict=True)], *[F.avg(f"d_{k}").alias(f"m_{k}") for k in models])
    means = checkpointed(means)  # read for its size and again for the join
    about = beside(rays.withColumnRenamed("n", "north"), means, ["site_id"]).withColumnRenamed("n", "members")
    spots = {k: (F.col("e") + F.col(f"d_{k}") * F.col("ux") - F.col(f"x_{k}"), F.col("north") + F.col(f"d_{k}") * F.col("uy") - F.col(f"y_{k}")) for k in models}
    wide = about.select(
        "site_id", "height", *[F.col(f"d_{k}") for k in models], *[(x * x + y * y).alias(f"sq_{k}") for k, (x, y) in spots.items()],
        *[(x * F.col("ux") + y * F.col("uy")).alias(f"along_{k}") for k, (x, y) in spots.items()], *[F.greatest(F.col(f"m_{k}"), F.lit(least_range)).alias(f"m_{k}") for k in models],
    )
    pairs = {}
    for k in models:
        pairs |= {f"range_{k}": (F.col(f"d_{k}"), F.col(f"along_{k}")), f"height_{k}": (F.col("height"), F.col(f"along_{k}") / F.col(f"m_{k}"))}
    found = within_slopes(wide, "site_id", pairs, {f"sum_{c}_{k}": F.col(f"{c}_{k}") for k in models for c in ("sq", "d")})
    rows = [
        F.struct(
            F.lit(k).alias("model"), F.col("groups").alias("n_sites"), F.col("n").alias("n_members"),
            F.round(F.try_divide(F.sqrt(F.col(f"sum_sq_{k}") / F.col("n")), F.col(f"sum_d_{k}") / F.col("n")), 4).alias("rms_over_range"),
            *[F.round(f"{s}_{k}_{v}", 4).alias(f"{s}_{v}") for s in ("range", "height") for v in ("slope", "se")],
        )
        for k in models
    ]
    return found.where("n > 0").select(F.inline(F.array(*rows)))


# ------------------------------------------------------------------ censuses


def rig(make: str = "camera_make", model: str = "camera_model") -> Column:
    return F.concat_ws(" / ", *[F.coalesce(F.col(c), F.lit("(none)")) for c in (make, model)])


def sequence_table(panos: DataFrame) -> DataFrame:
    """One row a sequence: its panoramas and members, most frequent rig and height, speed, spacing and capture mode.

    panos: sequence_id, pano_id, captured_at_ms, lat, lng, camera_make, camera_model, height, members. Steps that take no
    time or over LONGEST_STEP_S are recording gaps. The speed is the smaller of the median step's and that of the whole
    way: even time stamps inflate the first, stops deflate the second. A sequence is what one camera recorded in one go.
    """
    w = Window.partitionBy("sequence_id").orderBy("captured_at_ms", "pano_id")
    step = F.struct("captured_at_ms", "lat", "lng")
    steps = panos.select("sequence_id", "members", step.alias("here"), F.lag(step).over(w).alias("last"))
    seconds = (F.col("here.captured_at_ms") - F.col("last.captured_at_ms")) / 1000
    metres = geo.haversine_mean_m(F.col("last.lat"), F.col("last.lng"), F.col("here.lat"), F.col("here.lng"))
    timed = steps.select("sequence_id", "members", seconds.alias("s"), metres.alias("m")).withColumn("ok", F.coalesce((F.col("s") > 0) & (F.col("s") <= LONGEST_STEP_S), F.lit(False)))
    s, m = F.when(F.col("ok"), F.col("s")), F.when(F.col("ok"), F.col("m"))
    table = quantiles(timed, ["sequence_id"], {"_frame": (m / s, 0.5), "_spacing": (m, 0.5)}, [F.sum("members").alias("n_members"), F.count_if("ok").alias("timed"), F.sum(m).alias("way"), F.sum(s).alias("took")], digits=None)
    moving = (F.col("n") >= 3) & (F.col("timed") >= 2)
    speed, spacing = F.when(moving, F.least(F.col("_frame"), F.try_divide(F.col("way"), F.col("took")))), F.when(moving, F.col("_spacing"))
    table = table.select("sequence_id", F.col("n").alias("n_panos"), "n_members", speed.alias("speed_mps"), spacing.alias("spacing_m"))
    mode = last_rule_wins([
        (F.lit(True), "slow"), ((F.col("speed_mps") < ON_FOOT_SPEED) & (F.col("spacing_m") < ON_FOOT_SPACING), "on_foot"),
        ((F.col("speed_mps") > VEHICLE_SPEED) | (F.col("spacing_m") > VEHICLE_SPACING), "vehicle"), (F.col("speed_mps").isNull(), "unknown"),
    ])
    rigs = mode_per_group(panos.select("sequence_id", rig().alias("rig")), ["sequence_id"], "rig").drop("n")
    heights = mode_per_group(panos.where("height IS NOT NULL"), ["sequence_id"], "height").drop("n")
    return table.withColumn("capture_mode", mode).join(rigs, "sequence_id").join(heights, "sequence_id", "left")


def mode_census(sequences: DataFrame) -> DataFrame:
    """Sequences, panoramas and members by capture mode."""
    return sequences.groupBy("capture_mode").agg(F.count(F.lit(1)).alias("n_sequences"), F.sum("n_panos").alias("n_panos"), F.sum("n_members").alias("n_members"))


def rig_census(panos: DataFrame) -> DataFrame:
    """By rig the panoramas, sequences and members, its image sizes and the most frequent one with its share."""
    sized = panos.select(rig().alias("rig"), "sequence_id", "members", F.concat_ws("x", "width", "height").alias("size"))
    by_size = sized.groupBy("rig", "size").agg(F.count(F.lit(1)).alias("n"), F.sum("members").alias("m"))
    sizes = by_size.groupBy("rig").agg(
        F.sum("n").alias("n_panos"), F.sum("m").alias("n_members"), F.count(F.lit(1)).alias("n_sizes"), F.max("n").alias("_most"),
        F.min_by("size", F.struct((-F.col("n")).alias("a"), F.col("size").alias("b"))).alias("main_size"),
    )
    sequences = sized.groupBy("rig").agg(F.countDistinct("sequence_id").alias("n_sequences"))
    return sizes.join(sequences, "rig").select("rig", "n_panos", "n_sequences", "n_members", "n_sizes", "main_size", F.round(F.col("_most") / F.col("n_panos"), 6).alias("main_share"))


def position_shifts(panos: DataFrame, by: list[str]) -> DataFrame:
    """How far computed places, compass angles and altitudes are from the raw ones: quantiles by group, and what is degenerate.

    panos: lat, lng, raw_lat, raw_lng, compass_angle, computed_compass_angle, altitude, computed_altitude, width, height.
    """
    shift = geo.haversine_mean_m(F.col("raw_lat"), F.col("raw_lng"), F.col("lat"), F.col("lng"))
    compass = F.abs(geo.wrap_floor(F.col("computed_compass_angle") - F.col("compass_angle")))
    rise = F.col("computed_altitude") - F.col("altitude")
    wanted = {"shift_median": (shift, 0.5), "shift_p90": (shift, 0.9), "compass_median": (compass, 0.5), "compass_p90": (compass, 0.9), "rise_p10": (rise, 0.1), "rise_median": (rise, 0.5), "rise_p90": (rise, 0.9)}
    return quantiles(panos, by, wanted, [F.round(F.max(shift), 6).alias("shift_max"), F.count_if(F.col("compass_angle") == 0).alias("compass_zero"), F.bool_and(F.col("width") == 2 * F.col("height")).alias("all_true_size")])


# ------------------------------------------------------------------ stored pixels


def replay_fidelity(labels: DataFrame, by: list[str], cutoff: str) -> DataFrame:
    """Stored panorama pixels beside those that the projection gives: rates of exact rows and columns, by era, and the drift's signature.

    labels: pano_id, pov_heading, pov_pitch, camera_heading, pano_width, pano_height, stored_x, stored_y, time_created. Columns
    are compared the short way round the seam. Where a column is off by more than a pixel the angle of the miss is that of
    the camera heading used then: constant within a panorama (spread_within) and not across panoramas (spread_across).
    Labels without a time are of the older era.
    """
    from lodemark.session import checkpointed

    known = labels.dropna(subset=["stored_x", "stored_y", "pano_width", "pano_height", "camera_heading"])
    w, h = F.col("pano_width").cast("double"), F.col("pano_height").cast("double")
    x, y = pov.pano_pixel(F.col("pov_heading"), F.col("pov_pitch"), F.col("camera_heading"), w, h)
    early = F.coalesce(F.col("time_created") < F.lit(cutoff).cast("timestamp_ntz"), F.lit(True))
    rows = known.select(*by, "pano_id", pov.seam_difference(x - F.col("stored_x"), w).alias("dx"), F.abs(y - F.col("stored_y")).alias("dy"), w.alias("w"), early.alias("early"))

    def share(hit: Column, where: Column | None = None) -> Column:
        return F.round(F.avg(F.when(F.lit(True) if where is None else where, hit.cast("double"))), 6)

    exact = F.col("dx") == 0
    rates = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), share(F.col("dy") == 0).alias("y_exact"), share(exact).alias("x_exact"), share(F.abs("dx") <= 1).alias("x_within_1px"),
        share(exact, F.col("early")).alias("x_exact_early"), share(exact, ~F.col("early")).alias("x_exact_late"),
    )
    angle = F.col("dx") / F.col("w") * 360
    missed = checkpointed(rows.where(F.abs("dx") > 1).groupBy(*by, "pano_id").agg(F.avg(angle).alias("a"), F.stddev_samp(angle).alias("s")))  # quantiles read it twice or more
    spread = quantiles(missed, by, {"spread_within": (F.col("s"), 0.5)}, [F.round(F.stddev_samp("a"), 6).alias("spread_across"), F.count(F.lit(1)).alias("n_panos_off")]).drop("n")
    return beside(rates, spread.withColumn("n", F.lit(1)), by).drop("n") if not by else rates.join(spread, by, "left")


# ------------------------------------------------------------------ tilt


def roll_unwrapped(roll: Column) -> Column:
    """Roll in degrees as a tilt about zero: what is past half a turn is the other way."""
    return F.when(roll > 180, roll - 360).otherwise(roll)


def tilt_sinusoid(clicks: DataFrame, meta: DataFrame, height_m: float) -> DataFrame:
    """Whether the recorded tilt of panoramas explains the clicks' depressions; one row.

    clicks: pano_id, heading, dep, truth_m; meta: pano_id, yaw_deg, pitch_deg, roll_deg, a row a panorama. The residual is the
    depression less that of a camera at height_m; coef and r are of its line on pitch x cos + roll x sin of the heading
    from the yaw (near 1: the tilt explains it); cos_deg and sin_deg are the least-squares sinusoid itself, from moments.
    """
    turn = F.radians(F.col("heading") - F.col("yaw_deg"))
    joined = clicks.join(meta, "pano_id").select(
        "pano_id", F.cos(turn).alias("c"), F.sin(turn).alias("s"), (F.col("pitch_deg") * F.cos(turn) + roll_unwrapped(F.col("roll_deg")) * F.sin(turn)).alias("t"),
        (F.col("dep") - F.degrees(F.atan2(F.lit(height_m), F.col("truth_m")))).alias("y"),
    )
    rows = joined.dropna()
    m = rows.agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("pano_id").alias("n_panos"), F.regr_slope("y", "t").alias("coef"), F.corr("y", "t").alias("r"),
        F.var_pop("c").alias("cc"), F.var_pop("s").alias("ss"), F.covar_pop("c", "s").alias("cs"), F.covar_pop("c", "y").alias("cy"), F.covar_pop("s", "y").alias("sy"),
    )
    det = F.col("cc") * F.col("ss") - F.col("cs") * F.col("cs")
    return m.select(
        "n", "n_panos", F.round("coef", 6).alias("coef"), F.round("r", 6).alias("r"), F.round(F.try_divide(F.col("cy") * F.col("ss") - F.col("sy") * F.col("cs"), det), 6).alias("cos_deg"),
        F.round(F.try_divide(F.col("sy") * F.col("cc") - F.col("cy") * F.col("cs"), det), 6).alias("sin_deg"),
    )


# ------------------------------------------------------------------ nested summaries


def at_levels(df: DataFrame, levels: list[tuple[str, ...]], columns: list[str]) -> DataFrame:
    """Every row once for each level: `level` (its columns' names) and the columns, those that the level leaves out as "(all)"."""
    keys = list(dict.fromkeys(c for level in levels for c in level))
    copies = [F.struct(F.lit("/".join(level) or "all").alias("level"), *[(F.coalesce(F.col(c).cast("string"), F.lit("(none)")) if c in level else F.lit("(all)")).alias(c) for c in keys]) for level in levels]
    return df.select(*columns, F.explode(F.array(*copies)).alias("_l")).select("_l.*", *columns)


def nested_summary(df: DataFrame, levels: list[tuple[str, ...]], wanted: dict[str, tuple[Column, float]], aggs: list[Column], columns: list[str]) -> DataFrame:
    """Counts, aggregates and quantiles of every level of grouping, in one refinement of quantiles over all levels."""
    keys = list(dict.fromkeys(c for level in levels for c in level))
    return quantiles(at_levels(df, levels, columns), ["level", *keys], wanted, aggs)


def folded(rows: list, levels: list[tuple[str, ...]]) -> dict:
    """The rows of a nested summary as nested dictionaries: a level's groups under its name, one depth a column."""
    out: dict = {}
    names = {"/".join(level) or "all": level for level in levels}
    keys = {c for level in levels for c in level}
    for r in rows:
        values = r.asDict()
        level = values.pop("level")
        at = out.setdefault(level, {})
        for c in names[level]:
            at = at.setdefault(values[c], {})
        at.update({k: v for k, v in values.items() if k not in keys})
    return out


# ------------------------------------------------------------------ curbs


def curb_sensitivity(scored: DataFrame, by: list[str], predicted: Column, truth: Column, height_m: float, curb_m: float = 0.15) -> DataFrame:
    """Median signed error as it is and with the truth shortened by what a curb adds to it."""
    return quantiles(scored, by, {"signed_m": (predicted - truth, 0.5), "signed_corrected_m": (predicted - (truth - curb_m * truth / height_m), 0.5)})
