"""Distances of the deployed and candidate models, as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import by_ordinal

#: Per zoom 1, 2, 3 the deployed intercept, slope on panorama pixels and slope on canvas_y.
INTERCEPT = [18.6051843, 20.8794248, 25.2472682]
PANO_SLOPE = [0.0138947, 0.0184087, 0.0264216]
CANVAS_SLOPE = [0.0011023, 0.0022135, 0.0011071]
#: The frame of the coefficients, the canvas centre, camera heights, the blend and the cap.
FRAME_HEIGHT = 6656.0
CANVAS_CENTRE_Y = 240.0
COTANGENT_HEIGHT_M, BLEND_HEIGHT_M, BLEND_DEG, CAP_M = 2.6, 2.783, 11.25, 50.0


def _line(offset_px: Column, canvas_y: Column, zoom: Column) -> Column:
    a, b, c = (by_ordinal(v, zoom) for v in (INTERCEPT, PANO_SLOPE, CANVAS_SLOPE))
    out = a + b * offset_px + c * canvas_y
    return F.when(out.isNotNull(), F.greatest(F.lit(0.0), out))


def deployed_distance(pano_y: Column, pano_height: Column, canvas_y: Column, zoom: Column) -> Column:
    """The zoom's line on pixels of the panorama as it is; zoom is rounded half to even and kept within 1 .. 3."""
    return _line(pano_height / 2 - pano_y, canvas_y, zoom)


def normalized_distance(dep: Column, canvas_y: Column, zoom: Column) -> Column:
    """The same line on pixels of the frame that it was fitted in."""
    return _line(-dep / 180 * FRAME_HEIGHT, canvas_y, zoom)


def anchor_distance(dep: Column) -> Column:
    """The height over the tangent, at most CAP_M; clicks on or above the horizon get CAP_M."""
    return F.when(dep.isNull(), None).when(dep <= 0, F.lit(CAP_M)).otherwise(F.least(COTANGENT_HEIGHT_M / F.tan(F.radians(dep)), F.lit(CAP_M)))


def model_distances(dep: Column, pano_height: Column) -> dict[str, Column]:
    """The four candidates from the depression alone, at zoom 1 and the canvas centre.

    C is not capped and infinite on and above the horizon; D's tail below the blend angle is level above it.
    """
    below = F.when(dep.isNull(), None)
    centre = F.lit(CANVAS_CENTRE_Y)
    angle = math.radians(BLEND_DEG)
    tail = BLEND_HEIGHT_M / math.tan(angle) + BLEND_HEIGHT_M * math.radians(1) / math.sin(angle) ** 2 * (BLEND_DEG - F.greatest(dep, F.lit(0.0)))
    return {
        "a_status_quo": _line(-dep / 180 * pano_height, centre, F.lit(1)),
        "b_normalized": normalized_distance(dep, centre, F.lit(1)),
        "c_cotangent": below.when(dep > 0, COTANGENT_HEIGHT_M / F.tan(F.radians(dep))).otherwise(F.lit(math.inf)),
        "d_blend": below.when(dep >= BLEND_DEG, BLEND_HEIGHT_M / F.tan(F.radians(F.greatest(dep, F.lit(1e-9))))).otherwise(F.least(F.greatest(tail, F.lit(0.0)), F.lit(CAP_M))),
    }
