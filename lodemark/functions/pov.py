"""Click projection: canvas position, heading, pitch and zoom -> angles and panorama pixels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import floor_mod, wrap_keep_plus

CANVAS_WIDTH, CANVAS_HEIGHT = 720, 480


def field_of_view(zoom: Column) -> Column:
    """Horizontal field of view in degrees."""
    return F.when(zoom <= 2, 126.5 - zoom * 36.75).otherwise(195.93 / F.pow(F.lit(1.92), zoom))


def pov_if_centered(canvas_x: Column, canvas_y: Column, heading: Column, pitch: Column, zoom: Column) -> tuple[Column, Column]:
    """X11: heading and pitch of the clicked direction.

    The ray is focal * forward + right * across + up * above in an east, north, up frame; beyond the
    vertical (cos of the pitch below zero) the image's right is the other way.
    """
    sin_h, cos_h = F.sin(F.radians(heading)), F.cos(F.radians(heading))
    sin_p, cos_p = F.sin(F.radians(pitch)), F.cos(F.radians(pitch))
    focal = 0.5 * CANVAS_WIDTH / F.tan(0.5 * F.radians(field_of_view(zoom)))
    across = (canvas_x - CANVAS_WIDTH / 2) * F.when(cos_p >= 0, F.lit(1.0)).otherwise(F.lit(-1.0))
    above = CANVAS_HEIGHT / 2 - canvas_y
    level = focal * cos_p - above * sin_p  # along the heading, on the ground
    east = level * sin_h + across * cos_h
    north = level * cos_h - across * sin_h
    lift = focal * sin_p + above * cos_p
    return F.degrees(F.atan2(east, north)), F.degrees(F.asin(lift / F.sqrt(east * east + north * north + lift * lift)))


def exact_heading_diff(canvas_x: Column, canvas_y: Column, heading: Column, pitch: Column, zoom: Column) -> Column:
    """Clicked heading less camera heading, one turn at most, in (-180, 180]."""
    return wrap_keep_plus(pov_if_centered(canvas_x, canvas_y, heading, pitch, zoom)[0] - heading)


def exact_depression(canvas_x: Column, canvas_y: Column, heading: Column, pitch: Column, zoom: Column) -> Column:
    """Degrees below the horizon."""
    return -pov_if_centered(canvas_x, canvas_y, heading, pitch, zoom)[1]


def era_heading_diff(canvas_x: Column, canvas_y: Column, heading: Column, pitch: Column, zoom: Column, shift: float = 0.5) -> Column:
    """As the old client saw it: heading and pitch cut toward zero first, half a degree added."""
    whole = [x.cast("long").cast("double") for x in (heading, pitch)]
    return wrap_keep_plus(pov_if_centered(canvas_x, canvas_y, *whole, zoom)[0] + shift - heading)


def pano_pixel(pov_heading: Column, pov_pitch: Column, camera_heading: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """Panorama pixel of a direction; offsets are rounded half to even, x wraps on the width.

    Pixel zero looks away from the camera heading.
    """
    turn = floor_mod(pov_heading, 360.0) - floor_mod(camera_heading + 180, 360.0)
    return F.pmod(F.rint(width * turn / 360), width), height / 2 - F.rint(height / 2 * (pov_pitch / 90))


def seam_difference(dx: Column, width: Column) -> Column:
    """Pixel difference the short way round."""
    return F.pmod(dx + width / 2, width) - width / 2


def pixel_depression(pano_y: Column, height: Column) -> Column:
    """Degrees below the horizon of a pixel row."""
    return (pano_y - height / 2) * 180 / height


def normal_depression(y: Column) -> Column:
    """Degrees below the horizon of a row given as a share of the height."""
    return (y - 0.5) * 180
