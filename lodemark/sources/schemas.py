"""Schemas of the input tables. Identifiers that look like numbers stay strings."""

from __future__ import annotations




#: Historical labels as read: flags are text until they are decoded.
HISTORICAL = (
    "label_id long, label_type string, lat double, lng double, panorama_lat double, panorama_lng double, canvas_x long, canvas_y long, canvas_width long, canvas_height long, "
    "heading double, pitch double, zoom long, photographer_heading double, photographer_pitch double, sv_image_x long, sv_image_y long, gsv_panorama_id string, street_edge_id long, "
    "deleted string, tutorial string, computation_method string, pano_width long, pano_height long, time_created string, current_pano_x long, current_pano_y long"
)
MODERN = (
    "label_id long, label_type string, lat double, lng double, canvas_x long, canvas_y long, heading double, pitch double, zoom double, pano_x long, pano_y long, computation_method string, "
    "pano_id string, time_created string, is_ai string, pano_width long, pano_height long, pano_lat double, pano_lng double, camera_heading double, camera_pitch double, camera_roll double, "
    "capture_date date, pano_source string"
)
SITES = "site_id string, members array<struct<pano_id: string, y_normalized: double, bearing_deg: double, range_m: double, lat: double, lng: double, in_refit: boolean>>"
PAYLOADS = "pano_id string, part string, city string, fetched_utc string, capture_year int, capture_month int, image_sizes string, depth_b64 string"
MODERN_PAYLOADS = "pano_id string, b64 string"
PANO_META = "pano_id string, yaw_deg double, pitch_deg double, roll_deg double, link_bearings_deg string"
TILES = "pano_id string, `set` string, zoom int, width int, height int, tile_width int, tile_height int, capture_year int, tiles array<struct<x: int, y: int, b64: string>>"
