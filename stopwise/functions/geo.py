"""Distances, bearings and grid cells as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
M_PER_DEG = 111_320.0
WALK_SPEED = 1.2


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres; null where a coordinate is."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.when(a > 1, 1.0).otherwise(a)))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing in degrees, 0 to below 360."""
    turn = F.radians(lon2 - lon1)
    y = F.sin(turn) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(turn)
    return (F.degrees(F.atan2(y, x)) + 360) % 360


def metres_per_degree_of_longitude(lat: Column) -> Column:
    """Never below a fifth of the equator's, so that cells near the poles stay finite."""
    return M_PER_DEG * F.greatest(F.lit(0.2), F.cos(F.radians(lat)))


def walk_seconds(distance_m: Column, speed: float = WALK_SPEED, least: int = 1) -> Column:
    return F.greatest(F.ceil(distance_m / speed), F.lit(least)).cast("int")


def snap_outward(value: Column, step: float, up: bool) -> Column:
    """The next multiple of ``step`` outward, for bounding boxes that are used as keys."""
    k = value / step
    return (F.ceil(k) if up else F.floor(k)) * step


def in_box(lat: Column, lon: Column, south: float, west: float, north: float, east: float) -> Column:
    return lat.between(south, north) & lon.between(west, east)


def contrast_text(hex_color: Column) -> Column:
    """Black on light colours, white on dark ones, by luminance above 160; null unless six hex digits."""
    h = F.upper(F.regexp_replace(hex_color, "^#", ""))
    r, g, b = (F.conv(F.substring(h, k, 2), 16, 10).cast("int") for k in (1, 3, 5))
    light = (r * 299 + g * 587 + b * 114) / 1000 > 160
    return F.when(h.rlike("^[0-9A-F]{6}$"), F.when(light, F.lit("000000")).otherwise(F.lit("FFFFFF")))
