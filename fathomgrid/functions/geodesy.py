"""Local metres to latitude/longitude and slippy-map tiles, as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
EARTH_RADIUS_M = 6378137.0
WEB_MERCATOR_MAX_LAT = 85.05112878
EQUATOR_M_PER_PX = 156543.03392
MIN_ZOOM, MAX_ZOOM = 3, 19
SHARPNESS = 0.75


def enu_to_gps(lat0: Column, lon0: Column, east: Column, north: Column) -> Column:
    """struct(lat, lon) of an offset from an origin, equirectangular around that origin."""
    return F.struct(
        (lat0 + F.degrees(north / EARTH_RADIUS_M)).alias("lat"),
        (lon0 + F.degrees(east / (EARTH_RADIUS_M * F.cos(F.radians(lat0))))).alias("lon"))


def gps_to_enu(lat0: Column, lon0: Column, lat: Column, lon: Column) -> Column:
    """struct(east, north); exact inverse of `enu_to_gps`."""
    return F.struct(
        (F.radians(lon - lon0) * EARTH_RADIUS_M * F.cos(F.radians(lat0))).alias("east"),
        (F.radians(lat - lat0) * EARTH_RADIUS_M).alias("north"))


def _turn(x: Column, y: Column, theta: float) -> tuple[Column, Column]:
    c, s = math.cos(theta), math.sin(theta)
    return c * x - s * y, s * x + c * y


def local_to_gps(origin: Column, x: Column, y: Column, yaw_offset_deg: float = 0.0) -> Column:
    """GPS of a local point. `origin` is struct(lat, lon, x, y): NULL until bound, and so is the result."""
    east, north = _turn(x - origin["x"], y - origin["y"], math.radians(yaw_offset_deg))
    return F.when(origin.isNotNull(), enu_to_gps(origin["lat"], origin["lon"], east, north))


def gps_to_local(origin: Column, lat: Column, lon: Column, yaw_offset_deg: float = 0.0) -> Column:
    enu = gps_to_enu(origin["lat"], origin["lon"], lat, lon)
    x, y = _turn(enu["east"], enu["north"], -math.radians(yaw_offset_deg))
    return F.when(origin.isNotNull(), F.struct((x + origin["x"]).alias("x"), (y + origin["y"]).alias("y")))


def tile_xy(lat: Column, lon: Column, zoom: Column) -> Column:
    """Fractional slippy-tile coordinates, struct(x, y)."""
    n = F.pow(F.lit(2.0), zoom)
    clamped = F.radians(F.greatest(F.lit(-WEB_MERCATOR_MAX_LAT), F.least(F.lit(WEB_MERCATOR_MAX_LAT), lat)))
    return F.struct(
        ((lon + 180.0) / 360.0 * n).alias("x"),
        ((1.0 - F.asinh(F.tan(clamped)) / math.pi) / 2.0 * n).alias("y"))


def tile_corner(x: Column, y: Column, zoom: Column) -> Column:
    """Latitude/longitude of a tile's north-west corner."""
    n = F.pow(F.lit(2.0), zoom)
    return F.struct(
        F.degrees(F.atan(F.sinh(math.pi * (1.0 - 2.0 * y / n)))).alias("lat"),
        (x / n * 360.0 - 180.0).alias("lon"))


def ground_resolution(lat: Column, zoom: Column) -> Column:
    """Metres per tile pixel."""
    return EQUATOR_M_PER_PX * F.cos(F.radians(lat)) / F.pow(F.lit(2.0), zoom)


def zoom_for(lat: Column, metres_per_px: Column) -> Column:
    """Largest zoom whose pixels are still at least 0.75 view pixels wide; the maximum if none is."""
    choices = [F.when(ground_resolution(lat, F.lit(z)) >= metres_per_px * SHARPNESS, F.lit(z))
               for z in range(MAX_ZOOM, MIN_ZOOM - 1, -1)]
    return F.coalesce(*choices, F.lit(MAX_ZOOM))


def latlon_text(lat: Column, lon: Column) -> Column:
    return F.format_string("%.7f, %.7f", lat, lon)
