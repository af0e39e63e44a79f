"""Queries over scalar maths: frames, geodesy, units, text, validity filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathomgrid.functions import attitude, geodesy, units
from fathomgrid.operators.missions import select_range
from fathomgrid.plans import tables
from fathomgrid.plans.catalog import STATES, R, query, r6, with_
from fathomgrid.sources.messages import fix_valid


def _col(*names):
    return [F.col(n) for n in names]


@query(with_(STATES + """,
o AS (SELECT seq, radians(lon - 7.30e0) * 6378137e0 * cos(radians(43.69e0)) AS east, radians(lat - 43.69e0) * 6378137e0 AS north FROM e)""",
             f"""SELECT seq, {R('east')}, {R('north')}, {R('43.69e0 + degrees(north / 6378137e0)', 'lat', 9)},
{R('7.30e0 + degrees(east / (6378137e0 * cos(radians(43.69e0))))', 'lon', 9)} FROM o"""))
def gps_roundtrip(spark, d):
    lat0, lon0 = F.lit(43.69), F.lit(7.30)
    out = tables.states(spark, d).select("seq", geodesy.gps_to_enu(lat0, lon0, *_col("lat", "lon")).alias("p"))
    back = geodesy.enu_to_gps(lat0, lon0, F.col("p.east"), F.col("p.north"))
    return out.select("seq", r6("p.east", "east"), r6("p.north", "north"), r6(back["lat"], "lat", 9), r6(back["lon"], "lon", 9))


@query(with_(STATES + """,
t AS (SELECT seq, x, y, cos(radians(30e0)) AS c, sin(radians(30e0)) AS s FROM e),
g AS (SELECT *, 43.69e0 + degrees((s * (x - 1e0) + c * (y - 2e0)) / 6378137e0) AS lat,
  7.30e0 + degrees((c * (x - 1e0) - s * (y - 2e0)) / (6378137e0 * cos(radians(43.69e0)))) AS lon FROM t)""",
             f"SELECT seq, {R('lat')}, {R('lon')}, {R('x', 'back_x')}, {R('y', 'back_y')} FROM g"))
def local_gps_offset(spark, d):
    """Local to GPS and back, with a bound origin and a 30 degree frame offset."""
    origin = F.struct(F.lit(43.69).alias("lat"), F.lit(7.30).alias("lon"), F.lit(1.0).alias("x"), F.lit(2.0).alias("y"))
    gps = tables.states(spark, d).select("seq", geodesy.local_to_gps(origin, *_col("x", "y"), 30.0).alias("g"))
    back = geodesy.gps_to_local(origin, F.col("g.lat"), F.col("g.lon"), 30.0)
    return gps.select("seq", r6("g.lat", "lat"), r6("g.lon", "lon"), r6(back["x"], "back_x"), r6(back["y"], "back_y"))


@query(with_(STATES + """,
t AS (SELECT seq, (lon + 180e0) / 360e0 * 262144e0 AS tx, (1e0 - asinh(tan(radians(lat))) / pi()) / 2e0 * 262144e0 AS ty, lat FROM e)""",
             f"""SELECT seq, CAST(floor(tx) AS BIGINT) AS tile_x, CAST(floor(ty) AS BIGINT) AS tile_y,
{R('degrees(atan(sinh(pi() * (1e0 - 2e0 * floor(ty) / 262144e0))))', 'corner_lat')}, {R('floor(tx) / 262144e0 * 360e0 - 180e0', 'corner_lon')},
{R('156543.03392e0 * cos(radians(lat)) / 262144e0', 'metres_per_px')} FROM t"""))
def tile_key(spark, d):
    z = F.lit(18)
    at = tables.states(spark, d).select("seq", "lat", geodesy.tile_xy(*_col("lat", "lon"), z).alias("t")).select(
        "seq", "lat", F.floor("t.x").alias("tile_x"), F.floor("t.y").alias("tile_y"))
    corner = geodesy.tile_corner(*_col("tile_x", "tile_y"), z)
    return at.select("seq", "tile_x", "tile_y", r6(corner["lat"], "corner_lat"), r6(corner["lon"], "corner_lon"),
                     r6(geodesy.ground_resolution(F.col("lat"), z), "metres_per_px"))


@query(with_(STATES, """SELECT seq, coalesce((SELECT max(z) FROM range(3, 20) r(z)
WHERE 156543.03392e0 * cos(radians(lat)) / pow(2e0, z) >= (value * value * 0.05e0 + 0.05e0) * 0.75e0), 19)::INTEGER AS zoom FROM e"""))
def tile_zoom(spark, d):
    view = F.col("value") * F.col("value") * 0.05 + 0.05
    return tables.states(spark, d).select("seq", geodesy.zoom_for(F.col("lat"), view).alias("zoom"))


@query(with_(STATES + """,
a AS (SELECT seq, (seq % 7) * 0.1e0 - 0.3e0 AS roll, (seq % 11) * 0.1e0 - 0.5e0 AS pitch, yaw FROM e),
q AS (SELECT *, cos(roll / 2) AS cr, sin(roll / 2) AS sr, cos(pitch / 2) AS cp, sin(pitch / 2) AS sp, cos(yaw / 2) AS cy, sin(yaw / 2) AS sy FROM a),
w AS (SELECT *, sr * cp * cy - cr * sp * sy AS qx, cr * sp * cy + sr * cp * sy AS qy, cr * cp * sy - sr * sp * cy AS qz, cr * cp * cy + sr * sp * sy AS qw FROM q)""",
             f"""SELECT seq, {R('qx')}, {R('qy')}, {R('qz')}, {R('qw')}, {R('roll')}, {R('pitch')}, {R('atan2(sin(yaw), cos(yaw))', 'yaw')},
{R('sin(yaw / 2)', 'flat_z')}, {R('cos(yaw / 2)', 'flat_w')} FROM w"""))
def quaternion_angles(spark, d):
    """Roll, pitch, yaw to a quaternion and back."""
    rows = tables.states(spark, d).select("seq", "yaw", attitude.rpy_quat(
        (F.col("seq") % 7) * 0.1 - 0.3, (F.col("seq") % 11) * 0.1 - 0.5, F.col("yaw")).alias("q"))
    q = _col("q.x", "q.y", "q.z", "q.w")
    rpy, flat = attitude.quat_rpy(*q), attitude.yaw_quat(F.col("yaw"))
    return rows.select("seq", *[r6(c, n) for c, n in zip(q, ("qx", "qy", "qz", "qw"))], r6(rpy["roll"], "roll"),
                       r6(rpy["pitch"], "pitch"), r6(attitude.quat_yaw(*q), "yaw"), r6(flat["z"], "flat_z"), r6(flat["w"], "flat_w"))


@query(with_(STATES + """,
q AS (SELECT seq, cos(x) AS aw, sin(y) AS ax, yaw AS ay, 0.5e0 AS az, cos(yaw) AS bw, 0.25e0 AS bx, sin(x) AS by_, cos(y) AS bz FROM e)""",
             f"""SELECT seq, {R('aw * bw - ax * bx - ay * by_ - az * bz', 'w')}, {R('aw * bx + ax * bw + ay * bz - az * by_', 'x')},
{R('aw * by_ - ax * bz + ay * bw + az * bx', 'y')}, {R('aw * bz + ax * by_ - ay * bx + az * bw', 'z')},
{R('aw * bw - ax * bx - ay * by_ + az * bz', 'ew')}, {R('aw * bx + ax * bw - ay * bz - az * by_', 'ex')},
{R('aw * by_ + ax * bz + ay * bw + az * bx', 'ey')}, {R('-aw * bz + ax * by_ - ay * bx + az * bw', 'ez')} FROM q"""))
def quaternion_products(spark, d):
    x, y, yaw = _col("x", "y", "yaw")
    a, b = (F.cos(x), F.sin(y), yaw, F.lit(0.5)), (F.cos(yaw), F.lit(0.25), F.sin(x), F.cos(y))
    rows = tables.states(spark, d).select("seq", attitude.quat_multiply(a, b).alias("m"), attitude.quat_error(a, b).alias("e"))
    return rows.select("seq", *[r6(f"m.{c}", c) for c in "wxyz"], *[r6(f"e.{c}", f"e{c}") for c in "wxyz"])


@query(with_(STATES, f"""SELECT seq, {R('x + (cos(yaw) * 1.5e0 - sin(yaw) * -0.5e0)', 'world_x')}, {R('y + (sin(yaw) * 1.5e0 + cos(yaw) * -0.5e0)', 'world_y')},
{R('cos(yaw - pi() / 2) * x - sin(yaw - pi() / 2) * y', 'east')}, {R('sin(yaw - pi() / 2) * x + cos(yaw - pi() / 2) * y', 'north')},
{R('y', 'ned_x')}, {R('x', 'ned_y')}, {R('-value', 'ned_z')}, {R('pi() / 2 - yaw', 'ned_yaw')},
{R('atan2(sin(yaw * 3), cos(yaw * 3))', 'wrapped')}, {R('sqrt((x - 3) * (x - 3) + (y - 4) * (y - 4))', 'distance_m')} FROM e"""))
def frame_changes(spark, d):
    x, y, yaw, value = _col("x", "y", "yaw", "value")
    ned = attitude.swap_ned_enu(x, y, value)
    rows = tables.states(spark, d).select(
        "seq", attitude.body_to_world(x, y, yaw, F.lit(1.5), F.lit(-0.5)).alias("w"), attitude.local_to_enu(x, y, yaw).alias("l"),
        ned.alias("n"), attitude.swap_ned_enu_rpy(yaw, yaw, yaw).alias("r"), attitude.wrap_angle(yaw * 3).alias("a"),
        units.distance(x, y, F.lit(3.0), F.lit(4.0)).alias("dist"))
    return rows.select("seq", r6("w.x", "world_x"), r6("w.y", "world_y"), r6("l.east", "east"), r6("l.north", "north"), r6("n.x", "ned_x"),
                       r6("n.y", "ned_y"), r6("n.z", "ned_z"), r6("r.yaw", "ned_yaw"), r6("a", "wrapped"), r6("dist", "distance_m"))


@query(with_(STATES, f"SELECT seq, {R('90e0 - degrees(yaw) - 360e0 * floor((90e0 - degrees(yaw)) / 360e0)', 'heading_deg')} FROM e"))
def compass_heading(spark, d):
    return tables.states(spark, d).select("seq", r6(attitude.compass_deg(F.col("yaw")), "heading_deg"))


@query(with_(STATES, "SELECT seq, us * 1000 // 1000000000 AS sec, us * 1000 % 1000000000 AS nanosec, us * 1000 AS stamp_ns FROM e"))
def stamp_parts(spark, d):
    parts = tables.states(spark, d).select("seq", units.ns_parts(F.col("us") * 1000).alias("p"))
    return parts.select("seq", "p.sec", "p.nanosec", units.stamp_ns(F.col("p.sec"), F.col("p.nanosec")).alias("stamp_ns"))


@query(with_(STATES + ", s AS (SELECT *, seq * 7.5e0 AS sec FROM e)", """SELECT seq, printf('%.7f, %.7f', lat, lon) AS position,
printf('%02d:%04.1f', CAST(floor(sec / 60) AS BIGINT), sec - floor(sec / 60) * 60) AS minutes,
printf('%02d:%02d:%02d', CAST(floor(sec) AS BIGINT) // 3600, CAST(floor(sec) AS BIGINT) % 3600 // 60, CAST(floor(sec) AS BIGINT) % 60) AS hours FROM s"""))
def text_formats(spark, d):
    sec = F.col("seq") * 7.5
    return tables.states(spark, d).select("seq", geodesy.latlon_text(*_col("lat", "lon")).alias("position"),
                                          units.minutes_text(sec).alias("minutes"), units.hours_text(sec).alias("hours"))


@query(with_(STATES, f"""SELECT seq, CAST(round_even(lat * 1e7, 0) AS BIGINT) AS lat_e7, {R('round_even(lat * 1e7, 0) / 1e7', 'lat')},
CAST(round_even(value * 1000e0, 0) AS BIGINT) AS alt_mm, {R('round_even(value * 1000e0, 0) / 1000e0', 'alt_m')},
CAST(round_even(compass_deg * 100e0, 0) AS BIGINT) % 36000 AS hdg_cdeg, {R('compass_deg', 'hdg_deg')} FROM e"""))
def unit_conversions(spark, d):
    lat, value, compass = units.whole(F.col("lat") * 1e7), units.whole(F.col("value") * 1000.0), units.whole(F.col("compass_deg") * 100.0)
    return tables.states(spark, d).select(
        "seq", lat.alias("lat_e7"), r6(units.deg_e7(lat), "lat"), value.alias("alt_mm"), r6(units.milli(value), "alt_m"),
        F.pmod(compass, F.lit(36000)).alias("hdg_cdeg"), r6(units.centi(compass), "hdg_deg"))


@query(with_(STATES, """SELECT seq, event_type <> 'error' AND seq % 17 <> 0 AS fix_ok, seq % 5 <> 0 AS attitude_ok, seq % 13 > 1 AS compass_ok FROM e"""))
def validity_flags(spark, d):
    """Fix, attitude and compass validity."""
    e = F.col("seq")
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    status = F.when(F.col("event_type") == "error", -1).otherwise(0)
    lat = F.when(e % 17 == 0, nan).otherwise(F.col("lat"))
    zero = F.when(e % 5 == 0, 0.0).otherwise(0.5)
    compass = F.when(e % 13 == 0, nan).when(e % 13 == 1, inf).otherwise(F.col("compass_deg"))
    return tables.states(spark, d).select(
        "seq", fix_valid(status, lat, F.col("lon")).alias("fix_ok"),
        attitude.quat_valid(zero, zero, zero, zero).alias("attitude_ok"), units.finite(compass).alias("compass_ok"))


@query(with_(STATES, f"SELECT mission_id, seq, {R('x')} FROM e WHERE t BETWEEN 1704500000e0 AND 1705500000e0"))
def time_range(spark, d):
    """Events between two times."""
    return select_range(tables.states(spark, d), 1704500000.0, 1705500000.0).select("mission_id", "seq", r6("x"))


@query(with_(STATES, f"""SELECT seq, {R('x')}, {R('y')}, {R('value', 'z')}, 0e0 AS roll, 0e0 AS pitch, {R('atan2(sin(yaw), cos(yaw))', 'yaw')},
{R('x * 2', 'u')}, {R('yaw * 3', 'r')}, {R('sin(yaw / 2)', 'qz')} FROM e"""))
def odometry_vectors(spark, d):
    """Odometry flattened to pose and twist vectors, with Euler angles and with the quaternion."""
    x, y, yaw, zero = F.col("x"), F.col("y"), F.col("yaw"), F.lit(0.0)

    def named(**parts):
        return F.struct(*[c.alias(n) for n, c in parts.items()])
    odom = named(position=named(x=x, y=y, z=F.col("value")), orientation=named(x=zero, y=zero, z=F.sin(yaw / 2), w=F.cos(yaw / 2)),
                 linear=named(x=x * 2, y=zero, z=zero), angular=named(x=zero, y=zero, z=yaw * 3))
    rows = tables.states(spark, d).select("seq", odom.alias("o"))
    flat = rows.select("seq", attitude.flatten_odometry(F.col("o")).alias("e"), attitude.flatten_odometry(F.col("o"), True).alias("q"))
    pose = [r6(F.get("e.pose", F.lit(i)), n) for i, n in enumerate(("x", "y", "z", "roll", "pitch", "yaw"))]
    return flat.select("seq", *pose, r6(F.get("e.twist", F.lit(0)), "u"), r6(F.get("e.twist", F.lit(5)), "r"), r6(F.get("q.pose", F.lit(5)), "qz"))
