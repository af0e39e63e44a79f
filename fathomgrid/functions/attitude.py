"""Angles, quaternions and frame changes as Column expressions.

Body frame: +x forward, +y port. World frame: ENU metres, yaw counter-clockwise from East.
Functions of several values return a struct column.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

HALF_PI = math.pi / 2.0


def wrap_angle(angle: Column) -> Column:
    return F.atan2(F.sin(angle), F.cos(angle))


def angle_between(to: Column, origin: Column) -> Column:
    """Shortest signed turn from `origin` to `to`."""
    return wrap_angle(to - origin)


def compass_deg(yaw: Column) -> Column:
    """Heading clockwise from North, 0 <= heading < 360."""
    return F.pmod(F.lit(90.0) - F.degrees(yaw), F.lit(360.0))


def yaw_from_compass(deg: Column) -> Column:
    return F.radians(F.lit(90.0) - deg)


def quat_yaw(x: Column, y: Column, z: Column, w: Column) -> Column:
    return F.atan2(2.0 * (w * z + x * y), 1.0 - 2.0 * (y * y + z * z))


def quat_rpy(x: Column, y: Column, z: Column, w: Column) -> Column:
    """struct(roll, pitch, yaw); pitch saturates at a quarter turn."""
    sin_pitch = 2.0 * (w * y - z * x)
    pitch = F.when(F.abs(sin_pitch) >= 1.0, F.signum(sin_pitch) * HALF_PI).otherwise(F.asin(sin_pitch))
    roll = F.atan2(2.0 * (w * x + y * z), 1.0 - 2.0 * (x * x + y * y))
    return F.struct(roll.alias("roll"), pitch.alias("pitch"), quat_yaw(x, y, z, w).alias("yaw"))


def yaw_quat(yaw: Column) -> Column:
    zero = F.lit(0.0)
    return F.struct(zero.alias("x"), zero.alias("y"), F.sin(yaw * 0.5).alias("z"), F.cos(yaw * 0.5).alias("w"))


def rpy_quat(roll: Column, pitch: Column, yaw: Column) -> Column:
    """struct(x, y, z, w) of a ZYX rotation."""
    half = [(F.cos(a * 0.5), F.sin(a * 0.5)) for a in (roll, pitch, yaw)]
    (cr, sr), (cp, sp), (cy, sy) = half
    return F.struct(
        (sr * cp * cy - cr * sp * sy).alias("x"), (cr * sp * cy + sr * cp * sy).alias("y"),
        (cr * cp * sy - sr * sp * cy).alias("z"), (cr * cp * cy + sr * sp * sy).alias("w"))


def quat_multiply(a: tuple, b: tuple) -> Column:
    """Hamilton product of two w-first quaternions, struct(w, x, y, z)."""
    (aw, ax, ay, az), (bw, bx, by, bz) = a, b
    return F.struct(
        (aw * bw - ax * bx - ay * by - az * bz).alias("w"),
        (aw * bx + ax * bw + ay * bz - az * by).alias("x"),
        (aw * by - ax * bz + ay * bw + az * bx).alias("y"),
        (aw * bz + ax * by - ay * bx + az * bw).alias("z"))


def quat_error(a: tuple, b: tuple) -> Column:
    """Product of `a` with `b` whose last component is negated (not a true inverse; kept as defined)."""
    bw, bx, by, bz = b
    return quat_multiply(a, (bw, bx, by, -bz))


def quat_valid(x: Column, y: Column, z: Column, w: Column) -> Column:
    return (x * x + y * y + z * z + w * w) >= 1e-6


def body_to_world(x: Column, y: Column, yaw: Column, bx: Column, by: Column) -> Column:
    """A body-frame point (forward, port) in the world frame, struct(x, y)."""
    c, s = F.cos(yaw), F.sin(yaw)
    return F.struct((x + (c * bx - s * by)).alias("x"), (y + (s * bx + c * by)).alias("y"))


def local_to_enu(x: Column, y: Column, yaw0: Column) -> Column:
    """Heading-aligned local axes turned into ENU, struct(east, north)."""
    c, s = F.cos(yaw0 - HALF_PI), F.sin(yaw0 - HALF_PI)
    return F.struct((c * x - s * y).alias("east"), (s * x + c * y).alias("north"))


def swap_ned_enu(x: Column, y: Column, z: Column) -> Column:
    """NED to ENU position or velocity; the same rule undoes itself."""
    return F.struct(y.alias("x"), x.alias("y"), (-z).alias("z"))


def swap_ned_enu_rpy(roll: Column, pitch: Column, yaw: Column) -> Column:
    return F.struct(roll.alias("roll"), (-pitch).alias("pitch"), (HALF_PI - yaw).alias("yaw"))


def across_track_x(x: Column, yaw: Column, y_local: Column) -> Column:
    """World x of a sample at lateral offset `y_local` (+ port)."""
    return x - F.sin(yaw) * y_local


def across_track_y(y: Column, yaw: Column, y_local: Column) -> Column:
    return y + F.cos(yaw) * y_local


def swath_tips(x: Column, y: Column, yaw: Column, y_local: Column) -> Column:
    """Outer swath points on both sides, from the widest sample of the ping."""
    reach = F.array_max(F.transform(y_local, F.abs))
    return F.struct(
        (x - F.sin(yaw) * reach).alias("port_x"), (y + F.cos(yaw) * reach).alias("port_y"),
        (x + F.sin(yaw) * reach).alias("stbd_x"), (y - F.cos(yaw) * reach).alias("stbd_y"))


def flatten_odometry(odom: Column, quaternion: bool = False) -> Column:
    """struct(pose array, twist array) of an odometry struct with position, orientation, linear, angular."""
    p, q = odom["position"], odom["orientation"]
    place = [p["x"], p["y"], p["z"]]
    if quaternion:
        turn = [q["x"], q["y"], q["z"], q["w"]]
    else:
        rpy = quat_rpy(q["x"], q["y"], q["z"], q["w"])
        turn = [rpy["roll"], rpy["pitch"], rpy["yaw"]]
    twist = [odom[part][axis] for part in ("linear", "angular") for axis in ("x", "y", "z")]
    return F.struct(F.array(*place, *turn).alias("pose"), F.array(*twist).alias("twist"))
