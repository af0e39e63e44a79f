"""NED telemetry envelopes: ENU records back to JSON messages for the recorder."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomgrid.functions import attitude, units
from fathomgrid.operators.ordered import MISSION, Slices, latest, scan
from fathomgrid.operators.telemetry import sequence_numbers
from fathomgrid.sources.messages import fix_valid

# Fixed values.
SYSTEM_ID = COMPONENT_ID = 1
BOOT_MASK = 0xFFFFFFFF
FULL_TURN_CDEG = 36_000


def boot_ms(stamp_ns: Column, boot_ns: Column) -> Column:
    """Milliseconds since boot, modulo 2^32; equal stamps stay equal."""
    ns = stamp_ns - boot_ns
    ms = ((ns - F.pmod(ns, F.lit(1_000_000))) / 1_000_000).cast("long")
    return ms.bitwiseAND(F.lit(BOOT_MASK).cast("long"))


def _message(name: str, **fields: Column) -> Column:
    return F.struct(F.lit(name).alias("type"), *[c.alias(n) for n, c in fields.items()])


def envelopes(records: DataFrame, boot_ns: Column | None = None, *, keys: Sequence[str] = MISSION,
              order: Sequence[str] = ("stamp_ns", "seq"), slices: Slices | None = None) -> DataFrame:
    """keys, order, type, sequence and `envelope` (JSON) of stacked records.

    `kind` is imu, fix, pose, velocity, rel_alt, compass, home, origin or vfr; the columns are
    those of the typed topics. Fixes take the latest relative altitude and heading before them,
    poses the latest velocity. Records that are not valid are left out and take no number.
    """
    slices = slices or Slices.fit(order[0])
    kind = F.col("kind")
    finite = units.finite(F.col("data"))
    seen = scan(records, {
        "_rel": latest(F.when((kind == "rel_alt") & finite, units.whole(F.col("data") * 1000.0))),
        "_hdg": latest(F.when((kind == "compass") & finite, F.pmod(units.whole(F.col("data") * 100.0), F.lit(FULL_TURN_CDEG)))),
        "_vel": latest(F.when(kind == "velocity", F.struct("vx", "vy", "vz"))),
    }, keys=keys, order=order, slices=slices)
    q = [F.col(c) for c in ("qx", "qy", "qz", "qw")]
    sendable = (
        ((kind == "imu") & attitude.quat_valid(*q))
        | ((kind == "fix") & fix_valid(F.col("status"), F.col("lat"), F.col("lon"), F.col("alt")))
        | kind.isin("pose", "home", "origin", "vfr"))
    numbered = sequence_numbers(seen.filter(F.coalesce(sendable, F.lit(False))), keys=keys, order=order, slices=slices)
    rpy = attitude.quat_rpy(*q)
    ned = attitude.swap_ned_enu_rpy(rpy["roll"], rpy["pitch"], rpy["yaw"])
    boot = boot_ms(F.col("stamp_ns"), F.lit(0).cast("long") if boot_ns is None else boot_ns)
    zero, zero_int = F.lit(0.0), F.lit(0)
    pos, vel = attitude.swap_ned_enu(F.col("x"), F.col("y"), F.col("z")), F.col("_vel")
    speed = {a: F.coalesce(v, zero) for a, v in (("vx", vel["vy"]), ("vy", vel["vx"]), ("vz", -vel["vz"]))}
    place = {"latitude": units.whole(F.col("lat") * 1e7), "longitude": units.whole(F.col("lon") * 1e7),
             "altitude": units.whole(F.col("alt") * 1000.0)}
    messages = {
        "imu": _message("ATTITUDE", time_boot_ms=boot, roll=ned["roll"], pitch=ned["pitch"], yaw=ned["yaw"],
                        rollspeed=F.col("wx"), pitchspeed=-F.col("wy"), yawspeed=-F.col("wz")),
        "fix": _message("GLOBAL_POSITION_INT", time_boot_ms=boot, lat=place["latitude"], lon=place["longitude"], alt=place["altitude"],
                        relative_alt=F.coalesce("_rel", zero_int), vx=zero_int, vy=zero_int, vz=zero_int, hdg=F.coalesce("_hdg", zero_int)),
        "pose": _message("LOCAL_POSITION_NED", time_boot_ms=boot, x=pos["x"], y=pos["y"], z=pos["z"], **speed),
        "home": _message("HOME_POSITION", **place, x=zero, y=zero, z=zero, q=F.array(F.lit(1.0), zero, zero, zero),
                         approach_x=zero, approach_y=zero, approach_z=zero),
        "origin": _message("GPS_GLOBAL_ORIGIN", **place),
        "vfr": _message("VFR_HUD", airspeed=F.col("airspeed"), groundspeed=F.col("groundspeed"), heading=F.col("heading").cast("int"),
                        throttle=units.whole(F.col("throttle") * 100.0), alt=F.col("altitude"), climb=F.col("climb")),
    }
    header = F.struct(F.lit(SYSTEM_ID).alias("system_id"), F.lit(COMPONENT_ID).alias("component_id"), "sequence")
    text = name = None
    for k, message in messages.items():
        body = F.to_json(F.struct(header.alias("header"), message.alias("message")))
        text = F.when(kind == k, body) if text is None else text.when(kind == k, body)
        name = F.when(kind == k, message["type"]) if name is None else name.when(kind == k, message["type"])
    return numbered.select(*keys, *order, name.alias("type"), "sequence", text.alias("envelope"))
