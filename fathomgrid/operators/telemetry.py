"""Clock, boat state and pose repair from telemetry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomgrid.config import Alignment
from fathomgrid.functions import attitude, geodesy, units
from fathomgrid.operators import sequential
from fathomgrid.operators.asof import attach_latest
from fathomgrid.operators.ordered import MISSION, Slices, latest, position, previous, running, scan

# Fixed values.
TICK_NS = 20_000_000
CONVERTER_EPOCH_NS = 1_704_067_200 * units.NS


def burst_clock(packets: DataFrame, start_ns: int = 0, *, keys: Sequence[str] = MISSION,
                order: Sequence[str] = ("seq",), boot: str = "time_boot_ms", slices: Slices | None = None) -> DataFrame:
    """Add `stamp_ns`: 20 ms per packet, but packets repeating the previous boot time share a stamp.

    A packet without boot time always ticks. The replay clock starts at 0 and runs over every
    sonar and decoded telemetry packet; the converter clock starts at `CONVERTER_EPOCH_NS` and
    runs only over packets that decoded, so filter those first.
    """
    slices = slices or Slices.fit(order[0])
    seen = scan(packets, {"_last": previous(F.col(boot))}, keys=keys, order=order, slices=slices)
    tick = F.when(F.col(boot).isNotNull() & F.col(boot).eqNullSafe(F.col("_last")), 0).otherwise(1).cast("long")
    out = scan(seen, {"_ticks": running(tick)}, keys=keys, order=order, slices=slices)
    return out.withColumn("stamp_ns", F.col("_ticks") * TICK_NS + start_ns).drop("_last", "_ticks")


def locf(df: DataFrame, columns: Sequence[str], *, keys: Sequence[str] = MISSION,
         order: Sequence[str] = ("t", "seq"), slices: Slices | None = None) -> DataFrame:
    """Fill `columns` with their last non-NULL value."""
    out = scan(df, {f"_{c}": latest(F.col(c)) for c in columns}, keys=keys, order=order, slices=slices)
    return out.withColumns({c: F.col(f"_{c}") for c in columns}).drop(*[f"_{c}" for c in columns])


def robot_states(records: DataFrame, *, keys: Sequence[str] = MISSION, order: Sequence[str] = ("t", "seq"),
                 slices: Slices | None = None) -> DataFrame:
    """Boat states from a stacked telemetry stream, one per odometry row.

    `records` has `kind` (odom, gps, compass, vfr), x, y, yaw, vx, vy of odometry, and lat, lon,
    compass_deg, groundspeed of the others. The latest of each is attached; heading falls back to
    yaw and speed to the odometry velocity. Invalid fixes must be filtered before.
    """
    fix = F.when(F.col("kind") == "gps", F.struct("lat", "lon"))
    hdg = F.when((F.col("kind") == "compass") & units.finite(F.col("compass_deg")), F.pmod("compass_deg", F.lit(360.0)))
    spd = F.when(F.col("kind") == "vfr", F.col("groundspeed"))
    out = scan(records, {"_fix": latest(fix), "_hdg": latest(hdg), "_spd": latest(spd)}, keys=keys, order=order, slices=slices)
    return out.filter("kind = 'odom'").select(
        *keys, *order, "x", "y", "yaw", F.col("_fix.lat").alias("lat"), F.col("_fix.lon").alias("lon"),
        F.coalesce("_hdg", attitude.compass_deg(F.col("yaw"))).alias("heading_deg"),
        F.coalesce("_spd", F.hypot("vx", "vy")).alias("speed_mps"))


def synthesise_odom(telemetry: DataFrame, *, keys: Sequence[str] = MISSION, order: Sequence[str] = ("seq",),
                    slices: Slices | None = None) -> DataFrame:
    """A pose on every ATTITUDE or LOCAL_POSITION_NED once both are known: ENU position, velocity
    and attitude from the latest of each. Absent numbers count as 0."""
    def num(c):
        return F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    turn = F.when(F.col("type") == "ATTITUDE", attitude.swap_ned_enu_rpy(num("roll"), num("pitch"), num("yaw")))
    move = F.when(F.col("type") == "LOCAL_POSITION_NED", F.struct(
        attitude.swap_ned_enu(num("x"), num("y"), num("z")).alias("p"),
        attitude.swap_ned_enu(num("vx"), num("vy"), num("vz")).alias("v")))
    out = scan(telemetry, {"_turn": latest(turn), "_move": latest(move)}, keys=keys, order=order, slices=slices)
    out = out.filter(F.col("type").isin("ATTITUDE", "LOCAL_POSITION_NED")
                     & F.col("_turn").isNotNull() & F.col("_move").isNotNull())
    p, v, r = F.col("_move.p"), F.col("_move.v"), F.col("_turn")
    stamp = ["stamp_ns"] if "stamp_ns" in telemetry.columns else []
    return out.select(
        *keys, *order, *stamp, p["x"].alias("x"), p["y"].alias("y"), p["z"].alias("z"),
        v["x"].alias("vx"), v["y"].alias("vy"), v["z"].alias("vz"),
        r["roll"].alias("roll"), r["pitch"].alias("pitch"), r["yaw"].alias("yaw"))


def dead_reckon(fixes: DataFrame, *, keys: Sequence[str] = MISSION, order: Sequence[str] = ("t", "seq"),
                slices: Slices | None = None) -> DataFrame:
    """Local pose and speed from GPS fixes (lat, lon) and compass: the first fix is the origin. Speed is 0 for the first fix and
    for steps of 1 ms or less."""
    first = fixes.groupBy(*keys).agg(F.min_by(F.struct("lat", "lon"), F.struct(*order)).alias("_ref"))
    seen = scan(fixes, {"_was": previous(F.struct(order[0], "lat", "lon"))}, keys=keys, order=order, slices=slices)
    ref, was = F.col("_ref"), F.col("_was")
    here = geodesy.gps_to_enu(ref["lat"], ref["lon"], F.col("lat"), F.col("lon"))
    before = geodesy.gps_to_enu(ref["lat"], ref["lon"], was["lat"], was["lon"])
    out = seen.join(first, list(keys)).withColumns({"_here": here, "_before": before})
    dt = F.col(order[0]) - was[order[0]]
    moved = units.distance(F.col("_here.east"), F.col("_here.north"), F.col("_before.east"), F.col("_before.north"))
    return out.select(
        *fixes.columns, F.col("_here.east").alias("reckoned_x"), F.col("_here.north").alias("reckoned_y"),
        F.coalesce(attitude.yaw_from_compass(F.col("compass_deg")), F.lit(0.0)).alias("reckoned_yaw"),
        F.when(dt > 1e-3, moved / dt).otherwise(0.0).alias("reckoned_speed"))


def frozen_poses(pings: DataFrame, params: Alignment = Alignment(), *, keys: Sequence[str] = MISSION,
                 order: Sequence[str] = ("t", "seq"), slices: Slices | None = None) -> DataFrame:
    """Add `engaged`: ping poses have been stuck at the origin while the boat is elsewhere.

    Needs robot_x, robot_y of the ping and state_x, state_y (NULL: unknown). A frozen ping while
    the boat has not moved neither counts nor resets; any other ping resets.
    """
    slices = slices or Slices.fit(order[0])
    frozen = (F.abs("robot_x") < params.frozen_eps_m) & (F.abs("robot_y") < params.frozen_eps_m)
    moved = F.coalesce(F.hypot("state_x", "state_y") > params.moved_min_m, F.lit(False))
    counted = scan(pings.withColumn("_frozen", frozen), {"_hits": running((F.col("_frozen") & moved).cast("long"))},
                   keys=keys, order=order, slices=slices)
    based = scan(counted, {"_base": latest(F.when(~F.col("_frozen"), F.col("_hits")))}, keys=keys, order=order, slices=slices)
    streak = F.col("_hits") - F.coalesce("_base", F.lit(0))
    return based.withColumn("engaged", F.col("_frozen") & (streak >= params.frozen_after)).drop("_frozen", "_hits", "_base")


def track_segments(states: DataFrame, params: Alignment = Alignment(), *, keys: Sequence[str] = MISSION,
                   order: Sequence[str] = ("t", "seq"), slices: Slices | None = None) -> DataFrame:
    """Add `segment` (from 0): a new one after a jump or after a silence longer than `stale_s`."""
    slices = slices or Slices.fit(order[0])
    seen = scan(states, {"_was": previous(F.struct(F.col(order[0]).alias("t"), "x", "y"))}, keys=keys, order=order, slices=slices)
    was = F.col("_was")
    jump = units.distance(F.col("x"), F.col("y"), was["x"], was["y"]) > params.jump_m
    gap = F.col(order[0]) - was["t"] > params.stale_s
    breaks = F.coalesce(jump | gap, F.lit(False)).cast("long")
    return scan(seen, {"segment": running(breaks)}, keys=keys, order=order, slices=slices).drop("_was")


def gps_origin(states: DataFrame, *, keys: Sequence[str] = MISSION, order: Sequence[str] = ("t", "seq")) -> DataFrame:
    """Origin per mission as struct(lat, lon, x, y): the first state that has a fix."""
    return states.filter(F.col("lat").isNotNull()).groupBy(*keys).agg(
        F.min_by(F.struct("lat", "lon", "x", "y"), F.struct(*order)).alias("origin"))


def replay_origin(telemetry: DataFrame, poses: DataFrame, *, keys: Sequence[str] = MISSION,
                  slices: Slices | None = None) -> DataFrame:
    """Origin of a recorded log: the first GLOBAL_POSITION_INT with a plausible latitude seen after
    a pose, with the pose known before that message."""
    lat, lon = units.deg_e7(F.col("lat")), units.deg_e7(F.col("lon"))
    fixes = telemetry.filter("type = 'GLOBAL_POSITION_INT'").select(
        *keys, "seq", lat.alias("lat"), lon.alias("lon")).filter(F.abs("lat") > 1e-6)
    known = attach_latest(fixes, poses.select(*keys, "seq", "x", "y"), "_pose", keys=keys, on="seq",
                          inclusive=False, slices=slices).filter("_pose is not null")
    return known.groupBy(*keys).agg(F.min_by(
        F.struct("lat", "lon", F.col("_pose.x").alias("x"), F.col("_pose.y").alias("y")), F.col("seq")).alias("origin"))


def fallback_states(odom: DataFrame, fixes: DataFrame, params: Alignment = Alignment(), *, speeds: DataFrame | None = None,
                    keys: Sequence[str] = MISSION, slices: Slices | None = None) -> DataFrame:
    """GPS-derived states while odometry is dead or frozen at the origin although GPS has moved.

    By event time: a fix yields a state when the last odometry row is older than `odom_dead_s` (or
    there is none), or sits at the origin while the reckoned position is over 1 m away; at most one
    state per 200 ms. A measured speed (`speeds`: t, seq, speed) is used where one is known, else the
    reckoned one.
    """
    slices = slices or Slices.fit("t")
    reckoned = dead_reckon(fixes, keys=keys, slices=slices)
    seen = attach_latest(reckoned, odom.select(*keys, "t", "seq", "x", "y"), "_odom", keys=keys, slices=slices)
    speed = F.col("reckoned_speed")
    if speeds is not None:
        seen = attach_latest(seen, speeds.filter(units.finite(F.col("speed"))).select(*keys, "t", "seq", "speed"), "_speed", keys=keys, slices=slices)
        speed = F.coalesce(F.col("_speed.speed"), speed)
    o = F.col("_odom")
    dead = o.isNull() | (F.col("t") - o["t"] > params.odom_dead_s)
    stuck = ((F.abs(o["x"]) < params.frozen_eps_m) & (F.abs(o["y"]) < params.frozen_eps_m)
             & (F.hypot("reckoned_x", "reckoned_y") > params.moved_min_m))
    wanted = seen.filter(dead | F.coalesce(stuck, F.lit(False))).select(
        *keys, "seq", F.bround(F.col("t") * 1e9).cast("long").alias("stamp_ns"), "t",
        F.col("reckoned_x").alias("x"), F.col("reckoned_y").alias("y"), F.col("reckoned_yaw").alias("yaw"),
        "lat", "lon", F.coalesce("compass_deg", attitude.compass_deg(F.col("reckoned_yaw"))).alias("heading_deg"),
        speed.alias("speed_mps"))
    kept = sequential.throttle(wanted, params.state_period_ns, keys=keys, slices=Slices.fit("stamp_ns"))
    return wanted.join(kept.select(*keys, "seq"), [*keys, "seq"]).drop("stamp_ns")


def since_first(df: DataFrame, *, keys: Sequence[str] = MISSION, on: str = "t") -> DataFrame:
    """Add `since_first_s` (time since the mission's first row)."""
    first = df.groupBy(*keys).agg(F.min(on).alias("_first"))
    return df.join(first, list(keys)).withColumn("since_first_s", F.col(on) - F.col("_first")).drop("_first")


def sequence_numbers(df: DataFrame, *, keys: Sequence[str] = MISSION, order: Sequence[str] = ("t", "seq"),
                     slices: Slices | None = None) -> DataFrame:
    """Add `sequence`, a counter that wraps at 256."""
    out = scan(df, {"_no": position()}, keys=keys, order=order, slices=slices)
    return out.withColumn("sequence", F.pmod(F.col("_no") - 1, F.lit(256))).drop("_no")
