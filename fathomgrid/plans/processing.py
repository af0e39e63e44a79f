"""From raw profiles to geo-referenced pings."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from fathomgrid.config import Config
from fathomgrid.functions import acoustics, attitude, geodesy, units
from fathomgrid.operators import sequential
from fathomgrid.operators import telemetry as tel
from fathomgrid.operators.asof import attach_latest, attach_nearest
from fathomgrid.operators.ordered import MISSION, Slices
from fathomgrid.session import checkpointed, written
from fathomgrid.sources import logs


def measure(profiles: DataFrame, config: Config = Config()) -> DataFrame:
    """Add `db` and `slant_m` to profiles (pwr, min_pwr_db, max_pwr_db, start_mm, length_mm, num_results)."""
    scaled = profiles.withColumn("db", acoustics.scale_db(
        F.col("pwr"), F.col("min_pwr_db").cast("double"), F.col("max_pwr_db").cast("double"))).drop("pwr")
    found = acoustics.bottom_return(F.col("db"), F.col("start_mm"), F.col("length_mm"), F.col("num_results"), config.bottom)
    return scaled.withColumn("slant_m", found["slant_m"])


def process(profiles: DataFrame, poses: DataFrame, config: Config = Config(), *, keys: Sequence[str] = MISSION,
            slices: Slices | None = None, dropped: tuple[Observation, Observation] | None = None) -> DataFrame:
    """Pings (keys, seq, t, robot_x, robot_y, yaw, water_depth, y_local, intensity_db) of raw profiles.

    `profiles` has side, seq, stamp_ns and the raw columns of `measure`; `poses` seq, stamp_ns, x,
    y, yaw. Pairing, pose and altitude run on narrow rows; the sample arrays are joined once, at
    the end. Pairs without a pose are dropped before the altitude lock sees them. Store the result
    before working on it: it is the table that mosaics and images start from. `dropped` takes two
    observations: `pairs` and `unposed`, and `pings` and `unlocked` (no altitude yet).
    """
    measured = measure(profiles, config)
    slices = slices or Slices.fit("seq")
    by_stamp = Slices.fit("stamp_ns")
    pairs = sequential.pair_pings(profiles, config.pairing, keys=keys, slices=by_stamp)
    narrow_poses = poses.select(*keys, "seq", "stamp_ns", "x", "y", "yaw")
    if config.pairing.pose_mode == "locf":
        # what was known when the second packet of the pair arrived
        pairs = pairs.withColumn("seq", F.greatest("port_seq", "stbd_seq"))
        posed = attach_latest(pairs, narrow_poses, "pose", keys=keys, on="seq", left_tie="port_seq", slices=slices)
    else:
        pairs = pairs.withColumns({"seq": F.col("port_seq"), "stamp_ns": F.col("port_ns")})
        posed = attach_nearest(pairs, narrow_poses, "pose", keys=keys, left_tie="port_seq", slices=by_stamp)
    if dropped:
        posed = posed.observe(dropped[0], F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("pose").isNull()).alias("unposed"))
    # narrow rows, read by the altitude pass and again by the final joins
    posed = checkpointed(posed.filter(F.col("pose").isNotNull()))

    def side(name: str, columns: dict) -> DataFrame:
        return measured.filter(F.col("side") == name).select(*keys, F.col("seq").alias(f"{name}_seq"), *[
            F.col(c).alias(a) for c, a in columns.items()])

    slants = (posed.join(side("port", {"slant_m": "port_fbr"}), [*keys, "port_seq"])
              .join(side("stbd", {"slant_m": "stbd_fbr"}), [*keys, "stbd_seq"]))
    locked = sequential.track_altitude(slants, config.tracking, keys=keys, order=("seq",), slices=slices)
    fused = sequential.fuse_altitude(locked, keys=keys, slices=slices)
    if dropped:
        fused = fused.observe(dropped[1], F.count(F.lit(1)).alias("pings"), F.count_if(F.col("altitude").isNull()).alias("unlocked"))
    fused = fused.filter("altitude is not null").select(*keys, "seq", "altitude")
    good = posed.join(fused, [*keys, "seq"])

    raw = {c: c for c in ("db", "start_mm", "length_mm", "num_results")}
    g = config.geometry
    for name, offset, sign in (("port", g.y_port_m, 1.0), ("stbd", g.y_stbd_m, -1.0)):
        good = good.join(side(name, raw), [*keys, f"{name}_seq"]).withColumn(f"_{name}", acoustics.ground_samples(
            F.col("db"), F.col("start_mm"), F.col("length_mm"), F.col("num_results"), F.col("altitude"),
            F.lit(offset), F.lit(sign))).drop(*raw)
    samples = F.concat("_port", "_stbd")
    return good.select(
        *keys, "seq", units.seconds(F.col("port_ns")).alias("t"), F.col("pose.x").alias("robot_x"), F.col("pose.y").alias("robot_y"),
        F.col("pose.yaw").alias("yaw"), (F.col("altitude") + g.submersion_m).alias("water_depth"),
        F.transform(samples, lambda s: s["y"]).alias("y_local"), F.transform(samples, lambda s: s["v"]).alias("intensity_db"))


def replay(packets: DataFrame, config: Config = Config(), *, keys: Sequence[str] = MISSION) -> tuple[DataFrame, DataFrame]:
    """(pings, states) of recorded logs, on the mission clock (seconds from its first event).

    Packets are written once, then the decoded profiles and messages with their stamps, then the poses: every pass along
    a mission reads what it needs of those tables, and no plan parses packets or stamps again.
    """
    slices = Slices.fit("seq")
    profiles, messages = (written(x, name) for x, name in zip(logs.clocked(written(packets, "packets"), keys=keys, slices=slices), ("profiles", "messages"), strict=True))
    poses = written(tel.synthesise_odom(messages, keys=keys, slices=slices), "poses")
    pings = process(profiles, poses, _locf(config), keys=keys, slices=slices)
    kept = sequential.throttle(poses, config.alignment.state_period_ns, keys=keys, slices=Slices.fit("stamp_ns"))
    origin = tel.replay_origin(messages, poses, keys=keys, slices=slices)
    fix = _fix_seq(messages, poses, keys, slices)
    states = (poses.join(kept.select(*keys, "seq"), [*keys, "seq"]).join(origin, list(keys), "left").join(fix, list(keys), "left"))
    bound = F.when(F.col("seq") >= F.col("_from"), geodesy.local_to_gps(F.col("origin"), F.col("x"), F.col("y")))
    states = states.withColumn("_gps", bound).select(
        *keys, "seq", units.seconds(F.col("stamp_ns")).alias("t"), "x", "y", "yaw", F.col("_gps.lat").alias("lat"), F.col("_gps.lon").alias("lon"),
        attitude.compass_deg(F.col("yaw")).alias("heading_deg"), F.hypot("vx", "vy").alias("speed_mps"))
    first = pings.select(*keys, "t").unionByName(states.select(*keys, "t")).groupBy(*keys).agg(F.min("t").alias("_t0"))

    def rebased(df):
        return df.join(first, list(keys)).withColumn("t", F.col("t") - F.col("_t0")).drop("_t0")
    return rebased(pings), rebased(states)


def _locf(config: Config) -> Config:
    return replace(config, pairing=replace(config.pairing, pose_mode="locf"))


def _fix_seq(messages: DataFrame, poses: DataFrame, keys: Sequence[str], slices: Slices) -> DataFrame:
    """Packet at which the origin of a log becomes known."""
    fixes = messages.filter("type = 'GLOBAL_POSITION_INT'").filter(F.abs(units.deg_e7(F.col("lat"))) > 1e-6).select(*keys, "seq")
    known = attach_latest(fixes, poses.select(*keys, "seq"), "_p", keys=keys, on="seq", inclusive=False, slices=slices).filter("_p is not null")
    return known.groupBy(*keys).agg(F.min("seq").alias("_from"))


def mission_events(pings: DataFrame, states: DataFrame) -> DataFrame:
    """Pings and states of missions in one table with `kind`, the columns of the other kind NULL."""
    return (pings.withColumn("kind", F.lit("ping")).unionByName(states.withColumn("kind", F.lit("state")), allowMissingColumns=True))


def in_time_order(events: DataFrame, *, keys: Sequence[str] = MISSION) -> DataFrame:
    """Events sorted by time, arrival deciding among equal times."""
    return events.orderBy(*keys, "t", "seq")


def pings_of(events: DataFrame) -> DataFrame:
    return events.filter("kind = 'ping'")
