"""Recorded binary logs: packets, sonar profiles, telemetry, typed topics.

A log file is one binary row (files roll over at 500 MB), cut by one task and parsed in byte ranges by
many; from packets on, work spreads by packet.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from fathomgrid.functions import attitude, units
from fathomgrid.operators import telemetry as tel
from fathomgrid.operators.ordered import MISSION, Slices, latest, scan
from fathomgrid.session import written
from fathomgrid.sources import framing

# Profile layout, identifiers.
PROFILE_ID, TELEMETRY_ID = 2198, 150
PORT_DEVICE, STBD_DEVICE = 1, 2
PROFILE_HEAD = np.dtype([
    ("ping_number", "<u4"), ("start_mm", "<u4"), ("length_mm", "<u4"), ("timestamp_ms", "<u4"), ("ping_hz", "<u4"),
    ("gain_index", "<u2"), ("num_results", "<u2"), ("sos_dmps", "<u2"), ("channel_number", "u1"), ("reserved", "u1"),
    ("pulse_duration_sec", "<f4"), ("analog_gain", "<f4"), ("max_pwr_db", "<f4"), ("min_pwr_db", "<f4"),
    ("transducer_heading_deg", "<f4"), ("vehicle_heading_deg", "<f4")])
TELEMETRY_TYPES = ("ATTITUDE", "GLOBAL_POSITION_INT", "LOCAL_POSITION_NED", "HOME_POSITION", "GPS_GLOBAL_ORIGIN", "VFR_HUD")

PACKET = ("seq long, offset long, packet_id int, src int, dst int, payload binary, checksum int, checksum_ok boolean")
PROFILE = ("ping_number long, start_mm long, length_mm long, timestamp_ms long, ping_hz long, gain_index int, num_results int, "
           "sos_dmps int, channel_number int, pulse_duration_sec float, analog_gain float, max_pwr_db float, min_pwr_db float, "
           "transducer_heading_deg float, vehicle_heading_deg float, pwr array<int>")
MESSAGE = ("type string, time_boot_ms long, roll double, pitch double, yaw double, rollspeed double, pitchspeed double, yawspeed double, "
           "lat double, lon double, alt double, relative_alt double, hdg double, x double, y double, z double, vx double, vy double, vz double, "
           "latitude double, longitude double, altitude double, airspeed double, groundspeed double, heading double, throttle double, climb double")


def packets(blobs: DataFrame, *, keys: Sequence[str] = MISSION, content: str = "content", range_bytes: int = framing.RANGE_BYTES) -> DataFrame:
    """Packets of log contents (keys, binary), numbered from 0 within each row of `blobs`; NULL contents hold none.

    Junk between frames is skipped, and a frame that runs past the end stops the log. The checksum is reported, not
    enforced. A log is read in ranges of `range_bytes`, in parallel.
    """
    return framing.packets(blobs, PACKET, keys=keys, content=content, range_bytes=range_bytes)


def read_logs(spark: SparkSession, path: str, pattern: str = "*.svlog") -> DataFrame:
    """Packets of all log files below `path`; the file name without suffix is the mission."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return packets(files.select(F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1).alias("mission_id"), "content"))


def log_files(spark: SparkSession, path: str, pattern: str = "*.svlog") -> DataFrame:
    """path and mtime (seconds) of log files, without reading them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.unix_timestamp("modificationTime").alias("mtime"))


def _profile_decoder():
    target = to_arrow_schema(T.StructType.fromDDL(PROFILE))

    @F.arrow_udf(PROFILE)
    def decode(payload: pa.Array) -> pa.Array:
        rows = payload.to_pylist()
        heads = [np.frombuffer(p, PROFILE_HEAD, 1)[0] if p is not None and len(p) >= PROFILE_HEAD.itemsize else None for p in rows]
        size = PROFILE_HEAD.itemsize
        good = [h is not None and len(p) >= size + 2 * int(h["num_results"]) for h, p in zip(heads, rows)]
        blank = np.zeros(1, PROFILE_HEAD)[0]
        table = np.array([h if ok else blank for h, ok in zip(heads, good)], PROFILE_HEAD)
        columns = [pa.array(table[f.name]).cast(f.type) for f in target if f.name != "pwr"]
        power = [np.frombuffer(p, "<u2", int(h["num_results"]), size).astype(np.int32) if ok else None
                 for p, h, ok in zip(rows, heads, good)]
        columns.append(pa.array(power, pa.list_(pa.int32())))
        return pa.StructArray.from_arrays(columns, fields=list(target), mask=pa.array([not ok for ok in good]))

    return decode


def profiles(packets: DataFrame, *, keys: Sequence[str] = MISSION, extra: Sequence[str] = ()) -> DataFrame:
    """Sonar profiles with their side. `decode_error` marks short or truncated payloads, whose
    other columns are NULL; packets of other devices are left out."""
    sonar = packets.filter((F.col("packet_id") == PROFILE_ID) & F.col("src").isin(PORT_DEVICE, STBD_DEVICE))
    out = sonar.select(*keys, "seq", *extra, F.when(F.col("src") == PORT_DEVICE, "port").otherwise("stbd").alias("side"),
                       _profile_decoder()("payload").alias("_p"))
    return out.select(*keys, "seq", *extra, "side", F.col("_p").isNull().alias("decode_error"), "_p.*")


def profile_complete(payload: Column) -> Column:
    """Does a profile payload hold its head and all the samples the head announces?"""
    def byte(at: int) -> Column:
        return F.conv(F.hex(F.substring(payload, at + 1, 1)), 16, 10).cast("int")
    at = PROFILE_HEAD.fields["num_results"][1]
    head = PROFILE_HEAD.itemsize
    return F.when(F.length(payload) < head, False).otherwise(F.length(payload) >= head + 2 * (byte(at) + 256 * byte(at + 1)))


def telemetry(packets: DataFrame, *, keys: Sequence[str] = MISSION, extra: Sequence[str] = (), others: bool = False) -> DataFrame:
    """Telemetry messages. `decode_error` marks payloads that are not UTF-8 JSON. With `others`,
    packets of other kinds stay in, without message columns."""
    mine = F.col("packet_id") == TELEMETRY_ID
    text = F.when(mine, F.col("payload").cast("string"))
    # The whole envelope as a variant tells broken JSON from a message without some fields.
    tree = F.try_parse_json(F.when(F.is_valid_utf8(text), text))
    parsed = F.from_json(F.when(F.is_valid_utf8(text), text), f"message struct<{_fields(MESSAGE)}>")
    out = (packets if others else packets.filter(mine)).select(
        *keys, "seq", *extra, tree.isNull().alias("decode_error"), parsed["message"].alias("_m"))
    return out.select(*keys, "seq", *extra, "decode_error", "_m.*")


def _fields(ddl: str) -> str:
    return ", ".join(f"{f.split()[0]}: {f.split()[1]}" for f in ddl.split(", "))


def clocked(packets: DataFrame, *, converter: bool = False, keys: Sequence[str] = MISSION,
            slices: Slices | None = None) -> tuple[DataFrame, DataFrame]:
    """(profiles, telemetry) that decoded, with `stamp_ns` from the packet clock.

    In replay a sonar packet ticks whether or not it decodes; for the converter it must decode.
    """
    slices = slices or Slices.fit("seq")
    sonar, messages = profiles(packets, keys=keys), telemetry(packets, keys=keys)
    ticking_sonar = sonar.filter(~F.col("decode_error")) if converter else sonar
    boot = ticking_sonar.select(*keys, "seq", F.lit(None).cast("long").alias("time_boot_ms")).unionByName(
        messages.filter(~F.col("decode_error")).select(*keys, "seq", "time_boot_ms"))
    stamps = tel.burst_clock(boot, tel.CONVERTER_EPOCH_NS if converter else 0, keys=keys, slices=slices).drop("time_boot_ms")
    by = [*keys, "seq"]
    return (sonar.filter(~F.col("decode_error")).drop("decode_error").join(stamps, by),
            messages.filter(~F.col("decode_error")).drop("decode_error").join(stamps, by))


def _num(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0.0))


def topic_rows(packets: DataFrame, *, keys: Sequence[str] = MISSION, slices: Slices | None = None) -> DataFrame:
    """All typed streams of a log in one table: keys, seq, stamp_ns on the converter clock, `topic`, and one struct column
    per topic, NULL but for the row's own.

    Packets are parsed once and stored decoded. One pass along the log, over messages and the stamps of sonar packets, gives
    stamps, orientation and odometry; only sonar rows are joined with theirs.
    """
    slices = slices or Slices.fit("seq")
    sonar_packet = (F.col("packet_id") == PROFILE_ID) & F.col("src").isin(PORT_DEVICE, STBD_DEVICE)
    text = F.col("payload").cast("string")
    usable = F.when((F.col("packet_id") == TELEMETRY_ID) & F.is_valid_utf8(text), text)
    decoded = packets.filter(sonar_packet | (F.col("packet_id") == TELEMETRY_ID)).select(
        *keys, "seq", F.when(sonar_packet, F.when(F.col("src") == PORT_DEVICE, "port").otherwise("stbd")).alias("side"), "dst", "packet_id",
        F.when(sonar_packet, F.col("payload")).alias("payload"), _profile_decoder()(F.when(sonar_packet, F.col("payload"))).alias("profile"),
        F.try_parse_json(usable).isNotNull().alias("readable"), F.from_json(usable, f"message struct<{_fields(MESSAGE)}>")["message"].alias("_m"))
    decoded = written(decoded.filter("profile is not null or readable"), "decoded")

    quat = (lambda r: attitude.rpy_quat(r["roll"], r["pitch"], r["yaw"]))(attitude.swap_ned_enu_rpy(_num("roll"), _num("pitch"), _num("yaw")))
    p = attitude.swap_ned_enu(_num("x"), _num("y"), _num("z"))
    v = attitude.swap_ned_enu(_num("vx"), _num("vy"), _num("vz"))
    turns, moves = F.col("type") == "ATTITUDE", F.col("type") == "LOCAL_POSITION_NED"
    stamped = tel.burst_clock(decoded.select(*keys, "seq", "side", "_m.*"), tel.CONVERTER_EPOCH_NS, keys=keys, slices=slices)
    passed = scan(stamped, {
        "_q": latest(F.when(turns, quat)),
        "_turn": latest(F.when(turns, attitude.swap_ned_enu_rpy(_num("roll"), _num("pitch"), _num("yaw")))),
        "_move": latest(F.when(moves, F.struct(p.alias("p"), v.alias("v"))))}, keys=keys, order=("seq",), slices=slices)
    passed = written(passed, "passed")

    level = F.struct(*[F.lit(x).alias(n) for n, x in (("x", 0.0), ("y", 0.0), ("z", 0.0), ("w", 1.0))])
    geo = F.struct(units.deg_e7(_num("latitude")).alias("lat"), units.deg_e7(_num("longitude")).alias("lon"), units.milli(_num("altitude")).alias("alt"))
    fix = F.col("type") == "GLOBAL_POSITION_INT"
    messages = _tagged(passed.filter("side is null"), keys, {
        "imu": F.when(turns, F.struct(quat.alias("orientation"), F.struct(
            _num("rollspeed").alias("x"), (-_num("pitchspeed")).alias("y"), (-_num("yawspeed")).alias("z")).alias("angular_velocity"))),
        "navsat": F.when(fix, F.struct(F.lit(0).alias("status"), units.deg_e7(_num("lat")).alias("lat"), units.deg_e7(_num("lon")).alias("lon"),
                                       units.milli(_num("alt")).alias("alt"))),
        "rel_alt": F.when(fix, F.struct(units.milli(_num("relative_alt")).alias("data"))),
        "compass_hdg": F.when(fix, F.struct(units.centi(_num("hdg")).alias("data"))),
        "local_pose": F.when(moves, F.struct(p.alias("position"), F.coalesce("_q", level).alias("orientation"))),
        "local_velocity": F.when(moves, F.struct(v.alias("linear"))),
        "home_position": F.when(F.col("type") == "HOME_POSITION", geo),
        "gp_origin": F.when(F.col("type") == "GPS_GLOBAL_ORIGIN", geo),
        "vfr_hud": F.when(F.col("type") == "VFR_HUD", F.struct(
            *[_num(c).alias(c) for c in ("airspeed", "groundspeed")], _num("heading").cast("int").alias("heading"),
            units.centi(_num("throttle")).alias("throttle"), _num("alt").alias("altitude"), _num("climb").alias("climb"))),
        "odom": F.when((turns | moves) & F.col("_turn").isNotNull() & F.col("_move").isNotNull(), F.struct(
            "_move.p.x", "_move.p.y", "_move.p.z", *[F.col(f"_move.v.{c}").alias(f"v{c}") for c in "xyz"], "_turn.roll", "_turn.pitch", "_turn.yaw"))})
    sonar = decoded.filter("side is not null").join(passed.filter("side is not null").select(*keys, "seq", "stamp_ns"), [*keys, "seq"])
    raw = F.struct(F.lit(0).alias("src"), "dst", "packet_id", "payload")
    sides = {f"{side}_{kind}": F.when(F.col("side") == side, body) for side in ("port", "stbd") for kind, body in (("profile", F.col("profile")), ("raw", raw))}
    return messages.unionByName(_tagged(sonar, keys, sides), allowMissingColumns=True)


def _tagged(rows: DataFrame, keys: Sequence[str], bodies: dict[str, Column]) -> DataFrame:
    """One row per body that a row has, with its name as `topic`."""
    full = rows.select(*keys, "seq", "stamp_ns", *[c.alias(n) for n, c in bodies.items()])
    names = F.array_compact(F.array(*[F.when(F.col(n).isNotNull(), F.lit(n)) for n in bodies]))
    return full.withColumn("topic", F.explode(names)).withColumns({n: F.when(F.col("topic") == n, F.col(n)) for n in bodies})


def topics(packets: DataFrame, *, keys: Sequence[str] = MISSION, slices: Slices | None = None) -> dict[str, DataFrame]:
    """The typed streams of a log as tables of their own, each with keys, seq and stamp_ns; all read one stored table."""
    rows = written(topic_rows(packets, keys=keys, slices=slices), "topics")
    return {name: rows.filter(F.col("topic") == name).select(*keys, "seq", "stamp_ns", f"{name}.*") for name in rows.columns
            if name not in (*keys, "seq", "stamp_ns", "topic")}


# Counters of each telemetry type.
COUNTED_AS = {
    "ATTITUDE": ("imu",), "GLOBAL_POSITION_INT": ("navsat", "rel_alt", "compass_hdg"),
    "LOCAL_POSITION_NED": ("local_pose", "local_velocity"), "HOME_POSITION": ("home_position",),
    "GPS_GLOBAL_ORIGIN": ("gp_origin",), "VFR_HUD": ("vfr_hud",),
}


def ingest_counts(packets: DataFrame, *, keys: Sequence[str] = MISSION, slices: Slices | None = None) -> DataFrame:
    """Rows per ingest category (keys, category, packets)."""
    slices = slices or Slices.fit("seq")
    messages = telemetry(packets, keys=keys, extra=("packet_id", "src", "payload"), others=True)
    target = (F.col("packet_id") == PROFILE_ID) & F.col("src").isin(PORT_DEVICE, STBD_DEVICE)
    side = F.when(F.col("src") == PORT_DEVICE, "sonar_port").otherwise("sonar_stbd")
    names = F.when(target, F.array(F.when(profile_complete(F.col("payload")), side).otherwise("decode_errors")))
    names = names.when(F.col("packet_id") != TELEMETRY_ID, F.array(F.lit("skipped_non_target")))
    names = names.when(F.col("decode_error"), F.array(F.lit("decode_errors")))
    for message, categories in COUNTED_AS.items():
        names = names.when(F.col("type") == message, F.array(*map(F.lit, categories)))
    names = names.otherwise(F.array(F.lit("mavlink_skipped_type")))
    good = messages.filter((F.col("packet_id") == TELEMETRY_ID) & ~F.col("decode_error"))
    rows = messages.select(*keys, F.explode(names).alias("category")).unionByName(
        tel.synthesise_odom(good, keys=keys, slices=slices).select(*keys, F.lit("odom_synthesized").alias("category")))
    return rows.groupBy(*keys, "category").agg(F.count(F.lit(1)).alias("packets"))
