"""Queries over recorded logs. The log contents are built by Spark from the given tables: every 512
consecutive events are one log of framed packets with junk between them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomgrid.config import Config, Pairing
from fathomgrid.plans import tables
from fathomgrid.plans.catalog import BOTTOM, STATES, R, query, r6, recursive, with_
from fathomgrid.plans.ping_queries import LOOSE, PAIRS, _lock_sql
from fathomgrid.plans.processing import process
from fathomgrid.session import checkpointed, shared_folder
from fathomgrid.sinks.envelopes import envelopes
from fathomgrid.sinks.files import write_topics
from fathomgrid.sources import framing, logs

PER_LOG = 512
KEY = ("log_id",)


@F.arrow_udf(T.BinaryType())
def _profile_payload(number: pa.Array, values: pa.Array) -> pa.Array:
    """A profile payload with four samples; every 11th is cut short."""
    out = []
    for n, v in zip(number.to_pylist(), values.to_pylist()):
        head = np.zeros(1, logs.PROFILE_HEAD)
        for field, x in (("ping_number", n), ("length_mm", 30_000), ("timestamp_ms", n * 7), ("num_results", 4),
                         ("max_pwr_db", -10.0), ("min_pwr_db", -60.0), ("analog_gain", v)):
            head[field] = x
        body = head.tobytes() + (np.arange(4) * 100 + n % 1000).astype("<u2").tobytes()
        out.append(body[:-3] if n % 11 == 0 else body)
    return pa.array(out, pa.binary())


@F.arrow_udf(T.BinaryType())
def _frame(packet_id: pa.Array, src: pa.Array, payload: pa.Array) -> pa.Array:
    out = []
    for i, s, p in zip(packet_id.to_pylist(), src.to_pylist(), payload.to_pylist()):
        frame = framing.MARK + len(p).to_bytes(2, "little") + i.to_bytes(2, "little") + bytes([s, 0]) + p
        out.append(frame + (sum(frame) & 0xFFFF).to_bytes(2, "little"))
    return pa.array(out, pa.binary())


@F.arrow_udf(T.BinaryType())
def _damaged(seq: pa.Array, frame: pa.Array) -> pa.Array:
    """Every 13th frame has a wrong checksum; every 29th is followed by junk that reads as a frame, with marks inside."""
    out = []
    for n, f in zip(seq.to_pylist(), frame.to_pylist()):
        f = f[:-2] + bytes([f[-2] ^ 0x55, f[-1]]) if n % 13 == 0 else f
        out.append(f + b"B\x01RBB" + b"BR\x08\x00\x07\x00\x05\x06BRBR\x00BRB\xff\xff" if n % 29 == 0 else f)
    return pa.array(out, pa.binary())


def _contents(spark, d, damaged=False):
    """One binary row per log: view → ATTITUDE, click → GLOBAL_POSITION_INT, signup → LOCAL_POSITION_NED, purchase → one of
    three rarer types or an unknown one, error → a sonar profile; every 97th event is broken JSON."""
    rows = tables.states(spark, d)
    kind, boot = F.col("event_type"), F.col("time_boot_ms")

    def message(name, **fields):
        return F.to_json(F.struct(F.struct(F.lit(name).alias("type"), boot.alias("time_boot_ms"),
                                           *[c.alias(n) for n, c in fields.items()]).alias("message")))
    e7 = {c: F.bround(F.col(c) * 1e7).cast("long") for c in ("lat", "lon")}
    text = (F.when(F.col("seq") % 97 == 0, "{broken")
            .when(kind == "view", message("ATTITUDE", roll=F.lit(0.1), pitch=F.lit(0.2), yaw=F.col("yaw"), rollspeed=F.col("value")))
            .when(kind == "click", message("GLOBAL_POSITION_INT", lat=e7["lat"], lon=e7["lon"], hdg=F.col("compass_deg") * 100, relative_alt=F.col("seq") * 10))
            .when(kind == "signup", message("LOCAL_POSITION_NED", x=F.col("x"), y=F.col("y"), vx=F.col("yaw")))
            .when(F.col("seq") % 4 == 0, message("HOME_POSITION", latitude=e7["lat"], longitude=e7["lon"], altitude=F.col("seq")))
            .when(F.col("seq") % 4 == 1, message("GPS_GLOBAL_ORIGIN", latitude=e7["lat"], longitude=e7["lon"], altitude=F.col("seq")))
            .when(F.col("seq") % 4 == 2, message("VFR_HUD", airspeed=F.col("value"), heading=F.col("compass_deg"), throttle=F.col("value")))
            .otherwise(message("HEARTBEAT")))
    sonar = (kind == "error") & (F.col("seq") % 97 != 0)
    payload = F.when(sonar, _profile_payload("seq", "value")).otherwise(text.cast("binary"))
    packet_id = F.when(sonar, logs.PROFILE_ID).when(F.col("seq") % 31 == 0, 2194).otherwise(logs.TELEMETRY_ID)
    src = F.when(sonar, (F.col("seq") % 3).cast("int")).otherwise(0)
    framed = rows.select(F.floor(F.col("seq") / PER_LOG).alias("log_id"), "seq", packet_id.alias("p"), src.alias("s"), payload.alias("b"))
    framed = framed.select("log_id", "seq", _frame("p", "s", "b").alias("f"))
    if damaged:
        framed = framed.withColumn("f", _damaged("seq", "f"))
    # at most 512 small frames per group; joined by Spark, as a Python worker would hold a batch of whole logs
    joined = F.expr("listagg(f, X'00') WITHIN GROUP (ORDER BY seq, f)")
    return framed.groupBy("log_id").agg(F.concat(joined, F.lit(bytearray(b"BR\xff"))).alias("content"))


def _packets(spark, d):
    return logs.packets(_contents(spark, d), keys=KEY)


LOG = STATES + """,
lg AS (SELECT *, seq // 512 AS log_id, seq % 512 AS no, event_type = 'error' AND seq % 97 <> 0 AS sonar FROM e),
lp AS (SELECT *, CASE WHEN sonar THEN 2198 WHEN seq % 31 = 0 THEN 2194 ELSE 150 END AS packet_id, CASE WHEN sonar THEN seq % 3 ELSE 0 END AS src FROM lg)"""


# A damaged frame stays a packet, and junk that reads as a frame is one: its marks inside are payload.
FRAMED = LOG + """,
fr AS (SELECT log_id, no, 0 AS k, packet_id, src, 0 AS dst, seq % 13 <> 0 AS checksum_ok, CASE WHEN sonar THEN 60 + CASE WHEN seq % 11 = 0 THEN -3 ELSE 0 END END AS payload_bytes FROM lp
  UNION ALL SELECT log_id, no, 1, 7, 5, 6, false, 8 FROM lp WHERE seq % 29 = 0)"""


@query(with_(FRAMED, """SELECT log_id, row_number() OVER (PARTITION BY log_id ORDER BY no, k) - 1 AS seq, CAST(packet_id AS INTEGER) AS packet_id, CAST(src AS INTEGER) AS src,
CAST(dst AS INTEGER) AS dst, checksum_ok, CAST(payload_bytes AS INTEGER) AS payload_bytes FROM fr"""))
def log_packets(spark, d):
    """Logs of some 70 kB, in ranges of 8 kB: frames and junk lie across their borders."""
    found = logs.packets(_contents(spark, d, damaged=True), keys=KEY, range_bytes=8192)
    known = F.when(F.col("packet_id").isin(logs.PROFILE_ID, 7), F.length("payload"))
    return found.select("log_id", "seq", "packet_id", "src", "dst", "checksum_ok", known.alias("payload_bytes"))


@query(with_(LOG, f"""SELECT log_id, no AS seq, CASE WHEN src = 1 THEN 'port' ELSE 'stbd' END AS side, seq % 11 = 0 AS decode_error,
CASE WHEN seq % 11 <> 0 THEN seq END AS ping_number, CASE WHEN seq % 11 <> 0 THEN 400 + seq % 1000 * 4 + 200 END AS pwr_sum,
{R('CASE WHEN seq % 11 <> 0 THEN CAST(value AS FLOAT) END', 'analog_gain')} FROM lp WHERE packet_id = 2198 AND src IN (1, 2)"""))
def log_profiles(spark, d):
    total = F.aggregate("pwr", F.lit(0).cast("long"), lambda a, x: a + x)
    return logs.profiles(_packets(spark, d), keys=KEY).select(
        "log_id", "seq", "side", "decode_error", "ping_number", total.alias("pwr_sum"), r6(F.col("analog_gain").cast("double"), "analog_gain"))


@query(with_(LOG, f"""SELECT log_id, no AS seq, seq % 97 = 0 AS decode_error, CASE WHEN seq % 97 = 0 THEN NULL WHEN event_type = 'view' THEN 'ATTITUDE'
WHEN event_type = 'click' THEN 'GLOBAL_POSITION_INT' WHEN event_type = 'signup' THEN 'LOCAL_POSITION_NED' WHEN sonar THEN NULL
ELSE ['HOME_POSITION', 'GPS_GLOBAL_ORIGIN', 'VFR_HUD', 'HEARTBEAT'][CAST(seq % 4 + 1 AS INTEGER)] END AS type,
CASE WHEN seq % 97 <> 0 THEN time_boot_ms END AS time_boot_ms, {R("CASE WHEN seq % 97 <> 0 AND event_type = 'view' THEN yaw END", 'yaw')},
{R("CASE WHEN seq % 97 <> 0 AND event_type = 'signup' THEN x END", 'x')} FROM lp WHERE packet_id = 150"""))
def log_telemetry(spark, d):
    return logs.telemetry(_packets(spark, d), keys=KEY).select("log_id", "seq", "decode_error", "type", "time_boot_ms", r6("yaw"), r6("x"))


LOG_CLOCK = LOG + """,
ok AS (SELECT *, CASE WHEN sonar THEN NULL ELSE time_boot_ms END AS boot FROM lp WHERE (packet_id = 150 AND seq % 97 <> 0) OR (sonar AND src IN (1, 2) AND seq % 11 <> 0)),
tk AS (SELECT *, CASE WHEN boot IS NOT NULL AND boot IS NOT DISTINCT FROM lag(boot) OVER w THEN 0 ELSE 1 END AS tick FROM ok WINDOW w AS (PARTITION BY log_id ORDER BY no)),
st AS (SELECT *, 1704067200000000000 + CAST(sum(tick) OVER w AS BIGINT) * 20000000 AS stamp_ns,
  last_value(CASE WHEN event_type = 'view' THEN yaw END IGNORE NULLS) OVER w AS nyaw,
  last_value(CASE WHEN event_type = 'signup' THEN x END IGNORE NULLS) OVER w AS nx FROM tk WINDOW w AS (PARTITION BY log_id ORDER BY no))"""


def _topic_sql(topic: str, value: str, rows: str) -> str:
    return f"SELECT '{topic}' AS topic, log_id, no AS seq, stamp_ns, {R(value, 'value', 9)} FROM st WHERE {rows}"


def _purchase(rest: int) -> str:
    return f"event_type = 'purchase' AND seq % 4 = {rest}"


# Checked value of each topic: in the table, in SQL, and the rows of the log it is made from.
TOPICS = {
    "imu": ("imu.angular_velocity.x", "value", "event_type = 'view'"),
    "navsat": ("navsat.lat", "round_even(lat * 1e7, 0) / 1e7", "event_type = 'click'"),
    "rel_alt": ("rel_alt.data", "seq / 1e2", "event_type = 'click'"),
    "compass_hdg": ("compass_hdg.data", "compass_deg", "event_type = 'click'"),
    "local_pose": ("local_pose.position.y", "x", "event_type = 'signup'"),
    "local_velocity": ("local_velocity.linear.y", "yaw", "event_type = 'signup'"),
    "home_position": ("home_position.lat", "round_even(lat * 1e7, 0) / 1e7", _purchase(0)),
    "gp_origin": ("gp_origin.alt", "seq / 1e3", _purchase(1)),
    "vfr_hud": ("vfr_hud.throttle", "value / 1e2", _purchase(2)),
    "odom": ("odom.yaw", "pi() / 2 - nyaw", "event_type IN ('view', 'signup') AND nyaw IS NOT NULL AND nx IS NOT NULL"),
    "port_profile": ("port_profile.ping_number", "seq", "sonar AND src = 1"),
    "stbd_profile": ("stbd_profile.ping_number", "seq", "sonar AND src = 2"),
    "port_raw": ("port_raw.payload", "60", "sonar AND src = 1"),
    "stbd_raw": ("stbd_raw.payload", "60", "sonar AND src = 2"),
}


@query(with_(LOG_CLOCK, " UNION ALL ".join(_topic_sql(name, sql, rows) for name, (_, sql, rows) in TOPICS.items())))
def log_topics(spark, d):
    """All typed streams through their store: packets are parsed once, topics written in one pass."""
    path = shared_folder(spark, "topics")
    rows = logs.topic_rows(_packets(spark, d), keys=KEY)
    write_topics(rows, path, keys=KEY)
    back = spark.read.schema(rows.schema).parquet(path)
    values = [F.when(F.col("topic") == name, (F.length(c) if c.endswith("payload") else F.col(c)).cast("double")) for name, (c, _, _) in TOPICS.items()]
    return back.select("topic", "log_id", "seq", "stamp_ns", r6(F.coalesce(*values), "value", 9))


@query(with_(LOG_CLOCK + """,
ct AS (SELECT log_id, CASE WHEN packet_id = 2194 OR (sonar AND src = 0) THEN ['skipped_non_target'] WHEN seq % 97 = 0 OR (sonar AND seq % 11 = 0) THEN ['decode_errors']
  WHEN sonar THEN [CASE WHEN src = 1 THEN 'sonar_port' ELSE 'sonar_stbd' END] WHEN event_type = 'view' THEN ['imu'] WHEN event_type = 'click' THEN ['navsat', 'rel_alt', 'compass_hdg']
  WHEN event_type = 'signup' THEN ['local_pose', 'local_velocity'] ELSE [['home_position', 'gp_origin', 'vfr_hud', 'mavlink_skipped_type'][CAST(seq % 4 + 1 AS INTEGER)]] END AS cs FROM lp)""",
             """SELECT log_id, category, count(*) AS packets FROM (SELECT log_id, unnest(cs) AS category FROM ct
UNION ALL SELECT log_id, 'odom_synthesized' FROM st WHERE event_type IN ('view', 'signup') AND nyaw IS NOT NULL AND nx IS NOT NULL) GROUP BY ALL"""))
def log_counts(spark, d):
    # read for the categories and again for the odometry scan
    return logs.ingest_counts(checkpointed(_packets(spark, d)), keys=KEY)


@query(with_(STATES + """,
r AS (SELECT *, us * 1000 AS stamp_ns FROM e),
s AS (SELECT *, last_value(CASE WHEN event_type = 'signup' THEN round_even(value * 1000e0, 0) END IGNORE NULLS) OVER w AS rel,
  last_value(CASE WHEN event_type = 'purchase' THEN x END IGNORE NULLS) OVER w AS vy FROM r WINDOW w AS (PARTITION BY mission_id ORDER BY us, seq)),
n AS (SELECT *, row_number() OVER (PARTITION BY mission_id ORDER BY us, seq) - 1 AS k FROM s WHERE event_type = 'view' OR event_type = 'error'
  OR (event_type = 'click' AND seq % 7 <> 0))""",
             f"""SELECT seq, CASE event_type WHEN 'view' THEN 'ATTITUDE' WHEN 'click' THEN 'GLOBAL_POSITION_INT' ELSE 'LOCAL_POSITION_NED' END AS type, CAST(k % 256 AS BIGINT) AS sequence,
(us * 1000 - 1704067200000000000) // 1000000 % 4294967296 AS time_boot_ms, CASE WHEN event_type = 'click' THEN CAST(round_even(lat * 1e7, 0) AS BIGINT) END AS lat,
CASE WHEN event_type = 'click' THEN CAST(coalesce(rel, 0) AS BIGINT) END AS relative_alt,
{R("CASE WHEN event_type = 'view' THEN pi() / 2 - atan2(sin(yaw), cos(yaw)) END", 'yaw')},
{R("CASE WHEN event_type = 'error' THEN y END", 'x')}, {R("CASE WHEN event_type = 'error' THEN coalesce(vy, 0e0) WHEN event_type = 'click' THEN 0e0 END", 'vy')} FROM n"""))
def ned_envelopes(spark, d):
    kinds = {"view": "imu", "click": "fix", "error": "pose", "signup": "rel_alt", "purchase": "velocity"}
    kind = F.element_at(F.create_map(*[F.lit(v) for kv in kinds.items() for v in kv]), F.col("event_type"))
    zero = F.lit(0.0)
    rows = tables.states(spark, d).withColumns({
        "kind": kind, "stamp_ns": F.col("us") * 1000, "data": F.col("value"), "status": F.when(F.col("seq") % 7 == 0, -1).otherwise(0), "alt": F.col("value"),
        "qx": zero, "qy": zero, "qz": F.sin(F.col("yaw") / 2), "qw": F.cos(F.col("yaw") / 2), "wx": zero, "wy": zero, "wz": zero, "z": zero,
        "vx": F.col("x"), "vy": zero, "vz": zero, "airspeed": zero, "groundspeed": zero, "heading": zero, "throttle": zero, "altitude": zero, "climb": zero})
    out = envelopes(rows, F.lit(1_704_067_200_000_000_000).cast("long"))
    message = F.from_json("envelope", "header struct<sequence: long>, message struct<time_boot_ms: long, lat: long, relative_alt: long, yaw: double, x: double, vy: double>")
    m = F.col("j.message")
    return out.withColumn("j", message).select(
        "seq", "type", F.col("j.header.sequence").alias("sequence"), m["time_boot_ms"].alias("time_boot_ms"),
        m["lat"].alias("lat"), m["relative_alt"].alias("relative_alt"), r6(m["yaw"], "yaw"), r6(m["x"], "x"), r6(m["vy"], "vy"))


CHAIN = PAIRS.replace("STAMP", "sparse_ns") + BOTTOM[len(PAIRS[:PAIRS.index(",\np AS")]):] + """,
pn AS (SELECT *, row_number() OVER (PARTITION BY mission_id ORDER BY port_seq) AS k FROM pairs),
ps AS (SELECT pn.*, p.slant_m AS pf, s.slant_m AS sf FROM pn JOIN ab p ON p.vec_id = pn.port_seq JOIN ab s ON s.vec_id = pn.stbd_seq)"""


def _chain_lock(name: str, column: str) -> str:
    return _lock_sql("port", name).replace("ping_no, slant_m AS f, row_number() OVER (PARTITION BY mission_id ORDER BY ping_no) AS n FROM ab WHERE side = 'port'",
                                           f"port_seq AS ping_no, {column} AS f, k AS n FROM ps")


@query(recursive(CHAIN + _chain_lock("pl", "pf") + _chain_lock("sl", "sf") + """,
fu AS (SELECT mission_id, r.ping_no AS seq, last_value(greatest(coalesce(pl.alt, sl.alt), coalesce(sl.alt, pl.alt)) IGNORE NULLS)
  OVER (PARTITION BY mission_id ORDER BY n) AS a FROM plr r JOIN pl USING (mission_id, n) JOIN sl USING (mission_id, n)),
sm AS (SELECT fu.mission_id, fu.seq, fu.a, ps.port_ns, d.side, i / 63e0 * 30e0 AS r, d.db[i + 1] AS v FROM fu JOIN ps ON ps.port_seq = fu.seq
  JOIN ad d ON d.vec_id IN (ps.port_seq, ps.stbd_seq), (SELECT unnest(range(0, 64)) AS i) WHERE a IS NOT NULL AND i / 63e0 * 30e0 > a)""",
                 f"""SELECT mission_id, seq, {R('any_value(port_ns) / 1e9', 't')}, {R('seq * 0.05e0', 'robot_x')}, {R('any_value(a)', 'water_depth')}, count(*) AS samples,
{R("sum(CASE WHEN side = 'port' THEN 1 ELSE -1 END * sqrt(r * r - a * a))", 'y_sum')}, {R('sum(v)', 'db_sum')} FROM sm GROUP BY mission_id, seq"""))
def sonar_pings(spark, d):
    """The whole chain from raw profiles to geo-referenced pings; poses lie 3 ms after each ping."""
    sides = tables.side_pings(spark, d)
    profiles = sides.select("mission_id", "side", F.col("vec_id").alias("seq"), F.col("sparse_ns").alias("stamp_ns"), "pwr",
                            F.col("min_db").alias("min_pwr_db"), F.col("max_db").alias("max_pwr_db"), "start_mm", "length_mm", "num_results")
    poses = sides.filter("side = 'port'").select("mission_id", F.col("vec_id").alias("seq"), (F.col("sparse_ns") + 3_000_000).alias("stamp_ns"),
                                                 (F.col("vec_id") * 0.05).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("yaw"))
    out = process(profiles, poses, Config(bottom=tables.SHORT_BOTTOM, tracking=LOOSE, pairing=Pairing()))

    def total(c):
        return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return out.select("mission_id", "seq", r6("t"), r6("robot_x"), r6("water_depth"), F.size("y_local").cast("long").alias("samples"),
                      r6(total("y_local"), "y_sum"), r6(total("intensity_db"), "db_sum"))
