"""Queries over ordered telemetry: clocks, as-of joins, tracks, repair, rates."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathomgrid.config import Alignment
from fathomgrid.operators import asof, missions, sequential, telemetry
from fathomgrid.operators.ordered import newest
from fathomgrid.plans import processing, tables
from fathomgrid.plans.catalog import STATES, R, query, r6, recursive, with_
from fathomgrid.sinks import files
from fathomgrid.sources import messages

HOUR_NS = 3_600_000_000_000
W = "WINDOW w AS (PARTITION BY mission_id ORDER BY us, seq)"


def _kind(spark, d, *types):
    """Telemetry rows of some event types."""
    return tables.states(spark, d).filter(F.col("event_type").isin(*types))


CLOCK = STATES + f""",
k AS (SELECT *, CASE WHEN time_boot_ms IS NOT NULL AND time_boot_ms IS NOT DISTINCT FROM lag(time_boot_ms) OVER w THEN 0 ELSE 1 END AS tick FROM e {W})"""


@query(with_(CLOCK, f"SELECT seq, CAST(sum(tick) OVER w * 20000000 AS BIGINT) AS stamp_ns FROM k {W}"))
def burst_clock(spark, d):
    return telemetry.burst_clock(tables.states(spark, d), order=("us", "seq")).select("seq", "stamp_ns")


@query(with_(CLOCK.replace("FROM events)", "FROM events WHERE event_type <> 'signup')"),
             f"SELECT seq, CAST(1704067200000000000 + sum(tick) OVER w * 20000000 AS BIGINT) AS stamp_ns FROM k {W}"))
def burst_clock_converter(spark, d):
    """The converter's clock skips packets that did not decode (here: signup events)."""
    good = tables.states(spark, d).filter("event_type <> 'signup'")
    return telemetry.burst_clock(good, telemetry.CONVERTER_EPOCH_NS, order=("us", "seq")).select("seq", "stamp_ns")


@query(with_(STATES + f""",
b AS (SELECT *, CASE WHEN sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) > 5 OR t - lag(t) OVER w > 7200 THEN 1 ELSE 0 END AS brk FROM e {W})""",
             f"SELECT seq, CAST(sum(brk) OVER w AS BIGINT) AS segment FROM b {W}"))
def track_segments(spark, d):
    return telemetry.track_segments(tables.states(spark, d), Alignment(stale_s=7200.0)).select("seq", "segment")


FROZEN = STATES + f""",
f AS (SELECT *, CASE WHEN (seq // 512) % 2 = 0 THEN 0e0 ELSE x END AS px, CASE WHEN (seq // 512) % 2 = 0 THEN 0e0 ELSE y END AS py FROM e),
f1 AS (SELECT *, abs(px) < 0.05e0 AND abs(py) < 0.05e0 AS frozen, sqrt(x * x + y * y) > 1 AS moved FROM f),
f2 AS (SELECT *, sum(CASE WHEN frozen THEN 0 ELSE 1 END) OVER w AS grp FROM f1 {W}),
f3 AS (SELECT *, frozen AND sum(CASE WHEN frozen AND moved THEN 1 ELSE 0 END) OVER (PARTITION BY mission_id, grp ORDER BY us, seq) >= 20 AS engaged FROM f2)"""


@query(with_(FROZEN, "SELECT seq, engaged FROM f3"))
def frozen_pose(spark, d):
    stuck = F.floor(F.col("seq") / 512) % 2 == 0
    pings = tables.states(spark, d).withColumns({
        "robot_x": F.when(stuck, 0.0).otherwise(F.col("x")), "robot_y": F.when(stuck, 0.0).otherwise(F.col("y")),
        "state_x": F.col("x"), "state_y": F.col("y")})
    return telemetry.frozen_poses(pings).select("seq", "engaged")


GPS = STATES + f""",
c AS (SELECT * FROM e WHERE event_type = 'click'),
c0 AS (SELECT mission_id, arg_min(lat, row(us, seq)) AS lat0, arg_min(lon, row(us, seq)) AS lon0 FROM c GROUP BY mission_id),
c1 AS (SELECT c.*, radians(lon - lon0) * 6378137e0 * cos(radians(lat0)) AS rx, radians(lat - lat0) * 6378137e0 AS ry FROM c JOIN c0 USING (mission_id)),
c2 AS (SELECT *, coalesce(sqrt(pow(rx - lag(rx) OVER w, 2) + pow(ry - lag(ry) OVER w, 2)) / (t - lag(t) OVER w), 0e0) AS speed FROM c1 {W})"""


@query(with_(GPS, f"""SELECT seq, {R('rx', 'x')}, {R('ry', 'y')}, {R('radians(90e0 - compass_deg)', 'yaw')}, {R('''CASE WHEN t - lag(t) OVER w > 1e-3
  THEN sqrt(pow(rx - lag(rx) OVER w, 2) + pow(ry - lag(ry) OVER w, 2)) / (t - lag(t) OVER w) ELSE 0e0 END''', 'speed')} FROM c1 {W}"""))
def gps_reckon(spark, d):
    return telemetry.dead_reckon(_kind(spark, d, "click")).select(
        "seq", r6("reckoned_x", "x"), r6("reckoned_y", "y"), r6("reckoned_yaw", "yaw"), r6("reckoned_speed", "speed"))


@query(with_(STATES + """,
p AS (SELECT * FROM e WHERE event_type = 'error'), v AS (SELECT * FROM e WHERE event_type = 'view'),
b AS (SELECT p.mission_id, p.seq, p.us, v.seq AS bs, v.us AS bu FROM p ASOF LEFT JOIN v ON p.mission_id = v.mission_id AND p.us >= v.us),
f AS (SELECT p.seq, v.seq AS fs, v.us AS fu FROM p ASOF LEFT JOIN v ON p.mission_id = v.mission_id AND p.us <= v.us)""",
             """SELECT b.mission_id, b.seq, CASE WHEN fs IS NULL OR us - bu <= fu - us THEN bs ELSE fs END AS pose_seq FROM b JOIN f USING (seq)"""))
def nearest_pose(spark, d):
    out = asof.attach_nearest(_kind(spark, d, "error").select("mission_id", "us", "seq"), _kind(spark, d, "view").select("mission_id", "us", "seq"), "p", on="us")
    return out.select("mission_id", "seq", F.col("p.seq").alias("pose_seq"))


LOCF = STATES + f""",
lo AS (SELECT *, last_value(CASE WHEN event_type = 'click' THEN lat END IGNORE NULLS) OVER w AS glat,
  last_value(CASE WHEN event_type = 'click' THEN lon END IGNORE NULLS) OVER w AS glon,
  last_value(CASE WHEN event_type = 'signup' THEN compass_deg END IGNORE NULLS) OVER w AS hdg,
  last_value(CASE WHEN event_type = 'error' THEN value END IGNORE NULLS) OVER w AS spd FROM e {W})"""


@query(with_(LOCF, f"""SELECT seq, {R('glat', 'lat', 9)}, {R('glon', 'lon', 9)},
{R('coalesce(hdg, 90e0 - degrees(yaw) - 360e0 * floor((90e0 - degrees(yaw)) / 360e0))', 'heading_deg')},
{R('coalesce(spd, sqrt(pow(x * 0.1e0, 2) + pow(y * 0.1e0, 2)))', 'speed_mps')} FROM lo WHERE event_type = 'view'"""))
def robot_states(spark, d):
    names = {"view": "odom", "click": "gps", "signup": "compass", "error": "vfr"}
    kind = F.element_at(F.create_map(*[F.lit(v) for kv in names.items() for v in kv]), F.col("event_type"))
    rows = _kind(spark, d, *names).withColumns({
        "kind": kind, "vx": F.col("x") * 0.1, "vy": F.col("y") * 0.1, "groundspeed": F.col("value")})
    out = telemetry.robot_states(rows)
    return out.select("seq", r6("lat", digits=9), r6("lon", digits=9), r6("heading_deg"), r6("speed_mps"))


ODOM = STATES + f""",
o AS (SELECT *, last_value(CASE WHEN event_type = 'view' THEN yaw END IGNORE NULLS) OVER w AS nyaw,
  last_value(CASE WHEN event_type = 'click' THEN x END IGNORE NULLS) OVER w AS nx,
  last_value(CASE WHEN event_type = 'click' THEN y END IGNORE NULLS) OVER w AS ny FROM e {W})"""


@query(with_(ODOM, f"""SELECT seq, {R('ny', 'x')}, {R('nx', 'y')}, {R('pi() / 2 - nyaw', 'yaw')}, {R('-nyaw', 'pitch')}
FROM o WHERE event_type IN ('view', 'click') AND nyaw IS NOT NULL AND nx IS NOT NULL"""))
def odom_synthesis(spark, d):
    none = F.lit(None).cast("double")
    rows = tables.states(spark, d).withColumns({
        "type": F.when(F.col("event_type") == "view", "ATTITUDE").when(F.col("event_type") == "click", "LOCAL_POSITION_NED")
        .otherwise("HEARTBEAT"), "roll": none, "pitch": F.col("yaw"), "z": none, "vx": none, "vy": none, "vz": none})
    return telemetry.synthesise_odom(rows, order=("us", "seq")).select("seq", r6("x"), r6("y"), r6("yaw"), r6("pitch"))


STATE_OF = STATES + f""",
so AS (SELECT *, last_value(CASE WHEN event_type = 'view' THEN x END IGNORE NULLS) OVER w AS sx,
  last_value(CASE WHEN event_type = 'view' THEN y END IGNORE NULLS) OVER w AS sy,
  last_value(CASE WHEN event_type = 'view' THEN yaw END IGNORE NULLS) OVER w AS syaw,
  last_value(CASE WHEN event_type = 'click' THEN x END IGNORE NULLS) OVER w AS bx,
  last_value(CASE WHEN event_type = 'click' THEN y END IGNORE NULLS) OVER w AS by_ FROM e {W})"""


def _views(spark, d):
    return _kind(spark, d, "view").select("mission_id", "t", "seq", "x", "y", "yaw")


# a state with the stamp of a fix counts as known, whichever came first
@query(with_(STATE_OF.replace("ORDER BY us, seq", "ORDER BY us, event_type <> 'view', seq"), f"""SELECT seq, {R('sx + cos(syaw) * x - sin(syaw) * y', 'x')}, {R('sy + sin(syaw) * x + cos(syaw) * y', 'y')}
FROM so WHERE event_type = 'signup' AND sx IS NOT NULL"""))
def pinger_world(spark, d):
    fixes = _kind(spark, d, "signup").select("mission_id", "t", "seq", "x", "y")
    return asof.place_fixes(fixes, _views(spark, d)).select("seq", r6("x"), r6("y"))


@query(with_(STATE_OF, f"""SELECT seq, {R('sqrt(pow(sx - bx, 2) + pow(sy - by_, 2))', 'distance_m')} FROM so
WHERE event_type IN ('view', 'click') AND sx IS NOT NULL AND bx IS NOT NULL"""))
def live_distance(spark, d):
    return asof.live_distance(_views(spark, d), _kind(spark, d, "click")).select("seq", r6("distance_m"))


RESTAMP = STATE_OF + f""",
pg AS (SELECT *, CASE WHEN (seq // 512) % 2 = 0 THEN 0e0 ELSE x END AS px, CASE WHEN (seq // 512) % 2 = 0 THEN 0e0 ELSE y END AS py FROM so WHERE event_type = 'error'),
p1 AS (SELECT *, abs(px) < 0.05e0 AND abs(py) < 0.05e0 AS frozen, coalesce(sqrt(sx * sx + sy * sy) > 1, false) AS moved FROM pg),
p2 AS (SELECT *, sum(CASE WHEN frozen THEN 0 ELSE 1 END) OVER w AS grp FROM p1 {W}),
p3 AS (SELECT *, frozen AND sum(CASE WHEN frozen AND moved THEN 1 ELSE 0 END) OVER (PARTITION BY mission_id, grp ORDER BY us, seq) >= 5 AS engaged FROM p2)"""


def _restamp(spark, d, params):
    stuck = F.floor(F.col("seq") / 512) % 2 == 0
    pings = _kind(spark, d, "error").select(
        "mission_id", "t", "seq", F.when(stuck, 0.0).otherwise(F.col("x")).alias("robot_x"),
        F.when(stuck, 0.0).otherwise(F.col("y")).alias("robot_y"), "yaw")
    known = asof.attach_latest(pings, _views(spark, d), "s").withColumns({"state_x": F.col("s.x"), "state_y": F.col("s.y")}).drop("s")
    marked = telemetry.frozen_poses(known, params)
    out = asof.restamp_pings(marked, _views(spark, d), params=params)
    return out.select("seq", r6("robot_x"), r6("robot_y"), r6("yaw"))


@query(with_(RESTAMP, f"""SELECT seq, {R('CASE WHEN engaged AND sx IS NOT NULL THEN sx ELSE px END', 'robot_x')},
{R('CASE WHEN engaged AND sx IS NOT NULL THEN sy ELSE py END', 'robot_y')}, {R('CASE WHEN engaged AND sx IS NOT NULL THEN syaw ELSE yaw END', 'yaw')} FROM p3"""))
def pose_restamp_auto(spark, d):
    return _restamp(spark, d, Alignment(frozen_after=5))


@query(with_(RESTAMP, f"SELECT seq, {R('coalesce(sx, px)', 'robot_x')}, {R('coalesce(sy, py)', 'robot_y')}, {R('coalesce(syaw, yaw)', 'yaw')} FROM p3"))
def pose_restamp_gcs(spark, d):
    return _restamp(spark, d, Alignment(pose_source="gcs"))


@query(recursive(STATES + """,
k AS (SELECT mission_id, min(us) AS us FROM e GROUP BY mission_id UNION ALL
  SELECT mission_id, us FROM (SELECT k.mission_id, (SELECT min(e.us) FROM e WHERE e.mission_id = k.mission_id AND e.us >= k.us + 7200000000) AS us FROM k) WHERE us IS NOT NULL)""",
                 "SELECT mission_id, seq FROM k JOIN e USING (mission_id, us)"))
def throttle(spark, d):
    """Two hours between kept rows: the events lie minutes apart."""
    rows = tables.states(spark, d).withColumn("stamp_ns", F.col("us") * 1000)
    return sequential.throttle(rows, 2 * HOUR_NS).select("mission_id", "seq")


@query(with_(STATES + ", c AS (SELECT * FROM e WHERE event_type <> 'error')",
             f"""SELECT mission_id, {R('arg_min(lat, row(us, seq))', 'lat', 9)}, {R('arg_min(lon, row(us, seq))', 'lon', 9)},
{R('arg_min(x, row(us, seq))', 'x', 9)}, {R('arg_min(y, row(us, seq))', 'y', 9)} FROM c GROUP BY mission_id"""))
def gps_origin(spark, d):
    known = F.col("event_type") != "error"
    rows = tables.states(spark, d).withColumns({"lat": F.when(known, F.col("lat")), "lon": F.when(known, F.col("lon"))})
    return telemetry.gps_origin(rows).select("mission_id", *[r6(f"origin.{c}", c, 9) for c in ("lat", "lon", "x", "y")])


@query(with_(STATES + f""",
o AS (SELECT *, last_value(CASE WHEN event_type = 'view' THEN x END IGNORE NULLS) OVER w AS px,
  last_value(CASE WHEN event_type = 'view' THEN y END IGNORE NULLS) OVER w AS py FROM e {W}),
c AS (SELECT *, round_even(lat * 1e7, 0) / 1e7 AS la, round_even(lon * 1e7, 0) / 1e7 AS lo FROM o WHERE event_type = 'click' AND px IS NOT NULL)""",
             f"""SELECT mission_id, {R('arg_min(la, row(us, seq))', 'lat', 9)}, {R('arg_min(lo, row(us, seq))', 'lon', 9)},
{R('arg_min(px, row(us, seq))', 'x', 9)}, {R('arg_min(py, row(us, seq))', 'y', 9)} FROM c GROUP BY mission_id"""))
def replay_origin(spark, d):
    rows = tables.states(spark, d)
    fixes = rows.filter("event_type = 'click'").select(
        "mission_id", "seq", F.lit("GLOBAL_POSITION_INT").alias("type"),
        F.bround(F.col("lat") * 1e7).alias("lat"), F.bround(F.col("lon") * 1e7).alias("lon"))
    out = telemetry.replay_origin(fixes, rows.filter("event_type = 'view'"))
    return out.select("mission_id", *[r6(f"origin.{c}", c, 9) for c in ("lat", "lon", "x", "y")])


@query(with_(STATES, f"""SELECT mission_id, printf('%.3f', (us // 1000 - min(us // 1000) OVER (PARTITION BY mission_id)) / 1e3) AS t_since_first_s,
printf('%.3f', x) AS x_m, printf('%.3f', y) AS y_m, printf('%.3f', seq % 7 * 0.5e0) AS depth_m FROM e"""))
def trajectory_text(spark, d):
    """Whole milliseconds, so that no third decimal is a tie."""
    rows = tables.states(spark, d).select("mission_id", (F.floor(F.col("us") / 1000) / 1e3).alias("t"), F.col("x").alias("robot_x"), F.col("y").alias("robot_y"),
                                          (F.col("seq") % 7 * 0.5).alias("water_depth"))
    return files.trajectory_rows(rows)


@query(with_(STATES, f"SELECT seq, CAST((row_number() OVER w - 1) % 256 AS BIGINT) AS sequence FROM e {W}"))
def sequence_numbers(spark, d):
    return telemetry.sequence_numbers(tables.states(spark, d)).select("seq", "sequence")


@query(recursive(GPS + """,
v AS (SELECT * FROM e WHERE event_type = 'view'),
fb AS (SELECT c2.*, v.t AS ot, CASE WHEN (v.seq // 64) % 2 = 0 THEN 0e0 ELSE v.x END AS ox, CASE WHEN (v.seq // 64) % 2 = 0 THEN 0e0 ELSE v.y END AS oy
  FROM c2 ASOF LEFT JOIN v ON c2.mission_id = v.mission_id AND c2.us >= v.us),
fw AS (SELECT * FROM fb WHERE ot IS NULL OR t - ot > 3600 OR (abs(ox) < 0.05e0 AND abs(oy) < 0.05e0 AND sqrt(rx * rx + ry * ry) > 1)),
k AS (SELECT mission_id, min(us) AS us FROM fw GROUP BY mission_id UNION ALL
  SELECT mission_id, us FROM (SELECT k.mission_id, (SELECT min(f.us) FROM fw f WHERE f.mission_id = k.mission_id AND f.us >= k.us + 1800000000) AS us FROM k) WHERE us IS NOT NULL)""",
                 f"SELECT seq, {R('rx', 'x')}, {R('ry', 'y')}, {R('compass_deg', 'heading_deg')}, {R('speed', 'speed_mps')} FROM k JOIN fw USING (mission_id, us)"))
def fallback_states(spark, d):
    """Odometry silent for an hour or stuck at the origin; one state per half hour."""
    stuck = F.floor(F.col("seq") / 64) % 2 == 0
    odom = _views(spark, d).withColumns({c: F.when(stuck, 0.0).otherwise(F.col(c)) for c in ("x", "y")})
    params = Alignment(odom_dead_s=3600.0, state_period_ns=HOUR_NS // 2)
    out = telemetry.fallback_states(odom, _kind(spark, d, "click"), params)
    return out.select("seq", r6("x"), r6("y"), r6("heading_deg"), r6("speed_mps"))


@query(with_(STATES, "SELECT mission_id, event_type AS topic, CAST(floor(t) AS BIGINT) AS second, count(*) AS messages FROM e GROUP BY ALL"))
def rate_per_second(spark, d):
    return missions.rate_per_second(tables.states(spark, d), topic="event_type").withColumnRenamed("event_type", "topic")


@query(with_(STATES, f"""SELECT seq, {R('min(value) OVER w', 'depth_min')}, {R('max(value) OVER w', 'depth_max')} FROM e
WINDOW w AS (PARTITION BY mission_id ORDER BY us RANGE BETWEEN 21600000000 PRECEDING AND CURRENT ROW)"""))
def rolling_depth(spark, d):
    """Depth range over the last six hours: the events lie minutes apart."""
    rows = tables.states(spark, d).withColumnRenamed("value", "water_depth")
    return missions.rolling_depth(rows, 21_600.0).select("seq", r6("depth_min"), r6("depth_max"))


@query(with_(STATES, f"""SELECT mission_id, count(*) AS pings, {R('arg_min(x, row(us, seq))', 'first_x')}, {R('arg_min(y, row(us, seq))', 'first_y')},
{R('arg_max(x, row(us, seq))', 'last_x')}, {R('arg_max(y, row(us, seq))', 'last_y')} FROM e GROUP BY mission_id"""))
def trajectory_summary(spark, d):
    out = missions.trajectory_summary(tables.states(spark, d))
    return out.select("mission_id", "pings", *[r6(c) for c in ("first_x", "first_y", "last_x", "last_y")])


@query(with_(STATES, f"""SELECT seq, us - min(us) OVER m AS t, max(us) OVER m - min(us) OVER m AS duration_s FROM e
WINDOW m AS (PARTITION BY mission_id)"""))
def mission_rebase(spark, d):
    """Microseconds here, so that both engines subtract exactly."""
    return missions.rebase(tables.states(spark, d).withColumn("t", F.col("us"))).select("seq", "t", "duration_s")


@query(with_(STATES, f"""SELECT mission_id, us AS t, seq, CASE WHEN event_type = 'error' THEN 'ping' ELSE 'state' END AS kind,
{R("CASE WHEN event_type = 'error' THEN value END", 'water_depth')}, {R("CASE WHEN event_type = 'view' THEN yaw END", 'yaw')}
FROM e WHERE event_type IN ('error', 'view') ORDER BY mission_id, us, seq"""))
def mission_events(spark, d):
    """Pings and states in one table, in time order."""
    rows = tables.states(spark, d).withColumn("t", F.col("us"))
    pings = rows.filter("event_type = 'error'").select("mission_id", "t", "seq", F.col("value").alias("water_depth"))
    events = processing.mission_events(pings, rows.filter("event_type = 'view'").select("mission_id", "t", "seq", "yaw"))
    return processing.in_time_order(events).select("mission_id", "t", "seq", "kind", r6("water_depth"), r6("yaw"))


@query(with_(STATES + ", r AS (SELECT *, row_number() OVER (PARTITION BY mission_id ORDER BY us DESC, seq DESC) AS k FROM e)",
             "SELECT mission_id, seq FROM r WHERE k <= 150"))
def newest_rows(spark, d):
    return newest(tables.states(spark, d), 150).select("mission_id", "seq")


@query(with_(STATES + """,
v AS (SELECT mission_id, arg_max(seq, row(us, seq)) AS seq FROM e WHERE event_type = 'view' GROUP BY mission_id),
p AS (SELECT v.mission_id, e.x, e.y, k FROM v JOIN e USING (seq), (VALUES (0), (1), (2)) o(k))""",
             f"SELECT mission_id, CAST(k AS INTEGER) AS point_no, {R('x + k', 'x')}, {R('y - k', 'y')} FROM p"))
def planned_path(spark, d):
    """Points of the newest path of every mission."""
    poses = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.struct((F.col("x") + k).alias("x"), (F.col("y") - k).alias("y")))
    paths = messages.planned_paths(_kind(spark, d, "view").withColumn("poses", poses))
    return missions.path_points(missions.latest_path(paths)).select("mission_id", "point_no", r6("x"), r6("y"))


@query(with_(STATES, f"SELECT seq, {R('x')}, {R('y')}, 2e0 AS accuracy_m FROM e WHERE event_type = 'signup' AND seq % 3 <> 0 AND seq % 5 <> 0"))
def pinger_ingest(spark, d):
    """Fixes with fewer than two numbers or NaN are dropped."""
    short, bad = F.col("seq") % 3 == 0, F.col("seq") % 5 == 0
    data = F.when(short, F.array("x")).when(bad, F.array("x", F.lit(float("nan")))).otherwise(F.array("x", "y", "value"))
    fixes = messages.pinger_fixes(_kind(spark, d, "signup").withColumn("data", data))
    return fixes.select("seq", r6("x"), r6("y"), "accuracy_m")


SESSIONS = STATES + ", z AS (SELECT *, us // 86400000000 * 10 + mission_id AS session_id FROM e WHERE event_type IN ('error', 'purchase'))"


@query(with_(SESSIONS, f"""SELECT session_id, count(*) FILTER (event_type = 'error') AS ping_count, count(*) FILTER (event_type = 'purchase') AS detection_count,
round(max(t) - min(t), 1) + 0e0 AS duration_s FROM z GROUP BY session_id"""))
def session_report(spark, d):
    keyed = tables.states(spark, d).withColumn("session_id", F.floor(F.col("us") / 86_400_000_000) * 10 + F.col("mission_id"))
    out = missions.session_counts(keyed.filter("event_type = 'error'"), keyed.filter("event_type = 'purchase'"))
    return out.select("session_id", "ping_count", "detection_count", "duration_s")


@query("""WITH f AS (SELECT epoch_us(l_shipdate) // 1000000 AS mtime, count(*) AS k FROM lineitem GROUP BY 1),
s AS (SELECT o_orderkey AS session_id, epoch_us(o_orderdate) // 1000000 AS started FROM orders)
SELECT session_id, CAST(sum(k) AS BIGINT) AS adopted_files, min(mtime) AS first_mtime, max(mtime) AS last_mtime
FROM s JOIN f ON mtime BETWEEN started - 10 AND started + 3610 GROUP BY session_id""")
def session_files(spark, d):
    orders, items = tables.read(spark, d, "orders"), tables.read(spark, d, "lineitem")
    start = F.floor(tables.epoch_us(orders, "o_orderdate") / 1_000_000)
    sessions = orders.select(F.col("o_orderkey").alias("session_id"), start.alias("started"), (start + 3600).alias("ended"))
    written = items.select(F.floor(tables.epoch_us(items, "l_shipdate") / 1_000_000).alias("mtime"))
    return missions.adopted_counts(written, sessions)
