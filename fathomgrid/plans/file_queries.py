"""Queries that write a stored result to a new folder and return what reading it gives."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomgrid.config import Display
from fathomgrid.operators import imaging, missions
from fathomgrid.operators import mosaic as grid
from fathomgrid.plans import tables
from fathomgrid.plans.catalog import CELLS, DETECTIONS, MERGED, STATES, R, query, r6, with_
from fathomgrid.plans.ping_queries import IMAGE, IMAGES
from fathomgrid.plans.ping_queries import _members as image_members
from fathomgrid.plans.telemetry_queries import SESSIONS
from fathomgrid.session import shared_folder
from fathomgrid.sinks import files
from fathomgrid.sources import messages


@query(with_(CELLS, f"SELECT mission_id, cx, cy, count, {R('wsum')}, {R('pow(10e0, value / 20)', 'amplitude', 9)}, {R('closest')}, {R('oldest')}, {R('newest')}, 0.25e0 AS cell_size_m, -30e0 AS x0, -30e0 AS y0 FROM cells"))
def mosaic_saved(spark, d):
    """Mosaic cells through the mosaic store."""
    path = shared_folder(spark, "mosaic")
    files.write_mosaic(grid.mosaic(tables.samples(spark, d)), path)
    back = messages.read_mosaic(spark, path)
    return back.select(F.col("mission_id").cast("long").alias("mission_id"), "cx", "cy", "count", r6("wsum"), r6(F.pow(F.lit(10.0), F.col("mean") / 20), "amplitude", 9),
                       *[r6(c) for c in ("closest", "oldest", "newest")], "cell_size_m", "x0", "y0")


@query(with_(MERGED, f"SELECT {R('t - min(t) OVER (PARTITION BY mission_id)', 't_since_first_s', 3)}, {R('robot_x', 'x_m', 3)}, {R('robot_y', 'y_m', 3)}, {R('water_depth', 'depth_m', 3)} FROM mp"))
def trajectory_file(spark, d):
    """Trajectories through CSV files and their reader."""
    path = shared_folder(spark, "trajectory")
    files.write_trajectory(tables.merged_pings(spark, d), path)
    back = messages.read_trajectory(spark, path)
    return back.select(*[r6(c, digits=3) for c in ("t_since_first_s", "x_m", "y_m", "depth_m")])


@query(with_(DETECTIONS, f"""SELECT mission_id, uid, {R('x', 'x_m', 3)}, {R('y', 'y_m', 3)}, class_name AS class, {R('0.5e0 + seq % 8 / 8e0', 'confidence', 3)}, {R('0.25e0 * (seq % 5)', 'extent_m', 2)} FROM d"""))
def detections_file(spark, d):
    """Detections through CSV files."""
    path = shared_folder(spark, "detections")
    found = tables.detections(spark, d).withColumns({"confidence": 0.5 + F.col("seq") % 8 / 8.0, "extent_m": 0.25 * (F.col("seq") % 5)})
    files.write_detections(found, path)
    back = spark.read.csv(path, header=True)
    return back.select(F.col("mission_id").cast("long").alias("mission_id"), F.col("uid").cast("long").alias("uid"), *[
        r6(F.col(c).cast("double"), c, 3) for c in ("x_m", "y_m")], "class", r6(F.col("confidence").cast("double"), "confidence", 3), r6(F.col("extent_m").cast("double"), "extent_m", 2))


@query(with_(MERGED + """,
wide AS (SELECT mission_id, seq, greatest(0, least(799, CAST(trunc((range_m - y) / (2 * range_m) * 799) AS INTEGER))) AS col, pos, v FROM m JOIN mp USING (mission_id, seq)),
shown AS (SELECT mission_id, seq, col, CAST(CAST(arg_max(v, pos) AS FLOAT) AS DOUBLE) AS v FROM wide GROUP BY mission_id, seq, col),
line AS (SELECT mission_id, seq, count(*) AS filled, sum(v * (col + 1)) AS weighted FROM shown GROUP BY mission_id, seq)""",
             f"""SELECT mission_id, seq, {R('t')}, {R('robot_x')}, {R('range_m', 'swath_half_range_m')}, CAST(800 AS INTEGER) AS columns, filled, {R('weighted', digits=4)} FROM (
SELECT *, row_number() OVER (PARTITION BY mission_id ORDER BY t DESC, seq DESC) AS newest FROM mp) JOIN line USING (mission_id, seq) WHERE newest <= 1500"""))
def waterfall_file(spark, d):
    """The newest waterfall rows through their store."""
    path = shared_folder(spark, "waterfall")
    files.write_waterfall(tables.merged_pings(spark, d), path)
    back = spark.read.parquet(path)
    values = F.transform("intensity_db", lambda v, i: F.coalesce(v.cast("double") * (i + 1), F.lit(0.0)))
    return back.filter(F.size("intensity_db") == F.col("columns")).select(
        F.col("mission_id").cast("long").alias("mission_id"), "seq", r6("t"), r6("robot_x"), r6("swath_half_range_m"), "columns",
        F.size(F.array_compact("intensity_db")).cast("long").alias("filled"), r6(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), "weighted", 4))


@query("""WITH s AS (SELECT min(o_orderkey) AS session_id, epoch_us(o_orderdate) // 1000000 AS started FROM orders GROUP BY 2),
f AS (SELECT 'session_' || l_orderkey || '/' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS path, l_orderkey, epoch_us(l_shipdate) // 1000000 AS mtime FROM lineitem)
SELECT session_id, path, mtime FROM s JOIN f ON mtime BETWEEN started - 10 AND started + 3610 AND l_orderkey <> session_id""")
def adopted_files(spark, d):
    """(session, file) of files written during a session, but for those already in its folder."""
    orders, items = tables.read(spark, d, "orders"), tables.read(spark, d, "lineitem")
    start = F.floor(tables.epoch_us(orders, "o_orderdate") / 1_000_000)
    sessions = orders.groupBy(start.alias("started")).agg(F.min("o_orderkey").alias("session_id")).select(
        "session_id", "started", (F.col("started") + 3600).alias("ended"), F.concat(F.lit("session_"), "session_id").alias("folder"))
    path = F.concat(F.lit("session_"), "l_orderkey", F.lit("/"), "l_linenumber", F.lit("-"), "l_partkey", F.lit("-"), "l_suppkey")
    return missions.adopt_files(items.select(path.alias("path"), F.floor(tables.epoch_us(items, "l_shipdate") / 1_000_000).alias("mtime")), sessions)


@query(with_(IMAGES, f"""SELECT mission_id, image_id, count(*) AS rows, CAST(40 AS INTEGER) AS cols, {R('arg_min(t, row_no)', 't_start_s')},
'+range (PORT)' AS col0, {R('sum(t * (row_no + 1))', 't_sum')}, {R('sum(robot_x * (row_no + 1))', 'x_sum')}, {R('sum(yaw * (row_no + 1))', 'yaw_sum')},
{R('sum(range_m)', 'range_sum')}, {R('sum(speed_mps)', 'speed_sum')}, {R('sum(water_depth * (row_no + 1))', 'altitude_sum')},
{R('arg_max(robot_y, row_no)', 'end_y')}, CAST(1 AS BIGINT) AS detections FROM im GROUP BY mission_id, image_id"""))
def image_metadata(spark, d):
    """Images through their data set: the stored JSON, with a pose per row, read back and parsed."""
    path = shared_folder(spark, "images")
    members = image_members(spark, d)
    files.write_images(members, path, IMAGE.columns, imaging.detect(members))
    row = "t_s double, x_m double, y_m double, yaw_rad double, range_m double, speed_mps double, altitude_m double"
    layout = (f"schema int, rows long, cols int, t_start_s double, pixel_convention struct<col0: string>, rows_data array<struct<{row}>>, "
              "boat struct<end_pose: array<double>>, detections array<struct<class_name: string>>")
    m = spark.read.parquet(f"{path}/images").select(F.col("mission_id").cast("long").alias("mission_id"), "image_id", F.from_json("metadata", layout).alias("m"))

    def total(field: str, weighted: bool = True):
        values = F.transform("m.rows_data", lambda r, i: r[field] * (i + 1 if weighted else F.lit(1)))
        return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return m.select(
        "mission_id", "image_id", "m.rows", "m.cols", r6("m.t_start_s", "t_start_s"), "m.pixel_convention.col0", r6(total("t_s"), "t_sum"), r6(total("x_m"), "x_sum"),
        r6(total("yaw_rad"), "yaw_sum"), r6(total("range_m", False), "range_sum"), r6(total("speed_mps", False), "speed_sum"), r6(total("altitude_m"), "altitude_sum"),
        r6(F.col("m.boat.end_pose")[1], "end_y"), F.size("m.detections").cast("long").alias("detections"))


@query(with_(IMAGES, f"""SELECT im.mission_id, im.image_id, im.row_no, CAST(c AS INTEGER) AS col, {R('robot_x - sin(yaw) * (range_m * (1e0 - 2e0 * c / 39e0))', 'world_x')},
{R('CAST(wfr.v AS FLOAT)', 'v')} FROM im CROSS JOIN (SELECT unnest(range(0, 40)) AS c)
LEFT JOIN wfr ON wfr.mission_id = im.mission_id AND wfr.seq = im.seq AND wfr.col = c"""))
def image_pixels(spark, d):
    """The pixel table of the image data set, read back."""
    path = shared_folder(spark, "images")
    files.write_images(image_members(spark, d), path, IMAGE.columns)
    back = spark.read.parquet(f"{path}/pixels")
    return back.select(F.col("mission_id").cast("long").alias("mission_id"), "image_id", "row_no", "col", r6("world_x"), r6(F.col("v").cast("double"), "v"))


@query(with_(IMAGES + """,
h AS (SELECT mission_id, image_id, count(*) AS rows, arg_max(t, row_no) AS t_end_s, avg(water_depth) AS depth FROM im GROUP BY mission_id, image_id)""",
             f"""SELECT mission_id, image_id, 'dummy_center' AS class_name, row_no, 20 AS col, {R('t', 't_s')}, {R('t_end_s')}, {R('depth', 'mean_altitude_m')},
{R('robot_y + cos(yaw) * (range_m * (1e0 - 2e0 * 20 / 39e0))', 'y')} FROM im JOIN h USING (mission_id, image_id) WHERE row_no = rows // 2"""))
def analysis_json(spark, d):
    """The analysis message of every image, parsed: one finding each, no pixels."""
    members = image_members(spark, d)
    layout = ("image struct<t_end_s: double, boat: struct<mean_altitude_m: double>>, "
              "detections array<struct<pixel: array<int>, world: array<double>, class_name: string, t_s: double>>")
    m = files.analysis(members, imaging.detect(members)).select("mission_id", "image_id", F.from_json("metadata", layout).alias("m"))
    return m.select("mission_id", "image_id", "m.image", F.explode("m.detections").alias("f")).select(
        "mission_id", "image_id", "f.class_name", F.col("f.pixel")[0].alias("row_no"), F.col("f.pixel")[1].alias("col"), r6("f.t_s", "t_s"),
        r6("image.t_end_s", "t_end_s"), r6("image.boat.mean_altitude_m", "mean_altitude_m"), r6(F.col("f.world")[1], "y"))


@query(with_(SESSIONS + """,
c AS (SELECT session_id, count(*) FILTER (event_type = 'error') AS ping_count, count(*) FILTER (event_type = 'purchase') AS detection_count,
  min(us) AS us0, round(max(t) - min(t), 1) + 0e0 AS duration_s, min(t) AS t0, max(t) AS t1 FROM z GROUP BY session_id),
f AS (SELECT us // 1000000 AS mtime FROM e WHERE event_type = 'click'),
n AS (SELECT session_id, count(*) AS adopted FROM c JOIN f ON mtime BETWEEN floor(t0) - 10 AND floor(t1) + 10 GROUP BY session_id)""",
             f"""SELECT session_id AS session, ping_count, detection_count, duration_s, us0 // 1000 * 1000 AS started_us, coalesce(adopted, 0) AS adopted, 0.25e0 AS cell_size_m,
'newest' AS policy, 0.8e0 AS gamma, 'Gold' AS colormap, 'port' AS sonar FROM c LEFT JOIN n USING (session_id)"""))
def session_metadata(spark, d):
    """Session reports through JSON files, with settings as they were at the end."""
    keyed = tables.states(spark, d).withColumn("session_id", F.floor(F.col("us") / 86_400_000_000) * 10 + F.col("mission_id"))
    counts = missions.session_counts(keyed.filter("event_type = 'error'"), keyed.filter("event_type = 'purchase'"))
    logs = keyed.filter("event_type = 'click'").select(F.concat(F.lit("logs/"), "seq").alias("path"), F.floor(F.col("us") / 1_000_000).alias("mtime"))
    sessions = counts.select("session_id", F.concat(F.lit("session_"), "session_id").alias("folder"), *[F.floor(f"{c}_s").alias(c) for c in ("started", "ended")])
    report = files.session_metadata(counts, missions.adopt_files(logs, sessions), policy="newest", display=Display(gamma=0.8, colormap="Gold"), topics={"sonar": "port"})
    path = shared_folder(spark, "sessions")
    files.write_session_metadata(report, path)
    back = spark.read.schema("session long, ping_count long, detection_count long, duration_s double, started_utc timestamp, adopted_svlogs array<string>, "
                             "mosaic struct<cell_size_m: double, priority_mode_displayed: string>, display_settings_at_end struct<gamma: double, colormap: string>, "
                             "topics struct<sonar: string>").json(path)
    return back.select("session", "ping_count", "detection_count", "duration_s", (F.floor(F.unix_micros("started_utc") / 1000) * 1000).alias("started_us"),
                       F.size("adopted_svlogs").cast("long").alias("adopted"), "mosaic.cell_size_m", F.col("mosaic.priority_mode_displayed").alias("policy"),
                       "display_settings_at_end.gamma", "display_settings_at_end.colormap", "topics.sonar")


@query(with_(MERGED, f"""SELECT mission_id, seq, {R('any_value(t)', 't')}, {R('any_value(atan2(sin(yaw), cos(yaw)))', 'yaw')}, {R('any_value(water_depth)', 'water_depth')},
count(*) AS samples, {R('sum(y * v * (pos + 1))', 'weighted', 4)} FROM m GROUP BY mission_id, seq"""))
def sonar_messages(spark, d):
    """Processed ping messages, a stamp, quaternion and arrays per side, as merged pings."""
    pings = tables.merged_pings(spark, d)

    def side(values: str, port: bool):
        return F.filter(values, lambda _, i: (F.get("y_local", i) > 0) == F.lit(port))
    sent = pings.select(
        "mission_id", F.col("seq").alias("port_ping_number"), (F.col("seq") * 100_000_000).alias("port_stamp_ns"), "robot_x", "robot_y", "water_depth",
        F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.sin(F.col("yaw") / 2).alias("z"), F.cos(F.col("yaw") / 2).alias("w")).alias("orientation"),
        side("y_local", True).alias("port_y"), side("y_local", False).alias("starboard_y"),
        side("intensity_db", True).alias("port_intensity_db"), side("intensity_db", False).alias("starboard_intensity_db"))
    got = messages.sonar_pings(sent)
    values = F.transform(F.arrays_zip("y_local", "intensity_db"), lambda s, i: s["y_local"] * s["intensity_db"] * (i + 1))
    return got.select("mission_id", "seq", r6("t"), r6("yaw"), r6("water_depth"), F.size("y_local").cast("long").alias("samples"),
                      r6(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), "weighted", 4))


@query(with_(STATES, f"""SELECT CASE event_type WHEN 'view' THEN 'odom' WHEN 'click' THEN 'gps' WHEN 'signup' THEN 'compass' WHEN 'purchase' THEN 'detections' ELSE 'sonar' END AS stream,
mission_id, seq, {R('value')} FROM e"""))
def telemetry_streams(spark, d):
    """A stacked telemetry table split by topic."""
    topics = {"odom": "view", "gps": "click", "compass": "signup", "detections": "purchase", "sonar": "error"}
    parts = messages.telemetry_topics(tables.states(spark, d).withColumnRenamed("event_type", "topic"), topics)
    named = [rows.select(F.lit(name).alias("stream"), "mission_id", "seq", r6("value")) for name, rows in parts.items()]
    return reduce(DataFrame.unionByName, named)
