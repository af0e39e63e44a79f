"""Queries over pings: scaling, bottom return, pairing, altitude, images."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathomgrid.config import Mosaic, Pairing, Seabed, Tracking
from fathomgrid.functions import attitude
from fathomgrid.operators import imaging, raster, sequential
from fathomgrid.operators import mosaic as grid
from fathomgrid.plans import tables
from fathomgrid.plans.catalog import BOTTOM, CELLS, GROUND, MERGED, PINGS, SAMPLES, R, query, r6, recursive, with_

IMAGE = Seabed(rows=16, stride=8, columns=40)
LOOSE = Tracking(bootstrap_pings=3, agreement_m=3.0, outlier_m=2.0, relock_after=3)


@query(with_(PINGS, f"SELECT vec_id, CAST(i AS INTEGER) AS sample, {R('db[i + 1]', 'db')} "
                    "FROM ad, (SELECT unnest(range(0, 64)) AS i)"))
def scale_db(spark, d):
    return tables.scaled_pings(spark, d).select("vec_id", F.posexplode("db").alias("sample", "v")).select(
        "vec_id", "sample", r6("v", "db"))


@query(with_(BOTTOM, "SELECT vec_id, CAST(settle AS INTEGER) AS settle FROM ab"))
def settle_index(spark, d):
    return tables.bottom_pings(spark, d).select("vec_id", "settle")


@query(with_(BOTTOM, f"SELECT vec_id, {R('slant_m')} FROM ab"))
def fbr_slant(spark, d):
    return tables.bottom_pings(spark, d).select("vec_id", r6("slant_m"))


@query(with_(GROUND, f"SELECT ping_no, side, {R('yl', 'y_local')}, {R('v')}, {R('robot_x - sin(yaw) * yl', 'x')}, "
                     f"{R('robot_y + cos(yaw) * yl', 'y')} FROM ag"))
def slant_project(spark, d):
    flat = tables.side_ground(spark, d).select("ping_no", "side", "robot_x", "robot_y", "yaw", F.explode("ground").alias("g"))
    return flat.select(
        "ping_no", "side", r6("g.y", "y_local"), r6("g.v", "v"),
        r6(attitude.across_track_x(F.col("robot_x"), F.col("yaw"), F.col("g.y")), "x"),
        r6(attitude.across_track_y(F.col("robot_y"), F.col("yaw"), F.col("g.y")), "y"))


@query(with_(MERGED, f"SELECT mission_id, seq, CAST(pos AS INTEGER) AS pos, {R('y', 'y_local')}, {R('v', 'intensity_db')} FROM m"))
def merge_sides(spark, d):
    pings = tables.merged_pings(spark, d)
    return pings.select("mission_id", "seq", F.posexplode(F.arrays_zip("y_local", "intensity_db")).alias("pos", "s")).select(
        "mission_id", "seq", "pos", r6("s.y_local", "y_local"), r6("s.intensity_db", "intensity_db"))


@query(with_(MERGED, f"""SELECT seq, {R('robot_x - sin(yaw) * range_m', 'port_x')}, {R('robot_y + cos(yaw) * range_m', 'port_y')},
{R('robot_x + sin(yaw) * range_m', 'stbd_x')}, {R('robot_y - cos(yaw) * range_m', 'stbd_y')} FROM mp"""))
def swath_tips(spark, d):
    tips = attitude.swath_tips(F.col("robot_x"), F.col("robot_y"), F.col("yaw"), F.col("y_local"))
    return tables.merged_pings(spark, d).select("seq", tips.alias("t")).select(
        "seq", *[r6(f"t.{c}", c) for c in ("port_x", "port_y", "stbd_x", "stbd_y")])


PAIRS = PINGS + """,
p AS (SELECT mission_id, vec_id, STAMP AS ns, row_number() OVER (PARTITION BY mission_id ORDER BY STAMP, vec_id) AS n FROM a WHERE side = 'port'),
s AS (SELECT mission_id, vec_id, STAMP AS ns, row_number() OVER (PARTITION BY mission_id ORDER BY STAMP, vec_id) AS n FROM a WHERE side = 'stbd'),
walk AS (SELECT mission_id, 1 AS i, 1 AS j FROM a GROUP BY mission_id UNION ALL
  SELECT w.mission_id, CASE WHEN abs(p.ns - s.ns) <= 50000000 OR p.ns < s.ns THEN w.i + 1 ELSE w.i END,
    CASE WHEN abs(p.ns - s.ns) <= 50000000 OR p.ns > s.ns THEN w.j + 1 ELSE w.j END
  FROM walk w JOIN p ON p.mission_id = w.mission_id AND p.n = w.i JOIN s ON s.mission_id = w.mission_id AND s.n = w.j),
pairs AS (SELECT p.mission_id, p.vec_id AS port_seq, s.vec_id AS stbd_seq, p.ns AS port_ns, s.ns AS stbd_ns FROM walk w
  JOIN p ON p.mission_id = w.mission_id AND p.n = w.i JOIN s ON s.mission_id = w.mission_id AND s.n = w.j
  WHERE abs(p.ns - s.ns) <= 50000000)"""


def _pairs(spark, d, stamp):
    pings = tables.side_pings(spark, d).withColumnRenamed("vec_id", "seq")
    return sequential.pair_pings(pings, Pairing(), stamp=stamp)


@query(recursive(PAIRS.replace("STAMP", "sparse_ns"), "SELECT * FROM pairs"))
def pair_pings_sparse(spark, d):
    return _pairs(spark, d, "sparse_ns")


@query(recursive(PAIRS.replace("STAMP", "dense_ns"), "SELECT * FROM pairs"))
def pair_pings_dense(spark, d):
    return _pairs(spark, d, "dense_ns")


def _lock_sql(side: str, name: str) -> str:
    """Altitude lock of one side as a recursive walk over its detections."""
    locked, value = "w.alt IS NOT NULL", "r.f"
    ok = f"({locked} AND {value} IS NOT NULL AND abs({value} - w.alt) <= 2e0)"
    lost = f"({locked} AND NOT coalesce({ok}, false) AND w.streak + 1 >= 3)"
    grown = f"CASE WHEN {value} IS NULL THEN w.win ELSE list_append(w.win[-2:], {value}) END"
    return f""",
{name}r AS (SELECT mission_id, ping_no, slant_m AS f, row_number() OVER (PARTITION BY mission_id ORDER BY ping_no) AS n FROM ab WHERE side = '{side}'),
{name} AS (SELECT mission_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS DOUBLE) AS alt, 0 AS streak, CAST([] AS DOUBLE[]) AS win FROM {name}r GROUP BY mission_id
  UNION ALL SELECT w.mission_id, r.n,
  CASE WHEN {lost} THEN NULL WHEN {ok} THEN {value} WHEN {locked} THEN w.alt
    WHEN {value} IS NOT NULL AND len({grown}) = 3 AND list_max({grown}) - list_min({grown}) <= 3e0 THEN list_sum({grown}) / 3e0 END,
  CASE WHEN {lost} OR {ok} THEN 0 WHEN {locked} THEN w.streak + 1 WHEN {value} IS NOT NULL THEN 0
    WHEN w.streak + 1 >= 3 THEN 0 ELSE w.streak + 1 END,
  CASE WHEN {lost} THEN CAST([] AS DOUBLE[]) WHEN {locked} THEN w.win WHEN {value} IS NULL AND w.streak + 1 >= 3 THEN CAST([] AS DOUBLE[])
    ELSE {grown} END
  FROM {name} w JOIN {name}r r ON r.mission_id = w.mission_id AND r.n = w.n + 1)"""


LOCKS = BOTTOM + _lock_sql("port", "pl") + _lock_sql("stbd", "sl") + """,
locks AS (SELECT r.mission_id, r.ping_no AS seq, pl.alt AS port_alt, sl.alt AS stbd_alt FROM plr r
  JOIN pl USING (mission_id, n) JOIN sl USING (mission_id, n))"""


def _bottoms(spark, d):
    def side(name):
        return F.max(F.when(F.col("side") == name, F.col("slant_m")))
    return tables.bottom_pings(spark, d).groupBy("mission_id", F.col("ping_no").alias("seq")).agg(
        side("port").alias("port_fbr"), side("stbd").alias("stbd_fbr"))


@query(recursive(LOCKS, f"SELECT mission_id, seq, {R('port_alt')}, {R('stbd_alt')} FROM locks"))
def altitude_track(spark, d):
    return sequential.track_altitude(_bottoms(spark, d), LOOSE).select("mission_id", "seq", r6("port_alt"), r6("stbd_alt"))


@query(recursive(LOCKS, f"""SELECT mission_id, seq, {R('''last_value(greatest(coalesce(port_alt, stbd_alt), coalesce(stbd_alt, port_alt))
  IGNORE NULLS) OVER (PARTITION BY mission_id ORDER BY seq)''', 'altitude')} FROM locks"""))
def altitude_fused(spark, d):
    locked = sequential.track_altitude(_bottoms(spark, d), LOOSE)
    return sequential.fuse_altitude(locked).select("mission_id", "seq", r6("altitude"))


WATERFALL = MERGED + """,
wf AS (SELECT mission_id, seq, greatest(0, least(39, CAST(trunc((range_m - y) / (2 * range_m) * 39) AS INTEGER))) AS col, pos, v
  FROM m JOIN mp USING (mission_id, seq)),
wfr AS (SELECT mission_id, seq, col, arg_max(v, pos) AS v FROM wf GROUP BY mission_id, seq, col),
num AS (SELECT *, row_number() OVER (PARTITION BY mission_id ORDER BY t, seq) AS n, count(*) OVER (PARTITION BY mission_id) AS total FROM mp),
fl AS (SELECT *, CASE WHEN total >= 16 THEN (total - 16) // 8 + 1 ELSE 0 END AS nfull,
  coalesce(sqrt(pow(robot_x - lag(robot_x) OVER w, 2) + pow(robot_y - lag(robot_y) OVER w, 2)) / (t - lag(t) OVER w), 0e0) AS speed_mps
  FROM num WINDOW w AS (PARTITION BY mission_id ORDER BY t, seq)),
ti AS (SELECT *, CASE WHEN nfull > 0 THEN least(total - (16 + (nfull - 1) * 8), 16) ELSE least(total, 16) END AS tail FROM fl),
im AS (SELECT ti.*, j AS image_id, CAST(n - j * 8 - 1 AS INTEGER) AS row_no FROM ti, (SELECT unnest(range(0, 100)) AS j)
    WHERE j < nfull AND n > j * 8 AND n <= j * 8 + 16
  UNION ALL SELECT ti.*, nfull AS image_id, CAST(n - (total - tail) - 1 AS INTEGER) AS row_no FROM ti WHERE tail >= 2 AND n > total - tail)"""

#: the rows of every image, however many a mission has
IMAGES = WATERFALL[:WATERFALL.index("im AS (")] + """wi AS (SELECT *, unnest(range(greatest((n - 9) // 8, 0), least((n - 1) // 8 + 1, nfull))) AS j FROM ti),
im AS (SELECT * EXCLUDE (j), j AS image_id, CAST(n - j * 8 - 1 AS INTEGER) AS row_no FROM wi
  UNION ALL SELECT ti.*, nfull AS image_id, CAST(n - (total - tail) - 1 AS INTEGER) AS row_no FROM ti WHERE tail >= 2 AND n > total - tail)"""


def _members(spark, d):
    pings = imaging.ping_speed(imaging.usable_pings(tables.merged_pings(spark, d)))
    rows = pings.withColumn("intensity", imaging.waterfall_row(F.col("y_local"), F.col("intensity_db"), IMAGE.columns))
    return imaging.image_members(rows.drop("y_local", "intensity_db"), IMAGE)


@query(with_(WATERFALL, f"SELECT mission_id, seq, col, {R('CAST(v AS FLOAT)', 'v')} FROM wfr"))
def waterfall_rows(spark, d):
    pings = imaging.usable_pings(tables.merged_pings(spark, d))
    row = imaging.waterfall_row(F.col("y_local"), F.col("intensity_db"), IMAGE.columns)
    return pings.select("mission_id", "seq", F.posexplode(row).alias("col", "v")).filter("v is not null").select(
        "mission_id", "seq", "col", r6(F.col("v").cast("double"), "v"))


@query(with_(WATERFALL, f"SELECT mission_id, seq, {R('speed_mps')} FROM fl"))
def ping_speed(spark, d):
    return imaging.ping_speed(imaging.usable_pings(tables.merged_pings(spark, d))).select("mission_id", "seq", r6("speed_mps"))


@query(with_(IMAGES, "SELECT mission_id, image_id, row_no, seq FROM im"))
def image_windows(spark, d):
    pings = imaging.usable_pings(tables.merged_pings(spark, d))
    return imaging.image_members(pings, IMAGE).select("mission_id", "image_id", "row_no", "seq")


@query(with_(IMAGES, f"""SELECT mission_id, image_id, count(*) AS rows, {R('arg_min(t, row_no)', 't_start_s')}, {R('arg_max(t, row_no)', 't_end_s')},
{R('avg(speed_mps)', 'mean_speed_mps')}, {R('avg(water_depth)', 'mean_altitude_m')}, {R('arg_min(robot_x, row_no)', 'start_x')},
{R('arg_max(robot_y, row_no)', 'end_y')}, {R('arg_max(yaw, row_no)', 'end_yaw')} FROM im GROUP BY mission_id, image_id"""))
def image_summary(spark, d):
    out = imaging.image_summary(_members(spark, d))
    return out.select("mission_id", "image_id", "rows", r6("t_start_s"), r6("t_end_s"), r6("mean_speed_mps"), r6("mean_altitude_m"),
                      r6("start_pose.robot_x", "start_x"), r6("end_pose.robot_y", "end_y"), r6("end_pose.yaw", "end_yaw"))


@query(with_(IMAGES, f"""SELECT mission_id, image_id, row_no, CAST(c AS INTEGER) AS col,
{R('robot_x - sin(yaw) * (range_m * (1e0 - 2e0 * c / 39e0))', 'world_x')}, {R('robot_y + cos(yaw) * (range_m * (1e0 - 2e0 * c / 39e0))', 'world_y')},
{R('CAST(wfr.v AS FLOAT)', 'v')} FROM im, (SELECT unnest(range(0, 40)) AS c)
LEFT JOIN wfr ON wfr.mission_id = im.mission_id AND wfr.seq = im.seq AND wfr.col = c""".replace("SELECT mission_id", "SELECT im.mission_id")))
def pixel_world(spark, d):
    return imaging.pixel_world(_members(spark, d), IMAGE.columns).select(
        "mission_id", "image_id", "row_no", "col", r6("world_x"), r6("world_y"), r6(F.col("v").cast("double"), "v"))


@query(with_(IMAGES + """,
px AS (SELECT im.mission_id, im.image_id, row_no, col, CAST(CAST(v AS FLOAT) AS DOUBLE) AS v FROM im JOIN wfr USING (mission_id, seq)),
lim AS (SELECT mission_id, image_id, quantile_cont(v, 0.02) AS lo, quantile_cont(v, 0.98) AS hi FROM px GROUP BY mission_id, image_id)""",
             """SELECT im.mission_id, im.image_id, im.row_no, CAST(c AS INTEGER) AS col, CASE WHEN v IS NULL THEN 0 ELSE
CAST(trunc(greatest(0e0, least(1e0, (v - lo) / (greatest(hi, lo + 1e-6) - lo))) * 255) AS INTEGER) END AS pixel FROM im CROSS JOIN (SELECT unnest(range(0, 40)) AS c)
JOIN lim USING (mission_id, image_id) LEFT JOIN px ON px.mission_id = im.mission_id AND px.image_id = im.image_id
AND px.row_no = im.row_no AND px.col = c"""))
def image_8bit(spark, d):
    image = imaging.to_8bit(imaging.images(_members(spark, d)))
    return image.select("mission_id", "image_id", F.posexplode("pixels").alias("row_no", "r")).select(
        "mission_id", "image_id", "row_no", F.posexplode("r").alias("col", "pixel"))


@query(with_(IMAGES + """,
h AS (SELECT mission_id, image_id, count(*) AS rows FROM im GROUP BY mission_id, image_id),
c AS (SELECT im.*, range_m * (1e0 - 2e0 * 20 / 39e0) AS y FROM im JOIN h USING (mission_id, image_id) WHERE row_no = rows // 2)""",
             f"""SELECT mission_id, image_id, 1000000 + image_id * 16 AS uid, {R('t', 't_s')}, row_no, 20 AS col,
{R('robot_x - sin(yaw) * y', 'x')}, {R('robot_y + cos(yaw) * y', 'y')}, 'dummy_center' AS class_name, 0.5e0 AS confidence FROM c"""))
def image_detections(spark, d):
    return imaging.detect(_members(spark, d)).select(
        "mission_id", "image_id", "uid", r6("t_s"), "row_no", "col", r6("x"), r6("y"), "class_name", "confidence")


#: every side on an even grid (rs), the same grid points on the previous ping's profile (pi), and the virtual pings (vp)
DENSE = MERGED + """,
pr AS (SELECT mission_id, seq, CASE WHEN y > 0 THEN 0 ELSE 1 END AS side, y, v, lead(y) OVER w AS y1, lead(v) OVER w AS v1
  FROM m WINDOW w AS (PARTITION BY mission_id, seq, y > 0 ORDER BY y)),
ex AS (SELECT mission_id, seq, side, min(y) AS lo, max(y) AS hi, greatest(CAST(ceil((max(y) - min(y)) / 0.125e0) AS INTEGER) + 1, 2) AS n FROM pr GROUP BY ALL),
gu AS (SELECT *, unnest(range(0, n)) AS i FROM ex),
gr AS (SELECT mission_id, seq, side, i, CASE WHEN i = n - 1 THEN hi ELSE i * ((hi - lo) / (n - 1)) + lo END AS y FROM gu),
r0 AS (SELECT gr.mission_id, gr.seq, gr.side, gr.i, gr.y, CAST(CASE WHEN p.y1 IS NULL THEN p.v ELSE (p.v1 - p.v) / (p.y1 - p.y) * (gr.y - p.y) + p.v END AS FLOAT) AS v
  FROM gr ASOF JOIN pr p ON gr.mission_id = p.mission_id AND gr.seq = p.seq AND gr.side = p.side AND gr.y >= p.y),
rs AS (SELECT *, lead(y) OVER w AS y1, CAST(lead(v) OVER w AS DOUBLE) AS v1, CAST(first_value(v) OVER w AS DOUBLE) AS v0 FROM r0 WINDOW w AS (PARTITION BY mission_id, seq, side ORDER BY y)),
pv AS (SELECT *, lag(seq) OVER w AS ps, lag(robot_x) OVER w AS px, lag(robot_y) OVER w AS py, lag(yaw) OVER w AS pyaw FROM mp WINDOW w AS (PARTITION BY mission_id ORDER BY t, seq)),
ge AS (SELECT pv.*, sqrt(pow(robot_x - px, 2) + pow(robot_y - py, 2)) AS hull, atan2(sin(yaw - pyaw), cos(yaw - pyaw)) AS turn,
  greatest(p.hi, -s.hi) AS reach FROM pv JOIN ex p ON p.mission_id = pv.mission_id AND p.seq = pv.seq AND p.side = 0
  JOIN ex s ON s.mission_id = pv.mission_id AND s.seq = pv.seq AND s.side = 1),
gk AS (SELECT *, coalesce(hull <= 2.5e0 AND abs(turn) <= 0.6e0, false) AS ok FROM ge),
gn AS (SELECT *, CASE WHEN ok THEN least(greatest(CAST(ceil((hull + abs(turn) * reach) / 0.125e0) AS INTEGER), 1), 64) ELSE 1 END AS nv FROM gk),
vu AS (SELECT *, unnest(range(1, nv + 1)) AS k FROM gn),
vp AS (SELECT mission_id, seq, k, nv, k / CAST(nv AS DOUBLE) AS f, CASE WHEN ok THEN px + k / CAST(nv AS DOUBLE) * (robot_x - px) ELSE robot_x END AS vx,
  CASE WHEN ok THEN py + k / CAST(nv AS DOUBLE) * (robot_y - py) ELSE robot_y END AS vy, CASE WHEN ok THEN pyaw + k / CAST(nv AS DOUBLE) * turn ELSE yaw END AS vyaw FROM vu),
pg AS (SELECT rs.mission_id, rs.seq, rs.side, rs.i, rs.y, gn.ps FROM rs JOIN gn USING (mission_id, seq) WHERE ok),
pi AS (SELECT pg.mission_id, pg.seq, pg.side, pg.i, CASE WHEN q.y IS NULL THEN NULL WHEN q.y1 IS NULL THEN CAST(q.v AS DOUBLE)
  ELSE (q.v1 - CAST(q.v AS DOUBLE)) / (q.y1 - q.y) * (pg.y - q.y) + CAST(q.v AS DOUBLE) END AS pv
  FROM pg ASOF LEFT JOIN rs q ON pg.mission_id = q.mission_id AND pg.ps = q.seq AND pg.side = q.side AND pg.y >= q.y),
pf AS (SELECT mission_id, seq, side, any_value(v0) AS v0 FROM rs GROUP BY ALL),
l AS (SELECT rs.mission_id, rs.seq AS ping_seq, row_number() OVER (PARTITION BY rs.mission_id, rs.seq ORDER BY vp.k, rs.side, rs.i) - 1 AS sample_idx,
  vx - sin(vyaw) * rs.y AS x, vy + cos(vyaw) * rs.y AS y, abs(rs.y) AS rng,
  CAST(CASE WHEN vp.k = vp.nv THEN rs.v ELSE CAST((1e0 - f) * coalesce(pi.pv, pf.v0) + f * CAST(rs.v AS DOUBLE) AS FLOAT) END AS DOUBLE) AS v
  FROM rs JOIN vp USING (mission_id, seq) LEFT JOIN pi ON pi.mission_id = rs.mission_id AND pi.seq = rs.seq AND pi.side = rs.side AND pi.i = rs.i
  LEFT JOIN gn ON gn.mission_id = rs.mission_id AND gn.seq = rs.seq LEFT JOIN pf ON pf.mission_id = rs.mission_id AND pf.seq = gn.ps AND pf.side = rs.side)"""


@query(with_(DENSE, f"SELECT mission_id, ping_seq, CAST(sample_idx AS INTEGER) AS sample_idx, {R('x')}, {R('y')}, {R('v')}, {R('rng')} FROM l"))
def virtual_pings(spark, d):
    """Densified samples; the tests also compare them with a plain per-sample walk."""
    pings = raster.with_previous(tables.merged_pings(spark, d))
    out = raster.densified_samples(pings)
    return out.select("mission_id", "ping_seq", "sample_idx", r6("x"), r6("y"), r6("v"), r6("rng"))


@query(with_(CELLS.replace(SAMPLES, DENSE), f"SELECT mission_id, cx, cy, count, {R('sum')}, {R('wsum')}, {R('closest')}, {R('oldest')}, {R('newest')} FROM cells"))
def mosaic_densified(spark, d):
    """Mosaic of densified pings."""
    cells = grid.merge_cells(raster.densify(raster.with_previous(tables.merged_pings(spark, d))))
    return cells.select("mission_id", "cx", "cy", "count", *[r6(c) for c in ("sum", "wsum", "closest", "oldest", "newest")])


@query(with_(MERGED + """,
w AS (SELECT mission_id, seq AS ping_seq, pos AS sample_idx, robot_x - sin(yaw) * y AS x, robot_y + cos(yaw) * y AS y, v, abs(y) AS rng FROM m),
n AS (SELECT *, CAST(floor((x + 30e0) / 0.25e0) AS BIGINT) AS cx, CAST(floor((y + 30e0) / 0.25e0) AS BIGINT) AS cy FROM w)""",
             f"""SELECT mission_id, cx, cy, count(*) AS count, {R('sum(v)', 'sum')},
{R('arg_max(v, row(-CAST(CAST(rng AS FLOAT) AS DOUBLE), ping_seq, sample_idx))', 'closest')},
{R('arg_max(v, row(-ping_seq, sample_idx))', 'oldest')}, {R('arg_max(v, row(ping_seq, sample_idx))', 'newest')}
FROM n GROUP BY mission_id, cx, cy"""))
def mosaic_scatter(spark, d):
    """Mosaic of raw ping samples, nearest cell only."""
    cells = grid.mosaic(grid.project_samples(tables.merged_pings(spark, d)), Mosaic(bilinear=False))
    return cells.select("mission_id", "cx", "cy", "count", *[r6(c) for c in ("sum", "closest", "oldest", "newest")])
