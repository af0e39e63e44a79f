"""Queries over detections."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathomgrid.operators import detections as ops
from fathomgrid.plans import tables
from fathomgrid.plans.catalog import DETECTIONS, R, query, r6, with_
from fathomgrid.sources import messages


@query(with_(DETECTIONS + ", f AS (SELECT mission_id, uid, arg_min(class_name, row(us, seq)) AS class_name FROM d GROUP BY ALL)",
             "SELECT mission_id, class_name, count(*) AS detections FROM f GROUP BY ALL ORDER BY mission_id, class_name"))
def detection_counts(spark, d):
    return ops.class_counts(tables.detections(spark, d)).orderBy("mission_id", "class_name")


@query(with_(DETECTIONS, f"""SELECT mission_id, uid, max(seq) AS seq, arg_max(class_name, row(us, seq)) AS class_name,
{R('arg_max(x, row(us, seq))', 'x')}, {R('arg_max(confidence, row(us, seq))', 'confidence')} FROM d GROUP BY mission_id, uid"""))
def detection_latest(spark, d):
    out = ops.latest_detections(tables.detections(spark, d))
    return out.select("mission_id", "uid", "seq", "class_name", r6("x"), r6("confidence"))


@query(with_(DETECTIONS + ", r AS (SELECT *, row_number() OVER (PARTITION BY mission_id ORDER BY us DESC, seq DESC) AS k FROM d)",
             "SELECT mission_id, seq FROM r WHERE k <= 500"))
def detections_newest(spark, d):
    return ops.newest_detections(tables.detections(spark, d)).select("mission_id", "seq")


@query(with_(DETECTIONS + """,
v AS (SELECT *, row_number() OVER (PARTITION BY mission_id ORDER BY us, seq) - 1 AS row, 20e0 AS r FROM e WHERE event_type = 'view'),
j AS (SELECT d.mission_id, d.seq, d.x, d.y, d.t, v.x AS rx, v.y AS ry, v.yaw, v.row, v.r FROM d ASOF JOIN v ON d.mission_id = v.mission_id AND d.us <= v.us),
s AS (SELECT mission_id, min(t) AS t0 FROM v GROUP BY mission_id),
k AS (SELECT j.*, (y - ry) * cos(yaw) - (x - rx) * sin(yaw) AS yl FROM j JOIN s USING (mission_id) WHERE j.t >= t0)""",
             """SELECT seq, row, CAST(greatest(0, least(799, round_even((r - yl) / (2 * r) * 799, 0))) AS INTEGER) AS col FROM k WHERE abs(yl) <= r * 1.02e0"""))
def detection_rowcol(spark, d):
    rows = tables.states(spark, d).filter("event_type = 'view'").select(
        "mission_id", "t", "seq", F.col("x").alias("robot_x"), F.col("y").alias("robot_y"), "yaw", F.lit(20.0).alias("range_m"))
    return ops.on_waterfall(tables.detections(spark, d), rows).select("seq", "row", "col")


@query(with_(DETECTIONS, f"""SELECT seq, CAST(0 AS INTEGER) AS detection_no,
CASE WHEN uid % 4 <> 0 THEN uid ELSE CAST('0x' || substr(md5('d' || uid), 1, 8) AS BIGINT) & 2147483647 END AS uid, {R('x')}, {R('y')},
CASE WHEN seq % 3 = 0 THEN 'object' ELSE class_name END AS class_name, {R('confidence')}, {R('greatest(x * 0.05e0, 0.5e0)', 'extent_m')}
FROM d WHERE seq % 2 = 0"""))
def detection_ingest(spark, d):
    """Messages with one detection with results and one without; ids that are numbers become uids, others are hashed."""
    results = F.when(F.col("seq") % 2 == 0, F.array(F.struct(
        F.when(F.col("seq") % 3 == 0, "").otherwise(F.col("class_name")).alias("class_id"), F.col("confidence").alias("score"))))

    def one(found):
        return F.struct(F.when(F.col("uid") % 4 == 0, F.concat(F.lit("d"), F.col("uid"))).otherwise(F.col("uid").cast("string")).alias("id"),
                        "x", "y", (F.col("x") * 0.05).alias("size_x"), found.alias("results"))
    empty = F.array().cast("array<struct<class_id:string,score:double>>")
    rows = tables.detections(spark, d).select("mission_id", "t", "seq", F.col("uid").alias("plain_uid"),
                                              F.array(one(F.coalesce(results, empty)), one(empty)).alias("detections"))
    out = messages.detections(rows)
    return out.select("seq", "detection_no", "uid", r6("x"), r6("y"), "class_name", r6("confidence"), r6("extent_m"))
