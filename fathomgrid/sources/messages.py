"""Message tables: processed pings, telemetry, detections, pinger fixes, planned paths.

Each function maps the raw message columns to a record table and works the same on a batch and on
a streaming DataFrame (Kafka, files): all are projections and filters.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomgrid.functions import attitude, units
from fathomgrid.operators.ordered import MISSION

# Fixed values.
DEFAULT_CLASS = "object"
MIN_EXTENT_M = 0.5
FIX_ACCURACY_M = 2.0
UID_MASK = 0x7FFFFFFF


def fix_valid(status: Column, lat: Column, lon: Column, alt: Column | None = None) -> Column:
    """A GPS fix with a position; with `alt`, also with an altitude."""
    ok = (status >= 0) & ~F.isnan(lat) & ~F.isnan(lon)
    return ok if alt is None else ok & ~F.isnan(alt)


def sonar_pings(messages: DataFrame, keys: Sequence[str] = MISSION) -> DataFrame:
    """Processed ping messages (port/starboard stamps, pose with quaternion, arrays per side) as
    merged pings; time is the port stamp."""
    q = F.col("orientation")
    return messages.select(
        *keys, F.col("port_ping_number").alias("seq"), units.seconds(F.col("port_stamp_ns")).alias("t"), "robot_x", "robot_y",
        attitude.quat_yaw(q["x"], q["y"], q["z"], q["w"]).alias("yaw"), "water_depth",
        F.concat("port_y", "starboard_y").alias("y_local"),
        F.concat("port_intensity_db", "starboard_intensity_db").alias("intensity_db"))


def telemetry_topics(messages: DataFrame, topics: dict[str, str]) -> dict[str, DataFrame]:
    """Split one stacked telemetry stream by `topic`; `topics` maps a name to a topic."""
    return {name: messages.filter(F.col("topic") == topic) for name, topic in topics.items()}


def detections(messages: DataFrame, keys: Sequence[str] = MISSION) -> DataFrame:
    """Detection messages (t, detections[]: id, x, y, size_x, results[]: class_id, score), one row
    per detection that has a result; the first result counts.

    A non-numeric id becomes the first 31 bits after the sign of its MD5, which is stable across runs and engines.
    """
    d = F.col("_d")
    flat = messages.select(*keys, "t", "seq", F.posexplode("detections").alias("_i", "_d")).filter(F.size(d["results"]) > 0)
    best = F.get(d["results"], F.lit(0))
    label = F.when(F.length(d["id"]) > 0, d["id"]).otherwise(F.format_string("det-%s-%d", F.col("t").cast("string"), F.col("_i")))
    hashed = F.conv(F.substring(F.md5(label.cast("binary")), 1, 8), 16, 10).cast("long").bitwiseAND(F.lit(UID_MASK).cast("long"))
    return flat.select(
        *keys, "seq", F.col("_i").alias("detection_no"), F.coalesce(d["id"].try_cast("long"), hashed).alias("uid"), "t",
        d["x"].alias("x"), d["y"].alias("y"),
        F.when(F.length(best["class_id"]) > 0, best["class_id"]).otherwise(DEFAULT_CLASS).alias("class_name"),
        best["score"].alias("confidence"), F.greatest(d["size_x"], F.lit(MIN_EXTENT_M)).alias("extent_m"))


def pinger_fixes(messages: DataFrame, keys: Sequence[str] = MISSION) -> DataFrame:
    """Pinger messages (t, data[]): at least two numbers, neither NaN; further ones are ignored."""
    x, y = F.get("data", F.lit(0)), F.get("data", F.lit(1))
    ok = (F.size("data") >= 2) & ~F.isnan(x) & ~F.isnan(y)
    return messages.filter(F.coalesce(ok, F.lit(False))).select(
        *keys, "seq", "t", x.alias("x"), y.alias("y"), F.lit(FIX_ACCURACY_M).alias("accuracy_m"))


def planned_paths(messages: DataFrame, keys: Sequence[str] = MISSION) -> DataFrame:
    """Path messages (t, poses[]: x, y, ...) with their points."""
    return messages.select(*keys, "seq", "t", F.transform("poses", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("points"))


def read_mosaic(spark: SparkSession, path: str) -> DataFrame:
    """Stored mosaic cells; `mission_id` is a partition column, so filters on it prune files."""
    return spark.read.parquet(path)


def read_trajectory(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("t_since_first_s double, x_m double, y_m double, depth_m double").csv(path, header=True)
