"""Survey tables derived from the given parquet tables.

`embeddings` rows stand for one-side pings, `events` for ordered telemetry, detections and typed
messages, `lineitem` rows for geo-referenced samples and `orders` for recording sessions. The
derivations are deterministic projections, so work grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathomgrid.config import Bottom, Geometry
from fathomgrid.functions import acoustics

#: The pings have 64 samples, fewer than the default search needs.
SHORT_BOTTOM = Bottom(noise_window=8, threshold_db=2.0, persistence=2, ringing_search=20,
                      ringing_drop_db=3.0, ringing_persistence=3, ringing_fallback=8)
ALTITUDE_M = 5.0


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_us(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a timestamp column, whatever the session time zone."""
    if df.schema[name].dataType.typeName() == "timestamp_ntz":
        since = F.expr(f"CAST(CAST({name} - TIMESTAMP_NTZ'1970-01-01 00:00:00' AS INTERVAL SECOND) AS DECIMAL(18, 6))")
        return (since * 1_000_000).cast("long")
    return F.unix_micros(name)


def side_pings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw one-side pings with sparse and dense stamps and a pose."""
    v = F.col("vec_id")
    no = F.floor(v / 2)
    return read(spark, sf_dir, "embeddings").select(
        (no % 5).alias("mission_id"), F.when(v % 2 == 0, "port").otherwise("stbd").alias("side"),
        no.alias("ping_no"), v.alias("vec_id"),
        F.transform("embedding", lambda e: F.floor((e.cast("double") + 1.0) * 32767.5).cast("int")).alias("pwr"),
        F.lit(-80.0).alias("min_db"), F.lit(0.0).alias("max_db"), F.lit(0).cast("long").alias("start_mm"),
        F.lit(30000).cast("long").alias("length_mm"), F.lit(64).alias("num_results"),
        ((no * 100 + (v % 2) * 7 * (no % 10)) * 1_000_000).alias("sparse_ns"),
        ((v * 20 + (v * v) % 13) * 1_000_000).alias("dense_ns"))


def scaled_pings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return side_pings(spark, sf_dir).withColumn("db", acoustics.scale_db(F.col("pwr"), F.col("min_db"), F.col("max_db")))


def bottom_pings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scaled pings with `settle` and `slant_m`."""
    found = acoustics.bottom_return(F.col("db"), F.col("start_mm"), F.col("length_mm"), F.col("num_results"), SHORT_BOTTOM)
    return scaled_pings(spark, sf_dir).withColumn("_b", found).select("*", "_b.settle", "_b.slant_m").drop("_b")


def side_ground(spark: SparkSession, sf_dir: str, geometry: Geometry = Geometry()) -> DataFrame:
    """Slant-corrected sides at a fixed altitude, `ground` as array<struct<y, v>>, with a pose."""
    port = F.col("side") == "port"
    ground = acoustics.ground_samples(
        F.col("db"), F.col("start_mm"), F.col("length_mm"), F.col("num_results"), F.lit(ALTITUDE_M),
        F.when(port, geometry.y_port_m).otherwise(geometry.y_stbd_m), F.when(port, 1.0).otherwise(-1.0))
    no = F.col("ping_no")
    return scaled_pings(spark, sf_dir).select(
        "mission_id", "side", "ping_no", "num_results", ground.alias("ground"),
        (no * 0.05).alias("robot_x"), ((no % 7) * 0.1).alias("robot_y"), (no * 0.01).alias("yaw"))


def merged_pings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Port and starboard merged, port samples first: one `sonar_ping` row per ping number."""
    def side(name):
        return F.max(F.when(F.col("side") == name, F.col("ground")))
    both = side_ground(spark, sf_dir).groupBy("mission_id", "ping_no").agg(
        side("port").alias("p"), side("stbd").alias("s"), F.first("robot_x").alias("robot_x"),
        F.first("robot_y").alias("robot_y"), F.first("yaw").alias("yaw"))
    samples = F.concat("p", "s")
    return both.select(
        "mission_id", F.col("ping_no").alias("seq"), (F.col("ping_no") * 0.1).alias("t"), "robot_x", "robot_y", "yaw",
        (F.lit(ALTITUDE_M) + (F.col("ping_no") % 5) * 0.1).alias("water_depth"),
        F.transform(samples, lambda e: e["y"]).alias("y_local"), F.transform(samples, lambda e: e["v"]).alias("intensity_db"))


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered telemetry."""
    events = read(spark, sf_dir, "events")
    e, u, value = F.col("event_id"), F.col("user_id"), F.col("value")
    us = epoch_us(events, "ts")
    return events.select(
        (u % 10).alias("mission_id"), e.alias("seq"), us.alias("us"), (us / 1e6).alias("t"), u.alias("user_id"),
        "event_type", "value", (value * 0.1).alias("x"), ((u % 50) * 0.5).alias("y"), ((e % 628) * 0.01).alias("yaw"),
        ((e * 7) % 360).cast("double").alias("compass_deg"), (43.69 + value * 1e-5).alias("lat"), (7.30 + u * 1e-5).alias("lon"),
        F.when(F.col("event_type") != "error", F.floor(e / 3)).alias("time_boot_ms"))


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("seq")
    name = F.element_at(F.array(*map(F.lit, ("tire", "block", "chain", "pipe"))), (e % 4 + 1).cast("int"))
    return states(spark, sf_dir).filter("event_type = 'purchase'").select(
        "mission_id", "seq", "t", F.col("user_id").alias("uid"), "x", "y", name.alias("class_name"),
        F.least(F.lit(1.0), F.col("value") / 500).alias("confidence"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Geo-referenced samples of three missions."""
    inside = Window.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate", "l_discount", "l_tax")
    return read(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") % 3).alias("mission_id"), (F.col("l_partkey") * 0.05).alias("x"), (F.col("l_suppkey") * 0.3).alias("y"),
        (-60.0 + F.col("l_extendedprice") / 2500.0).alias("v"), F.col("l_quantity").cast("double").alias("rng"),
        F.col("l_orderkey").alias("ping_seq"), F.row_number().over(inside).alias("sample_idx"))
