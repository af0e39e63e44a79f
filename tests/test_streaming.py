"""Streaming operators give the rows of their batch forms."""

import random

import pytest
from pyspark.sql import functions as F

from fathomgrid.config import Mosaic, Seabed, Tracking
from fathomgrid.operators import imaging, mosaic, sequential
from fathomgrid.streaming import live, stateful

MS = 1_000_000


@pytest.fixture(scope="module", autouse=True)
def store(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    stateful.use_rocksdb(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def streamed(spark, df, order, tmp_path, pieces=3):
    """`df` as a stream of files, one micro-batch each, cut along `order`."""
    folder = str(tmp_path / "in")
    cuts = df.approxQuantile(order, [i / pieces for i in range(1, pieces)], 0.0) if pieces > 1 else []
    for i, (lo, hi) in enumerate(zip([float("-inf"), *cuts], [*cuts, float("inf")])):
        df.filter((F.col(order) >= lo) & (F.col(order) < hi)).coalesce(1).write.mode("append").parquet(f"{folder}")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def drain(df, tmp_path, mode="append"):
    name = "out" + tmp_path.name.replace("-", "_")
    q = (df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp"))
         .trigger(availableNow=True).start())
    q.awaitTermination(300)
    return df.sparkSession.table(name)


def rows(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=repr)


def test_pairing(spark, tmp_path):
    rng = random.Random(1)
    data = [(m, side, t * MS, i) for m in range(2) for side in ("port", "stbd")
            for i, t in enumerate(sorted(rng.sample(range(4000), 60)))]
    df = spark.createDataFrame(data, "mission_id long, side string, stamp_ns long, seq long")
    got = drain(stateful.pair_pings(streamed(spark, df, "stamp_ns", tmp_path)), tmp_path)
    assert rows(got) == rows(sequential.pair_pings(df))


def test_altitude_and_throttle(spark, tmp_path):
    rng = random.Random(2)
    data = [(m, i, i * 70 * MS, *[None if rng.random() < 0.2 else 5 + rng.uniform(-0.5, 0.5) for _ in range(2)])
            for m in range(2) for i in range(120)]
    df = spark.createDataFrame(data, "mission_id long, seq long, stamp_ns long, port_fbr double, stbd_fbr double")
    params = Tracking(bootstrap_pings=3, relock_after=3)
    source = streamed(spark, df, "seq", tmp_path)
    got = drain(stateful.track_altitude(source, params), tmp_path)
    assert rows(got) == rows(sequential.fuse_altitude(sequential.track_altitude(df, params)))


def test_throttle(spark, tmp_path):
    df = spark.range(100).select(F.lit(1).cast("long").alias("mission_id"), F.col("id").alias("seq"), (F.col("id") * 70 * MS).alias("stamp_ns"))
    got = drain(stateful.throttle(streamed(spark, df, "stamp_ns", tmp_path), 200 * MS), tmp_path)
    assert rows(got) == rows(sequential.throttle(df, 200 * MS))


def test_images(spark, tmp_path):
    n = 45
    df = spark.range(n).select(F.lit(1).cast("long").alias("mission_id"), F.col("id").alias("seq"), F.col("id").cast("double").alias("t"), F.lit(False).alias("end"))
    last = df.filter(f"seq = {n - 1}").select("mission_id", (F.col("seq") + 1).alias("seq"), (F.col("t") + 1).alias("t"), F.lit(True).alias("end"))
    params = Seabed(rows=16, stride=8)
    got = drain(stateful.image_members(streamed(spark, df.union(last), "t", tmp_path), params), tmp_path)
    want = imaging.image_members(df.drop("end"), params).select("mission_id", "image_id", F.col("row_no").cast("long").alias("row_no"), "seq")
    assert rows(got.select("mission_id", "image_id", "row_no", "seq")) == rows(want)


def test_pose_snap_prefers_the_earlier(spark, tmp_path):
    poses = spark.createDataFrame([(1, 0, 1.0, 0.0, 0.0), (1, 100, 2.0, 0.0, 0.0)], "mission_id long, stamp_ns long, x double, y double, yaw double")
    data = poses.select("*", F.lit(None).cast("long").alias("port_seq")).union(
        spark.createDataFrame([(1, 50, None, None, None, 7)], "mission_id long, stamp_ns long, x double, y double, yaw double, port_seq long"))
    source = streamed(spark, data, "stamp_ns", tmp_path, pieces=1)
    pairs = source.filter("port_seq is not null").select("mission_id", F.col("stamp_ns").alias("port_ns"), "port_seq", F.col("port_seq").alias("stbd_seq"))
    got = drain(stateful.snap_poses(pairs, source.filter("port_seq is null")), tmp_path).collect()
    assert [(r.port_seq, r.x) for r in got] == [(7, 1.0)]


def test_states_fall_back_to_gps(spark, tmp_path):
    nan = float("nan")
    data = [(1, "odom", 0.0, 0, 5.0, 6.0, 0.0, 1.0, nan, nan, nan), (1, "odom", 0.1, 1, 5.0, 6.0, 0.0, 1.0, nan, nan, nan),
            (1, "gps", 1.0, 2, nan, nan, nan, nan, 43.0, 7.0, nan), (1, "compass", 1.5, 3, nan, nan, nan, nan, nan, nan, 90.0),
            (1, "gps", 3.0, 4, nan, nan, nan, nan, 43.0001, 7.0, nan), (1, "odom", 4.0, 5, 0.0, 0.0, 0.0, 1.0, nan, nan, nan),
            (1, "gps", 4.5, 6, nan, nan, nan, nan, 43.0002, 7.0, nan)]
    df = spark.createDataFrame(data, "mission_id long, kind string, t double, seq long, x double, y double, yaw double, speed double, lat double, lon double, compass_deg double")
    got = drain(stateful.robot_states(streamed(spark, df, "t", tmp_path, 2)), tmp_path).orderBy("t").collect()
    assert [(r.seq, r.source) for r in got] == [(0, "odom"), (4, "gps"), (6, "gps")]
    assert abs(got[1].y - 11.1319) < 1e-3 and got[1].heading_deg == 90.0


def test_live_mosaic_ends_at_the_batch_mosaic(spark, tmp_path):
    rng = random.Random(5)
    data = [(1, i // 20, i % 20, rng.uniform(0, 4), rng.uniform(0, 4), rng.uniform(-60, -20), rng.uniform(0, 9)) for i in range(300)]
    df = spark.createDataFrame(data, "mission_id long, ping_seq long, sample_idx int, x double, y double, v double, rng double")
    out = drain(live.live_mosaic(streamed(spark, df, "ping_seq", tmp_path), Mosaic(bilinear=False)), tmp_path, "update")
    last = out.groupBy("mission_id", "cx", "cy").agg(F.max_by(F.struct("newest", "oldest", "closest"), "count").alias("p"), F.max("count").alias("count"))
    want = mosaic.mosaic(df, Mosaic(bilinear=False)).select("mission_id", "cx", "cy", F.struct("newest", "oldest", "closest").alias("p"), "count")
    assert rows(last) == rows(want)


def test_time_windows_and_dedupe(spark, tmp_path):
    df = spark.range(20).select(F.lit(1).cast("long").alias("mission_id"), F.lit("port").alias("side"), F.floor(F.col("id") / 2).alias("ping_number"),
                                F.timestamp_seconds(1000 + F.floor(F.col("id") / 2)).alias("ts"), F.lit("a").alias("topic"), F.col("id").alias("k"))
    once = drain(stateful.dedupe(streamed(spark, df, "k", tmp_path), "5 seconds"), tmp_path)
    assert once.count() == 10


def test_rates_and_sessions(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", float(t)) for t in (0, 0.5, 1, 9, 9.2, 30)], "mission_id long, topic string, t double").withColumn("ts", F.timestamp_seconds("t")).withColumn("water_depth", F.col("t"))
    source = streamed(spark, df, "t", tmp_path, 1)
    got = drain(live.rates(source, "5 seconds"), tmp_path, "update")
    assert sorted(r.messages for r in got.collect()) == [1, 1, 2, 2]
    runs = live.activity(df, "5 seconds").select("states").collect()
    assert sorted(r.states for r in runs) == [1, 2, 3]
    assert live.gate(df, spark.createDataFrame([(1, 1.0, 9.0)], "mission_id long, started double, ended double")).count() == 2


def test_states_do_not_depend_on_micro_batches(spark, tmp_path):
    rng, nan = random.Random(7), float("nan")
    data = []
    for i in range(160):
        t, kind = i * 0.15, rng.choice(["odom", "gps", "compass", "vfr"] if i < 60 else ["gps", "compass", "odom" if i > 110 else "gps"])
        x = 0.0 if rng.random() < 0.5 else rng.uniform(1, 5)
        data.append((1, kind, t, i, x, x, 0.3, rng.choice([1.0, nan]), 43 + i * 1e-5, 7.0, rng.choice([10.0, nan, 400.0])))
    df = spark.createDataFrame(data, "mission_id long, kind string, t double, seq long, x double, y double, yaw double, speed double, lat double, lon double, compass_deg double")
    (tmp_path / "a").mkdir(), (tmp_path / "b").mkdir()
    whole = rows(drain(stateful.robot_states(streamed(spark, df, "t", tmp_path / "a", 1)), tmp_path / "a"))
    assert rows(drain(stateful.robot_states(streamed(spark, df, "t", tmp_path / "b", 4)), tmp_path / "b")) == whole and len(whole) > 40
