"""Recorded logs: framing, decoding, the replay chain and stored results."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomgrid.config import Config, Display, Seabed, Tracking
from fathomgrid.functions.attitude import flatten_odometry
from fathomgrid.operators import imaging, missions, mosaic, raster
from fathomgrid.operators import telemetry as tel
from fathomgrid.plans import processing
from fathomgrid.sinks import files
from fathomgrid.sources import framing, logs, messages


def frame(packet_id, src, payload, checksum=None):
    head = b"BR" + len(payload).to_bytes(2, "little") + packet_id.to_bytes(2, "little") + bytes([src, 0]) + payload
    return head + ((sum(head) & 0xFFFF) if checksum is None else checksum).to_bytes(2, "little")


def profile(number, samples, lo=-60.0, hi=0.0, length=9900):
    head = np.zeros(1, logs.PROFILE_HEAD)
    for k, v in dict(ping_number=number, length_mm=length, num_results=len(samples), max_pwr_db=hi, min_pwr_db=lo).items():
        head[k] = v
    return head.tobytes() + np.asarray(samples, "<u2").tobytes()


def message(kind, boot=None, **values):
    return json.dumps({"header": {}, "message": {"type": kind, "time_boot_ms": boot, **values}}).encode()


def test_walk_skips_junk_and_stops_at_a_cut_frame(spark):
    good = frame(150, 0, b"{}")
    data = b"xxB" + good + b"junk" + frame(7, 3, b"abc", checksum=1) + frame(150, 0, b"long payload")[:-4]
    df = spark.createDataFrame([("m", data)], "mission_id string, content binary")
    got = logs.packets(df).orderBy("seq").collect()
    assert [(r.seq, r.offset, r.packet_id, r.src, bytes(r.payload), r.checksum_ok) for r in got] == [
        (0, 3, 150, 0, b"{}", True), (1, 3 + len(good) + 4, 7, 3, b"abc", False)]


def test_ranges_equal_the_plain_walk(spark):
    """Random bytes full of marks, and real frames with junk: any split gives the walk from the start."""
    rng = np.random.default_rng(8)
    blobs = [b"", b"B", b"BR", b"BRBRBRBRBR", frame(1, 2, b"") * 50]
    for i in range(30):
        noise = rng.choice(np.frombuffer(b"BBRR\x00\x01\x02\x05", np.uint8), int(rng.integers(1, 4000))).tobytes()
        real = b"".join(frame(int(rng.integers(9)), int(rng.integers(3)), rng.choice(np.frombuffer(b"BRxy", np.uint8), int(rng.integers(0, 300))).tobytes(),
                              checksum=None if rng.random() < 0.8 else 7) + (b"BR" if rng.random() < 0.02 else b"junkB" * int(rng.integers(0, 3))) for _ in range(60))
        blobs.append(noise if i % 3 == 0 else real if i % 3 == 1 else real[:-3])
    df = spark.createDataFrame([("same" if i < 9 else str(i), b) for i, b in enumerate(blobs)] + [("none", None)], "mission_id string, content binary")
    want = []
    for i, data in enumerate(blobs):
        for seq, (at, size) in enumerate(framing.walk(data)):
            end = at + 8 + size
            want.append(("same" if i < 9 else str(i), seq, at, int.from_bytes(data[at + 4:at + 6], "little"), data[at + 6], data[at + 7], data[at + 8:end],
                         int.from_bytes(data[end:end + 2], "little"), sum(data[at:end]) & 0xFFFF == int.from_bytes(data[end:end + 2], "little")))
    assert len(want) > 600 and {w[-1] for w in want} == {True, False}
    for width in (1 << 20, 2500, 97):
        got = [(*r[:6], bytes(r.payload), *r[7:]) for r in logs.packets(df, range_bytes=width).collect()]
        assert sorted(got) == sorted(want)
    assert logs.packets(df.limit(0)).count() == 0


def test_frames_longer_than_ranges(spark):
    data = frame(1, 0, b"BR" * 30_000) + b"BR\x00" + frame(2, 0, b"x" * 65_535) + frame(3, 0, b"")
    df = spark.createDataFrame([("m", data)], "mission_id string, content binary")
    for width in (10_000, 70_000):
        got = logs.packets(df, range_bytes=width).orderBy("seq").collect()
        assert [(r.offset, len(r.payload)) for r in got] == list(framing.walk(data))


@pytest.fixture(scope="module")
def recording(tmp_path_factory):
    """A boat moving east at 1 m/s: bottom at 6 m on both sides, one odometry pair per ping pair."""
    root = tmp_path_factory.mktemp("logs")
    level = lambda db: int((db + 60) / 60 * 65535)
    samples = [level(-5)] * 10 + [level(-50)] * 50 + [level(-20)] * 40
    out = [frame(2198, 1, profile(0, samples)), frame(2198, 2, profile(0, samples))]  # before any pose
    for i in range(40):
        out.append(frame(150, 0, message("ATTITUDE", 1000 + i, roll=0.0, pitch=0.0, yaw=np.pi / 2)))
        out.append(frame(150, 0, message("LOCAL_POSITION_NED", 1000 + i, x=0.0, y=float(i), z=0.0, vx=0.0, vy=1.0, vz=0.0)))
        if i == 5:
            out.append(frame(150, 0, message("GLOBAL_POSITION_INT", 1000 + i, lat=436900000, lon=73000000)))
        out.append(frame(2198, 1, profile(i + 1, samples)))
        out.append(frame(2198, 2, profile(i + 1, samples)))
    out.append(frame(150, 0, b"\xff\xfe"))
    out.append(frame(2198, 1, b"short"))
    out.append(frame(2198, 9, profile(1, samples)))
    (root / "run_1.svlog").write_bytes(b"".join(out))
    (root / "notes.txt").write_text("not a log")
    return str(root)


def test_counts(spark, recording):
    got = {r.category: r.packets for r in logs.ingest_counts(logs.read_logs(spark, recording)).collect()}
    assert got == {"sonar_port": 41, "sonar_stbd": 41, "imu": 40, "local_pose": 40, "local_velocity": 40, "navsat": 1, "rel_alt": 1,
                   "compass_hdg": 1, "odom_synthesized": 79, "decode_errors": 2, "skipped_non_target": 1}
    assert [r.path.endswith("run_1.svlog") for r in logs.log_files(spark, recording).collect()] == [True]


def test_replay_and_artefacts(spark, recording, tmp_path):
    packets = logs.read_logs(spark, recording).cache()
    config = Config(tracking=Tracking(bootstrap_pings=10))
    pings, states = (df.cache() for df in processing.replay(packets, config))
    rows = pings.orderBy("t").collect()
    # 40 posed pairs, the first nine find no altitude yet
    assert len(rows) == 31 and rows[0].mission_id == "run_1"
    assert all(r.water_depth == pytest.approx(6.0, abs=0.05) for r in rows)
    assert [r.robot_x for r in rows] == [float(i) for i in range(9, 40)]
    assert all(r.robot_y == 0 and abs(r.yaw) < 1e-9 for r in rows)
    assert rows[0].y_local[0] > 0 > rows[0].y_local[-1]
    boat = states.orderBy("t").collect()
    assert boat[0].t == 0.0 and all(b.t - a.t >= 0.2 - 1e-9 for a, b in zip(boat, boat[1:]))
    assert [r.lat is None for r in boat[:2]] == [True, True] and boat[-1].lat == pytest.approx(43.69)
    assert boat[0].speed_mps == 1.0 and boat[0].heading_deg == pytest.approx(90.0)

    cells = mosaic.merge_cells(raster.densify(raster.with_previous(pings)))
    files.write_mosaic(cells, str(tmp_path / "mosaic"))
    stored = messages.read_mosaic(spark, str(tmp_path / "mosaic"))
    assert stored.count() == cells.count() and stored.filter("mission_id = 'run_1'").count() == cells.count()
    files.write_trajectory(pings, str(tmp_path / "trajectory"))
    back = messages.read_trajectory(spark, str(tmp_path / "trajectory"))
    assert back.agg(F.min("t_since_first_s"), F.max("x_m")).first()[:] == (0.0, 39.0)
    files.write_waterfall(pings, str(tmp_path / "waterfall"))
    assert spark.read.parquet(str(tmp_path / "waterfall")).select(F.size("intensity_db")).distinct().first()[0] == 800

    seabed = Seabed(rows=16, stride=8, columns=40)
    prepared = imaging.ping_speed(imaging.usable_pings(pings)).withColumn("intensity", imaging.waterfall_row(F.col("y_local"), F.col("intensity_db"), 40))
    members = imaging.image_members(prepared.drop("y_local", "intensity_db"), seabed)
    found = imaging.detect(members)
    files.write_images(members, str(tmp_path / "images"), 40, found)
    meta = [json.loads(r.metadata) for r in spark.read.parquet(str(tmp_path / "images" / "images")).collect()]
    assert sorted(m["rows"] for m in meta) == [15, 16] or sorted(m["rows"] for m in meta) == [7, 16, 16]
    assert all(len(m["rows_data"]) == m["rows"] and m["rows_data"][0]["t_s"] == m["t_start_s"] and m["pixel_convention"]["row0"] == "oldest ping" for m in meta)
    assert all(m["detections"][0]["class_name"] == "dummy_center" for m in meta)
    assert imaging.detect(members, None).count() == 0
    files.write_topics(logs.topic_rows(packets), str(tmp_path / "topics"))
    assert spark.read.parquet(str(tmp_path / "topics" / "topic=imu")).count() == 40
    assert logs.topics(packets)["imu"].select("angular_velocity.x").count() == 40
    files.write_detections(found.withColumns({"t": F.col("t_s"), "extent_m": F.lit(1.0)}), str(tmp_path / "det"))
    assert (tmp_path / "det").exists()


def test_dropped_pairs_are_counted(spark, recording):
    from pyspark.sql import Observation

    packets = logs.read_logs(spark, recording)
    profiles, telemetry_rows = logs.clocked(packets)
    poses = tel.synthesise_odom(telemetry_rows)
    seen = Observation(), Observation()
    config = processing._locf(Config())
    assert processing.process(profiles, poses, config, dropped=seen).count() == 31
    assert seen[0].get == {"pairs": 41, "unposed": 1} and seen[1].get == {"pings": 40, "unlocked": 9}


def test_session_files(spark):
    log = spark.createDataFrame([("/data/a.svlog", 95), ("/data/b.svlog", 200), ("/data/s/c.svlog", 100)], "path string, mtime long")
    sessions = spark.createDataFrame([("s", "/data/s", 100, 150)], "session_id string, folder string, started long, ended long")
    assert [r.path for r in missions.adopt_files(log, sessions).collect()] == ["/data/a.svlog"]
    counts = spark.createDataFrame([("s", 3, 1, 100.0, 150.0, 50.0)], "session_id string, ping_count long, detection_count long, started_s double, ended_s double, duration_s double")
    row = files.session_metadata(counts, missions.adopt_files(log, sessions), topics={"sonar": "/sonar"}).first()
    assert row.adopted_svlogs == ["a.svlog"] and row.mosaic.cell_size_m == 0.25
    assert row.display_settings_at_end is None and row.topics.sonar == "/sonar"
    shown = files.session_metadata(counts, missions.adopt_files(log, sessions), display=Display(gamma=0.5)).first()
    assert shown.display_settings_at_end.gamma == 0.5 and shown.display_settings_at_end.colormap == "Copper" and shown.topics is None


def test_message_sources(spark):
    q = "named_struct('x', 0d, 'y', 0d, 'z', sin(0.25d), 'w', cos(0.25d))"
    df = spark.sql(f"""select 1 as mission_id, 7 as port_ping_number, 1500000000 as port_stamp_ns, 1d as robot_x, 2d as robot_y, {q} as orientation, 5d as water_depth,
        array(1d, 2d) as port_y, array(-1d) as starboard_y, array(10d, 20d) as port_intensity_db, array(30d) as starboard_intensity_db""")
    row = messages.sonar_pings(df).first()
    assert (row.t, row.y_local, row.intensity_db) == (1.5, [1.0, 2.0, -1.0], [10.0, 20.0, 30.0]) and row.yaw == pytest.approx(0.5)
    v = "named_struct('x', 1d, 'y', 2d, 'z', 3d)"
    odom = spark.sql(f"select named_struct('position', {v}, 'orientation', {q}, 'linear', {v}, 'angular', {v}) as o")
    flat = odom.select(flatten_odometry(F.col("o")).alias("f")).first().f
    assert np.allclose(flat.pose, [1, 2, 3, 0, 0, 0.5]) and list(flat.twist) == [1, 2, 3, 1, 2, 3]


def test_hashed_detection_ids_are_stable(spark):
    df = spark.sql("""select 1 as mission_id, 1 as seq, 2d as t, array(named_struct('id', 'abc', 'x', 1d, 'y', 2d, 'size_x', 0.1d, 'results',
        array(named_struct('class_id', 'tire', 'score', 0.9d))), named_struct('id', '12', 'x', 1d, 'y', 2d, 'size_x', 3d, 'results',
        array(named_struct('class_id', '', 'score', 0.9d)))) as detections""")
    a, b = messages.detections(df).orderBy("detection_no").collect()
    assert 0 <= a.uid <= 0x7FFFFFFF and a.extent_m == 0.5
    assert (b.uid, b.class_name, b.extent_m) == (12, "object", 3.0)


def test_topic_files_do_not_grow_with_the_logs(spark, tmp_path):
    rows = spark.range(0, 2000, 1, 2).selectExpr("id % 500 AS log_id", "id AS seq", "id % 2 AS stamp_ns", "IF(id % 3 = 0, 'imu', 'odom') AS topic", "id AS value")
    files.write_topics(rows, str(tmp_path / "topics"), keys=("log_id",))
    back = spark.read.parquet(str(tmp_path / "topics"))
    assert sorted(map(tuple, back.select(rows.columns).collect())) == sorted(map(tuple, rows.collect()))
    assert len(list((tmp_path / "topics").rglob("*.parquet"))) <= 4


def test_whole_logs_stay_out_of_python(spark, monkeypatch):
    """Contents are joined and cut by Spark; Python sees ranges only."""
    from fathomgrid.plans import log_queries
    from fathomgrid.sources import framing

    plan = log_queries._contents(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "listagg" in plan
    seen = []

    def stored(df, name, **options):
        if name == "log_ranges":
            seen.append(df._jdf.queryExecution().optimizedPlan().toString())
        return df.localCheckpoint()

    monkeypatch.setattr(framing, "written", stored)
    frame = framing.MARK + b"\x02\x00\x07\x00\x01\x00ab" + b"\x00\x00"
    blobs = spark.createDataFrame([(1, None), (2, b""), (3, b"B"), (4, frame * 5), (5, frame * 2 + b"BR")], "mission_id long, content binary")
    for width in (1, 12, 24, 1 << 20):
        got = logs.packets(blobs, range_bytes=width).select("mission_id", "seq", "offset").collect()
        assert sorted(map(tuple, got)) == [(4, i, 12 * i) for i in range(5)] + [(5, i, 12 * i) for i in range(2)]
    assert not any("InArrow" in plan or "Python" in plan for plan in seen)
