"""Ordered passes: the sliced way must equal the whole-mission way."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomgrid.config import Pairing, Tracking
from fathomgrid.operators import ordered as O
from fathomgrid.operators import sequential as S

MS = 1_000_000


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    data = [(0 if rng.random() < 0.6 else rng.randrange(1, 4), float(rng.randrange(400)), i,
             None if rng.random() < 0.5 else rng.randrange(100)) for i in range(600)]
    return spark.createDataFrame(data, "mission_id long, t double, seq long, v long").cache()


def as_set(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=repr)


def test_sliced_scan_equals_plain_windows(rows):
    looks = {"p": O.previous(F.col("v")), "l": O.latest(F.col("v")), "u": O.upcoming(F.col("v")),
             "r": O.running(F.col("v")), "n": O.position()}
    cut = O.Slices("t", 23.0)
    assert as_set(O.scan(rows, looks, slices=cut)) == as_set(O.scan(rows, looks, slices=O.Slices("t")))


def test_newest_and_percentiles(rows):
    got = {}
    for r in O.newest(rows, 5).collect():
        got.setdefault(r.mission_id, []).append((r.t, r.seq))
    everything = {}
    for r in rows.collect():
        everything.setdefault(r.mission_id, []).append(r)
    for m, rs in everything.items():
        assert sorted(got[m]) == sorted((r.t, r.seq) for r in rs)[-5:]
    for accuracy in (10_000, 40):  # brackets of single values, and of several
        for r in O.exact_percentiles(rows, "v", [0.0, 0.02, 0.5, 0.98, 1.0], accuracy=accuracy).collect():
            want = np.percentile([x.v for x in everything[r.mission_id] if x.v is not None], [0, 2, 50, 98, 100])
            assert np.allclose(r.q, want)


def greedy(p, s, tol):
    p, s, out = list(p), list(s), []
    while p and s:
        d = p[0] - s[0]
        if abs(d) <= tol:
            out.append((p.pop(0), s.pop(0)))
        elif d > 0:
            s.pop(0)
        else:
            p.pop(0)
    return out


def ping_rows(spark, port, stbd, mission=1):
    data = [(mission, "port", ms * MS, i) for i, ms in enumerate(port)]
    data += [(mission, "stbd", ms * MS, i) for i, ms in enumerate(stbd)]
    return spark.createDataFrame(data, "mission_id long, side string, stamp_ns long, seq long")


def pairs_of(df):
    return sorted((r.port_ns // MS, r.stbd_ns // MS) for r in df.collect())


def test_pairing_worked_case(spark):
    assert pairs_of(S.pair_pings(ping_rows(spark, [0, 20, 100], [40, 45, 200]))) == [(0, 40), (20, 45)]


@pytest.mark.parametrize("seed", range(4))
def test_pairing_sliced_equals_queue(spark, seed):
    rng = random.Random(seed)
    if seed == 0:  # regular interleave: the phase is never forgotten
        port, stbd = list(range(0, 4000, 40)), list(range(20, 4000, 40))
        port.remove(120)
    else:
        port = sorted(rng.sample(range(5000), 120))
        stbd = sorted(rng.sample(range(5000), 120))
    tol = 50
    df = ping_rows(spark, port, stbd)
    want = sorted(greedy(port, stbd, tol))
    for size in (7, 25):
        cut = O.Slices("stamp_ns", size * 20.0 * MS)
        got = pairs_of(S.pair_pings(df, Pairing(tolerance_ns=tol * MS), slices=cut))
        assert got == want
    assert pairs_of(S.pair_pings(df, slices=O.Slices("stamp_ns"))) == want


@pytest.mark.parametrize("step", [100, 7])
def test_throttle_sliced_equals_sequential(spark, step):
    rng = random.Random(step)
    times = list(range(0, 12000, 100)) if step == 100 else sorted(rng.choices(range(3000), k=300))
    df = spark.createDataFrame([(1, t * MS, i) for i, t in enumerate(times)], "mission_id long, stamp_ns long, seq long")
    kept, last = [], None
    for i, t in enumerate(times):
        if last is None or t - last >= 200:
            kept.append(i)
            last = t
    for cut in (O.Slices("stamp_ns"), O.Slices("stamp_ns", 700.0 * MS)):
        got = sorted(r.seq for r in S.throttle(df, 200 * MS, slices=cut).collect())
        assert got == kept


def test_throttle_worked_case(spark):
    df = spark.createDataFrame([(1, t * MS, i) for i, t in enumerate([0, 100, 250, 400, 450])],
                               "mission_id long, stamp_ns long, seq long")
    assert sorted(r.stamp_ns // MS for r in S.throttle(df, 200 * MS).collect()) == [0, 250, 450]


def test_altitude_worked_case(spark):
    port = [5.0] * 10 + [6.5, 5.5] + [None] * 15
    df = spark.createDataFrame([(1, i, v, None) for i, v in enumerate(port)],
                               "mission_id long, seq long, port_fbr double, stbd_fbr double")
    got = S.fuse_altitude(S.track_altitude(df)).orderBy("seq").collect()
    assert [r.port_alt for r in got] == [None] * 9 + [5.0, 5.0, 5.5] + [5.5] * 14 + [None]
    assert [r.altitude for r in got] == [None] * 9 + [5.0, 5.0] + [5.5] * 16
    assert all(r.stbd_alt is None for r in got)


def test_altitude_sliced_equals_sequential(spark):
    rng = random.Random(3)
    data = []
    for m in range(3):
        level = 5.0
        for i in range(400):
            level += rng.uniform(-0.2, 0.2)
            def hit():
                u = rng.random()
                return None if u < 0.25 else level + rng.uniform(-1.5, 1.5) if u < 0.4 else level + rng.uniform(-0.1, 0.1)
            data.append((m, i, hit(), hit()))
    df = spark.createDataFrame(data, "mission_id long, seq long, port_fbr double, stbd_fbr double").cache()
    params = Tracking(bootstrap_pings=3, agreement_m=0.4, outlier_m=1.0, relock_after=4)
    cut = O.Slices("seq", 33.0)
    assert as_set(S.track_altitude(df, params, slices=cut)) == as_set(S.track_altitude(df, params, slices=O.Slices("seq")))


def test_altitude_lock_is_the_row_by_row_rule():
    """Runs from saved states, cut anywhere, against the rule taken one row at a time."""
    def plain(values, p):
        out, altitude, streak, recent = [], None, 0, []
        for v in values:
            if altitude is None:
                streak = streak + 1 if v != v else 0
                recent = recent + [v] if v == v else [] if streak >= p.relock_after else recent
                last = recent[-p.bootstrap_pings:]
                if v == v and len(last) == p.bootstrap_pings and max(last) - min(last) <= p.agreement_m:
                    altitude = sum(last) / len(last)
            else:
                near = v == v and abs(v - altitude) <= p.outlier_m
                altitude, streak = (v, 0) if near else (altitude, streak + 1)
                if streak >= p.relock_after:
                    altitude, streak, recent = None, 0, []
            out.append(np.nan if altitude is None else altitude)
        return np.array(out)

    rng = random.Random(1)
    for _ in range(1500):
        p = Tracking(rng.choice([1, 2, 3, 4]), rng.choice([0.2, 0.4, 1]), rng.choice([0.1, 0.5, 1.0]), rng.choice([1, 2, 4, 5]))
        level, values = 5.0, []
        for _ in range(rng.randrange(60)):
            level += rng.uniform(-0.3, 0.3)
            u = rng.random()
            values.append(np.nan if u < 0.3 else level + rng.uniform(-2, 2) if u < 0.45 else level + rng.uniform(-0.1, 0.1))
        got, state, i = [np.zeros(0)], [], 0
        while i < len(values):
            k = rng.randrange(1, 20)
            part, state = S.lock_altitude(np.array(values[i:i + k]), p, state)
            got.append(part)
            i += k
        assert np.allclose(np.concatenate(got), plain(values, p), rtol=0, atol=1e-9, equal_nan=True)


def test_altitude_of_a_silent_side_settles_in_few_rounds(spark, monkeypatch):
    rounds = []
    stored = S.checkpointed
    monkeypatch.setattr(S, "checkpointed", lambda df: rounds.append(1) or stored(df))
    level = [5.0 + 0.01 * (i % 7) for i in range(600)]
    df = spark.createDataFrame([(1, i, v, None) for i, v in enumerate(level)], "mission_id long, seq long, port_fbr double, stbd_fbr double")
    got = S.track_altitude(df, slices=O.Slices("seq", 50.0)).orderBy("seq").collect()
    assert [r.port_alt for r in got[9:]] == [pytest.approx(v, abs=0.05) for v in level[9:]] and all(r.stbd_alt is None for r in got)
    assert len(rounds) <= 2 * 3  # two stores a round, over 12 slices
