"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
import check

SF = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return check.oracle(SF)


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    result = check.compare(spark, con, name, SF)
    assert not result.startswith("FAIL"), result


ORDERED = (
    "burst_clock", "track_segments", "frozen_pose", "gps_reckon", "nearest_pose", "robot_states", "odom_synthesis", "pinger_world",
    "live_distance", "pose_restamp_auto", "throttle", "replay_origin", "sequence_numbers", "fallback_states", "rolling_depth",
    "detection_rowcol", "pair_pings_sparse", "pair_pings_dense", "altitude_fused", "ping_speed", "image_windows", "contrast_limits",
    "log_counts", "ned_envelopes", "sonar_pings")


@pytest.mark.parametrize("name", ORDERED)
def test_query_in_other_slices(spark, con, name, monkeypatch):
    """The same rows when slices are cut elsewhere, and narrower."""
    from fathomgrid.operators.ordered import Slices

    whole = Slices.fit.__func__
    monkeypatch.setattr(Slices, "fit", classmethod(lambda cls, column: Slices(column, whole(cls, column).width / 37)))
    result = check.compare(spark, con, name, SF)
    assert not result.startswith("FAIL"), result
