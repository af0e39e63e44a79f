"""As-of joins: both sides are stacked in time order and the wanted neighbour is carried over.

One shuffle of both sides and no range join; a long mission is scanned in time slices.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomgrid.config import Alignment
from fathomgrid.functions import attitude, units
from fathomgrid.operators.ordered import MISSION, Slices, latest, scan, upcoming


def _stack(left: DataFrame, right: DataFrame, keys, on: str, left_tie: str, right_tie: str, right_first: bool) -> DataFrame:
    """Rows of both sides as structs `_l` / `_r`, with the total order (on, _side, _tie)."""
    def boxed(df, name, side, tie):
        return df.select(*keys, on, F.lit(side).alias("_side"), F.col(tie).cast("long").alias("_tie"),
                         F.struct(*df.columns).alias(name))
    a = boxed(left, "_l", 1 if right_first else 0, left_tie)
    b = boxed(right, "_r", 0 if right_first else 1, right_tie)
    return a.unionByName(b, allowMissingColumns=True)


def attach_latest(left: DataFrame, right: DataFrame, name: str = "right", *, keys: Sequence[str] = MISSION,
                  on: str = "t", left_tie: str = "seq", right_tie: str = "seq", inclusive: bool = True,
                  slices: Slices | None = None) -> DataFrame:
    """Every left row with the last right row at or before it (before it, if not `inclusive`) as
    struct `name`; NULL when there is none yet."""
    stacked = _stack(left, right, keys, on, left_tie, right_tie, inclusive)
    out = scan(stacked, {name: latest(F.col("_r"))}, keys=keys, order=(on, "_side", "_tie"), slices=slices)
    return out.filter(F.col("_l").isNotNull()).select("_l.*", name)


def attach_next(left: DataFrame, right: DataFrame, name: str = "right", *, keys: Sequence[str] = MISSION,
                on: str = "t", left_tie: str = "seq", right_tie: str = "seq", slices: Slices | None = None) -> DataFrame:
    """Every left row with the first right row at or after it as struct `name`."""
    stacked = _stack(left, right, keys, on, left_tie, right_tie, False)
    out = scan(stacked, {name: upcoming(F.col("_r"))}, keys=keys, order=(on, "_side", "_tie"), slices=slices)
    return out.filter(F.col("_l").isNotNull()).select("_l.*", name)


def attach_nearest(left: DataFrame, right: DataFrame, name: str = "right", *, keys: Sequence[str] = MISSION,
                   on: str = "stamp_ns", left_tie: str = "seq", right_tie: str = "seq", tolerance=None,
                   slices: Slices | None = None) -> DataFrame:
    """Every left row with the nearest right row in time as struct `name`.

    Ties go to the earlier stamp, and among equal stamps to the earliest arrival (`right_tie`).
    Without a `tolerance` any distance counts. Later rows are candidates too.
    """
    one = right.groupBy(*keys, on).agg(F.min_by(F.struct(*right.columns), F.col(right_tie)).alias("_one")).select("_one.*")
    stacked = _stack(left, one, keys, on, left_tie, right_tie, True)
    out = scan(stacked, {"_back": latest(F.col("_r")), "_fore": upcoming(F.col("_r"))}, keys=keys,
               order=(on, "_side", "_tie"), slices=slices)
    back, fore = F.col(on) - F.col("_back")[on], F.col("_fore")[on] - F.col(on)
    pick = F.when(F.col("_fore").isNull() | (back <= fore), F.col("_back")).otherwise(F.col("_fore"))
    if tolerance is not None:
        pick = F.when(F.least(back, fore) <= tolerance, pick)
    return out.filter(F.col("_l").isNotNull()).select("_l.*", pick.alias(name))


def restamp_pings(pings: DataFrame, states: DataFrame, engaged: Column | None = None,
                  params: Alignment = Alignment(), *, keys: Sequence[str] = MISSION, on: str = "t",
                  slices: Slices | None = None) -> DataFrame:
    """Replace ping poses by the latest boat state.

    `embedded` keeps them, `gcs` always replaces, `auto` only where `engaged` (see
    `telemetry.frozen_poses`). A ping keeps its pose while there is no state.
    """
    if params.pose_source == "embedded":
        return pings
    joined = attach_latest(pings, states, "_state", keys=keys, on=on, slices=slices)
    use = F.col("_state").isNotNull()
    if params.pose_source == "auto":
        use = use & (F.col("engaged") if engaged is None else engaged)
    fresh = {"robot_x": "x", "robot_y": "y", "yaw": "yaw"}
    return joined.withColumns({
        c: F.when(use, F.col(f"_state.{s}")).otherwise(F.col(c)) for c, s in fresh.items()}).drop("_state")


def place_fixes(fixes: DataFrame, states: DataFrame, params: Alignment = Alignment(), *,
                keys: Sequence[str] = MISSION, on: str = "t", slices: Slices | None = None) -> DataFrame:
    """Pinger fixes in the world frame; vehicle-relative fixes before any boat state are dropped."""
    if params.pinger_frame == "world":
        return fixes
    joined = attach_latest(fixes, states, "_state", keys=keys, on=on, slices=slices).filter("_state is not null")
    s = F.col("_state")
    at = attitude.body_to_world(s["x"], s["y"], s["yaw"], F.col("x"), F.col("y"))
    return joined.withColumn("_at", at).withColumns({"x": F.col("_at.x"), "y": F.col("_at.y")}).drop("_at", "_state")


def live_distance(a: DataFrame, b: DataFrame, *, keys: Sequence[str] = MISSION, on: str = "t",
                  slices: Slices | None = None) -> DataFrame:
    """Distance between two moving points (x, y), recomputed whenever either moves."""
    points = [df.select(*keys, on, F.col("seq").cast("long").alias("seq"), F.lit(i).alias("mover"),
                        F.struct("x", "y").alias(f"_p{i}")) for i, df in enumerate((a, b))]
    both = points[0].unionByName(points[1], allowMissingColumns=True)
    out = scan(both, {"_a": latest(F.col("_p0")), "_b": latest(F.col("_p1"))}, keys=keys,
               order=(on, "mover", "seq"), slices=slices)
    gap = units.distance(F.col("_a.x"), F.col("_a.y"), F.col("_b.x"), F.col("_b.y"))
    return out.filter("_a is not null and _b is not null").select(*keys, on, "seq", "mover", gap.alias("distance_m"))
