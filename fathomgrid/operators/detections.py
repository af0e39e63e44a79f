"""Detection summaries and their place on the waterfall."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomgrid.config import Mosaic
from fathomgrid.operators import imaging
from fathomgrid.operators.asof import attach_next
from fathomgrid.operators.ordered import MISSION, Slices, newest, position, scan

#: A detection may lie this much beyond the swath of its row.
SWATH_SLACK = 1.02
KEPT_DETECTIONS = 500


def class_counts(detections: DataFrame, *, keys: Sequence[str] = MISSION, order: Sequence[str] = ("t", "seq")) -> DataFrame:
    """Distinct detections per class, a uid counting for the first class it was seen with."""
    first = detections.groupBy(*keys, "uid").agg(F.min_by("class_name", F.struct(*order)).alias("class_name"))
    return first.groupBy(*keys, "class_name").agg(F.count(F.lit(1)).alias("detections"))


def latest_detections(detections: DataFrame, *, keys: Sequence[str] = MISSION, order: Sequence[str] = ("t", "seq")) -> DataFrame:
    """The newest record of every uid."""
    return detections.groupBy(*keys, "uid").agg(
        F.max_by(F.struct(*[c for c in detections.columns if c not in (*keys, "uid")]), F.struct(*order)).alias("_d")
    ).select(*keys, "uid", "_d.*")


def newest_detections(detections: DataFrame, n: int = KEPT_DETECTIONS, *, keys: Sequence[str] = MISSION) -> DataFrame:
    return newest(detections, n, keys=keys)


def on_waterfall(detections: DataFrame, rows: DataFrame, params: Mosaic = Mosaic(), *, keys: Sequence[str] = MISSION,
                 slices: Slices | None = None) -> DataFrame:
    """Row and column of each detection on the waterfall: the first ping at or after its time.

    `rows` are usable pings (t, seq, robot_x, robot_y, yaw, range_m). Detections outside the time
    span of the rows or beyond the swath are left out.
    """
    numbered = scan(rows.select(*keys, "t", "seq", "robot_x", "robot_y", "yaw", "range_m"),
                    {"_no": position()}, keys=keys, slices=slices)
    span = rows.groupBy(*keys).agg(F.min("t").alias("_first"))
    placed = attach_next(detections, numbered, "_row", keys=keys, slices=slices).filter("_row is not null")
    placed = placed.join(span, list(keys)).filter(F.col("t") >= F.col("_first"))
    lateral, r = imaging.world_lateral(F.col("x"), F.col("y"), F.col("_row")), F.col("_row.range_m")
    return placed.withColumn("_y", lateral).filter((r > 0) & (F.abs("_y") <= r * SWATH_SLACK)).select(
        *detections.columns, (F.col("_row._no") - 1).alias("row"),
        imaging.lateral_pixel(F.col("_y"), r, params.waterfall_columns).alias("col"))
