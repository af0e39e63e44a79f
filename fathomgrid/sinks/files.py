"""Stored results. Every writer is one distributed write; nothing passes through the driver."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomgrid.config import Config, Display
from fathomgrid.operators import imaging
from fathomgrid.operators.mosaic import shown_value
from fathomgrid.operators.ordered import MISSION, newest
from fathomgrid.operators.telemetry import since_first

NOTE = "Stored cells and waterfall rows are raw values; colours are applied when they are shown."
PIXELS = {
    "row0": "oldest ping", "last_row": "newest ping", "col0": "+range (PORT)", "last_col": "-range (STARBOARD)",
    "formula": "lateral = range_m * (1 - 2 * col / (cols - 1)); x = x_m - sin(yaw_rad) * lateral; y = y_m + cos(yaw_rad) * lateral"}


def write_mosaic(cells: DataFrame, path: str, config: Config = Config(), *, keys: Sequence[str] = MISSION) -> None:
    """Measured cells only (never gap-filled), with the mean shown and the lattice they are on."""
    m = config.mosaic
    (cells.withColumns({"mean": shown_value("average", m), "cell_size_m": F.lit(m.cell_m), "x0": F.lit(-m.half_extent_m), "y0": F.lit(-m.half_extent_m)})
     .write.mode("overwrite").partitionBy(*keys).parquet(path, compression="zstd"))


def _fixed(name: str, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", F.col(name).cast("double"))


def trajectory_rows(pings: DataFrame, *, keys: Sequence[str] = MISSION) -> DataFrame:
    return since_first(pings, keys=keys).select(
        *keys, _fixed("since_first_s", 3).alias("t_since_first_s"), _fixed("robot_x", 3).alias("x_m"),
        _fixed("robot_y", 3).alias("y_m"), _fixed("water_depth", 3).alias("depth_m"))


def write_trajectory(pings: DataFrame, path: str, *, keys: Sequence[str] = MISSION) -> None:
    trajectory_rows(pings, keys=keys).write.mode("overwrite").partitionBy(*keys).csv(path, header=True)


def detection_rows(detections: DataFrame, *, keys: Sequence[str] = MISSION) -> DataFrame:
    return detections.select(
        *keys, "uid", _fixed("t", 3).alias("t"), _fixed("x", 3).alias("x_m"), _fixed("y", 3).alias("y_m"),
        F.col("class_name").alias("class"), _fixed("confidence", 3).alias("confidence"), _fixed("extent_m", 2).alias("extent_m"))


def write_detections(detections: DataFrame, path: str, *, keys: Sequence[str] = MISSION) -> None:
    """All detections, repeats included; nothing is written when there are none."""
    if not detections.isEmpty():
        detection_rows(detections, keys=keys).write.mode("overwrite").partitionBy(*keys).csv(path, header=True)


def _snapshot(values: dict | None, empty: str) -> Column:
    """A struct of settings, NULL where there are none."""
    return F.struct(*[F.lit(v).alias(n) for n, v in values.items()]) if values else F.lit(None).cast(empty)


def session_metadata(sessions: DataFrame, adopted: DataFrame, config: Config = Config(), policy: str = "average", *,
                     display: Display | None = None, topics: dict[str, str] | None = None) -> DataFrame:
    """One row per session: counters, span, adopted files and settings, `display` as it was at the end, `topics` by their use.

    `sessions` as from `missions.session_counts`, `adopted` as from `missions.adopt_files`.
    """
    # the files written during one session; a boat writes one file per 500 MB
    files = adopted.groupBy("session_id").agg(F.sort_array(F.collect_list(F.element_at(F.split("path", "/"), -1))).alias("adopted_svlogs"))
    m = config.mosaic
    settings = F.struct(F.lit(m.cell_m).alias("cell_size_m"), F.lit(m.densify).alias("densify"),
                        F.lit(m.bilinear).alias("bilinear_splat"), F.lit(policy).alias("priority_mode_displayed"))
    return sessions.join(files, "session_id", "left").select(
        F.col("session_id").alias("session"), F.timestamp_seconds("started_s").alias("started_utc"),
        F.timestamp_seconds("ended_s").alias("ended_utc"), "duration_s", "ping_count", "detection_count",
        F.coalesce("adopted_svlogs", F.array().cast("array<string>")).alias("adopted_svlogs"), settings.alias("mosaic"),
        _snapshot(display and asdict(display), "struct<colormap: string>").alias("display_settings_at_end"),
        _snapshot(topics, "map<string, string>").alias("topics"), F.lit(NOTE).alias("note"))


def write_session_metadata(metadata: DataFrame, path: str) -> None:
    metadata.write.mode("overwrite").json(path)


def write_waterfall(pings: DataFrame, path: str, config: Config = Config(), *, keys: Sequence[str] = MISSION) -> None:
    """The newest waterfall rows of each mission with their half range, raw values."""
    m = config.mosaic
    rows = newest(imaging.usable_pings(pings), m.waterfall_rows, keys=keys)
    (rows.select(*keys, "t", "seq", "robot_x", "robot_y", "yaw", F.col("range_m").alias("swath_half_range_m"),
                 F.lit(m.waterfall_columns).alias("columns"),
                 imaging.waterfall_row(F.col("y_local"), F.col("intensity_db"), m.waterfall_columns).alias("intensity_db"))
     .write.mode("overwrite").partitionBy(*keys).parquet(path))


def write_images(members: DataFrame, path: str, columns: int, detections: DataFrame | None = None, *,
                 keys: Sequence[str] = MISSION) -> None:
    """Image data set: `images` (8-bit pixels and metadata JSON with a pose per row) and `pixels` (raw values with world coordinates)."""
    image = imaging.to_8bit(imaging.images(members, keys=keys))
    described = image.join(_described(members, detections, keys), [*keys, "image_id"])
    per_row = F.transform("rows_data", lambda r: F.struct(
        r["t"].alias("t_s"), r["robot_x"].alias("x_m"), r["robot_y"].alias("y_m"), r["yaw"].alias("yaw_rad"), r["range_m"].alias("range_m"),
        r["speed_mps"].alias("speed_mps"), r["altitude_m"].alias("altitude_m")))
    body = F.struct(F.lit(imaging.SCHEMA_VERSION).alias("schema"), "image_id", "rows", "cols", "t_start_s", "t_end_s",
                    _snapshot(PIXELS, "").alias("pixel_convention"), per_row.alias("rows_data"), "boat", "detections")
    described.withColumn("metadata", F.to_json(body)).select(*keys, "image_id", "pixels", "metadata").write.mode("overwrite").partitionBy(*keys).parquet(f"{path}/images")
    imaging.pixel_world(members, columns).write.mode("overwrite").partitionBy(*keys).parquet(f"{path}/pixels")


def _described(members: DataFrame, detections: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    """Size, time span, `boat` and `detections` of each image."""
    by = [*keys, "image_id"]
    width = members.groupBy(*by).agg(F.first(F.size("intensity")).alias("cols"))
    out = imaging.image_summary(members, keys=keys).join(width, by)
    if detections is not None:
        # bounded: an analyzer's findings on one image
        found = detections.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(
            "detection_no", F.array("row_no", "col").alias("pixel"), F.array("x", "y").alias("world"), "class_name", "confidence", "t_s"))).alias("detections"))
        out = out.join(found, by, "left")
    else:
        out = out.withColumn("detections", F.array())
    return out.withColumn("boat", F.struct("mean_speed_mps", "mean_altitude_m", *[
        F.array(F.col(f"{p}.robot_x"), F.col(f"{p}.robot_y"), F.col(f"{p}.yaw")).alias(p) for p in ("start_pose", "end_pose")]))


def analysis(members: DataFrame, detections: DataFrame | None = None, *, keys: Sequence[str] = MISSION) -> DataFrame:
    """keys, image_id and `metadata`: JSON of an image with its detections, never its pixels."""
    body = F.struct(F.lit(imaging.SCHEMA_VERSION).alias("schema"), F.struct("image_id", "t_start_s", "t_end_s", "rows", "cols", "boat").alias("image"), "detections")
    return _described(members, detections, keys).select(*keys, "image_id", F.to_json(body).alias("metadata"))


def write_topics(rows: DataFrame, path: str, *, keys: Sequence[str] = MISSION) -> None:
    """The typed streams of converted logs (`logs.topic_rows`) in one write, a folder per topic. Rows of a log stand together in
    a file, so the number of files doesn't grow with the logs and a reader of one log skips the others."""
    rows.sortWithinPartitions("topic", *keys, "seq").write.mode("overwrite").partitionBy("topic").parquet(path)
