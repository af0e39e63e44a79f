"""Sessions, trajectories, rates and other summaries over time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomgrid.operators.ordered import MISSION

# Fixed values.
FILE_SLACK_S = 10
DEPTH_SPAN_S = 60.0


def select_range(events: DataFrame, start_s: float, end_s: float) -> DataFrame:
    """Events between two times, both included."""
    return events.filter(F.col("t").between(start_s, end_s))


def slider_time(step: int, duration_s: float) -> float:
    """Time of a range slider with 1000 steps."""
    return step / 1000.0 * duration_s


def session_counts(pings: DataFrame, detections: DataFrame, *, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """Ping count, detection count, start, end and duration per session."""
    p = pings.groupBy(*keys).agg(F.count(F.lit(1)).alias("ping_count"), F.min("t").alias("_t0"), F.max("t").alias("_t1"))
    d = detections.groupBy(*keys).agg(F.count(F.lit(1)).alias("detection_count"), F.min("t").alias("_d0"), F.max("t").alias("_d1"))
    start, end = F.least("_t0", "_d0"), F.greatest("_t1", "_d1")
    none = F.lit(0).cast("long")
    return p.join(d, list(keys), "full").select(
        *keys, F.coalesce("ping_count", none).alias("ping_count"), F.coalesce("detection_count", none).alias("detection_count"),
        start.alias("started_s"), end.alias("ended_s"), F.round(end - start, 1).alias("duration_s"))


def _by_hour(files: DataFrame, sessions: DataFrame, slack_s: int):
    """Both sides keyed by hour, so that the interval join is an equality join plus a filter."""
    hour = 3600
    lo, hi = F.col("started") - slack_s, F.col("ended") + slack_s
    spread = sessions.withColumns({"_lo": lo, "_hi": hi}).withColumn("_hour", F.explode(F.sequence(
        F.floor(F.col("_lo") / hour).cast("long"), F.floor(F.col("_hi") / hour).cast("long"))))
    return files.withColumn("_hour", F.floor(F.col("mtime") / hour).cast("long")), spread


def adopt_files(files: DataFrame, sessions: DataFrame, *, slack_s: int = FILE_SLACK_S) -> DataFrame:
    """(session, file) for files modified during a session and not already in its folder.

    `files` has path and mtime (seconds), `sessions` session_id, folder, started and ended (seconds).
    """
    keyed, spread = _by_hour(files, sessions, slack_s)
    return keyed.join(spread, "_hour").filter(
        F.col("mtime").between(F.col("_lo"), F.col("_hi")) & ~F.col("path").startswith(F.concat("folder", F.lit("/")))
    ).select("session_id", "path", "mtime")


def adopted_counts(files: DataFrame, sessions: DataFrame, *, slack_s: int = FILE_SLACK_S) -> DataFrame:
    """Number of files per session, with their earliest and latest change.

    Files are counted per modification second first, so overlapping sessions and busy seconds do
    not multiply into pairs.
    """
    busy = files.groupBy("mtime").agg(F.count(F.lit(1)).alias("_files"))
    keyed, spread = _by_hour(busy, sessions.select("session_id", "started", "ended"), slack_s)
    # sessions with the same interval see the same files: join each interval once
    spans = spread.select("_hour", "_lo", "_hi").distinct()
    per_span = keyed.join(spans, "_hour").filter(F.col("mtime").between(F.col("_lo"), F.col("_hi"))).groupBy("_lo", "_hi").agg(
        F.sum("_files").alias("adopted_files"), F.min("mtime").alias("first_mtime"), F.max("mtime").alias("last_mtime"))
    return (sessions.select("session_id", (F.col("started") - slack_s).alias("_lo"), (F.col("ended") + slack_s).alias("_hi"))
            .join(per_span, ["_lo", "_hi"]).select("session_id", "adopted_files", "first_mtime", "last_mtime"))


def rate_per_second(messages: DataFrame, *, keys: Sequence[str] = MISSION, on: str = "t", topic: str = "topic") -> DataFrame:
    """Messages per second and topic (`second` is whole seconds)."""
    return messages.groupBy(*keys, topic, F.floor(on).cast("long").alias("second")).agg(F.count(F.lit(1)).alias("messages"))


def rolling_depth(pings: DataFrame, span_s: float = DEPTH_SPAN_S, *, keys: Sequence[str] = MISSION, on: str = "t") -> DataFrame:
    """Add depth_min and depth_max over the last `span_s` seconds up to the row, rows of the same time included.

    Time is cut into blocks as long as the span, so a window is the end of one block and the beginning of the next. Each
    row goes to its own block and, `span_s` later, to the next one; there both parts are running extremes, one forwards and one
    backwards in time. One shuffle, linear in the rows, no frame is aggregated twice. Rows without a time see each other.
    """
    span = round(span_s * 1e6)
    at = F.bround(F.col(on) * 1e6).cast("long")
    block, depth = at - F.pmod(at, F.lit(span)), F.col("water_depth")
    row, nothing = F.struct(*pings.columns), F.lit(None)
    own = F.struct(at.alias("at"), block.alias("block"), depth.alias("here"), nothing.cast(pings.schema["water_depth"].dataType).alias("before"), row.alias("row"))
    later = F.struct((at + span).alias("at"), (block + span).alias("block"), nothing.cast(pings.schema["water_depth"].dataType).alias("here"),
                     depth.alias("before"), F.when(F.lit(False), row).alias("row"))
    spots = pings.select(*keys, F.explode(F.array(own, later)).alias("_e")).select(*keys, "_e.*")
    part = Window.partitionBy(*keys, "block")
    since_start = part.orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    to_end = part.orderBy(F.col("at").desc()).rangeBetween(Window.unboundedPreceding, 0)
    out = spots.select("row", F.least(F.min("here").over(since_start), F.min("before").over(to_end)).alias("depth_min"),
                       F.greatest(F.max("here").over(since_start), F.max("before").over(to_end)).alias("depth_max"))
    return out.filter("row is not null").select("row.*", "depth_min", "depth_max")


def trajectory_summary(pings: DataFrame, *, keys: Sequence[str] = MISSION, order: Sequence[str] = ("t", "seq")) -> DataFrame:
    """Ping count, first and last position."""
    at, by = F.struct("x", "y"), F.struct(*order)
    return pings.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("pings"), F.min_by(at, by).alias("_a"), F.max_by(at, by).alias("_b")).select(
        *keys, "pings", F.col("_a.x").alias("first_x"), F.col("_a.y").alias("first_y"),
        F.col("_b.x").alias("last_x"), F.col("_b.y").alias("last_y"))


def latest_path(paths: DataFrame, *, keys: Sequence[str] = MISSION, order: Sequence[str] = ("t", "seq")) -> DataFrame:
    """The newest planned path; it replaces all before."""
    return paths.groupBy(*keys).agg(F.max_by("points", F.struct(*order)).alias("points"))


def path_points(paths: DataFrame, *, keys: Sequence[str] = MISSION) -> DataFrame:
    return paths.select(*keys, F.posexplode("points").alias("point_no", "p")).select(*keys, "point_no", "p.x", "p.y")


def rebase(events: DataFrame, *, keys: Sequence[str] = MISSION) -> DataFrame:
    """Event times from the mission's first event, with `duration_s` (the last of them)."""
    span = events.groupBy(*keys).agg(F.min("t").alias("_t0"), F.max("t").alias("_t1"))
    return events.join(span, list(keys)).withColumns(
        {"t": F.col("t") - F.col("_t0"), "duration_s": F.col("_t1") - F.col("_t0")}).drop("_t0", "_t1")
