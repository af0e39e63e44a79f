"""Streaming queries built from the batch operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from fathomgrid.config import Config, Mosaic
from fathomgrid.operators import mosaic as grid
from fathomgrid.operators.ordered import MISSION


def gate(messages: DataFrame, sessions: DataFrame, *, keys: Sequence[str] = MISSION, on: str = "t") -> DataFrame:
    """Messages inside a recording session (started, ended) of their mission; `sessions` is static."""
    inside = F.col(on).between(F.col("started"), F.col("ended"))
    return messages.join(sessions.select(*keys, "started", "ended"), list(keys)).filter(inside).drop("started", "ended")


def live_mosaic(samples: DataFrame, params: Mosaic = Mosaic(), *, policies: Sequence[str] | None = None) -> DataFrame:
    """The mosaic of a sample stream; write in update mode, so that a trigger emits the cells it changed."""
    return grid.mosaic(samples, params, policies=policies)


def at_render_rate(df: DataFrame, config: Config = Config()) -> DataStreamWriter:
    """Update-mode writer that fires at the display rate."""
    period = round(1000 / config.mosaic.render_hz)
    return df.writeStream.outputMode("update").trigger(processingTime=f"{period} milliseconds")


def rates(messages: DataFrame, delay: str, *, event_time: str = "ts", keys: Sequence[str] = ("mission_id", "topic")) -> DataFrame:
    """Messages per second and topic; a message later than `delay` is not counted."""
    return messages.withWatermark(event_time, delay).groupBy(*keys, F.window(event_time, "1 second")).agg(F.count(F.lit(1)).alias("messages"))


def depth_range(pings: DataFrame, delay: str, *, event_time: str = "ts", keys: Sequence[str] = MISSION) -> DataFrame:
    """Depth range over the last minute, every second."""
    sliding = F.window(event_time, "60 seconds", "1 second")
    return pings.withWatermark(event_time, delay).groupBy(*keys, sliding).agg(
        F.min("water_depth").alias("depth_min"), F.max("water_depth").alias("depth_max"), F.max_by("water_depth", event_time).alias("depth"))


def activity(states: DataFrame, delay: str, *, event_time: str = "ts", gap: str = "3 seconds", keys: Sequence[str] = MISSION) -> DataFrame:
    """Unbroken runs of a stream: a silence longer than the gap starts a new one."""
    runs = F.session_window(event_time, gap)
    return states.withWatermark(event_time, delay).groupBy(*keys, runs).agg(F.count(F.lit(1)).alias("states"))
