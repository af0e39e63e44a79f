"""Mapping of intensities to 8-bit pixels and colours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomgrid.config import Display

# Slope and offset of each channel along a ramp of 256 steps of 1/255, clipped to 0..1 and truncated to
# bytes. "Inverse gray" is the gray ramp read from its end.
COLOURS = {
    "Copper": ((1.25, 0.0), (0.7812, 0.0), (0.4975, 0.0)),
    "Grayscale": ((1.0, 0.0), (1.0, 0.0), (1.0, 0.0)),
    "Inverse gray": ((1.0, 0.0), (1.0, 0.0), (1.0, 0.0)),
    "Gold": ((1.6, 0.0), (1.15, -0.05), (0.9, -0.35)),
}
REVERSED = ("Inverse gray",)
STEP = 1.0 / 255


def _unit(value: Column) -> Column:
    """Clipped to 0..1; `greatest` and `least` skip NULL, so a missing value is kept apart."""
    return F.when(value.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def normalise(value: Column, low: Column, high: Column) -> Column:
    return _unit((value - low) / (high - low))


def to_8bit(value: Column, low: Column, high: Column) -> Column:
    """0..255, truncated; 0 for a missing value."""
    safe = F.greatest(high, low + 1e-6)
    return F.coalesce((normalise(value, low, safe) * 255).cast("int"), F.lit(0))


def colour_index(value: Column, settings: Display, low: Column | None = None, high: Column | None = None) -> Column:
    if settings.auto_range:
        unit = normalise(value, low, high)
    else:
        unit = normalise(value, F.lit(settings.vmin_db), F.lit(max(settings.vmax_db, settings.vmin_db + 1e-6)))
    if settings.gamma != 1.0:
        unit = F.pow(unit, F.lit(settings.gamma))
    if settings.brightness != 0.0:
        unit = _unit(unit + settings.brightness)
    return F.coalesce((unit * 255).cast("int"), F.lit(0))


def colourise(cells: DataFrame, settings: Display = Display(), value: str = "value") -> DataFrame:
    """Add r, g, b, a. Auto range reads vmin and vmax columns; empty cells are transparent."""
    index = colour_index(F.col(value), settings, F.col("vmin"), F.col("vmax")) if settings.auto_range \
        else colour_index(F.col(value), settings)
    # an unknown palette name falls back to copper
    ramps = COLOURS.get(settings.colormap, COLOURS["Copper"])
    at = (255 - F.col("_index") if settings.colormap in REVERSED else F.col("_index")) * F.lit(STEP)
    channels = {c: (_unit(at * slope + offset) * 255).cast("int") for c, (slope, offset) in zip("rgb", ramps)}
    return cells.withColumn("_index", index).withColumns(
        {**channels, "a": F.when(F.col(value).isNotNull(), 255).otherwise(0)}).drop("_index")
