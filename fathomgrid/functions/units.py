"""Stamps, durations and integer telemetry units as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NS = 1_000_000_000


def stamp_ns(sec: Column, nanosec: Column) -> Column:
    return sec.cast("long") * F.lit(NS).cast("long") + nanosec.cast("long")


def ns_parts(ns: Column) -> Column:
    """struct(sec, nanosec), floor division."""
    rest = F.pmod(ns, F.lit(NS).cast("long"))
    return F.struct(((ns - rest) / NS).cast("long").alias("sec"), rest.alias("nanosec"))


def seconds(ns: Column) -> Column:
    return ns / float(NS)


def minutes_text(s: Column) -> Column:
    """mm:ss.s"""
    minutes = F.floor(s / 60.0)
    return F.format_string("%02d:%04.1f", minutes, s - minutes * 60.0)


def hours_text(s: Column) -> Column:
    """hh:mm:ss of whole seconds."""
    whole = F.floor(s)
    return F.format_string("%02d:%02d:%02d", F.floor(whole / 3600), F.floor(F.pmod(whole, F.lit(3600)) / 60),
                           F.pmod(whole, F.lit(60)))


def deg_e7(value: Column) -> Column:
    return value / 1e7


def milli(value: Column) -> Column:
    return value / 1000.0


def centi(value: Column) -> Column:
    return value / 100.0


def whole(value: Column) -> Column:
    """Nearest integer, halves to even."""
    return F.bround(value, 0).cast("long")


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.hypot(ax - bx, ay - by)
