"""Importing the query modules registers their queries."""

from __future__ import annotations

import importlib

MODULES = ("mosaic_queries", "ping_queries", "frame_queries", "telemetry_queries", "detection_queries", "log_queries", "file_queries")


def load() -> None:
    for name in MODULES:
        importlib.import_module(f"fathomgrid.plans.{name}")
