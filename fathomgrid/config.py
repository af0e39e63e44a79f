"""Operator parameters with their field defaults."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass, replace

NS = 1_000_000_000


@dataclass(frozen=True)
class Bottom:
    """First-bottom-return search."""

    noise_window: int = 20
    threshold_db: float = 8.0
    persistence: int = 3
    ringing_search: int = 60
    ringing_drop_db: float = 10.0
    ringing_persistence: int = 5
    ringing_fallback: int = 30


@dataclass(frozen=True)
class Tracking:
    """Per-side altitude lock."""

    bootstrap_pings: int = 10
    agreement_m: float = 0.30
    outlier_m: float = 1.0
    relock_after: int = 15


@dataclass(frozen=True)
class Pairing:
    tolerance_ns: int = 50_000_000
    pose_buffer_ns: int = 5 * NS
    pose_mode: str = "nearest"  # nearest | locf


@dataclass(frozen=True)
class Geometry:
    transducer_x_m: float = 0.0
    y_port_m: float = 0.0
    y_stbd_m: float = 0.0
    submersion_m: float = 0.0


@dataclass(frozen=True)
class Mosaic:
    cell_m: float = 0.25
    half_extent_m: float = 30.0
    percentiles: tuple = (2.0, 98.0)
    densify: bool = True
    bilinear: bool = True
    waterfall_rows: int = 1500
    waterfall_columns: int = 800
    max_gap_m: float = 2.5
    max_yaw_jump_rad: float = 0.6
    max_virtual_pings: int = 64
    min_splat_weight: float = 1e-4
    min_shown_weight: float = 0.25
    render_hz: float = 4.0


@dataclass(frozen=True)
class Seabed:
    rows: int = 256
    stride: int = 128
    columns: int = 800


@dataclass(frozen=True)
class GapFill:
    max_gap_m: float = 0.75
    min_neighbors: int = 3


@dataclass(frozen=True)
class Alignment:
    pose_source: str = "auto"  # auto | embedded | gcs
    pinger_frame: str = "robot"  # robot | world
    frozen_eps_m: float = 0.05
    frozen_after: int = 20
    moved_min_m: float = 1.0
    state_period_ns: int = NS // 5
    stale_s: float = 3.0
    odom_dead_s: float = 2.0
    jump_m: float = 5.0


@dataclass(frozen=True)
class Display:
    """How intensities become colours. The defaults."""

    auto_range: bool = True
    vmin_db: float = -60.0
    vmax_db: float = -10.0
    gamma: float = 1.0
    brightness: float = 0.0
    colormap: str = "Copper"


@dataclass(frozen=True)
class Scale:
    """Sizing of ordered passes; see operators.ordered.Slices."""

    slice_s: float = 3600.0
    slice_rows: int = 100_000
    #: ordering columns that hold seconds
    seconds: tuple = ("t",)


@dataclass(frozen=True)
class Config:
    bottom: Bottom = field(default_factory=Bottom)
    tracking: Tracking = field(default_factory=Tracking)
    pairing: Pairing = field(default_factory=Pairing)
    geometry: Geometry = field(default_factory=Geometry)
    mosaic: Mosaic = field(default_factory=Mosaic)
    seabed: Seabed = field(default_factory=Seabed)
    gapfill: GapFill = field(default_factory=GapFill)
    alignment: Alignment = field(default_factory=Alignment)
    scale: Scale = field(default_factory=Scale)


def overlay(base, values: dict):
    """`base` with nested `values` laid over it; an unknown key raises KeyError."""
    known = {f.name for f in fields(base)}
    changes = {}
    for key, value in values.items():
        if key not in known:
            raise KeyError(f"unknown setting {key!r} for {type(base).__name__}")
        current = getattr(base, key)
        changes[key] = overlay(current, value) if is_dataclass(current) else value
    return replace(base, **changes)
