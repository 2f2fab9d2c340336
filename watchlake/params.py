"""Parameters of the operator families with their defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class LogParams:
    cap_seconds: float = 300.0  # averages count longer times as this
    keep_days: int = 90


@dataclass(frozen=True)
class MotionParams:
    gap_s: float = 3.0
    significant_s: float = 0.8
    insignificant_s: float = 0.2
    padding_s: float = 1.5


@dataclass(frozen=True)
class TrustParams:
    drift_px: float = 10.0
    updates: int = 20
    confidence: float = 0.80


@dataclass(frozen=True)
class CrossingParams:
    line_y: int = 810
    tolerance: int = 6
    stable: int = 2
    dwell_s: float = 2.0
    highlight_frames: int = 5
    person_frames: int = 10


@dataclass(frozen=True)
class SpeedParams:
    metres_per_pixel: float = 0.0051
    reference_row: float = 0.60
    row_gain: float = 1.1
    edge_gain: float = 1.1
    least_scale: float = 0.55
    most_scale: float = 2.20
    least_px: float = 2.5
    gap_s: float = 1.0
    alpha: float = 0.25
    window: int = 6
    dy_weight: float = 0.35
    cap: float = 100.0
    label_from: float = 5.0
    trail: int = 18


@dataclass(frozen=True)
class TrapParams:
    x1: float = 1860.0
    x2: float = 2620.0
    metres: float = 5.0
    cap: float = 100.0


@dataclass(frozen=True)
class MatchParams:
    iou: float = 0.5
    iou_near: float = 0.3
    distance: float = 0.35
    size_ratio: float = 1.6
    duplicate_iou: float = 0.7
    duplicate_distance: float = 0.25
    gap_s: float = 2.0


@dataclass(frozen=True)
class ReidParams:
    threshold: float = 0.6
    margin: float = 0.08
    samples: int = 128
    top: int = 3
    matched: int = 2
    diversity: float = 0.2
    same_person: float = 0.75
    duplicate: float = 0.95
