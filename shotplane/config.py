"""Thresholds and settings of the operators."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class CullConfig:
    """Thresholds of grouping and judging."""

    scene_gap: float = 45.0
    split_dist: float = 0.17
    face_weight: float = 0.5
    blink_closed: float = 0.45
    blink_both: float = 0.3
    min_presence: float = 0.5
    min_eye_px: float = 40.0
    soft_rel: float = 0.5
    soft_frame: float = 0.6
    smile: float = 0.5
    pick_ratio: float = 0.9
    more_picks: tuple[int, int] = (8, 16)
    orientation_break: bool = True


@dataclass(frozen=True)
class PeopleConfig:
    """Thresholds of clustering and recognition."""

    same: float = 0.363
    core_norm: float = 9.5
    core_presence: float = 0.5
    weak_norm: float = 5.5
    attach: float = 0.30
    samples: int = 24
    unnamed_base: int = 1000
    min_width: float = 48.0


@dataclass(frozen=True)
class DetectConfig:
    """Thresholds of detections."""

    min_score: float = 0.6
    min_width: float = 0.25
    max_iou: float = 0.3
    match_iou: float = 0.5


@dataclass(frozen=True)
class ReframeConfig:
    """Settings of crop candidates and their scores."""

    ratios: tuple[tuple[int, int], ...] = ((4, 5), (1, 1), (3, 2), (16, 9), (2, 3))
    sizes: int = 12
    min_scale: float = 0.35
    max_scale: float = 0.9
    step: float = 0.015
    min_long: int = 2560
    margin: tuple[float, float, float] = (0.3, 0.25, 0.1)
    yaw_turned: float = 0.1
    chin_band: float = 0.3
    bright_slack: float = 0.1
    clutter: float = 0.6
    w_eyes: float = 4.0
    w_lead: float = 3.0
    w_cut: float = 1.0
    w_bright: float = 2.0
    w_busy: float = 0.25
    w_pop: float = 0.4
    w_clutter: float = 2.0
    max_iou: float = 0.5
    slack: float = 1.0
    gate: float = 0.04
    tolerance: float = 0.05
    per_ratio: int = 2
    total: int = 5
    strip: float = 0.06
    segments: int = 4


#: Thresholds that calibration moves: name, first value, last value, step.
KNOBS: tuple[tuple[str, float, float, float], ...] = (
    ("blink_closed", 0.30, 0.70, 0.025),
    ("blink_both", 0.10, 0.50, 0.025),
    ("soft_rel", 0.25, 0.80, 0.025),
    ("min_presence", 0.20, 0.80, 0.05),
    ("min_eye_px", 15.0, 80.0, 5.0),
)
