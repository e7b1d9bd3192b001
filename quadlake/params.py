"""Job options, with the defaults of the evaluation protocol."""

from __future__ import annotations

from dataclasses import dataclass

#: Licences that rule out a production use.
COPYLEFT = ("AGPL-3.0", "GPL-3.0", "GPL-2.0", "SSPL-1.0")


#: The shapes of the angle weight (see functions/geometry.py).
DECAY_NAMES = ("linear", "smoothstep", "quadratic", "step")


@dataclass(frozen=True)
class Params:
    """The defaults are those of the protocol."""

    ratios: tuple[float, float, float] = (0.70, 0.15, 0.15)
    seed: int = 20260910
    folds: int = 5
    visibility_threshold: float = 0.25
    min_relative_area: float = 0.25
    margin: float = 0.05
    margins: tuple[float, ...] = (0.0, 0.05, 0.10)
    single_max: float = 0.01
    fan_max: float = 0.92
    contamination_percentile: float = 95.0
    coverage_percentile: float = 5.0
    coverage_target: float = 0.98
    match_iou: float = 0.5
    report_confidence: float = 0.25
    inference_confidence: float = 0.01
    nms_iou: float = 0.5
    max_detections: int = 300
    pad_fraction: float = 0.25
    angle_weights: bool = True
    angle_ratio_threshold: float = 1.1
    angle_least: float = 0.0
    angle_decay: str = "smoothstep"
    long_side_tie: float = 0.05
    duplicate_threshold: float = 0.92
    bootstrap_samples: int = 2000
    simota_radius: float = 2.5
    simota_top: int = 10
    simota_blocked: float = 1e5
    simota_iou_weight: float = 3.0

    def __post_init__(self) -> None:
        if abs(sum(self.ratios) - 1.0) > 1e-9:
            raise ValueError("ratios must sum to 1")
        if not 0 <= self.min_relative_area <= 1:
            raise ValueError("min_relative_area must be within 0 and 1")
        if self.angle_ratio_threshold <= 1 or self.angle_decay not in DECAY_NAMES:
            raise ValueError(f"the angle weight rises above a ratio of 1, in one of the shapes {DECAY_NAMES}")
        if self.fan_max < self.single_max:
            raise ValueError("fan_max must not be below single_max")
        if self.margin < 0 or any(m < 0 for m in self.margins):
            raise ValueError("margins must not be negative")


PARAMS = Params()
COCO_THRESHOLDS = tuple(round(0.5 + 0.05 * i, 2) for i in range(10))
