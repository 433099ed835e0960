"""Parameters of scoring, of the printed sheet and of mark reading.

The dataclasses check and clamp their values once, on the driver; operators use
them as literals in the plan.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, fields, replace

#: Option letters a sheet may print.
OPTION_SETS = ("ABCD", "ABCDE")

#: Least and greatest value of each layout field, in millimetres or counts.
LAYOUT_BOUNDS = {
    "columns": (1, 5),
    "rows_per_column": (4, 40),
    "num_questions": (1, 200),
    "bubble_diameter_mm": (3, 8),
    "bubble_gap_mm": (0.6, 5),
    "row_pitch_mm": (4.5, 14),
    "column_gap_mm": (2, 20),
    "grid_top_mm": (30, 160),
    "number_gutter_mm": (5, 20),
    "margin_mm": (6, 25),
    "fiducial_size_mm": (3, 10),
    "fiducial_inset_mm": (3, 20),
    "footer_mm": (6, 30),
}

#: Counts among the layout's fields: rounded after clamping.
LAYOUT_COUNTS = ("columns", "rows_per_column", "num_questions")


def clamp(value: float, low: float, high: float) -> float:
    return min(high, max(low, value))


def half_up(x: float) -> int:
    """Nearest integer, halves towards plus infinity."""
    return math.floor(x + 0.5)


def to_number(value: object) -> float | None:
    """A value as a number the way a form field is read: null and blank text are 0, other text that is no number is none."""
    if value is None or isinstance(value, str) and not value.strip():
        return 0.0
    try:
        x = float(value)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return None
    return x if math.isfinite(x) else None


@dataclass(frozen=True)
class Layout:
    """The printed sheet; lengths in millimetres."""

    # The default sheet.
    page_width_mm: float = 210
    page_height_mm: float = 297
    margin_mm: float = 12
    columns: int = 3
    rows_per_column: int = 20
    num_questions: int = 30
    option_set: str = "ABCDE"
    bubble_diameter_mm: float = 5
    bubble_gap_mm: float = 1.6
    row_pitch_mm: float = 7.5
    column_gap_mm: float = 6
    grid_top_mm: float = 92
    number_gutter_mm: float = 9
    fiducial_size_mm: float = 6
    fiducial_inset_mm: float = 6
    footer_mm: float = 14

    @staticmethod
    def of(values: dict | None = None) -> Layout:
        """Defaults overridden by ``values``, each number clamped to its bounds; what is no number falls back to its default."""
        given = values or {}
        out = {}
        for f in fields(Layout):
            value = given.get(f.name, f.default)
            if f.name in LAYOUT_BOUNDS:
                number = to_number(value)
                value = clamp(f.default if number is None else number, *LAYOUT_BOUNDS[f.name])
                if f.name in LAYOUT_COUNTS:
                    value = half_up(value)
            elif f.name == "option_set":
                value = value if value in OPTION_SETS else f.default
            out[f.name] = value
        return Layout(**out)


@dataclass(frozen=True)
class Heading:
    """What a printed page says above its items."""

    institution: str = ""
    unit: str = ""
    test_name: str = ""
    instrument: str = ""


@dataclass(frozen=True)
class ScoringConfig:
    """How answers become scores and norms."""

    num_questions: int = 30
    option_set: str = "ABCDE"
    penalty: bool = False
    scale_max: float = 100
    passing_score: float = 60
    norm_mode: str = "sample"
    norm_mean: float = 15
    norm_sd: float = 5
    merge_by_name: bool = False

    def validated(self) -> ScoringConfig:
        """scale_max within 1 to 1000 and passing_score within 0 to scale_max."""
        top = clamp(self.scale_max, 1, 1000)
        return replace(self, scale_max=top, passing_score=clamp(self.passing_score, 0, top))

    def for_layout(self, layout: Layout) -> ScoringConfig:
        return replace(self, num_questions=layout.num_questions, option_set=layout.option_set)

    @property
    def options(self) -> list[str]:
        return list(self.option_set)


#: Ranges in which the decision parameters may be set.
CALIBRATION_BOUNDS = {"fill_threshold": (0.05, 0.6), "margin_threshold": (0.02, 0.4), "sample_radius_factor": (0.2, 0.45)}


@dataclass(frozen=True)
class OmrOptions:
    """Mark reading: image size, sampling and decision thresholds."""

    # The defaults at which sheets are read.
    max_dim: int = 1400
    sample_radius_factor: float = 0.32
    fill_threshold: float = 0.16
    margin_threshold: float = 0.1
    local_window_divisor: int = 60
    local_bias: float = 30

    def calibrated(self, **values: float) -> OmrOptions:
        """With the given decision parameters, each clamped to its range."""
        return replace(self, **{k: clamp(v, *CALIBRATION_BOUNDS[k]) for k, v in values.items()})
