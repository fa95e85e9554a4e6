"""Parameters of a panel: which accounts become which series, which days it spans, which cutoffs are scored."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Stage:
    train_start: str
    first_cutoff: str
    last_cutoff: str
    locked: bool = False


@dataclass(frozen=True)
class PanelConfig:
    """Accounts of rank up to `top` are series of their own; `bands` are inclusive upper ranks of the tail groups."""

    start: str = "1995-01-01"
    end: str = "2001-11-04"
    ref_start: str = "2000-11-05"
    ref_end: str = "2001-11-04"
    top: int = 10
    bands: tuple[tuple[int, str], ...] = ((20, "g1_tail"), (35, "g2_tail"), (50, "g3_tail"), (75, "g4_tail"))
    rest: str = "g5_tail"
    first_year: int = 1995
    last_year: int = 2001
    horizon: int = 14
    cutoffs: tuple[str, ...] = ("1999-01-11", "1999-05-10", "1999-07-12", "1999-10-11", "1999-11-22", "1999-12-20")
    stages: dict[str, Stage] = field(
        default_factory=lambda: {
            "stage1": Stage("1995-01-01", "1997-01-06", "1997-12-22"),
            "stage2": Stage("1995-01-01", "1998-01-05", "1998-12-21"),
            "stage3": Stage("1995-01-01", "1999-01-04", "1999-12-20"),
            "holdout": Stage("1995-01-01", "2000-11-06", "2000-12-25", locked=True),
        }
    )

    @property
    def ranked(self) -> int:
        """Ranks beyond this are the rest."""
        return self.bands[-1][0] if self.bands else self.top


DEFAULT = PanelConfig()

# Fixed values of the forecasting model.
SHAPE_OBS = 4
LEVEL_DAYS = 14
EVENT_DAYS = 28
EVENT_MIN_OBS = 10
FACTOR_CLIP = (0.0, 1.5)
BF_FACTOR_CLIP = (0.0, 5.0)
POOLED_DEFAULT = 0.5
SERIES_K = 500.0
SERIES_CLIP = (0.2, 3.0)
VACATION_CLIP = (0.3, 2.0)
STEP_TAU = 0.18
HALF_LIFE_DAYS = 365.25
TREND_CLIP = (0.85, 1.15)
TREND_K = 500.0
TREND_DAMP = 0.5
LAG_CAP = 12.0
TARGET_CAP = 15.0
EDGE_CAP = 10
