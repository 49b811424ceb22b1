"""Run parameters shared by the plans."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    """One value per knob; pass a changed copy (``dataclasses.replace``) to vary a run."""

    deflator_base_year: int = 2025
    event_grace_days: int = 30
    pending_threshold_pct: float = 1.0
    growth_from_vintage: int = 2019
    growth_to_vintage: int = 2024
    focus_state: str = "MI"
    focus_state_fips: str = "26"
    focus_county_count: int = 83
    unusable_warn_pct: float = 10.0
    first_65_plus_vintage: int = 2017
    small_cell: int = 10
    suppressed_service_pct: float = 33.0
    # Stands in for "today" where an event is still open, so a rerun gives the same answer.
    as_of: dt.date | None = None


DEFAULT = Params()
