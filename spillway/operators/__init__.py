"""Generic operators over stage logs."""

from .experiments import bootstrap_lift, two_proportion_test
from .order_statistics import exact_percentiles, ranked
from .periods import period_reach, period_trend, within_year
from .progress import entity_progress, furthest_stage, journeys, reached
from .quality import (
    InRange,
    NotNull,
    OneOf,
    References,
    Unique,
    constraint_violations,
    primary_key,
    table_row_counts,
)
from .reach import (
    reach_between,
    reach_sketches,
    reach_words,
    rolling_reach,
    sketched_between,
)
from .responses import differences, response_gaps
from .scoring import area_under_curve, calibration
from .segments import outcomes, roll_up, segment_conversion, tally
from .service_levels import service_breaches
from .strict import strict_cohorts, strict_progress
from .stuck import stuck_report
from .transitions import next_stages, stage_transitions, transition_summary
from .volumes import drop_offs, funnel, reach_totals, stage_counts

__all__ = [
    "InRange",
    "NotNull",
    "OneOf",
    "References",
    "Unique",
    "area_under_curve",
    "bootstrap_lift",
    "calibration",
    "constraint_violations",
    "differences",
    "drop_offs",
    "entity_progress",
    "exact_percentiles",
    "funnel",
    "furthest_stage",
    "journeys",
    "next_stages",
    "outcomes",
    "period_reach",
    "period_trend",
    "primary_key",
    "ranked",
    "reach_between",
    "reach_sketches",
    "reach_totals",
    "reach_words",
    "reached",
    "response_gaps",
    "roll_up",
    "rolling_reach",
    "segment_conversion",
    "service_breaches",
    "sketched_between",
    "stage_counts",
    "stage_transitions",
    "strict_cohorts",
    "strict_progress",
    "stuck_report",
    "table_row_counts",
    "tally",
    "transition_summary",
    "two_proportion_test",
    "within_year",
]
