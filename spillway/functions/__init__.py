"""Column-level building blocks."""

from .bands import AGE_GROUPS, CREDIT_BANDS, JOURNEY_SPEEDS, RESPONSE_TIERS, Band, Bands
from .joins import by_merge
from .ladder import LOAN_LADDER, StageLadder, StageLog
from .scalars import (
    columns,
    day_of_hour,
    days_between,
    display_name,
    hour_number,
    hours_between,
    mean_of,
    month_label,
    name,
    percent,
    ratio,
    rows_of,
    settled_round,
    text,
    weekdays_after,
    whole_mean,
)

__all__ = [
    "AGE_GROUPS",
    "CREDIT_BANDS",
    "JOURNEY_SPEEDS",
    "LOAN_LADDER",
    "RESPONSE_TIERS",
    "Band",
    "Bands",
    "StageLadder",
    "StageLog",
    "by_merge",
    "columns",
    "day_of_hour",
    "days_between",
    "display_name",
    "hour_number",
    "hours_between",
    "mean_of",
    "month_label",
    "name",
    "percent",
    "ratio",
    "rows_of",
    "settled_round",
    "text",
    "weekdays_after",
    "whole_mean",
]
