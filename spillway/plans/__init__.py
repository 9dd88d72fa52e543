"""Named reports over a loan book."""

from .approval_model import (
    approval_calibration,
    approval_evaluation,
    approval_features,
    approval_probability,
    fit_approval,
    held_out_probability,
)
from .dashboard import VIEWS, create_views, executive_dashboard, read_view
from .follow_ups import (
    approval_breaches,
    cohort_by_application_month,
    cohort_by_registration_month,
    fast_review_experiment,
    fast_review_interval,
    registration_step,
    strict_cohort_by_application_month,
)
from .funnel_reports import (
    biggest_dropoff,
    funnel_overview,
    funnel_summary,
    monthly_trend,
    monthly_trend_by_date,
    stage_dropoff,
    stage_month_heatmap,
)
from .segment_reports import (
    channel_performance,
    conv_by_age_group,
    conv_by_channel,
    conv_by_credit_band,
    conv_by_employment,
    conv_by_loan_type,
    conv_channel_x_loan,
    segment_performance,
)
from .standing_reach import StandingReach
from .standing_views import StandingViews
from .timing_reports import (
    journey_durations,
    response_tier_conversion,
    stage_durations,
    stuck_applications,
    time_to_convert_by_channel,
    time_to_convert_by_loan_type,
)

__all__ = [
    "approval_calibration",
    "approval_evaluation",
    "approval_features",
    "approval_probability",
    "fit_approval",
    "StandingReach",
    "StandingViews",
    "VIEWS",
    "approval_breaches",
    "biggest_dropoff",
    "channel_performance",
    "cohort_by_application_month",
    "cohort_by_registration_month",
    "conv_by_age_group",
    "conv_by_channel",
    "conv_by_credit_band",
    "conv_by_employment",
    "conv_by_loan_type",
    "conv_channel_x_loan",
    "create_views",
    "executive_dashboard",
    "fast_review_experiment",
    "fast_review_interval",
    "funnel_overview",
    "funnel_summary",
    "held_out_probability",
    "journey_durations",
    "monthly_trend",
    "monthly_trend_by_date",
    "read_view",
    "registration_step",
    "response_tier_conversion",
    "segment_performance",
    "stage_dropoff",
    "stage_durations",
    "stage_month_heatmap",
    "strict_cohort_by_application_month",
    "stuck_applications",
    "time_to_convert_by_channel",
    "time_to_convert_by_loan_type",
]
