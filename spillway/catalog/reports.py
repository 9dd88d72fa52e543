"""The named reports over the loan book derived from a folder's order tables."""

from __future__ import annotations

import datetime as dt

from .. import plans
from ..operators import table_row_counts
from ..sources import loan_book_from_orders

# The order data runs from 1995 to 2001: report parameters that make sense for it.
TREND_YEAR = 1997
AS_OF = dt.date(2001, 12, 31)
#: About the median journey, so that the window cuts some chains short.
STRICT_DAYS = 9
#: A little below the mean of 30 cells, so that the filter takes some away at every size.
MIN_PERMILLE = 32


def over_book(report, **parameters):
    """A report over a loan book as a query over a folder."""

    def query(spark, folder):
        return report(loan_book_from_orders(spark, folder), **parameters)

    return query


def _view(name):
    return over_book(plans.read_view, name=name)


flagship = over_book(plans.funnel_overview)

REPORTS = {
    "table_row_counts": over_book(lambda book: table_row_counts(book.tables())),
    "funnel_overview": flagship,
    "biggest_dropoff": over_book(plans.biggest_dropoff),
    "funnel_summary": over_book(plans.funnel_summary),
    "monthly_trend": over_book(plans.monthly_trend, year=TREND_YEAR),
    "monthly_trend_by_date": over_book(plans.monthly_trend_by_date, year=TREND_YEAR),
    "stage_month_heatmap": over_book(plans.stage_month_heatmap),
    "conv_by_loan_type": over_book(plans.conv_by_loan_type),
    "conv_by_channel": over_book(plans.conv_by_channel),
    "conv_by_age_group": over_book(plans.conv_by_age_group),
    "conv_by_credit_band": over_book(plans.conv_by_credit_band),
    "conv_by_employment": over_book(plans.conv_by_employment),
    "conv_channel_x_loan": over_book(plans.conv_channel_x_loan, min_permille=MIN_PERMILLE),
    "stage_durations": over_book(plans.stage_durations),
    "journey_durations": over_book(plans.journey_durations),
    "response_tier_conversion": over_book(plans.response_tier_conversion),
    "time_to_convert_by_loan_type": over_book(plans.time_to_convert_by_loan_type),
    "stuck_applications": over_book(plans.stuck_applications, as_of=AS_OF),
    **{name: _view(name) for name in plans.VIEWS},
    "time_to_convert_by_channel": over_book(plans.time_to_convert_by_channel),
    "cohort_by_registration_month": over_book(plans.cohort_by_registration_month),
    "cohort_by_application_month": over_book(plans.cohort_by_application_month),
    "strict_cohort_by_application_month": over_book(
        plans.strict_cohort_by_application_month, within_days=STRICT_DAYS
    ),
    "approval_breaches": over_book(plans.approval_breaches, as_of=AS_OF),
    "registration_step": over_book(plans.registration_step),
    "fast_review_experiment": over_book(plans.fast_review_experiment),
    "fast_review_interval": over_book(plans.fast_review_interval),
}

#: What SQL cannot express: checked by its own tests.
MODELS = {
    "approval_probability": over_book(plans.approval_probability),
    "approval_evaluation": over_book(plans.approval_evaluation),
    "approval_calibration": over_book(plans.approval_calibration),
}
