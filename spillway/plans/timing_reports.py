"""Time in stages, journey length, response speed, stuck applications."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame

from ..functions import (
    JOURNEY_SPEEDS,
    RESPONSE_TIERS,
    by_merge,
    columns,
    days_between,
    display_name,
    mean_of,
    whole_mean,
)
from ..operators import (
    journeys,
    outcomes,
    reached,
    response_gaps,
    stage_transitions,
    stuck_report,
    tally,
    transition_summary,
)
from ..operators.segments import TOTAL, conversion_pct
from ..sources import LoanBook


def stage_durations(book: LoanBook, repeats: str = "keep") -> DataFrame:
    """How long applications spend between one stage and the next.

    ``repeats`` as for :func:`~spillway.operators.stage_transitions`.
    """
    ladder = book.log.ladder
    return (
        transition_summary(stage_transitions(book.log, repeats))
        .orderBy("stage_order", "next_order")
        .selectExpr(
            f"{display_name(ladder.name_at('stage_order'))} AS stage",
            f"{display_name(ladder.name_at('next_order'))} AS transitions_to",
            "transitions AS transitions_observed",
            "avg_hours",
            "avg_days",
            "min_days",
            "max_days",
            "median_days",
        )
    )


def journey_durations(book: LoanBook, outlier_factor: int = 2, ordered: bool = True) -> DataFrame:
    """One row per disbursed application, longest journey first.

    An outlier took more than ``outlier_factor`` times the mean, which is cut to whole days for
    this test.  Both means come from one scalar subquery; a window over all rows would put them
    all into one task.
    """
    finished = journeys(book.log).join(
        by_merge(book.loan_applications.select("application_id", "loan_type", "loan_amount")), "application_id"
    )
    days, n = "sum(total_days)", "count(total_days)"
    means = finished.agg(
        *columns(
            [f"named_struct('whole', {whole_mean(days, n)}, 'shown', {mean_of(days, n, 1)}) AS m"]
        )
    ).scalar()
    report = (
        finished.withColumn("means", means)
        .selectExpr(
            "application_id",
            f"{display_name('loan_type')} AS loan_type",
            "loan_amount",
            "CAST(started_at AS DATE) AS submitted_date",
            "CAST(ended_at AS DATE) AS disbursed_date",
            "total_days",
            f"{JOURNEY_SPEEDS.label('total_days')} AS journey_category",
            f"IF(total_days > {outlier_factor} * means.whole, 'OUTLIER', 'Normal') AS outlier_flag",
            "means.shown AS overall_avg_days",
        )
    )
    if not ordered:
        return report
    return report.orderBy("total_days", "application_id", ascending=[False, True])


def response_tier_conversion(book: LoanBook, repeats: str = "keep") -> DataFrame:
    """Conversion by the time from submission to first review.

    An application with repeated submissions or reviews counts once per distinct hour gap;
    ``repeats="first"`` counts it once.
    """
    gaps = response_gaps(book.log, "submitted", "under_review", repeats).selectExpr(
        "*", f"{RESPONSE_TIERS.label('hours')} AS response_tier"
    )
    stages = ("approved", "disbursed")
    return (
        tally(book.log, gaps, ["response_tier"], stages, {"hours": "hours"})
        .selectExpr(
            "response_tier",
            TOTAL,
            *stages,
            f"{conversion_pct('disbursed')} AS conv_rate_pct",
            f"{mean_of('hours', TOTAL, 1)} AS avg_hours_to_review",
        )
        .orderBy("response_tier")
    )


def _journey_tally(book: LoanBook, by: str) -> DataFrame:
    """Applications, disbursals and days to disburse per fact column ``by``."""
    log = book.log
    start, end = log.ladder.first, log.ladder.last
    facts = book.loan_applications.select("application_id", by)
    days = days_between(f"first_{start}", f"last_{end}")
    return (
        outcomes(log, facts, first_of=[start], last_of=[end])
        .groupBy(by)
        .agg(
            *columns(
                [
                    f"count(1) AS {TOTAL}",
                    f"sum({reached(log, end)}) AS disbursed",
                    f"sum({days}) AS days",
                    f"count({days}) AS days_known",
                    f"min({days}) AS fastest_days",
                    f"max({days}) AS slowest_days",
                ]
            )
        )
    )


def _journey_report(tallies: DataFrame, by: str) -> DataFrame:
    return tallies.selectExpr(
        f"{display_name(by)} AS {by}",
        TOTAL,
        "disbursed",
        f"{conversion_pct('disbursed')} AS conv_rate_pct",
        f"{mean_of('days', 'days_known', 1)} AS avg_days_to_disburse",
        "fastest_days",
        "slowest_days",
    ).orderBy("avg_days_to_disburse", by, ascending=[False, True])


def time_to_convert_by_loan_type(book: LoanBook) -> DataFrame:
    return _journey_report(_journey_tally(book, "loan_type"), "loan_type")


def time_to_convert_by_channel(book: LoanBook) -> DataFrame:
    """As by loan type; journeys are tallied per applicant before the channel is looked up."""
    people = book.applicants.selectExpr("applicant_id", "acquisition_channel AS channel")
    channels = (
        _journey_tally(book, "applicant_id")
        .join(by_merge(people), "applicant_id")
        .groupBy("channel")
        .agg(
            *columns(f"sum({c}) AS {c}" for c in (TOTAL, "disbursed", "days", "days_known")),
            *columns(
                ["min(fastest_days) AS fastest_days", "max(slowest_days) AS slowest_days"]
            ),
        )
    )
    return _journey_report(channels, "channel")


def stuck_applications(book: LoanBook, as_of: dt.date = dt.date(2024, 1, 1)) -> DataFrame:
    """Applications that never reached disbursement, by the last stage they reached."""
    return (
        stuck_report(book.log, book.loan_applications, "loan_amount", as_of)
        .orderBy("stage_order")
        .selectExpr(
            f"{display_name('stage')} AS stuck_at_stage",
            "entities AS abandoned_applications",
            "avg_days_inactive",
            "avg_amount AS avg_loan_amount",
            "total_amount AS total_revenue_at_risk",
        )
    )
