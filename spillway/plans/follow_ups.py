"""Reports announced as next steps: cohorts, service levels, registration step, experiment."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame

from ..functions import by_merge, columns, percent
from ..operators import (
    bootstrap_lift,
    entity_progress,
    reached,
    response_gaps,
    segment_conversion,
    service_breaches,
    strict_cohorts,
    two_proportion_test,
)
from ..operators.segments import TOTAL, conversion_pct
from ..sources import LoanBook


def cohort_by_registration_month(book: LoanBook) -> DataFrame:
    """Conversion of applications by the month their applicant registered."""
    stages = ("approved", "disbursed")
    people = book.applicants.selectExpr(
        "applicant_id", "trunc(registration_date, 'month') AS cohort_month"
    )
    cohorts = segment_conversion(
        book.log, book.loan_applications, people, "applicant_id", ["cohort_month"], stages
    )
    return cohorts.selectExpr(
        "cohort_month", TOTAL, *stages, f"{conversion_pct('disbursed')} AS conv_rate_pct"
    ).orderBy("cohort_month")


def cohort_by_application_month(book: LoanBook) -> DataFrame:
    """Conversion of applications by the month they were submitted, whenever they were disbursed."""
    log = book.log
    start, *later = log.ladder.stages
    cohorts = (
        entity_progress(log, first_of=[start])
        .where(f"first_{start} IS NOT NULL")
        .groupBy(*columns([f"trunc(first_{start}, 'month') AS cohort_month"]))
        .agg(
            *columns([f"count(1) AS {start}"]),
            *columns(f"sum({reached(log, s)}) AS {s}" for s in later),
        )
    )
    return cohorts.selectExpr(
        "*", f"{percent(log.ladder.last, start)} AS conv_rate_pct"
    ).orderBy("cohort_month")


def strict_cohort_by_application_month(book: LoanBook, within_days: int | None = None) -> DataFrame:
    """The cohorts again, counting only applications that went through all stages in order."""
    return strict_cohorts(book.log, None if within_days is None else within_days * 86_400)


def approval_breaches(
    book: LoanBook, working_days: int = 5, as_of: dt.date = dt.date(2024, 1, 1)
) -> DataFrame:
    """Verified applications without an approval decision in time."""
    return service_breaches(book.log, "verified", "approved", working_days, as_of)


def registration_step(book: LoanBook) -> DataFrame:
    """The step in front of the funnel: registered applicants, and how many of them applied.

    Counts applicants on both sides, so that the rate compares like with like.
    """
    applied = book.loan_applications.select("applicant_id").distinct()
    return (
        book.applicants.select("applicant_id")
        .join(by_merge(applied.selectExpr("applicant_id", "1 AS applied")), "applicant_id", "left")
        .agg(
            *columns(
                [
                    "count(1) AS registered_applicants",
                    "count(applied) AS applicants_with_application",
                ]
            )
        )
        .selectExpr(
            "*",
            f"{percent('applicants_with_application', 'registered_applicants')}"
            " AS registered_to_submitted_pct",
        )
    )


def fast_review_experiment(book: LoanBook, within_hours: int = 6) -> DataFrame:
    """Do applications first reviewed within ``within_hours`` convert better than the others?

    The unit is the application: one row each, from its first submission to its first review.
    """
    log = book.log
    gaps = response_gaps(log, "submitted", "under_review", repeats="first")
    return two_proportion_test(
        gaps, f"hours <= {within_hours}", f"{reached(log, log.ladder.last)} = 1"
    )


def fast_review_interval(book: LoanBook, within_hours: int = 6, replicates: int = 200) -> DataFrame:
    """The experiment's lift within acquisition channels, with a bootstrap interval around it.

    The same units as in :func:`fast_review_experiment`; those without an applicant on record are
    a stratum of their own.
    """
    log = book.log
    gaps = response_gaps(log, "submitted", "under_review", repeats="first")
    people = book.applicants.selectExpr("applicant_id", "acquisition_channel AS channel")
    applied = book.loan_applications.select("application_id", "applicant_id")
    channels = applied.join(by_merge(people), "applicant_id", "left")
    return bootstrap_lift(
        gaps.join(by_merge(channels.select("application_id", "channel")), "application_id", "left"),
        "application_id",
        "channel",
        f"hours <= {within_hours}",
        f"{reached(log, log.ladder.last)} = 1",
        replicates,
    )
