"""Funnel volume, drop-off and monthly reports."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions import columns, display_name, month_label, percent, settled_round, text
from ..operators import (
    drop_offs,
    funnel,
    period_reach,
    period_trend,
    reach_totals,
    stage_counts,
    within_year,
)
from ..sources import LoanBook


# Texts that reports print.
_WORST_STEP_FLAG = "PRIORITY ACTION REQUIRED"
_BENCHMARK_LABEL = "Full-year avg ({year})"


def funnel_overview(book: LoanBook, drop_name: str = "drop_off_count") -> DataFrame:
    """Volume, drop-off, step and overall conversion per stage."""
    return (
        funnel(stage_counts(book.log))
        .selectExpr(
            "stage_order",
            f"{display_name('stage')} AS stage_name",
            "reached AS applications_reached",
            f"coalesce(lost, 0L) AS {drop_name}",
            "stage_conv_rate_pct",
            "overall_conv_rate_pct",
        )
        .orderBy("stage_order")
    )


def _drop_offs(book: LoanBook) -> DataFrame:
    return drop_offs(funnel(stage_counts(book.log))).selectExpr(
        "stage_order",
        f"{display_name('stage')} AS stage_name",
        "entered AS entered_stage",
        "reached AS passed_stage",
        "lost AS lost_applicants",
        "pct_lost",
        "severity_rank",
    )


def stage_dropoff(book: LoanBook) -> DataFrame:
    """Every step's loss, worst first."""
    return _drop_offs(book).orderBy("severity_rank", "stage_order")


def biggest_dropoff(book: LoanBook) -> DataFrame:
    """The step that loses most; the earlier step where two lose the same."""
    return (
        _drop_offs(book)
        .orderBy("severity_rank", "stage_order")
        .limit(1)
        .selectExpr(
            "stage_name AS biggest_drop_off_stage",
            "entered_stage",
            "passed_stage",
            "lost_applicants",
            "pct_lost AS pct_of_stage_lost",
            f"{text(_WORST_STEP_FLAG)} AS flag",
        )
    )


def funnel_summary(book: LoanBook) -> DataFrame:
    """One row of headline figures."""
    return reach_totals(book.log).selectExpr(
        "submitted AS total_applications",
        "under_review",
        "verified",
        "approved",
        "disbursed AS total_disbursed",
        f"{percent('disbursed', 'submitted')} AS end_to_end_conv_pct",
        "submitted - disbursed AS total_lost",
        f"{percent('submitted - disbursed', 'submitted')} AS pct_lost_overall",
    )


_MONTH_COLUMNS = (
    "period",
    "applications_submitted",
    "applications_disbursed",
    "mom_change",
    "rolling_3m_avg",
    "monthly_conv_pct",
)


def monthly_trend(book: LoanBook, year: int = 2023, window: int = 3) -> DataFrame:
    """Submissions and disbursals per month of one year, and the year's mean rate as a last row.

    Month rows sort by label, as the report prints them; :func:`monthly_trend_by_date` has them
    in calendar order.
    """
    months = _months(book, year, window)
    rows = months.selectExpr(*_MONTH_COLUMNS, "0 AS sort_order")
    benchmark = months.agg(
        *columns([f"{settled_round('avg(monthly_conv_pct)')} AS monthly_conv_pct"])
    ).selectExpr(f"{text(_BENCHMARK_LABEL.format(year=year))} AS period", "monthly_conv_pct", "1 AS sort_order")
    return rows.unionByName(benchmark, allowMissingColumns=True).orderBy("sort_order", "period")


def monthly_trend_by_date(book: LoanBook, year: int = 2023, window: int = 3) -> DataFrame:
    """Month rows of :func:`monthly_trend` with ``yr`` and ``mth``, in calendar order."""
    return _months(book, year, window).orderBy("yr", "mth")


def _months(book: LoanBook, year: int, window: int) -> DataFrame:
    ladder = book.log.ladder
    trend = period_trend(within_year(book.log, year), ladder.first, ladder.last, window)
    return trend.selectExpr(
        "CAST(year(period_start) AS BIGINT) AS yr",
        "CAST(month(period_start) AS BIGINT) AS mth",
        f"{month_label('period_start')} AS period",
        "opened AS applications_submitted",
        "closed AS applications_disbursed",
        "change AS mom_change",
        "rolling_avg AS rolling_3m_avg",
        "conv_pct AS monthly_conv_pct",
    )


def stage_month_heatmap(book: LoanBook) -> DataFrame:
    """Applications per month and stage, over all years."""
    return (
        period_reach(book.log)
        .orderBy("period_start")
        .selectExpr(
            f"{month_label('period_start')} AS month_label",
            "CAST(month(period_start) AS BIGINT) AS mth_num",
            *book.log.ladder.stages,
            f"{percent('disbursed', 'submitted')} AS monthly_end_to_end_pct",
        )
    )
