"""Conversion by product, channel, age, credit, employment and channel x product."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions import AGE_GROUPS, CREDIT_BANDS, by_merge, display_name, mean_of
from ..operators import outcomes, reached, segment_conversion, tally
from ..operators.segments import (
    TOTAL,
    conversion_pct,
    conversion_rank,
    delta_of_rounded,
    rounded_delta,
    share_pct,
)
from ..sources import LoanBook

_APPROVED = ("approved", "disbursed")
_VERIFIED = ("verified", "approved", "disbursed")
_RATE = f"{conversion_pct('disbursed')} AS conv_rate_pct"
_AVG_AMOUNT = f"{mean_of('amount', 'amount_known', 0)} AS avg_loan_amount"


def _loan_types(book: LoanBook) -> DataFrame:
    log = book.log
    facts = book.loan_applications.select("application_id", "loan_type", "loan_amount")
    sums = {
        "amount": "loan_amount",
        "amount_known": "IF(loan_amount IS NULL, 0, 1)",
        "paid_out": f"IF({reached(log, 'disbursed')} = 1, loan_amount, 0)",
    }
    return tally(log, outcomes(log, facts), ["loan_type"], _VERIFIED, sums)


def conv_by_loan_type(book: LoanBook) -> DataFrame:
    return (
        _loan_types(book)
        .selectExpr(
            f"{display_name('loan_type')} AS loan_type",
            TOTAL,
            "verified AS reached_verification",
            "approved AS reached_approval",
            "disbursed AS total_disbursed",
            _RATE,
            _AVG_AMOUNT,
            "paid_out AS total_disbursed_value",
        )
        .orderBy("conv_rate_pct", "loan_type", ascending=[False, True])
    )


def segment_performance(book: LoanBook) -> DataFrame:
    """Loan types with their conversion rank."""
    return segment_figures(_loan_types(book))


def segment_figures(tallies: DataFrame) -> DataFrame:
    """The report from tallies per loan type."""
    return (
        tallies.selectExpr(
            f"{display_name('loan_type')} AS loan_type",
            TOTAL,
            *_VERIFIED,
            _RATE,
            _AVG_AMOUNT,
            "paid_out AS total_value_disbursed",
            f"{conversion_rank('disbursed')} AS conv_rank",
        )
        .orderBy("conv_rank", "loan_type")
    )


def _channels(book: LoanBook) -> DataFrame:
    people = book.applicants.select("applicant_id", "acquisition_channel")
    return segment_conversion(
        book.log, book.loan_applications, people, "applicant_id", ["acquisition_channel"], _APPROVED
    )


def conv_by_channel(book: LoanBook) -> DataFrame:
    return (
        _channels(book)
        .selectExpr(
            f"{display_name('acquisition_channel')} AS channel",
            TOTAL,
            *_APPROVED,
            _RATE,
            f"{share_pct()} AS channel_share_pct",
            f"{conversion_rank('disbursed')} AS conv_rank",
        )
        .orderBy("conv_rate_pct", "channel", ascending=[False, True])
    )


def channel_performance(book: LoanBook) -> DataFrame:
    """Channels with their share and their distance from the overall rate."""
    return channel_figures(_channels(book))


def channel_figures(tallies: DataFrame) -> DataFrame:
    """The report from tallies per channel."""
    return (
        tallies.selectExpr(
            f"{display_name('acquisition_channel')} AS channel",
            TOTAL,
            *_APPROVED,
            _RATE,
            f"{share_pct()} AS volume_share_pct",
            f"{rounded_delta('disbursed')} AS conv_vs_avg_pct",
            f"{conversion_rank('disbursed')} AS quality_rank",
        )
        .orderBy("quality_rank", "channel")
    )


def conv_by_age_group(book: LoanBook) -> DataFrame:
    people = book.applicants.selectExpr(
        "applicant_id",
        f"{AGE_GROUPS.label('age')} AS age_group",
        f"{AGE_GROUPS.position('age')} AS age_sort",
    )
    groups = segment_conversion(
        book.log, book.loan_applications, people, "applicant_id", ["age_group", "age_sort"], _VERIFIED
    )
    return (
        groups.selectExpr("*", f"{delta_of_rounded('disbursed')} AS diff_from_avg_pct")
        .orderBy("age_sort")
        .selectExpr(
            "age_group",
            TOTAL,
            "verified AS reached_verification",
            "approved AS reached_approval",
            "disbursed",
            _RATE,
            "diff_from_avg_pct",
        )
    )


def conv_by_credit_band(book: LoanBook) -> DataFrame:
    profiles = book.credit_profiles.selectExpr(
        "applicant_id",
        "credit_score",
        f"{CREDIT_BANDS.label('credit_score')} AS credit_band",
        f"{CREDIT_BANDS.position('credit_score')} AS band_sort",
    ).join(by_merge(book.applicants.select("applicant_id")), "applicant_id")
    bands = segment_conversion(
        book.log,
        book.loan_applications,
        profiles,
        "applicant_id",
        ["credit_band", "band_sort"],
        _APPROVED,
        weighted=["credit_score"],
    )
    return bands.orderBy("band_sort").selectExpr(
        "credit_band",
        TOTAL,
        *_APPROVED,
        _RATE,
        f"{mean_of('sum_credit_score', 'n_credit_score', 0)} AS avg_credit_score",
    )


def conv_by_employment(book: LoanBook) -> DataFrame:
    statuses = segment_conversion(
        book.log,
        book.loan_applications,
        book.applicants.select("applicant_id", "employment_status", "annual_income"),
        "applicant_id",
        ["employment_status"],
        _VERIFIED,
        weighted=["annual_income"],
    )
    return statuses.selectExpr(
        f"{display_name('employment_status')} AS employment_status",
        TOTAL,
        *_VERIFIED,
        _RATE,
        f"{mean_of('sum_annual_income', 'n_annual_income', 0)} AS avg_annual_income",
        f"{conversion_rank('disbursed')} AS conv_rank",
    ).orderBy("conv_rate_pct", "employment_status", ascending=[False, True])


def conv_channel_x_loan(
    book: LoanBook, min_sample: int = 5, min_permille: int = 0
) -> DataFrame:
    """Cells with at least ``min_sample`` applications and ``min_permille`` thousandths of all of
    them, ranked inside their channel by rounded rate."""
    cells = segment_conversion(
        book.log,
        book.loan_applications,
        book.applicants.select("applicant_id", "acquisition_channel"),
        "applicant_id",
        ["acquisition_channel", "loan_type"],
        ["disbursed"],
        keep=["loan_type"],
    )
    best_in_channel = "PARTITION BY channel ORDER BY conv_rate_pct DESC"
    return (
        cells.selectExpr("*", f"sum({TOTAL}) OVER () AS everything")
        .where(f"{TOTAL} >= {min_sample} AND {TOTAL} * 1000 >= everything * {min_permille}")
        .selectExpr(
            f"{display_name('acquisition_channel')} AS channel",
            f"{display_name('loan_type')} AS loan_type",
            TOTAL,
            "disbursed",
            _RATE,
        )
        .selectExpr(
            "*", f"CAST(rank() OVER ({best_in_channel}) AS BIGINT) AS rank_within_channel"
        )
        .orderBy("conv_rate_pct", "channel", "loan_type", ascending=[False, True, True])
    )
