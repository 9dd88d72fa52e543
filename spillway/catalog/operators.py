"""One small query per operator, over the whole loan book, so that each can be checked alone."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import (
    AGE_GROUPS,
    CREDIT_BANDS,
    JOURNEY_SPEEDS,
    RESPONSE_TIERS,
    by_merge,
    columns,
    days_between,
    display_name,
    hours_between,
    mean_of,
    month_label,
    percent,
    ratio,
    settled_round,
    whole_mean,
)
from ..operators import (
    drop_offs,
    entity_progress,
    exact_percentiles,
    funnel,
    furthest_stage,
    journeys,
    next_stages,
    outcomes,
    period_reach,
    ranked,
    reach_totals,
    reached,
    response_gaps,
    stage_counts,
    stage_transitions,
    strict_cohorts,
    strict_progress,
    tally,
    transition_summary,
    within_year,
)
from ..operators.segments import TOTAL, conversion_rank, overall_pct, share_pct
from ..plans.funnel_reports import monthly_trend_by_date
from ..sources import clickstream_log, read_table

from .reports import TREND_YEAR, over_book

_AS_OF = dt.date(2001, 12, 31)


def _count(frame, *by):
    return frame.groupBy(*by).agg(*columns(["count(1) AS n"]))


# Projections, filters, predicates.


def projection_alias(book):
    return book.loan_applications.selectExpr("application_id AS id", "loan_amount AS amount")


def computed_column(book):
    return book.credit_profiles.selectExpr(
        "applicant_id", "850 - credit_score AS points_below_best"
    )


def constant_columns(book):
    return book.applicants.selectExpr(
        "applicant_id", "'registered' AS flag", "0 AS sort_order", "CAST(NULL AS BIGINT) AS padding"
    )


def filter_equal(book):
    return book.application_events.where("stage = 'disbursed'").select("application_id", "event_timestamp")


def filter_not_equal(book):
    return _count(book.application_events.where("stage != 'disbursed'"), "stage")


def filter_is_not_null(book):
    return (
        entity_progress(book.log, first_of=["approved"])
        .where("first_approved IS NOT NULL")
        .selectExpr("application_id", "first_approved AS approved_at")
    )


def is_null_in_case(book):
    flagged = entity_progress(book.log, last_of=["disbursed"]).selectExpr(
        "CASE WHEN last_disbursed IS NULL THEN 'open' ELSE 'paid out' END AS outcome"
    )
    return _count(flagged, "outcome")


def filter_between(book):
    return book.applicants.where("age BETWEEN 26 AND 35").select("applicant_id", "age")


def filter_comparisons(book):
    chosen = "credit_score >= 600 AND debt_to_income_ratio < 0.40 AND existing_loans <= 3"
    return book.credit_profiles.where(f"{chosen} AND previous_defaults > 0").select(
        "applicant_id", "credit_score"
    )


def filter_row_number(book):
    """Latest-stage row per application; the top-1 is taken before the shuffle as well."""
    order = f"{book.log.ladder.order('stage')} DESC, event_timestamp DESC, event_id"
    return (
        book.application_events.selectExpr(
            "application_id",
            "stage",
            f"row_number() OVER (PARTITION BY application_id ORDER BY {order}) AS rn",
        )
        .where("rn = 1")
        .select("application_id", "stage")
    )


def filter_after_aggregate(book):
    return _count(book.loan_applications, "applicant_id").where("n >= 15")


def having_two_aggregates(book):
    days = entity_progress(book.log, first_of=["submitted"], last_of=["disbursed"])
    return days.where("first_submitted IS NOT NULL AND last_disbursed IS NOT NULL").selectExpr(
        "application_id", "first_submitted AS submitted_at", "last_disbursed AS disbursed_at"
    )


def filter_year(book):
    events = within_year(book.log, TREND_YEAR).rows("submitted")
    return events.selectExpr("application_id", "CAST(month(event_timestamp) AS BIGINT) AS mth")


def filter_in_list(book):
    return _count(
        book.loan_applications.where("loan_term_months IN (12, 36, 60)"), "loan_term_months"
    )


def quoted_identifier(book):
    return book.loan_applications.selectExpr("loan_type AS `table`", "loan_amount AS `amount due`").groupBy(
        "table"
    ).agg(F.sum("`amount due`").alias("total amount due"))


# Joins.


def join_fact_events(book):
    """Events are counted per application before they meet the application."""
    per_application = _count(book.application_events, "application_id", "stage")
    return (
        book.loan_applications.select("application_id", "loan_type")
        .join(by_merge(per_application), "application_id")
        .groupBy("loan_type", "stage")
        .agg(*columns(["sum(n) AS n"]))
    )


def join_dimension(book):
    per_person = _count(book.loan_applications, "applicant_id")
    people = book.applicants.select("applicant_id", "acquisition_channel")
    return per_person.join(by_merge(people), "applicant_id").groupBy("acquisition_channel").agg(
        *columns(["sum(n) AS n"])
    )


def join_four_tables(book):
    facts = outcomes(book.log, book.loan_applications.select("application_id", "applicant_id"))
    per_person = tally(book.log, facts, ["applicant_id"], ["disbursed"])
    return (
        per_person.join(by_merge(book.applicants.select("applicant_id", "age")), "applicant_id")
        .join(by_merge(book.credit_profiles.select("applicant_id", "credit_score")), "applicant_id")
        .groupBy("age")
        .agg(
            *columns(
                [
                    f"sum({TOTAL}) AS n",
                    "sum(disbursed) AS disbursed",
                    "min(credit_score) AS lowest_score",
                    "max(credit_score) AS highest_score",
                ]
            )
        )
    )


def join_stage_pair(book):
    """Submission joined to first review, each reduced to one row per application."""
    log = book.log
    opened = entity_progress(log.where("stage = 'submitted'"), first_of=["submitted"])
    answered = entity_progress(log.where("stage = 'under_review'"), first_of=["under_review"])
    pairs = opened.alias("s").join(by_merge(answered.alias("r")), "application_id")
    return pairs.selectExpr(
        "application_id", f"{hours_between('first_submitted', 'first_under_review')} AS hours"
    )


def join_derived_to_table(book):
    return journeys(book.log).join(
        by_merge(book.loan_applications.select("application_id", "loan_amount")), "application_id"
    ).select("application_id", "loan_amount", "total_days")


def join_aggregate_to_detail(book):
    """Each application's amount against the mean of its loan type; whether the means are
    broadcast is left to their measured size."""
    means = book.loan_applications.groupBy("loan_type").agg(
        *columns([f"{mean_of('sum(loan_amount)', 'count(loan_amount)', 0)} AS type_mean"])
    )
    return (
        book.loan_applications.join(means, "loan_type")
        .where("loan_amount > 1.9 * type_mean")
        .select("application_id", "loan_amount", "type_mean")
    )


def left_join_months(book):
    """Months of submissions with the approvals of the same month, where there are any."""
    months = period_reach(book.log).selectExpr(
        "CAST(year(period_start) AS BIGINT) AS yr",
        "CAST(month(period_start) AS BIGINT) AS mth",
        "submitted",
        "approved",
    )
    opened = months.where("submitted > 0").select("yr", "mth", "submitted")
    closed = months.where("approved > 0 AND mth != 2").select("yr", "mth", "approved")
    return opened.join(closed, ["yr", "mth"], "left").selectExpr(
        "yr", "mth", "submitted", "coalesce(approved, 0L) AS approved"
    )


def join_derived_aggregate(book):
    outcome = entity_progress(book.log).selectExpr(
        "application_id", f"{reached(book.log, 'disbursed')} AS paid"
    )
    return book.loan_applications.join(by_merge(outcome), "application_id").groupBy("paid").agg(
        *columns(["count(1) AS n", "sum(loan_amount) AS amount"])
    )


def combine_single_rows(book):
    """One-row results side by side, as scalar subqueries."""
    amount = book.loan_applications.agg(F.sum("loan_amount").alias("v")).scalar()
    best = book.credit_profiles.agg(F.max("credit_score").alias("v")).scalar()
    return book.applicants.agg(*columns(["count(1) AS applicants"])).select(
        "applicants", amount.alias("total_amount"), best.alias("best_score")
    )


def rejoin_outcomes(book):
    gaps = response_gaps(book.log, "submitted", "under_review")
    return gaps.selectExpr(
        "application_id",
        "hours",
        f"{reached(book.log, 'approved')} AS is_approved",
        f"{reached(book.log, 'disbursed')} AS is_disbursed",
    )


def rows_without_partner(book):
    """Applicants who never applied for a one-year home loan.  Applications are reduced to distinct
    applicants first, so one with very many of them is one row in the join."""
    applied = book.loan_applications.where("loan_type = 'home_loan' AND loan_term_months = 12")
    return book.applicants.select("applicant_id").join(
        by_merge(applied.select("applicant_id").distinct()), "applicant_id", "left_anti"
    )


# Aggregations.


def count_rows(book):
    return book.application_events.agg(*columns(["count(1) AS n"]))


def count_distinct_entities(book):
    return stage_counts(book.log)


def conditional_distinct_counts(book):
    return reach_totals(book.log)


def flag_aggregate(book):
    return entity_progress(book.log).selectExpr(
        "application_id",
        *[f"{reached(book.log, s)} AS is_{s}" for s in ("verified", "approved", "disbursed")],
    )


def conditional_first_last(book):
    return entity_progress(book.log, first_of=["submitted"], last_of=["disbursed"]).selectExpr(
        "application_id", "first_submitted AS submitted_at", "last_disbursed AS disbursed_at"
    )


def sum_flags(book):
    facts = outcomes(book.log, book.loan_applications.select("application_id", "loan_term_months"))
    return tally(book.log, facts, ["loan_term_months"], ["verified", "approved", "disbursed"])


def conditional_sum(book):
    facts = outcomes(book.log, book.loan_applications.select("application_id", "loan_amount"))
    paid = f"{reached(book.log, 'disbursed')} = 1"
    return facts.agg(
        *columns(
            [
                f"sum(CASE WHEN {paid} THEN loan_amount ELSE 0 END) AS paid_out",
                f"sum(CASE WHEN {paid} THEN 0 ELSE loan_amount END) AS at_risk",
            ]
        )
    )


def sum_column(book):
    return book.loan_applications.agg(*columns(["sum(loan_amount) AS total_amount"]))


def average_as_double(book):
    return book.applicants.groupBy("employment_status").agg(
        *columns([f"{settled_round('avg(CAST(annual_income AS DOUBLE))', 0)} AS avg_income"])
    )


def conditional_average(book):
    facts = outcomes(
        book.log,
        book.loan_applications.select("application_id", "loan_type"),
        first_of=["submitted"],
        last_of=["disbursed"],
    )
    days = days_between("first_submitted", "last_disbursed")
    paid = f"{reached(book.log, 'disbursed')} = 1"
    return facts.groupBy("loan_type").agg(
        *columns(
            [f"{settled_round(f'avg(CASE WHEN {paid} THEN CAST({days} AS DOUBLE) END)')} AS avg_days"]
        )
    )


def min_max(book):
    return book.loan_applications.groupBy("loan_type").agg(
        *columns(["min(loan_amount) AS smallest", "max(loan_amount) AS largest"])
    )


def conditional_min_max(book):
    return book.credit_profiles.agg(
        *columns(
            [
                "min(CASE WHEN previous_defaults = 0 THEN credit_score END) AS lowest_clean",
                "max(CASE WHEN previous_defaults > 0 THEN credit_score END) AS highest_defaulted",
            ]
        )
    )


def median_by_group(book):
    """Exact interpolated median from a histogram, so no group is held in one task."""
    histogram = _count(
        journeys(book.log).join(
            by_merge(book.loan_applications.select("application_id", "loan_type")), "application_id"
        ),
        "loan_type",
        "total_days",
    )
    return histogram.groupBy("loan_type").agg(
        F.percentile("total_days", F.lit(0.5), F.col("n")).alias("median_days")
    )


def global_aggregate(book):
    return book.credit_profiles.agg(
        *columns(
            [
                "count(1) AS n",
                "sum(existing_loans) AS existing_loans",
                "max(debt_to_income_ratio) AS highest_ratio",
            ]
        )
    )


def group_by_expression(book):
    return (
        book.application_events.groupBy(
            *columns(
                [
                    "CAST(year(event_timestamp) AS BIGINT) AS yr",
                    "CAST(month(event_timestamp) AS BIGINT) AS mth",
                ]
            ),
            F.expr(month_label("event_timestamp")).alias("label"),
        )
        .agg(*columns(["count(1) AS n"]))
    )


def group_with_sort_key(book):
    banded = book.applicants.selectExpr(
        f"{AGE_GROUPS.label('age')} AS age_group", f"{AGE_GROUPS.position('age')} AS age_sort"
    )
    return _count(banded, "age_group", "age_sort").orderBy("age_sort")


def average_of_averages(book):
    return monthly_trend_by_date(book, TREND_YEAR).agg(
        *columns([f"{settled_round('avg(monthly_conv_pct)')} AS mean_monthly_pct"])
    )


def two_level_aggregate(book):
    per_application = entity_progress(book.log).selectExpr(
        f"{book.log.ladder.name_at('bit_count(stage_set)')} AS stages_seen", "application_id"
    )
    return _count(per_application, "stages_seen")


def select_distinct(book):
    return book.loan_applications.select("loan_type", "loan_term_months").distinct()


# Windows.


def window_lag(book):
    return funnel(stage_counts(book.log)).select("stage_order", "reached", "entered")


def window_first_value(book):
    return funnel(stage_counts(book.log)).select("stage_order", "overall_conv_rate_pct")


def window_month_over_month(book):
    return monthly_trend_by_date(book, TREND_YEAR).select("yr", "mth", "mom_change")


def window_moving_average(book):
    return monthly_trend_by_date(book, TREND_YEAR).select("yr", "mth", "rolling_3m_avg")


def lead_next_timestamp(book):
    """The first visit of each stage, and the first visit of the next stage present."""
    return next_stages(book.log).selectExpr("application_id", "stage_order", "next_at")


def lead_next_stage(book):
    ladder = book.log.ladder
    steps = next_stages(book.log).selectExpr(
        f"{ladder.name_at('stage_order')} AS stage", f"{ladder.name_at('next_order')} AS next_stage"
    )
    return _count(steps, "stage", "next_stage")


def lead_every_event(book):
    """Every event's step to the next, repeats included: how many equal steps an application has."""
    return _equal_steps(stage_transitions(book.log), "application_id")


def _equal_steps(steps, entity):
    return steps.groupBy(entity, "stage_order", "next_order", "hours", "days").agg(
        *columns(["sum(weight) AS steps"])
    )


def row_number_furthest(book):
    return furthest_stage(book.log)


def rank_by_ratio(book):
    facts = outcomes(book.log, book.loan_applications.select("application_id", "loan_term_months"))
    return tally(book.log, facts, ["loan_term_months"], ["disbursed"]).selectExpr(
        "loan_term_months", f"{conversion_rank('disbursed')} AS conv_rank"
    )


def rank_in_partition(book):
    facts = outcomes(
        book.log, book.loan_applications.select("application_id", "loan_type", "loan_term_months")
    )
    rated = tally(book.log, facts, ["loan_type", "loan_term_months"], ["approved"]).selectExpr(
        "loan_type", "loan_term_months", f"{percent('approved', TOTAL)} AS rate"
    )
    return rated.selectExpr(
        "*", "CAST(rank() OVER (PARTITION BY loan_type ORDER BY rate DESC) AS BIGINT) AS place"
    )


def rank_by_difference(book):
    return drop_offs(funnel(stage_counts(book.log))).select("stage_order", "lost", "severity_rank")


def share_of_total(book):
    totals = book.loan_applications.groupBy("loan_type").agg(*columns([f"count(1) AS {TOTAL}"]))
    return totals.selectExpr("loan_type", f"{share_pct()} AS share_pct")


def overall_average(book):
    facts = outcomes(book.log, book.loan_applications.select("application_id", "loan_type"))
    return tally(book.log, facts, ["loan_type"], ["disbursed"]).selectExpr(
        "loan_type",
        f"{percent('disbursed', TOTAL)} AS rate",
        f"{overall_pct('disbursed')} AS overall_rate",
    )


def _journey_means(book, mean):
    totals = journeys(book.log).agg(
        *columns([f"{mean('sum(total_days)', 'count(total_days)')} AS v"])
    )
    return totals.scalar()


def integer_mean_of_detail(book):
    mean = _journey_means(book, whole_mean)
    return journeys(book.log).select(
        "application_id", (F.col("total_days") > mean * 2).alias("over_twice_mean")
    )


def double_mean_of_detail(book):
    mean = _journey_means(book, lambda total, n: mean_of(total, n, 1))
    return journeys(book.log).select("application_id", "total_days", mean.alias("mean_days"))


def windowed_median(book):
    return transition_summary(stage_transitions(book.log)).select("stage_order", "median_days")


# Sorts and top rows.


def sort_ascending(book):
    return _count(book.loan_applications, "loan_term_months").orderBy("loan_term_months")


def sort_descending_with_tiebreak(book):
    return book.loan_applications.select("application_id", "loan_amount").orderBy(
        "loan_amount", "application_id", ascending=[False, True]
    )


def sort_by_hidden_expression(book):
    order = F.expr(book.log.ladder.order("stage"))
    return _count(book.application_events, "stage").orderBy(order)


def top_one(book):
    return (
        book.loan_applications.orderBy(F.desc("loan_amount"), "application_id")
        .limit(1)
        .select("application_id", "loan_amount")
    )


# Set operations.


def union_all(book):
    early = book.application_events.where("stage = 'submitted'").select("application_id")
    late = book.application_events.where("stage = 'disbursed'").select("application_id")
    return _count(early.union(late), "application_id")


def union_with_padding(book):
    """Rows and their total line; the columns a line lacks are NULL."""
    types = _count(book.loan_applications, "loan_type").withColumn("sort_order", F.lit(0))
    total = book.loan_applications.agg(
        *columns([f"{settled_round('avg(loan_amount)', 0)} AS avg_amount"])
    ).selectExpr("'all types' AS loan_type", "avg_amount", "1 AS sort_order")
    return types.unionByName(total, allowMissingColumns=True).orderBy("sort_order", "loan_type")


# Scalar functions.


def text_replace(book):
    return _count(
        book.applicants.selectExpr(f"{display_name('acquisition_channel')} AS channel"), "channel"
    )


def coalesce_to_zero(book):
    applied = _count(book.loan_applications, "applicant_id")
    return book.applicants.select("applicant_id").join(by_merge(applied), "applicant_id", "left").selectExpr(
        "applicant_id", "coalesce(n, 0L) AS applications"
    )


def division_guard(book):
    """Disbursals per submission of a day; NULL on days without submissions."""
    return period_reach(book.log, "day").selectExpr(
        "period_start", f"{percent('disbursed', 'submitted')} AS pct"
    )


def round_to_tenth(book):
    return book.credit_profiles.selectExpr(
        "applicant_id", f"{settled_round('credit_score / 7.0')} AS sevenths"
    )


def round_to_whole(book):
    return book.loan_applications.selectExpr(
        "application_id", f"{settled_round('loan_amount / 8.0', 0)} AS eighths"
    )


def cast_to_double(book):
    return book.credit_profiles.selectExpr(
        "applicant_id", "CAST(credit_score AS DOUBLE) / 850 AS score_ratio"
    )


def cast_to_date(book):
    return _count(
        book.application_events.selectExpr("CAST(event_timestamp AS DATE) AS event_date"),
        "event_date",
    )


def year_and_month(book):
    parts = book.applicants.selectExpr(
        "CAST(year(registration_date) AS BIGINT) AS yr",
        "CAST(month(registration_date) AS BIGINT) AS mth",
    )
    return _count(parts, "yr", "mth")


def month_name(book):
    return _count(
        book.loan_applications.selectExpr(f"{month_label('application_date')} AS label"), "label"
    )


def hours_crossed(book):
    """Between first visits of consecutive stages."""
    return (
        next_stages(book.log)
        .where("next_at IS NOT NULL")
        .selectExpr("application_id", "stage_order", f"{hours_between('at', 'next_at')} AS hours")
    )


def days_crossed(book):
    """Between first visits of consecutive stages."""
    return (
        next_stages(book.log)
        .where("next_at IS NOT NULL")
        .selectExpr("application_id", "stage_order", f"{days_between('at', 'next_at')} AS days")
    )


def days_until_date(book):
    return furthest_stage(book.log).selectExpr(
        "application_id", f"{days_between('last_activity', f'''DATE '{_AS_OF}' ''')} AS days_idle"
    )


def arithmetic(book):
    return book.loan_applications.selectExpr(
        "application_id",
        "loan_amount * 3 - 1000 AS scaled",
        f"{settled_round(ratio('loan_amount', 'loan_term_months'), 2)} AS per_month",
    )


def stage_ordinal(book):
    return _count(
        book.application_events.selectExpr("stage", f"{book.log.ladder.order('stage')} AS position"),
        "stage",
        "position",
    )


def _banded(frame, bands, value):
    return _count(
        frame.selectExpr(f"{bands.label(value)} AS band", f"{bands.position(value)} AS position"),
        "band",
        "position",
    )


def bands_age(book):
    return _banded(book.applicants, AGE_GROUPS, "age")


def bands_credit(book):
    return _banded(book.credit_profiles, CREDIT_BANDS, "credit_score")


def bands_journey(book):
    return _banded(journeys(book.log), JOURNEY_SPEEDS, "total_days")


def bands_response(book):
    return _banded(response_gaps(book.log, "submitted", "under_review"), RESPONSE_TIERS, "hours")


def outlier_flag(book):
    mean = _journey_means(book, whole_mean)
    flagged = journeys(book.log).select(
        F.when(F.col("total_days") > mean * 2, "OUTLIER").otherwise("Normal").alias("flag")
    )
    return _count(flagged, "flag")


def default_for_first_stage(book):
    return funnel(stage_counts(book.log)).select("stage_order", "stage_conv_rate_pct")


# Composition.


def steps_of_steps(book):
    """A chain of derived relations: totals, steps, losses, worst loss."""
    return drop_offs(funnel(stage_counts(book.log))).agg(
        *columns(["max(lost) AS worst_loss", "sum(lost) AS all_lost"])
    )


def relation_used_twice(book):
    """Months above the mean month, from one set of months."""
    months = monthly_trend_by_date(book, TREND_YEAR)
    mean = months.agg(F.avg("applications_submitted").alias("v")).scalar()
    return months.where(F.col("applications_submitted") > mean).select(
        "yr", "mth", "applications_submitted"
    )


def derived_table(book):
    per_person = book.loan_applications.groupBy("applicant_id").agg(
        *columns(["count(1) AS applications", "sum(loan_amount) AS amount"])
    )
    return per_person.groupBy("applications").agg(
        *columns(["count(1) AS applicants", "sum(amount) AS amount"])
    )


def two_aliases(book):
    """Later events of an application next to its submission, one row per stage and application."""
    log = book.log
    first = entity_progress(log.where("stage = 'submitted'"), first_of=["submitted"]).alias("a")
    others = next_stages(log).where("stage_order > 1").alias("b")
    return first.join(by_merge(others), "application_id").selectExpr(
        "application_id",
        "b.stage_order AS stage_order",
        f"{days_between('a.first_submitted', 'b.at')} AS days_since_submission",
    )


def rank_of_applicants(book):
    """Every applicant by the share of applications paid out, and by the amount applied for."""
    log = book.log
    facts = outcomes(log, book.loan_applications.select("application_id", "applicant_id", "loan_amount"))
    people = tally(log, facts, ["applicant_id"], ["disbursed"], {"amount": "loan_amount"})
    by_rate = ranked(people, f"CAST(disbursed AS DOUBLE) / {TOTAL}", "rate_rank")
    return ranked(by_rate, "amount", "amount_rank").select(
        "applicant_id", TOTAL, "disbursed", "amount", "rate_rank", "amount_rank"
    )


def percentiles_of_amounts(book):
    """Quartiles and the ninth decile of the amounts of each loan type."""
    found = exact_percentiles(book.loan_applications, ["loan_type"], "loan_amount", (0.25, 0.5, 0.75, 0.9))
    return found.selectExpr("loan_type", "fraction", "n", f"{settled_round('percentile', 3)} AS amount")


def median_review_seconds(book):
    """The median time from submission to review in seconds, of each month."""
    log = book.log
    seconds = "(datediff({0}, DATE'1970-01-01') * 86400L + hour({0}) * 3600 + minute({0}) * 60 + CAST(floor(second({0})) AS INT))"
    waits = entity_progress(log, first_of=["submitted", "under_review"]).selectExpr(
        "CAST(trunc(first_submitted, 'month') AS DATE) AS submitted_month",
        f"{seconds.format('first_under_review')} - {seconds.format('first_submitted')} AS wait",
    )
    found = exact_percentiles(waits, ["submitted_month"], "wait")
    return found.selectExpr("submitted_month", "n", f"{settled_round('percentile', 3)} AS median_seconds")


# A second, messy log: generic operators with another ladder and entity.


def _clicks(operator):
    return lambda spark, folder: operator(clickstream_log(read_table(spark, folder, "events")))


def click_funnel(log):
    return funnel(stage_counts(log))


def click_transitions(log):
    return transition_summary(stage_transitions(log, repeats="first"))


def click_transitions_all(log):
    return transition_summary(stage_transitions(log))


def click_steps(log):
    return _equal_steps(stage_transitions(log), log.entity)


def click_journeys(log):
    return journeys(log)


def click_response_gaps(log):
    return response_gaps(log, "view", "purchase").select("visit_id", "hours")


def click_furthest(log):
    return furthest_stage(log)


def click_strict(log):
    """How far user-days come when the stages count in order and within six hours."""
    return strict_progress(log, 6 * 3600).select("visit_id", "stage_order", "entered_on")


def click_strict_cohorts(log):
    return strict_cohorts(log, period="week")


def click_days(log):
    return period_reach(log, "day")


_OVER_BOOK = (
    projection_alias, computed_column, constant_columns, filter_equal, filter_not_equal,
    filter_is_not_null, is_null_in_case, filter_between, filter_comparisons, filter_row_number,
    filter_after_aggregate, having_two_aggregates, filter_year, filter_in_list, quoted_identifier,
    join_fact_events, join_dimension, join_four_tables, join_stage_pair, join_derived_to_table,
    join_aggregate_to_detail, left_join_months, join_derived_aggregate, combine_single_rows,
    rejoin_outcomes, rows_without_partner, count_rows, count_distinct_entities,
    conditional_distinct_counts, flag_aggregate, conditional_first_last, sum_flags, conditional_sum,
    sum_column, average_as_double, conditional_average, min_max, conditional_min_max,
    median_by_group, global_aggregate, group_by_expression, group_with_sort_key,
    average_of_averages, two_level_aggregate, select_distinct, window_lag, window_first_value,
    window_month_over_month, window_moving_average, lead_next_timestamp, lead_next_stage,
    lead_every_event, row_number_furthest, rank_by_ratio, rank_in_partition, rank_by_difference,
    share_of_total, overall_average, integer_mean_of_detail, double_mean_of_detail,
    windowed_median, sort_ascending, sort_descending_with_tiebreak, sort_by_hidden_expression,
    top_one, union_all, union_with_padding, text_replace, coalesce_to_zero, division_guard,
    round_to_tenth, round_to_whole, cast_to_double, cast_to_date, year_and_month, month_name,
    hours_crossed, days_crossed, days_until_date, arithmetic, stage_ordinal, bands_age,
    bands_credit, bands_journey, bands_response, outlier_flag, default_for_first_stage,
    steps_of_steps, relation_used_twice, derived_table, two_aliases, rank_of_applicants,
    percentiles_of_amounts, median_review_seconds,
)
_OVER_CLICKS = (
    click_funnel, click_transitions, click_transitions_all, click_steps, click_journeys, click_response_gaps,
    click_furthest, click_strict, click_strict_cohorts, click_days,
)

OPERATORS = {
    **{query.__name__: over_book(query) for query in _OVER_BOOK},
    **{query.__name__: _clicks(query) for query in _OVER_CLICKS},
}
