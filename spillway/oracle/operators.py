"""DuckDB statements for the single-operator queries."""

from .bands import AGES, CREDIT, JOURNEYS, RESPONSES, Ladder
from .reports import REPORTS, mean, pct
from .streams import CLICK_STEPS, STREAMS

_STEPS = STREAMS["live_loan_funnel"]
_MONTHS = REPORTS["monthly_trend_by_date"]

_TRIPS = """(SELECT application_id, date_diff('day', submitted_at, disbursed_at) AS total_days
  FROM app WHERE submitted_at IS NOT NULL AND disbursed_at IS NOT NULL)"""

#: One row per application and stage with the next stage present.
_ALONG = """(SELECT application_id, stage_order, stage, event_timestamp AS t,
    lead(event_timestamp) OVER w AS t_next, lead(stage_order) OVER w AS order_next,
    lead(stage) OVER w AS stage_next
  FROM application_events JOIN ladder USING (stage)
  WINDOW w AS (PARTITION BY application_id ORDER BY stage_order))"""

_GAPS = """(SELECT application_id, date_diff('hour', submitted_at, reviewed_at) AS hours
  FROM app WHERE submitted_at IS NOT NULL AND reviewed_at IS NOT NULL)"""

_FIRST_CLICKS = """(SELECT visit_id, stage_order, min(ts) AS t
  FROM visits JOIN click_ladder USING (stage) GROUP BY ALL)"""


def _click_moves(source: str, order: str) -> str:
    return f"""
WITH moves AS (
  SELECT stage_order, order_next AS next_order, date_diff('hour', t, t_next) AS h,
         date_diff('day', t, t_next) AS d
  FROM (SELECT stage_order, t, lead(stage_order) OVER w AS order_next, lead(t) OVER w AS t_next
        FROM {source} WINDOW w AS (PARTITION BY visit_id ORDER BY {order}))
  WHERE t_next IS NOT NULL
), middle AS (
  SELECT stage_order, round(round(quantile_cont(CAST(d AS DOUBLE), 0.5), 8), 1) AS median_days
  FROM moves GROUP BY 1
)
SELECT stage_order, next_order, any_value(median_days) AS median_days, count(*) AS transitions,
       {mean("h")} AS avg_hours, {mean("d")} AS avg_days, min(d) AS min_days, max(d) AS max_days
FROM moves JOIN middle USING (stage_order) GROUP BY stage_order, next_order"""


def _bands(source: str, ladder: Ladder, value: str) -> str:
    return f"""
SELECT {ladder.label(value)} AS band, {ladder.place(value)} AS position, count(*) AS n
FROM {source} GROUP BY 1, 2"""


_BY_TERM = "loan_applications JOIN app USING (application_id) GROUP BY loan_term_months"
_PAID = "count(*) FILTER (WHERE is_disbursed)"

OPERATORS = {
    # Projections, filters, predicates.
    "projection_alias": "SELECT application_id AS id, loan_amount AS amount FROM loan_applications",
    "computed_column": """
SELECT applicant_id, 850 - credit_score AS points_below_best FROM credit_profiles""",
    "constant_columns": """
SELECT applicant_id, 'registered' AS flag, 0 AS sort_order, CAST(NULL AS BIGINT) AS padding
FROM applicants""",
    "filter_equal": """
SELECT application_id, event_timestamp FROM application_events WHERE stage = 'disbursed'""",
    "filter_not_equal": """
SELECT stage, count(*) AS n FROM application_events WHERE stage <> 'disbursed' GROUP BY stage""",
    "filter_is_not_null": """
SELECT application_id, approved_at FROM app WHERE approved_at IS NOT NULL""",
    "is_null_in_case": """
SELECT CASE WHEN disbursed_at IS NULL THEN 'open' ELSE 'paid out' END AS outcome, count(*) AS n
FROM app GROUP BY 1""",
    "filter_between": "SELECT applicant_id, age FROM applicants WHERE age BETWEEN 26 AND 35",
    "filter_comparisons": """
SELECT applicant_id, credit_score FROM credit_profiles
WHERE credit_score >= 600 AND debt_to_income_ratio < 0.40 AND existing_loans <= 3
  AND previous_defaults > 0""",
    "filter_row_number": """
SELECT application_id, stage FROM application_events JOIN ladder USING (stage)
QUALIFY row_number() OVER (PARTITION BY application_id ORDER BY stage_order DESC) = 1""",
    "filter_after_aggregate": """
SELECT applicant_id, count(*) AS n FROM loan_applications GROUP BY 1 HAVING count(*) >= 15""",
    "having_two_aggregates": """
SELECT application_id, min(CASE WHEN stage = 'submitted' THEN event_timestamp END) AS submitted_at,
       max(CASE WHEN stage = 'disbursed' THEN event_timestamp END) AS disbursed_at
FROM application_events GROUP BY application_id
HAVING count_if(stage = 'submitted') > 0 AND count_if(stage = 'disbursed') > 0""",
    "filter_year": """
SELECT application_id, month(event_timestamp) AS mth FROM application_events
WHERE stage = 'submitted' AND year(event_timestamp) = 1997""",
    "filter_in_list": """
SELECT loan_term_months, count(*) AS n FROM loan_applications
WHERE loan_term_months IN (12, 36, 60) GROUP BY 1""",
    "quoted_identifier": """
SELECT loan_type AS "table", CAST(sum(loan_amount) AS BIGINT) AS "total amount due"
FROM loan_applications GROUP BY 1""",
    # Joins.
    "join_fact_events": """
SELECT loan_type, stage, count(*) AS n
FROM loan_applications JOIN application_events USING (application_id) GROUP BY ALL""",
    "join_dimension": """
SELECT acquisition_channel, count(*) AS n
FROM loan_applications JOIN applicants USING (applicant_id) GROUP BY 1""",
    "join_four_tables": f"""
SELECT age, count(*) AS n, {_PAID} AS disbursed, min(credit_score) AS lowest_score,
       max(credit_score) AS highest_score
FROM loan_applications JOIN app USING (application_id) JOIN applicants USING (applicant_id)
     JOIN credit_profiles USING (applicant_id)
GROUP BY age""",
    "join_stage_pair": """
SELECT s.application_id, date_diff('hour', s.event_timestamp, r.event_timestamp) AS hours
FROM application_events s JOIN application_events r
  ON s.application_id = r.application_id AND s.stage = 'submitted' AND r.stage = 'under_review'""",
    "join_derived_to_table": f"""
SELECT application_id, loan_amount, total_days
FROM {_TRIPS} JOIN loan_applications USING (application_id)""",
    "join_aggregate_to_detail": f"""
WITH means AS (SELECT loan_type, {mean("loan_amount", 0)} AS type_mean
               FROM loan_applications GROUP BY 1)
SELECT application_id, loan_amount, type_mean FROM loan_applications JOIN means USING (loan_type)
WHERE loan_amount > CAST(1.9 AS DOUBLE) * type_mean""",
    "left_join_months": """
WITH opened AS (
  SELECT year(event_timestamp) AS yr, month(event_timestamp) AS mth,
         count(DISTINCT application_id) AS submitted
  FROM application_events WHERE stage = 'submitted' GROUP BY ALL
), closed AS (
  SELECT year(event_timestamp) AS yr, month(event_timestamp) AS mth,
         count(DISTINCT application_id) AS approved
  FROM application_events WHERE stage = 'approved' AND month(event_timestamp) <> 2 GROUP BY ALL
)
SELECT yr, mth, submitted, coalesce(approved, 0) AS approved
FROM opened LEFT JOIN closed USING (yr, mth)""",
    "join_derived_aggregate": """
SELECT CAST(is_disbursed AS INTEGER) AS paid, count(*) AS n, CAST(sum(loan_amount) AS BIGINT) AS amount
FROM loan_applications JOIN app USING (application_id) GROUP BY 1""",
    "combine_single_rows": """
SELECT a.n AS applicants, CAST(t.v AS BIGINT) AS total_amount, b.v AS best_score
FROM (SELECT count(*) AS n FROM applicants) a CROSS JOIN
     (SELECT sum(loan_amount) AS v FROM loan_applications) t CROSS JOIN
     (SELECT max(credit_score) AS v FROM credit_profiles) b""",
    "rejoin_outcomes": f"""
SELECT application_id, hours, CAST(is_approved AS INTEGER) AS is_approved,
       CAST(is_disbursed AS INTEGER) AS is_disbursed
FROM {_GAPS} JOIN app USING (application_id)""",
    "rows_without_partner": """
SELECT applicant_id FROM applicants
WHERE applicant_id NOT IN (SELECT applicant_id FROM loan_applications
                           WHERE loan_type = 'home_loan' AND loan_term_months = 12)""",
    # Aggregations.
    "count_rows": "SELECT count(*) AS n FROM application_events",
    "count_distinct_entities": """
SELECT stage_order, stage, count(DISTINCT application_id) AS reached
FROM application_events JOIN ladder USING (stage) GROUP BY ALL""",
    "conditional_distinct_counts": """
SELECT count(DISTINCT CASE WHEN stage = 'submitted' THEN application_id END) AS submitted,
       count(DISTINCT CASE WHEN stage = 'under_review' THEN application_id END) AS under_review,
       count(DISTINCT CASE WHEN stage = 'verified' THEN application_id END) AS verified,
       count(DISTINCT CASE WHEN stage = 'approved' THEN application_id END) AS approved,
       count(DISTINCT CASE WHEN stage = 'disbursed' THEN application_id END) AS disbursed
FROM application_events""",
    "flag_aggregate": """
SELECT application_id, CAST(is_verified AS INTEGER) AS is_verified,
       CAST(is_approved AS INTEGER) AS is_approved, CAST(is_disbursed AS INTEGER) AS is_disbursed
FROM app""",
    "conditional_first_last": "SELECT application_id, submitted_at, disbursed_at FROM app",
    "sum_flags": f"""
SELECT loan_term_months, count(*) AS total_applications,
       count(*) FILTER (WHERE is_verified) AS verified,
       count(*) FILTER (WHERE is_approved) AS approved, {_PAID} AS disbursed
FROM {_BY_TERM}""",
    "conditional_sum": """
SELECT CAST(sum(loan_amount) FILTER (WHERE is_disbursed) AS BIGINT) AS paid_out,
       CAST(sum(loan_amount) FILTER (WHERE NOT is_disbursed) AS BIGINT) AS at_risk
FROM loan_applications JOIN app USING (application_id)""",
    "sum_column": "SELECT CAST(sum(loan_amount) AS BIGINT) AS total_amount FROM loan_applications",
    "average_as_double": f"""
SELECT employment_status, {mean("annual_income", 0)} AS avg_income FROM applicants GROUP BY 1""",
    "conditional_average": f"""
SELECT loan_type, {mean("total_days")} AS avg_days
FROM loan_applications LEFT JOIN {_TRIPS} USING (application_id) GROUP BY 1""",
    "min_max": """
SELECT loan_type, min(loan_amount) AS smallest, max(loan_amount) AS largest
FROM loan_applications GROUP BY 1""",
    "conditional_min_max": """
SELECT min(credit_score) FILTER (WHERE previous_defaults = 0) AS lowest_clean,
       max(credit_score) FILTER (WHERE previous_defaults > 0) AS highest_defaulted
FROM credit_profiles""",
    "median_by_group": f"""
SELECT loan_type, quantile_cont(CAST(total_days AS DOUBLE), 0.5) AS median_days
FROM {_TRIPS} JOIN loan_applications USING (application_id) GROUP BY 1""",
    "global_aggregate": """
SELECT count(*) AS n, CAST(sum(existing_loans) AS BIGINT) AS existing_loans,
       max(debt_to_income_ratio) AS highest_ratio
FROM credit_profiles""",
    "group_by_expression": """
SELECT year(event_timestamp) AS yr, month(event_timestamp) AS mth,
       strftime(event_timestamp, '%b %Y') AS label, count(*) AS n
FROM application_events GROUP BY ALL""",
    "group_with_sort_key": f"""
SELECT {AGES.label("age")} AS age_group, {AGES.place("age")} AS age_sort, count(*) AS n
FROM applicants GROUP BY ALL""",
    "average_of_averages": f"""
SELECT round(round(avg(monthly_conv_pct), 8), 1) AS mean_monthly_pct FROM ({_MONTHS})""",
    "two_level_aggregate": """
SELECT stage AS stages_seen, count(*) AS n
FROM (SELECT application_id, count(DISTINCT stage) AS stage_order FROM application_events GROUP BY 1)
     JOIN ladder USING (stage_order) GROUP BY stage""",
    "select_distinct": "SELECT DISTINCT loan_type, loan_term_months FROM loan_applications",
    # Windows.
    "window_lag": f"SELECT stage_order, reached, entered FROM ({_STEPS})",
    "window_first_value": f"SELECT stage_order, overall_conv_rate_pct FROM ({_STEPS})",
    "window_month_over_month": f"SELECT yr, mth, mom_change FROM ({_MONTHS})",
    "window_moving_average": f"SELECT yr, mth, rolling_3m_avg FROM ({_MONTHS})",
    "lead_next_timestamp": f"SELECT application_id, stage_order, t_next AS next_at FROM {_ALONG}",
    "lead_next_stage": f"""
SELECT stage, stage_next AS next_stage, count(*) AS n FROM {_ALONG} GROUP BY ALL""",
    "lead_every_event": f"""
SELECT application_id, stage_order, order_next AS next_order, date_diff('hour', t, t_next) AS hours,
       date_diff('day', t, t_next) AS days, count(*) AS steps
FROM {_ALONG} WHERE t_next IS NOT NULL GROUP BY ALL""",
    "click_steps": """
SELECT visit_id, stage_order, order_next AS next_order, date_diff('hour', t, t_next) AS hours,
       date_diff('day', t, t_next) AS days, count(*) AS steps
FROM (SELECT visit_id, stage_order, ts AS t, lead(ts) OVER w AS t_next,
             lead(stage_order) OVER w AS order_next
      FROM visits JOIN click_ladder USING (stage)
      WINDOW w AS (PARTITION BY visit_id ORDER BY stage_order, ts))
WHERE t_next IS NOT NULL GROUP BY ALL""",
    "row_number_furthest": """
SELECT application_id, stage_order, event_timestamp AS last_activity
FROM application_events JOIN ladder USING (stage)
QUALIFY row_number() OVER (PARTITION BY application_id ORDER BY stage_order DESC) = 1""",
    "rank_by_ratio": f"""
SELECT loan_term_months, rank() OVER (ORDER BY CAST({_PAID} AS DOUBLE) / count(*) DESC) AS conv_rank
FROM {_BY_TERM}""",
    "rank_in_partition": f"""
SELECT *, rank() OVER (PARTITION BY loan_type ORDER BY rate DESC) AS place
FROM (SELECT loan_type, loan_term_months,
             {pct("count(*) FILTER (WHERE is_approved)", "count(*)")} AS rate
      FROM loan_applications JOIN app USING (application_id) GROUP BY ALL)""",
    "rank_by_difference": f"""
SELECT stage_order, lost, rank() OVER (ORDER BY lost DESC) AS severity_rank
FROM ({_STEPS}) WHERE lost IS NOT NULL""",
    "share_of_total": f"""
SELECT loan_type, {pct("count(*)", "(SELECT count(*) FROM loan_applications)")} AS share_pct
FROM loan_applications GROUP BY 1""",
    "overall_average": f"""
WITH j AS (SELECT * FROM loan_applications JOIN app USING (application_id))
SELECT loan_type, {pct(_PAID, "count(*)")} AS rate,
       any_value((SELECT {pct(_PAID, "count(*)")} FROM j)) AS overall_rate
FROM j GROUP BY 1""",
    "integer_mean_of_detail": f"""
SELECT application_id,
       total_days > 2 * (SELECT CAST(sum(total_days) AS BIGINT) // count(*) FROM {_TRIPS})
         AS over_twice_mean
FROM {_TRIPS}""",
    "double_mean_of_detail": f"""
SELECT application_id, total_days,
       round(round(avg(CAST(total_days AS DOUBLE)) OVER (), 8), 1) AS mean_days FROM {_TRIPS}""",
    "windowed_median": f"""
SELECT stage_order, round(round(quantile_cont(CAST(date_diff('day', t, t_next) AS DOUBLE), 0.5), 8), 1)
         AS median_days
FROM {_ALONG} WHERE t_next IS NOT NULL GROUP BY 1""",
    # Sorts and top rows.
    "sort_ascending": """
SELECT loan_term_months, count(*) AS n FROM loan_applications GROUP BY 1 ORDER BY 1""",
    "sort_descending_with_tiebreak": """
SELECT application_id, loan_amount FROM loan_applications ORDER BY loan_amount DESC, application_id""",
    "sort_by_hidden_expression": """
SELECT stage, count(*) AS n FROM application_events JOIN ladder USING (stage)
GROUP BY stage, stage_order ORDER BY stage_order""",
    "top_one": """
SELECT application_id, loan_amount FROM loan_applications
ORDER BY loan_amount DESC, application_id LIMIT 1""",
    # Set operations.
    "union_all": """
SELECT application_id, count(*) AS n
FROM (SELECT application_id FROM application_events WHERE stage = 'submitted'
      UNION ALL SELECT application_id FROM application_events WHERE stage = 'disbursed')
GROUP BY 1""",
    "union_with_padding": f"""
SELECT loan_type, count(*) AS n, NULL AS avg_amount, 0 AS sort_order
FROM loan_applications GROUP BY loan_type
UNION ALL SELECT 'all types', NULL, {mean("loan_amount", 0)}, 1 FROM loan_applications""",
    # Scalar functions.
    "text_replace": """
SELECT replace(acquisition_channel, '_', ' ') AS channel, count(*) AS n FROM applicants GROUP BY 1""",
    "coalesce_to_zero": """
SELECT applicant_id, coalesce(n, 0) AS applications FROM applicants LEFT JOIN
  (SELECT applicant_id, count(*) AS n FROM loan_applications GROUP BY 1) USING (applicant_id)""",
    "division_guard": f"""
SELECT CAST(event_timestamp AS DATE) AS period_start,
       {pct("count(DISTINCT application_id) FILTER (WHERE stage = 'disbursed')",
            "count(DISTINCT application_id) FILTER (WHERE stage = 'submitted')")} AS pct
FROM application_events GROUP BY 1""",
    "round_to_tenth": """
SELECT applicant_id, round(round(CAST(credit_score AS DOUBLE) / 7, 8), 1) AS sevenths
FROM credit_profiles""",
    "round_to_whole": """
SELECT application_id, round(round(CAST(loan_amount AS DOUBLE) / 8, 8), 0) AS eighths
FROM loan_applications""",
    "cast_to_double": """
SELECT applicant_id, CAST(credit_score AS DOUBLE) / 850 AS score_ratio FROM credit_profiles""",
    "cast_to_date": """
SELECT CAST(event_timestamp AS DATE) AS event_date, count(*) AS n FROM application_events GROUP BY 1""",
    "year_and_month": """
SELECT year(registration_date) AS yr, month(registration_date) AS mth, count(*) AS n
FROM applicants GROUP BY ALL""",
    "month_name": """
SELECT strftime(application_date, '%b %Y') AS label, count(*) AS n FROM loan_applications GROUP BY 1""",
    "hours_crossed": f"""
SELECT application_id, stage_order, date_diff('hour', t, t_next) AS hours
FROM {_ALONG} WHERE t_next IS NOT NULL""",
    "days_crossed": f"""
SELECT application_id, stage_order, date_diff('day', t, t_next) AS days
FROM {_ALONG} WHERE t_next IS NOT NULL""",
    "days_until_date": """
SELECT application_id, date_diff('day', last_activity, TIMESTAMP '2001-12-31') AS days_idle FROM app""",
    "arithmetic": """
SELECT application_id, loan_amount * 3 - 1000 AS scaled,
       round(round(CAST(loan_amount AS DOUBLE) / loan_term_months, 8), 2) AS per_month
FROM loan_applications""",
    "stage_ordinal": """
SELECT stage, stage_order AS position, count(*) AS n
FROM application_events JOIN ladder USING (stage) GROUP BY ALL""",
    "bands_age": _bands("applicants", AGES, "age"),
    "bands_credit": _bands("credit_profiles", CREDIT, "credit_score"),
    "bands_journey": _bands(_TRIPS, JOURNEYS, "total_days"),
    "bands_response": _bands(_GAPS, RESPONSES, "hours"),
    "outlier_flag": f"""
SELECT if(total_days > 2 * (SELECT CAST(sum(total_days) AS BIGINT) // count(*) FROM {_TRIPS}),
          'OUTLIER', 'Normal') AS flag, count(*) AS n
FROM {_TRIPS} GROUP BY 1""",
    "default_for_first_stage": f"SELECT stage_order, stage_conv_rate_pct FROM ({_STEPS})",
    # Composition.
    "steps_of_steps": f"""
SELECT max(lost) AS worst_loss, CAST(sum(lost) AS BIGINT) AS all_lost FROM ({_STEPS})""",
    "relation_used_twice": f"""
WITH m AS ({_MONTHS})
SELECT yr, mth, applications_submitted FROM m
WHERE applications_submitted > (SELECT avg(applications_submitted) FROM m)""",
    "derived_table": """
SELECT applications, count(*) AS applicants, CAST(sum(amount) AS BIGINT) AS amount
FROM (SELECT count(*) AS applications, sum(loan_amount) AS amount
      FROM loan_applications GROUP BY applicant_id)
GROUP BY applications""",
    "two_aliases": """
SELECT b.application_id, stage_order, date_diff('day', a.t0, event_timestamp) AS days_since_submission
FROM stage_plan a JOIN application_events b ON a.k = b.application_id JOIN ladder USING (stage)
WHERE stage <> 'submitted'""",
    # Order statistics of whole tables.
    "rank_of_applicants": """
WITH people AS (
  SELECT applicant_id, count(*) AS total_applications, count(*) FILTER (WHERE is_disbursed) AS disbursed,
         CAST(sum(loan_amount) AS BIGINT) AS amount
  FROM loan_applications JOIN app USING (application_id) GROUP BY applicant_id
)
SELECT *, rank() OVER (ORDER BY CAST(disbursed AS DOUBLE) / total_applications DESC NULLS LAST) AS rate_rank,
       rank() OVER (ORDER BY amount DESC NULLS LAST) AS amount_rank
FROM people""",
    "percentiles_of_amounts": """
SELECT loan_type, fraction, n, round(round(amount, 8), 3) AS amount FROM (
  SELECT loan_type, count(loan_amount) AS n, unnest([0.25::DOUBLE, 0.5::DOUBLE, 0.75::DOUBLE, 0.9::DOUBLE]) AS fraction,
         unnest(quantile_cont(loan_amount, [0.25, 0.5, 0.75, 0.9])) AS amount
  FROM loan_applications GROUP BY loan_type)""",
    "median_review_seconds": """
SELECT CAST(date_trunc('month', submitted_at) AS DATE) AS submitted_month, count(*) AS n,
       round(round(quantile_cont(date_diff('second', submitted_at, reviewed_at), 0.5), 8), 3) AS median_seconds
FROM app WHERE submitted_at IS NOT NULL AND reviewed_at IS NOT NULL GROUP BY 1""",
    # The click log.
    "click_funnel": CLICK_STEPS,
    "click_transitions": _click_moves(_FIRST_CLICKS, "stage_order"),
    "click_transitions_all": _click_moves(
        "(SELECT visit_id, stage_order, ts AS t FROM visits JOIN click_ladder USING (stage))",
        "stage_order, t",
    ),
    "click_journeys": """
SELECT visit_id, min(ts) FILTER (WHERE stage = 'view') AS started_at,
       max(ts) FILTER (WHERE stage = 'purchase') AS ended_at,
       date_diff('day', min(ts) FILTER (WHERE stage = 'view'),
                 max(ts) FILTER (WHERE stage = 'purchase')) AS total_days
FROM visits GROUP BY visit_id
HAVING count_if(stage = 'view') > 0 AND count_if(stage = 'purchase') > 0""",
    "click_response_gaps": """
SELECT DISTINCT v.visit_id, date_diff('hour', v.ts, p.ts) AS hours
FROM visits v JOIN visits p USING (visit_id) WHERE v.stage = 'view' AND p.stage = 'purchase'""",
    "click_furthest": """
SELECT visit_id, max(stage_order) AS stage_order, arg_max(ts, (stage_order, ts)) AS last_activity
FROM visits JOIN click_ladder USING (stage) GROUP BY visit_id""",
    "click_days": """
SELECT CAST(ts AS DATE) AS period_start,
       count(DISTINCT visit_id) FILTER (WHERE stage = 'view') AS "view",
       count(DISTINCT visit_id) FILTER (WHERE stage = 'click') AS click,
       count(DISTINCT visit_id) FILTER (WHERE stage = 'signup') AS signup,
       count(DISTINCT visit_id) FILTER (WHERE stage = 'purchase') AS purchase
FROM visits JOIN click_ladder USING (stage) GROUP BY 1""",
}
