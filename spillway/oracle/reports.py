"""DuckDB statements for the named reports."""

from ..operators.experiments import poisson_steps
from .bands import AGES, CREDIT, JOURNEYS, RESPONSES


def pct(part: str, whole: str) -> str:
    return f"round(round(CAST({part} AS DOUBLE) / nullif({whole}, 0) * 100, 8), 1)"


def mean(value: str, digits: int = 1) -> str:
    return f"round(round(avg(CAST({value} AS DOUBLE)), 8), {digits})"


def flags(name: str) -> str:
    return f"count(*) FILTER (WHERE is_{name})"


_STEPS = """
WITH volume AS (
  SELECT stage_order, stage, count(DISTINCT application_id) AS n
  FROM application_events JOIN ladder USING (stage) GROUP BY ALL
), steps AS (
  SELECT *, lag(n) OVER (ORDER BY stage_order) AS before,
         max(n) FILTER (WHERE stage_order = 1) OVER () AS top
  FROM volume
)
"""


def _overview(drop_name: str) -> str:
    return f"""{_STEPS}
SELECT stage_order, replace(stage, '_', ' ') AS stage_name, n AS applications_reached,
       coalesce(before - n, 0) AS {drop_name},
       coalesce({pct("n", "before")}, 100.0) AS stage_conv_rate_pct,
       {pct("n", "top")} AS overall_conv_rate_pct
FROM steps"""


_DROPS = f"""{_STEPS}
SELECT stage_order, replace(stage, '_', ' ') AS stage_name, before AS entered_stage,
       n AS passed_stage, before - n AS lost_applicants, {pct("before - n", "before")} AS pct_lost,
       rank() OVER (ORDER BY before - n DESC) AS severity_rank
FROM steps WHERE before IS NOT NULL"""

_LOAN_TYPE_FROM = """
FROM loan_applications JOIN app USING (application_id) GROUP BY loan_applications.loan_type"""
_CHANNEL_FROM = """
FROM loan_applications JOIN app USING (application_id) JOIN applicants USING (applicant_id)
GROUP BY acquisition_channel"""
_RATE = pct(flags("disbursed"), "count(*)")
_RAW_RATE = f"CAST({flags('disbursed')} AS DOUBLE) / count(*)"
_PAID = "CAST(coalesce(sum(loan_amount) FILTER (WHERE is_disbursed), 0) AS BIGINT)"

_MONTHS = f"""
WITH opened AS (
  SELECT date_trunc('month', event_timestamp) AS m, count(DISTINCT application_id) AS n
  FROM application_events WHERE stage = 'submitted' AND year(event_timestamp) = 1997 GROUP BY 1
), closed AS (
  SELECT date_trunc('month', event_timestamp) AS m, count(DISTINCT application_id) AS n
  FROM application_events WHERE stage = 'disbursed' GROUP BY 1
), months AS (
  SELECT o.m, strftime(o.m, '%b %Y') AS period, o.n AS applications_submitted,
         coalesce(c.n, 0) AS applications_disbursed,
         o.n - lag(o.n) OVER (ORDER BY o.m) AS mom_change,
         round(round(avg(CAST(o.n AS DOUBLE)) OVER (ORDER BY o.m ROWS 2 PRECEDING), 8), 1)
           AS rolling_3m_avg,
         {pct("coalesce(c.n, 0)", "o.n")} AS monthly_conv_pct
  FROM opened o LEFT JOIN closed c ON o.m = c.m
)
"""
_MONTH_COLUMNS = """period, applications_submitted, applications_disbursed, mom_change,
       rolling_3m_avg, monthly_conv_pct"""

_JOURNEYS = """
WITH trip AS (
  SELECT application_id, loan_type, loan_amount, submitted_at, disbursed_at,
         date_diff('day', submitted_at, disbursed_at) AS total_days
  FROM app JOIN loan_applications USING (application_id)
  WHERE submitted_at IS NOT NULL AND disbursed_at IS NOT NULL
)
"""

_TIERS = """
WITH pairs AS (
  SELECT DISTINCT s.application_id,
         date_diff('hour', s.event_timestamp, r.event_timestamp) AS hours
  FROM application_events s JOIN application_events r USING (application_id)
  WHERE s.stage = 'submitted' AND r.stage = 'under_review'
)
"""

_NEXT = """
WITH lined_up AS (
  SELECT stage_order, stage, event_timestamp AS t,
         lead(event_timestamp) OVER w AS t_next, lead(stage) OVER w AS stage_next
  FROM application_events JOIN ladder USING (stage)
  WINDOW w AS (PARTITION BY application_id ORDER BY stage_order, event_timestamp)
), moves AS (
  SELECT stage, stage_next, date_diff('hour', t, t_next) AS h, date_diff('day', t, t_next) AS d
  FROM lined_up WHERE t_next IS NOT NULL
), middle AS (
  SELECT stage, round(round(quantile_cont(CAST(d AS DOUBLE), 0.5), 8), 1) AS median_days
  FROM moves GROUP BY stage
)
"""


def _to_convert(key: str, source: str) -> str:
    days = "CASE WHEN is_disbursed THEN date_diff('day', submitted_at, disbursed_at) END"
    return f"""
SELECT replace({source}, '_', ' ') AS {key}, count(*) AS total_applications,
       {flags("disbursed")} AS disbursed, {_RATE} AS conv_rate_pct,
       {mean(days)} AS avg_days_to_disburse,
       min({days}) AS fastest_days, max({days}) AS slowest_days
FROM loan_applications JOIN app USING (application_id) JOIN applicants USING (applicant_id)
GROUP BY {source}"""


REPORTS = {
    "table_row_counts": """
SELECT 'applicants' AS "table", count(*) AS row_count FROM applicants
UNION ALL SELECT 'loan_applications', count(*) FROM loan_applications
UNION ALL SELECT 'application_events', count(*) FROM application_events
UNION ALL SELECT 'credit_profiles', count(*) FROM credit_profiles""",
    "funnel_overview": _overview("drop_off_count"),
    "biggest_dropoff": f"""
SELECT stage_name AS biggest_drop_off_stage, entered_stage, passed_stage, lost_applicants,
       pct_lost AS pct_of_stage_lost, 'PRIORITY ACTION REQUIRED' AS flag
FROM ({_DROPS}) ORDER BY lost_applicants DESC, stage_order LIMIT 1""",
    "funnel_summary": f"""
WITH v AS (
  SELECT count(DISTINCT application_id) FILTER (WHERE stage = 'submitted') AS s,
         count(DISTINCT application_id) FILTER (WHERE stage = 'under_review') AS u,
         count(DISTINCT application_id) FILTER (WHERE stage = 'verified') AS v,
         count(DISTINCT application_id) FILTER (WHERE stage = 'approved') AS a,
         count(DISTINCT application_id) FILTER (WHERE stage = 'disbursed') AS d
  FROM application_events
)
SELECT s AS total_applications, u AS under_review, v AS verified, a AS approved,
       d AS total_disbursed, {pct("d", "s")} AS end_to_end_conv_pct, s - d AS total_lost,
       {pct("s - d", "s")} AS pct_lost_overall
FROM v""",
    "monthly_trend": f"""{_MONTHS}
SELECT {_MONTH_COLUMNS}, 0 AS sort_order FROM months
UNION ALL
SELECT 'Full-year avg (1997)', NULL, NULL, NULL, NULL,
       round(round(avg(monthly_conv_pct), 8), 1), 1 FROM months""",
    "monthly_trend_by_date": f"""{_MONTHS}
SELECT year(m) AS yr, month(m) AS mth, {_MONTH_COLUMNS} FROM months""",
    "stage_month_heatmap": f"""
WITH cells AS (
  SELECT DISTINCT date_trunc('month', event_timestamp) AS m, stage, application_id
  FROM application_events
), months AS (
  SELECT m, count(*) FILTER (WHERE stage = 'submitted') AS submitted,
         count(*) FILTER (WHERE stage = 'under_review') AS under_review,
         count(*) FILTER (WHERE stage = 'verified') AS verified,
         count(*) FILTER (WHERE stage = 'approved') AS approved,
         count(*) FILTER (WHERE stage = 'disbursed') AS disbursed
  FROM cells GROUP BY m
)
SELECT strftime(m, '%b %Y') AS month_label, month(m) AS mth_num, * EXCLUDE (m),
       {pct("disbursed", "submitted")} AS monthly_end_to_end_pct
FROM months""",
    "conv_by_loan_type": f"""
SELECT replace(loan_type, '_', ' ') AS loan_type, count(*) AS total_applications,
       {flags("verified")} AS reached_verification, {flags("approved")} AS reached_approval,
       {flags("disbursed")} AS total_disbursed, {_RATE} AS conv_rate_pct,
       {mean("loan_amount", 0)} AS avg_loan_amount, {_PAID} AS total_disbursed_value
{_LOAN_TYPE_FROM}""",
    "conv_by_channel": f"""
SELECT replace(acquisition_channel, '_', ' ') AS channel, count(*) AS total_applications,
       {flags("approved")} AS approved, {flags("disbursed")} AS disbursed,
       {_RATE} AS conv_rate_pct,
       {pct("count(*)", "sum(count(*)) OVER ()")} AS channel_share_pct,
       rank() OVER (ORDER BY {_RAW_RATE} DESC) AS conv_rank
{_CHANNEL_FROM}""",
    "conv_by_age_group": f"""
WITH rows AS (
  SELECT is_verified, is_approved, is_disbursed,
         {AGES.label("age")} AS age_group
  FROM loan_applications JOIN app USING (application_id) JOIN applicants USING (applicant_id)
), whole AS (SELECT {_RATE} AS rate FROM rows)
SELECT age_group, count(*) AS total_applications, {flags("verified")} AS reached_verification,
       {flags("approved")} AS reached_approval, {flags("disbursed")} AS disbursed,
       {_RATE} AS conv_rate_pct,
       round({_RATE} - (SELECT rate FROM whole), 1) AS diff_from_avg_pct
FROM rows GROUP BY age_group""",
    "conv_by_credit_band": f"""
WITH rows AS (
  SELECT is_approved, is_disbursed, credit_score,
         {CREDIT.label("credit_score")} AS credit_band
  FROM loan_applications JOIN app USING (application_id) JOIN applicants USING (applicant_id)
       JOIN credit_profiles USING (applicant_id)
)
SELECT credit_band, count(*) AS total_applications, {flags("approved")} AS approved,
       {flags("disbursed")} AS disbursed, {_RATE} AS conv_rate_pct,
       {mean("credit_score", 0)} AS avg_credit_score
FROM rows GROUP BY credit_band""",
    "conv_by_employment": f"""
SELECT replace(employment_status, '_', ' ') AS employment_status, count(*) AS total_applications,
       {flags("verified")} AS verified, {flags("approved")} AS approved,
       {flags("disbursed")} AS disbursed, {_RATE} AS conv_rate_pct,
       {mean("annual_income", 0)} AS avg_annual_income,
       rank() OVER (ORDER BY {_RAW_RATE} DESC) AS conv_rank
FROM loan_applications JOIN app USING (application_id) JOIN applicants USING (applicant_id)
GROUP BY applicants.employment_status""",
    "conv_channel_x_loan": f"""
WITH cells AS (
  SELECT replace(acquisition_channel, '_', ' ') AS channel,
         replace(loan_type, '_', ' ') AS loan_type, count(*) AS total_applications,
         {flags("disbursed")} AS disbursed, {_RATE} AS conv_rate_pct
  FROM loan_applications JOIN app USING (application_id) JOIN applicants USING (applicant_id)
  GROUP BY acquisition_channel, loan_applications.loan_type HAVING count(*) >= 5
     AND count(*) * 1000 >= 32 * (SELECT count(*) FROM loan_applications)
)
SELECT *, rank() OVER (PARTITION BY channel ORDER BY conv_rate_pct DESC) AS rank_within_channel
FROM cells""",
    "stage_durations": f"""{_NEXT}
SELECT replace(stage, '_', ' ') AS stage, replace(stage_next, '_', ' ') AS transitions_to,
       count(*) AS transitions_observed, {mean("h")} AS avg_hours, {mean("d")} AS avg_days,
       min(d) AS min_days, max(d) AS max_days, any_value(median_days) AS median_days
FROM moves JOIN middle USING (stage) GROUP BY moves.stage, stage_next""",
    "journey_durations": f"""{_JOURNEYS}, whole AS (
  SELECT CAST(sum(total_days) AS BIGINT) // count(*) AS cut, {mean("total_days")} AS shown FROM trip
)
SELECT application_id, replace(loan_type, '_', ' ') AS loan_type, loan_amount,
       CAST(submitted_at AS DATE) AS submitted_date, CAST(disbursed_at AS DATE) AS disbursed_date,
       total_days,
       {JOURNEYS.label("total_days")} AS journey_category,
       if(total_days > 2 * cut, 'OUTLIER', 'Normal') AS outlier_flag, shown AS overall_avg_days
FROM trip, whole""",
    "response_tier_conversion": f"""{_TIERS}, tiers AS (
  SELECT hours, is_approved, is_disbursed,
         {RESPONSES.label("hours")} AS response_tier
  FROM pairs JOIN app USING (application_id)
)
SELECT response_tier, count(*) AS total_applications, {flags("approved")} AS approved,
       {flags("disbursed")} AS disbursed, {_RATE} AS conv_rate_pct,
       {mean("hours")} AS avg_hours_to_review
FROM tiers GROUP BY response_tier""",
    "time_to_convert_by_loan_type": _to_convert("loan_type", "loan_applications.loan_type"),
    "time_to_convert_by_channel": _to_convert("channel", "acquisition_channel"),
    "stuck_applications": f"""
SELECT replace(stage, '_', ' ') AS stuck_at_stage, count(*) AS abandoned_applications,
       {mean("date_diff('day', last_activity, TIMESTAMP '2001-12-31')", 0)} AS avg_days_inactive,
       {mean("loan_amount", 0)} AS avg_loan_amount,
       CAST(sum(loan_amount) AS BIGINT) AS total_revenue_at_risk
FROM app JOIN ladder ON furthest = stage_order JOIN loan_applications USING (application_id)
WHERE furthest < 5 GROUP BY stage""",
    "vw_funnel_kpi_summary": _overview("dropped_at_stage"),
    "vw_stage_dropoff": _DROPS,
    "vw_channel_performance": f"""
SELECT replace(acquisition_channel, '_', ' ') AS channel, count(*) AS total_applications,
       {flags("approved")} AS approved, {flags("disbursed")} AS disbursed,
       {_RATE} AS conv_rate_pct,
       {pct("count(*)", "sum(count(*)) OVER ()")} AS volume_share_pct,
       round(round({_RAW_RATE} * 100
         - CAST(sum({flags("disbursed")}) OVER () AS DOUBLE) / sum(count(*)) OVER () * 100, 8), 1)
         AS conv_vs_avg_pct,
       rank() OVER (ORDER BY {_RAW_RATE} DESC) AS quality_rank
{_CHANNEL_FROM}""",
    "vw_segment_conversion": f"""
SELECT replace(loan_type, '_', ' ') AS loan_type, count(*) AS total_applications,
       {flags("verified")} AS verified, {flags("approved")} AS approved,
       {flags("disbursed")} AS disbursed, {_RATE} AS conv_rate_pct,
       {mean("loan_amount", 0)} AS avg_loan_amount, {_PAID} AS total_value_disbursed,
       rank() OVER (ORDER BY {_RAW_RATE} DESC) AS conv_rank
{_LOAN_TYPE_FROM}""",
    "vw_executive_dashboard": f"""
WITH v AS (
  SELECT count(submitted_at) AS s, {flags("disbursed")} AS d,
         {mean("date_diff('day', submitted_at, disbursed_at)")} AS avg_days_to_disburse
  FROM app
), money AS (
  SELECT {_PAID} AS total_disbursed_value,
         CAST(sum(loan_amount) FILTER (WHERE NOT is_disbursed) AS BIGINT) AS pipeline_at_risk
  FROM loan_applications JOIN app USING (application_id)
)
SELECT s AS total_applications, d AS total_disbursed, s - d AS total_lost,
       {pct("d", "s")} AS end_to_end_conv_pct, {pct("s - d", "s")} AS overall_dropoff_pct,
       avg_days_to_disburse, total_disbursed_value, pipeline_at_risk
FROM v, money""",
    "cohort_by_registration_month": f"""
SELECT CAST(date_trunc('month', registration_date) AS DATE) AS cohort_month,
       count(*) AS total_applications, {flags("approved")} AS approved,
       {flags("disbursed")} AS disbursed, {_RATE} AS conv_rate_pct
FROM loan_applications JOIN app USING (application_id) JOIN applicants USING (applicant_id)
GROUP BY 1""",
    "cohort_by_application_month": f"""
SELECT CAST(date_trunc('month', submitted_at) AS DATE) AS cohort_month, count(*) AS submitted,
       count(reviewed_at) AS under_review, {flags("verified")} AS verified,
       {flags("approved")} AS approved, {flags("disbursed")} AS disbursed,
       {_RATE} AS conv_rate_pct
FROM app WHERE submitted_at IS NOT NULL GROUP BY 1""",
    "approval_breaches": """
WITH waits AS (
  SELECT application_id, CAST(verified_at AS DATE) AS waiting_since,
         CAST(approved_at AS DATE) AS decided_date
  FROM app WHERE verified_at IS NOT NULL
), due AS (
  SELECT application_id, waiting_since,
         CAST(waiting_since + CASE isodow(waiting_since) WHEN 6 THEN 6 WHEN 7 THEN 5 ELSE 7 END
              AS DATE) AS due_date,
         decided_date
  FROM waits
)
SELECT * FROM due WHERE coalesce(decided_date, DATE '2001-12-31') > due_date""",
    "registration_step": f"""
SELECT count(*) AS registered_applicants,
       count(*) FILTER (WHERE applicant_id IN (SELECT applicant_id FROM loan_applications))
         AS applicants_with_application,
       {pct("count(*) FILTER (WHERE applicant_id IN (SELECT applicant_id FROM loan_applications))",
            "count(*)")} AS registered_to_submitted_pct
FROM applicants""",
    "fast_review_experiment": """
WITH pairs AS (
  SELECT date_diff('hour', submitted_at, reviewed_at) AS hours, is_disbursed
  FROM app WHERE submitted_at IS NOT NULL AND reviewed_at IS NOT NULL
), g AS (
  SELECT count(*) FILTER (WHERE hours <= 6) AS treated_n,
         count(*) FILTER (WHERE hours <= 6 AND is_disbursed) AS treated_converted,
         count(*) FILTER (WHERE hours > 6) AS control_n,
         count(*) FILTER (WHERE hours > 6 AND is_disbursed) AS control_converted
  FROM pairs
), r AS (
  SELECT *, treated_converted / treated_n AS p1, control_converted / control_n AS p2,
         (treated_converted + control_converted) / (treated_n + control_n) AS p FROM g
), t AS (
  SELECT *, (p1 - p2) / sqrt(p * (1 - p) * (1 / treated_n + 1 / control_n)) AS z FROM r
)
SELECT treated_n, treated_converted, control_n, control_converted,
       round(round(p1 * 100, 8), 1) AS treated_pct, round(round(p2 * 100, 8), 1) AS control_pct,
       round(round((p1 - p2) * 100, 8), 2) AS lift_points, round(round(z, 8), 4) AS z_value,
       abs(z) > 1.959963984540054 AS significant_95
FROM t""",
    "fast_review_interval": f"""
WITH units AS (
  SELECT application_id, acquisition_channel AS channel, is_disbursed AS hit,
         date_diff('hour', submitted_at, reviewed_at) <= 6 AS treated
  FROM app JOIN loan_applications USING (application_id) LEFT JOIN applicants USING (applicant_id)
  WHERE submitted_at IS NOT NULL AND reviewed_at IS NOT NULL
), hashed AS (
  SELECT channel, hit, treated, r,
         CAST('0x' || substr(md5('42:' || application_id || ':' || (r // 4)), 1 + 8 * (r % 4), 8) AS BIGINT) AS u
  FROM units, range(200) AS t(r)
), weighted AS (
  SELECT *, {" + ".join(f"CAST(u >= {step} AS BIGINT)" for step in poisson_steps())} AS w FROM hashed
), strata AS (
  SELECT r, channel, sum(w) AS w, count(*) AS n,
         sum(w) FILTER (WHERE treated AND hit) AS wth, sum(w) FILTER (WHERE treated) AS wt,
         sum(w) FILTER (WHERE NOT treated AND hit) AS wch, sum(w) FILTER (WHERE NOT treated) AS wc,
         avg(hit::INT) FILTER (WHERE treated) - avg(hit::INT) FILTER (WHERE NOT treated) AS plain
  FROM weighted GROUP BY r, channel
), lifts AS (
  SELECT r, sum(w * diff) / sum(w) FILTER (WHERE diff IS NOT NULL) AS lift,
         sum(n * plain) / sum(n) FILTER (WHERE plain IS NOT NULL) AS plain,
         count(plain) AS strata, sum(n) FILTER (WHERE plain IS NOT NULL) AS compared
  FROM (SELECT *, coalesce(wth, 0) / nullif(wt, 0) - coalesce(wch, 0) / nullif(wc, 0) AS diff FROM strata)
  GROUP BY r
)
SELECT CAST(max(compared) AS BIGINT) AS compared, max(strata) AS strata, count(lift) AS replicates,
       round(round(max(plain) * 100, 8), 2) AS lift_points,
       round(round(quantile_cont(lift, 0.025) * 100, 8), 2) AS low_points,
       round(round(quantile_cont(lift, 0.975) * 100, 8), 2) AS high_points
FROM lifts""",
}
