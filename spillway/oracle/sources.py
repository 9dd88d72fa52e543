"""DuckDB statements for loads, sinks, views and constraint checks."""

import re

from .reports import REPORTS


def _rule(table: str, rule: str, violations: str) -> str:
    return f"SELECT '{table}' AS \"table\", '{rule}' AS rule, ({violations}) AS violations"


def _null(table: str, column: str) -> str:
    return _rule(table, f"not_null({column})", f"SELECT count(*) - count({column}) FROM {table}")


def _unique(table: str, column: str) -> str:
    repeated = f"SELECT {column} FROM {table} WHERE {column} IS NOT NULL GROUP BY 1 HAVING count(*) > 1"
    return _rule(table, f"unique({column})", f"SELECT count(*) FROM ({repeated})")


def _check(table: str, rule: str, broken: str) -> str:
    return _rule(table, rule, f"SELECT count(*) FILTER (WHERE {broken}) FROM {table}")


def _one_of(table: str, column: str, values: str) -> str:
    return _check(table, f"one_of({column})", f"{column} NOT IN ({values})")


def _references(table: str, column: str, parent: str, parent_column: str) -> str:
    return _rule(
        table,
        f"references({column}, {parent})",
        f"""SELECT count(*) FROM {table} c WHERE c.{column} IS NOT NULL
            AND NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.{parent_column} = c.{column})""",
    )


_STAGES = "'submitted', 'under_review', 'verified', 'approved', 'disbursed'"
_DQ = [
    _null("applicants", "applicant_id"),
    _unique("applicants", "applicant_id"),
    _null("applicants", "first_name"),
    _rule("applicants", "not_null(last_name)", "SELECT 0"),
    _null("applicants", "email"),
    _unique("applicants", "email"),
    _check("applicants", "in_range(age)", "NOT age BETWEEN 18 AND 100"),
    _one_of(
        "applicants",
        "employment_status",
        "'employed', 'self_employed', 'unemployed', 'student', 'retired'",
    ),
    _one_of(
        "applicants",
        "acquisition_channel",
        "'organic_search', 'paid_search', 'referral', 'social_media', 'email_campaign', 'direct'",
    ),
    _null("applicants", "registration_date"),
    _null("loan_applications", "application_id"),
    _unique("loan_applications", "application_id"),
    _null("loan_applications", "applicant_id"),
    _references("loan_applications", "applicant_id", "applicants", "applicant_id"),
    _one_of(
        "loan_applications",
        "loan_type",
        "'personal_loan', 'home_loan', 'auto_loan', 'business_loan', 'education_loan'",
    ),
    _null("loan_applications", "loan_amount"),
    _check("loan_applications", "in_range(loan_amount)", "NOT loan_amount > 0"),
    _one_of("loan_applications", "loan_term_months", "12, 24, 36, 48, 60"),
    _null("loan_applications", "status"),
    _null("loan_applications", "application_date"),
    _null("application_events", "event_id"),
    _unique("application_events", "event_id"),
    _null("application_events", "application_id"),
    _references("application_events", "application_id", "loan_applications", "application_id"),
    _null("application_events", "stage"),
    _one_of("application_events", "stage", _STAGES),
    _null("application_events", "event_timestamp"),
    _null("credit_profiles", "applicant_id"),
    _unique("credit_profiles", "applicant_id"),
    _references("credit_profiles", "applicant_id", "applicants", "applicant_id"),
    _check("credit_profiles", "in_range(credit_score)", "NOT credit_score BETWEEN 300 AND 850"),
    _check(
        "credit_profiles",
        "in_range(debt_to_income_ratio)",
        "NOT debt_to_income_ratio BETWEEN 0 AND 1",
    ),
]

#: The same rows with some values broken, as in the query.
_BROKEN = """
WITH broken_applicants AS (
  SELECT CASE WHEN applicant_id % 31 = 0 THEN applicant_id - 1 ELSE applicant_id END AS applicant_id,
         first_name, CASE WHEN applicant_id % 40 = 0 THEN NULL ELSE email END AS email,
         CASE WHEN applicant_id % 50 = 0 THEN 130 ELSE age END AS age, employment_status,
         CASE WHEN applicant_id % 60 = 0 THEN 'billboard' ELSE acquisition_channel END
           AS acquisition_channel, registration_date
  FROM applicants
), broken_loan_applications AS (
  SELECT application_id,
         CASE WHEN application_id % 97 = 0 THEN -application_id ELSE applicant_id END AS applicant_id,
         loan_type, CASE WHEN application_id % 89 = 0 THEN -loan_amount ELSE loan_amount END AS loan_amount,
         loan_term_months, CASE WHEN application_id % 83 = 0 THEN NULL ELSE status END AS status,
         application_date
  FROM loan_applications
), broken_application_events AS (
  SELECT CASE WHEN event_id % 101 = 0 THEN event_id - 1 ELSE event_id END AS event_id,
         CASE WHEN event_id % 103 = 0 THEN -application_id ELSE application_id END AS application_id,
         CASE WHEN event_id % 107 = 0 THEN 'lost' ELSE stage END AS stage,
         CASE WHEN event_id % 109 = 0 THEN NULL ELSE event_timestamp END AS event_timestamp
  FROM application_events
), broken_credit_profiles AS (
  SELECT applicant_id,
         CASE WHEN applicant_id % 37 = 0 THEN credit_score + 600 ELSE credit_score END AS credit_score,
         CASE WHEN applicant_id % 41 = 0 THEN 1.5 ELSE debt_to_income_ratio END AS debt_to_income_ratio
  FROM credit_profiles
)
"""
_TABLE_NAMES = "applicants|loan_applications|application_events|credit_profiles"

_VIEW_NAMES = [v for v in REPORTS if v.startswith("vw_")]

_FIELDS = """
WITH fields AS (
  SELECT application_id AS k, CASE WHEN application_id % 41 = 0 THEN NULL ELSE application_id END AS application_id,
         CASE WHEN application_id % 23 = 0 THEN 'boat' ELSE loan_type END AS loan_type,
         CASE WHEN application_id % 19 = 0 THEN -loan_amount ELSE loan_amount END AS loan_amount,
         CASE WHEN application_id % 29 = 0 THEN 13 ELSE loan_term_months END AS loan_term_months, status,
         application_id % 17 = 0 OR application_id % 31 = 0 AS malformed
  FROM loan_applications
), judged AS (
  SELECT *, list_filter(CASE WHEN malformed THEN ['malformed'] ELSE [
    CASE WHEN application_id IS NULL THEN 'not_null(application_id)' END,
    CASE WHEN loan_type = 'boat' THEN 'one_of(loan_type)' END,
    CASE WHEN loan_amount < 1 THEN 'in_range(loan_amount)' END,
    CASE WHEN loan_term_months = 13 THEN 'one_of(loan_term_months)' END] END, lambda x: x IS NOT NULL) AS reasons
  FROM fields
)"""

SOURCES = {
    "load_reject_reasons": f"""{_FIELDS}
SELECT reason, count(*) AS n FROM (
  SELECT unnest(CASE WHEN len(reasons) = 0 THEN ['accepted'] ELSE reasons END) AS reason FROM judged)
GROUP BY reason""",
    "load_accepted": f"""{_FIELDS}
SELECT loan_type, status, count(*) AS n, CAST(sum(application_id) AS BIGINT) AS application_sum,
       CAST(sum(loan_amount) AS BIGINT) AS amount
FROM judged WHERE len(reasons) = 0 GROUP BY 1, 2""",
    "partition_reload": """
SELECT CAST(date_trunc('month', event_timestamp) AS DATE) AS event_month, stage, count(*) AS n,
       CAST(sum(event_id) AS BIGINT) AS event_sum, max(event_timestamp) AS last_at
FROM application_events GROUP BY 1, 2""",
    "standing_channel_performance": REPORTS["vw_channel_performance"],
    "standing_segment_conversion": REPORTS["vw_segment_conversion"],
    "standing_executive_dashboard": REPORTS["vw_executive_dashboard"],
    "load_csv": "SELECT * FROM loan_applications",
    "load_csv_book": """
SELECT 'applicants' AS "table", count(*) AS n, CAST(sum(applicant_id) AS BIGINT) AS key_sum,
       CAST(sum(annual_income) AS BIGINT) AS number_sum FROM applicants
UNION ALL
SELECT 'loan_applications', count(*), CAST(sum(application_id) AS BIGINT),
       CAST(sum(loan_amount) AS BIGINT) FROM loan_applications
UNION ALL
SELECT 'application_events', count(*), CAST(sum(application_id) AS BIGINT),
       CAST(sum(event_id) AS BIGINT) FROM application_events
UNION ALL
SELECT 'credit_profiles', count(*), CAST(sum(applicant_id) AS BIGINT),
       CAST(sum(credit_score) AS BIGINT) FROM credit_profiles""",
    "bucketed_tables": REPORTS["conv_by_loan_type"],
    "load_csv_events": """
SELECT stage, count(*) AS n, min(event_timestamp) AS first_at, max(event_timestamp) AS last_at
FROM application_events GROUP BY stage""",
    "load_defaults": """
SELECT CASE WHEN applicant_id % 4 = 0 THEN 0 ELSE existing_loans END AS existing_loans,
       CASE WHEN applicant_id % 5 = 0 THEN 0 ELSE previous_defaults END AS previous_defaults,
       count(*) AS n
FROM credit_profiles GROUP BY 1, 2""",
    "rolling_click_reach": """
WITH clicks AS (
  SELECT user_id, CAST(ts AS DATE) AS d, stage_order
  FROM events JOIN click_ladder ON stage = event_type WHERE ts IS NOT NULL AND user_id IS NOT NULL
), days AS (SELECT DISTINCT d AS on_day FROM clicks)
SELECT on_day, CAST(stage_order AS INTEGER) AS stage_order, count(DISTINCT user_id) AS entities
FROM days JOIN clicks ON d BETWEEN on_day - 6 AND on_day
GROUP BY 1, 2""",
    "loan_reach_between": """
WITH inside AS (
  SELECT DISTINCT application_id, stage_order
  FROM application_events JOIN ladder USING (stage)
  WHERE date_trunc('month', event_timestamp) BETWEEN DATE '1996-02-01' AND DATE '1997-04-01'
)
SELECT stage, CAST(stage_order AS INTEGER) AS stage_order, count(a.application_id) AS entities,
       CASE WHEN stage_order > 1 THEN count(b.application_id) END AS with_stage_before
FROM ladder l LEFT JOIN inside a USING (stage_order)
     LEFT JOIN inside b ON b.application_id = a.application_id AND b.stage_order = l.stage_order - 1
GROUP BY stage, stage_order""",
    "layout_for_two_keys": """
WITH hits AS (
  SELECT 'application' AS filtered_by, stage, event_id FROM application_events
  WHERE application_id BETWEEN 1000 AND 2000
  UNION ALL
  SELECT 'time', stage, event_id FROM application_events
  WHERE event_timestamp >= TIMESTAMP '1996-03-01' AND event_timestamp < TIMESTAMP '1996-03-31 18:00:00'
  UNION ALL
  SELECT 'reference', stage, event_id FROM application_events WHERE event_id IN (10011, 10012, 11)
)
SELECT filtered_by, stage, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS id_sum
FROM hits GROUP BY 1, 2""",
    "status_default": "SELECT status, count(*) AS n FROM loan_applications GROUP BY status",
    "parquet_sink": """
SELECT stage, count(*) AS n, CAST(sum(application_id) AS BIGINT) AS application_sum
FROM application_events GROUP BY stage""",
    "report_output": REPORTS["funnel_overview"],
    "read_all_views": " UNION ALL ".join(
        f"SELECT '{v}' AS view_name, (SELECT count(*) FROM ({REPORTS[v]})) AS n" for v in _VIEW_NAMES
    ),
    "tables_in_sql": """
SELECT loan_type, count(*) AS "applications per type", max(loan_amount) AS "max"
FROM loan_applications GROUP BY loan_type""",
    "dq_constraint_violations": " UNION ALL ".join(_DQ),
    "dq_broken_book": _BROKEN
    + re.sub(rf"FROM ({_TABLE_NAMES})\b", r"FROM broken_\1", " UNION ALL ".join(_DQ)),
    "dq_clickstream": " UNION ALL ".join(
        [
            _null("events", "ts"),
            _unique("events", "event_id"),
            _unique("events", "user_id"),
            _one_of("events", "event_type", "'view', 'click', 'signup', 'purchase'"),
            _one_of("events", "event_type", _STAGES),
        ]
    ),
}
