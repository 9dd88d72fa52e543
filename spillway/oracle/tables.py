"""The derived tables, as common table expressions put in front of every statement."""

# Names of stages, loan types, channels and employment, and the mapping's numbers.
TABLES = """
applicants AS (
  SELECT c_custkey AS applicant_id, c_name AS first_name, lower(c_name) AS email,
         CAST(18 + (c_custkey * 7) % 60 AS INTEGER) AS age,
         CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'employed' WHEN 'BUILDING' THEN 'self_employed'
              WHEN 'FURNITURE' THEN 'unemployed' WHEN 'HOUSEHOLD' THEN 'student'
              WHEN 'MACHINERY' THEN 'retired' END AS employment_status,
         CAST(20000 + (c_custkey * 37) % 80000 AS INTEGER) AS annual_income,
         ['organic_search', 'paid_search', 'referral', 'social_media', 'email_campaign',
          'direct'][c_nationkey % 6 + 1] AS acquisition_channel,
         TIMESTAMP '1995-01-01' + to_days(CAST((c_custkey * 13) % 365 AS INTEGER)) AS registration_date
  FROM customer
),
credit_profiles AS (
  SELECT c_custkey AS applicant_id, CAST(300 + (c_custkey * 131) % 551 AS INTEGER) AS credit_score,
         CAST(((c_custkey * 17) % 61 + 5) / 100.0 AS DECIMAL(5, 2)) AS debt_to_income_ratio,
         CAST(c_custkey % 6 AS INTEGER) AS existing_loans,
         CAST(c_custkey % 3 AS INTEGER) AS previous_defaults
  FROM customer
),
loan_applications AS (
  SELECT o_orderkey AS application_id, o_custkey AS applicant_id,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'personal_loan' WHEN '2-HIGH' THEN 'home_loan'
              WHEN '3-MEDIUM' THEN 'auto_loan' WHEN '4-NOT SPECIFIED' THEN 'business_loan'
              WHEN '5-LOW' THEN 'education_loan' END AS loan_type,
         CAST(floor(o_totalprice) AS BIGINT) AS loan_amount,
         CAST(12 * (1 + o_orderkey % 5) AS INTEGER) AS loan_term_months,
         'submitted' AS status,
         o_orderdate + to_minutes((o_orderkey * 37) % 1440) AS application_date
  FROM orders
),
stage_plan AS (
  SELECT application_id AS k, application_date AS t0, (application_id * 31 + 7) % 100 AS score,
         60 + (k * 53) % 3900 AS d2,
         720 + (k * 71) % 5000 AS d3,
         600 + (k * 89) % 3500 AS d4,
         1440 + (k * 97) % 4800
           + CASE WHEN k % 8 = 0 THEN ((k // 8) % 25) * 1440 ELSE 0 END AS d5
  FROM loan_applications
),
application_events AS (
  SELECT k * 10 + 1 AS event_id, k AS application_id, 'submitted' AS stage, t0 AS event_timestamp
  FROM stage_plan
  UNION ALL
  SELECT k * 10 + 2, k, 'under_review', t0 + to_minutes(d2) FROM stage_plan WHERE score >= 8
  UNION ALL
  SELECT k * 10 + 3, k, 'verified', t0 + to_minutes(d2 + d3) FROM stage_plan WHERE score >= 34
  UNION ALL
  SELECT k * 10 + 4, k, 'approved', t0 + to_minutes(d2 + d3 + d4) FROM stage_plan WHERE score >= 60
  UNION ALL
  SELECT k * 10 + 5, k, 'disbursed', t0 + to_minutes(d2 + d3 + d4 + d5)
  FROM stage_plan WHERE score >= 63
),
ladder AS (
  SELECT * FROM (VALUES (1, 'submitted'), (2, 'under_review'), (3, 'verified'), (4, 'approved'),
                        (5, 'disbursed')) AS l(stage_order, stage)
),
app AS (
  SELECT application_id,
         min(event_timestamp) FILTER (WHERE stage = 'submitted') AS submitted_at,
         min(event_timestamp) FILTER (WHERE stage = 'under_review') AS reviewed_at,
         min(event_timestamp) FILTER (WHERE stage = 'verified') AS verified_at,
         min(event_timestamp) FILTER (WHERE stage = 'approved') AS approved_at,
         max(event_timestamp) FILTER (WHERE stage = 'disbursed') AS disbursed_at,
         count(*) FILTER (WHERE stage = 'verified') > 0 AS is_verified,
         count(*) FILTER (WHERE stage = 'approved') > 0 AS is_approved,
         count(*) FILTER (WHERE stage = 'disbursed') > 0 AS is_disbursed,
         max(stage_order) AS furthest,
         arg_max(event_timestamp, stage_order) AS last_activity
  FROM application_events JOIN ladder USING (stage)
  GROUP BY application_id
),
visits AS (
  SELECT user_id * 100 + day(ts) AS visit_id, event_type AS stage, ts FROM events
),
click_ladder AS (
  SELECT * FROM (VALUES (1, 'view'), (2, 'click'), (3, 'signup'), (4, 'purchase'))
    AS l(stage_order, stage)
)
"""


def with_tables(body: str) -> str:
    """A statement over the derived tables; ``body`` may start with its own WITH."""
    return f"WITH {TABLES.strip()}\nSELECT * FROM (\n{body.strip()}\n)"
