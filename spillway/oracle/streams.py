"""DuckDB statements for the streaming queries: their batch equivalents."""

from .reports import pct


def _steps(volume: str) -> str:
    return f"""
WITH volume AS ({volume}), steps AS (
  SELECT *, lag(n) OVER (ORDER BY stage_order) AS before, first(n) OVER (ORDER BY stage_order) AS top
  FROM volume
)
SELECT stage_order, stage, n AS reached, before AS entered, before - n AS lost,
       {pct("before - n", "before")} AS pct_lost,
       coalesce({pct("n", "before")}, 100.0) AS stage_conv_rate_pct,
       {pct("n", "top")} AS overall_conv_rate_pct
FROM steps"""


CLICK_STEPS = _steps(
    """SELECT stage_order, stage, count(DISTINCT visit_id) AS n
       FROM visits JOIN click_ladder USING (stage) GROUP BY ALL"""
)

def _reached(stages: tuple, entity: str) -> str:
    return ", ".join(f"CAST(sum(CAST({entity}_{s} AS INTEGER)) AS BIGINT) AS \"{s}\"" for s in stages)


def _flags(stages: tuple, entity: str) -> str:
    return ", ".join(f"bool_or(stage = '{s}') AS {entity}_{s}" for s in stages)


_LOAN_STAGES = ("submitted", "under_review", "verified", "approved", "disbursed")
_CLICK_STAGES = ("view", "click", "signup", "purchase")

STREAMS = {
    "live_loan_funnel": _steps(
        """SELECT stage_order, stage, count(DISTINCT application_id) AS n
           FROM application_events JOIN ladder USING (stage) GROUP BY ALL"""
    ),
    "live_click_funnel": CLICK_STEPS,
    "live_approval_alerts": """
WITH waits AS (
  SELECT application_id, CAST(verified_at AS DATE) AS waiting_since,
         CAST(approved_at AS DATE) AS decided_date
  FROM app WHERE verified_at IS NOT NULL
), due AS (
  SELECT *, CAST(waiting_since + CASE isodow(waiting_since) WHEN 6 THEN 6 WHEN 7 THEN 5 ELSE 7 END
              AS DATE) AS due_date
  FROM waits
), clock AS (
  SELECT least(max(due_date) + 1, max(decided_date)) - 1 AS today FROM due
)
SELECT application_id, waiting_since, due_date FROM due, clock
WHERE due_date < today AND (decided_date IS NULL OR decided_date > due_date)""",
    "live_loan_days": f"""
WITH days AS (
  SELECT date_trunc('day', event_timestamp) AS period_start, application_id, {_flags(_LOAN_STAGES, "n")}
  FROM application_events GROUP BY ALL
)
SELECT CAST(period_start AS TIMESTAMP) AS period_start,
       CAST(period_start AS TIMESTAMP) + INTERVAL 1 DAY AS period_end, {_reached(_LOAN_STAGES, "n")}
FROM days
WHERE CAST(period_start AS TIMESTAMP) + INTERVAL 1 DAY
      <= (SELECT max(event_timestamp) FROM application_events) - INTERVAL 36 HOURS
GROUP BY 1, 2""",
    "live_click_sessions": f"""
WITH steps AS (
  SELECT visit_id, stage, date_trunc('second', ts) AS t,
         lag(date_trunc('second', ts)) OVER (PARTITION BY visit_id ORDER BY ts) AS before
  FROM visits JOIN click_ladder USING (stage)
), numbered AS (
  SELECT *, count(*) FILTER (WHERE before IS NULL OR t > before + INTERVAL 40 MINUTES)
    OVER (PARTITION BY visit_id ORDER BY t) AS number
  FROM steps
), sessions AS (
  SELECT date_trunc('day', max(t) + INTERVAL 40 MINUTES - INTERVAL 1 SECOND) AS period_start,
         {_flags(_CLICK_STAGES, "n")}
  FROM numbered GROUP BY visit_id, number
)
SELECT CAST(period_start AS TIMESTAMP) AS period_start,
       CAST(period_start AS TIMESTAMP) + INTERVAL 1 DAY AS period_end, count(*) AS sessions,
       {_reached(_CLICK_STAGES, "n")}
FROM sessions
WHERE CAST(period_start AS TIMESTAMP) + INTERVAL 1 DAY
      <= (SELECT max(date_trunc('second', t)) FROM steps) - INTERVAL 3 HOURS
GROUP BY 1, 2""",
}
