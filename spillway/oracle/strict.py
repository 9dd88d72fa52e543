"""DuckDB statements for the strict funnels: every start, each followed to its earliest next stages."""

from .reports import pct


def chains(log: str, entity: str, order: str, at: str, stages: int, seconds: int | None) -> str:
    """Common tables ending in ``furthest(entity, entered_on, stage_order)``."""
    limit = "" if seconds is None else f" AND date_diff('second', c.t1, min(v.t)) <= {seconds}"
    parts = [
        f"visit AS (SELECT DISTINCT {entity} AS entity, {order} AS stage_order, date_trunc('second', {at}) AS t FROM {log})",
        "c1 AS (SELECT entity, t AS t1, t FROM visit WHERE stage_order = 1)",
    ]
    for i in range(2, stages + 1):
        parts.append(f"""c{i} AS (SELECT c.entity, c.t1, min(v.t) AS t FROM c{i - 1} c JOIN visit v
            ON v.entity = c.entity AND v.stage_order = {i} AND v.t > c.t
            GROUP BY c.entity, c.t1 HAVING true{limit})""")
    every = " UNION ALL ".join(f"SELECT entity, t1, {i} AS stage_order FROM c{i}" for i in range(1, stages + 1))
    parts.append(f"""furthest AS (SELECT entity, CAST(min(t1) FILTER (WHERE stage_order = 1) AS DATE) AS entered_on,
            max(stage_order) AS stage_order FROM ({every}) GROUP BY entity)""")
    return "WITH " + ",\n".join(parts)


def cohorts(tables: str, period: str, stages: list[str]) -> str:
    counts = ", ".join(f'count(*) FILTER (WHERE stage_order >= {i}) AS "{s}"' for i, s in enumerate(stages, 1))
    rate = pct(f"count(*) FILTER (WHERE stage_order >= {len(stages)})", "count(*)")
    return f"""{tables}
SELECT CAST(date_trunc('{period}', entered_on) AS DATE) AS cohort_{period}, {counts}, {rate} AS conv_rate_pct
FROM furthest GROUP BY 1"""


_LOANS = "application_events JOIN ladder USING (stage)"
_CLICKS = "visits JOIN click_ladder USING (stage)"

STRICT = {
    "strict_cohort_by_application_month": cohorts(
        chains(_LOANS, "application_id", "stage_order", "event_timestamp", 5, 9 * 86_400),
        "month",
        ["submitted", "under_review", "verified", "approved", "disbursed"],
    ),
    "click_strict": chains(_CLICKS, "visit_id", "stage_order", "ts", 4, 6 * 3600)
    + "\nSELECT entity AS visit_id, stage_order, entered_on FROM furthest",
    "click_strict_cohorts": cohorts(
        chains(_CLICKS, "visit_id", "stage_order", "ts", 4, None), "week", ["view", "click", "signup", "purchase"]
    ),
}
