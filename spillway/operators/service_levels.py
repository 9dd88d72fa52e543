"""Service-level breaches: a stage not followed by the next within so many working days."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame

from ..functions import StageLog, columns, name, text, weekdays_after


def service_breaches(
    log: StageLog, waiting: str, decided: str, working_days: int, as_of: dt.date
) -> DataFrame:
    """``entity, waiting_since, due_date, decided_date``: one row per entity and day on which it
    began to wait, if no ``decided`` event lies between that day and the due date, and that date is
    past at ``as_of``.  ``decided_date`` is the first decision from that day on, if any; decisions
    before a wait say nothing about it.

    Events are first reduced to days, so an entity brings at most one row per day to the window.
    """
    entity = name(log.entity)
    days = (
        log.rows(waiting, decided)
        .selectExpr(entity, f"CAST({log.at_sql} AS DATE) AS day", f"{log.stage_sql} AS stage_name")
        .groupBy(log.entity, "day")
        .agg(
            *columns(
                [
                    f"bool_or(stage_name = {text(waiting)}) AS waits",
                    f"max(IF(stage_name = {text(decided)}, day, NULL)) AS decided_on",
                ]
            )
        )
    )
    onward = f"(PARTITION BY {entity} ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    return (
        days.selectExpr("*", f"min(decided_on) OVER {onward} AS decided_date")
        .where("waits")
        .selectExpr(
            entity,
            "day AS waiting_since",
            f"{weekdays_after('day', working_days)} AS due_date",
            "decided_date",
        )
        .where(f"coalesce(decided_date, DATE '{as_of}') > due_date")
    )
