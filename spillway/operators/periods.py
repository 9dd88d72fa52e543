"""Stage volumes per calendar period."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions import StageLog, columns, name, percent, settled_round
from .progress import entity_progress, reached


def within_year(log: StageLog, year: int) -> StageLog:
    """Events of one calendar year, as a range on the raw column so that the scan can prune."""
    at = log.at_sql
    return log.where(f"{at} >= DATE '{year:04d}-01-01' AND {at} < DATE '{year + 1:04d}-01-01'")


def period_reach(log: StageLog, grain: str = "month") -> DataFrame:
    """``period_start, <stage>...``: entities with an event of the stage inside the period.

    ``grain`` is ``day``, ``week``, ``month``, ``quarter`` or ``year``.  Each event counts in its
    own period, so this is a volume table and not a cohort table.
    """
    day = f"CAST({log.at_sql} AS DATE)"
    start = day if grain == "day" else f"trunc({day}, '{grain}')"
    sums = [f"sum({reached(log, s)}) AS {name(s)}" for s in log.ladder.stages]
    return (
        entity_progress(log, by=[f"{start} AS period_start"])
        .groupBy("period_start")
        .agg(*columns(sums))
    )


def period_trend(log: StageLog, opening: str, closing: str, window: int = 3) -> DataFrame:
    """``period_start, opened, closed, change, rolling_avg, conv_pct`` per month.

    Months without ``opening`` events are left out, and the windows run over the months present.
    """
    both = log.where(log.ladder.holds(log.stage_sql, opening, closing))
    opening, closing = name(opening), name(closing)
    in_order = "ORDER BY period_start"
    trailing = f"avg(CAST({opening} AS DOUBLE)) OVER ({in_order} ROWS {window - 1} PRECEDING)"
    return (
        period_reach(both)
        .where(f"{opening} > 0")
        .selectExpr(
            "period_start",
            f"{opening} AS opened",
            f"{closing} AS closed",
            f"{opening} - lag({opening}) OVER ({in_order}) AS change",
            f"{settled_round(trailing)} AS rolling_avg",
            f"{percent(closing, opening)} AS conv_pct",
        )
    )
