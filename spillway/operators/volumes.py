"""Stage volumes, step and overall conversion, drop-off."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions import StageLog, columns, name, percent, rows_of, text
from .progress import entity_progress, reached


def reach_totals(log: StageLog) -> DataFrame:
    """One row, one column per stage: how many distinct entities reached it.

    Distinct counting is one sum per stage over the per-entity stage sets, where a multi-way
    ``count(DISTINCT CASE ...)`` would expand every event once per stage before the shuffle.
    """
    sums = [f"coalesce(sum({reached(log, s)}), 0) AS {name(s)}" for s in log.ladder.stages]
    return entity_progress(log).agg(*columns(sums))


def stage_counts(log: StageLog) -> DataFrame:
    """``stage_order, stage, reached``; stages nobody reached are absent."""
    rows = [(i, text(s), name(s)) for i, s in enumerate(log.ladder.stages, 1)]
    return (
        reach_totals(log)
        .selectExpr(rows_of(rows, ("stage_order", "stage", "reached")))
        .where("reached > 0")
    )


def funnel(counts: DataFrame) -> DataFrame:
    """Adds ``entered, lost, pct_lost, stage_conv_rate_pct, overall_conv_rate_pct``.

    Each stage is compared with the stage present before it; the windows see one row per stage.
    """
    return counts.selectExpr(
        "*",
        "lag(reached) OVER (ORDER BY stage_order) AS entered",
        """first_value(reached) OVER (ORDER BY stage_order
           ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS top""",
    ).selectExpr(
        "stage_order",
        "stage",
        "reached",
        "entered",
        "entered - reached AS lost",
        f"{percent('entered - reached', 'entered')} AS pct_lost",
        f"CASE WHEN entered IS NULL THEN 100D ELSE {percent('reached', 'entered')} END"
        " AS stage_conv_rate_pct",
        f"{percent('reached', 'top')} AS overall_conv_rate_pct",
    )


def drop_offs(steps: DataFrame) -> DataFrame:
    """Steps of a :func:`funnel` that have a stage before them, with ``severity_rank``."""
    return steps.where("entered IS NOT NULL").selectExpr(
        "*", "CAST(rank() OVER (ORDER BY lost DESC) AS BIGINT) AS severity_rank"
    )
