"""Time spent between consecutive stages."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions import (
    StageLog,
    columns,
    day_of_hour,
    days_between,
    hour_number,
    mean_of,
    name,
    rows_of,
    settled_round,
)
from .progress import entity_progress, first_of_stage


def stage_transitions(log: StageLog, repeats: str = "keep") -> DataFrame:
    """``entity, stage_order, next_order, hours, days, weight`` in ladder order.

    Durations are clock-hour and midnight crossings and may be negative, since stages are taken
    in ladder order and not in time order.

    ``repeats="keep"``: every event is followed by the next one, repeats of a stage (in time
    order) included; ``weight`` counts equal steps.  ``repeats="first"``: only the first event of
    each stage counts, which needs no window at all.
    """
    if repeats == "first":
        return _first_visit_steps(log)
    if repeats != "keep":
        raise ValueError("repeats is 'keep' or 'first'")
    return _every_visit_steps(log)


def _every_visit_steps(log: StageLog) -> DataFrame:
    # Durations only depend on the clock hour, so events are first combined to
    # (entity, stage, hour, copies).  That bounds what one entity brings to the window by the
    # hours of the log's time span, however many events it has.
    entity = name(log.entity)
    visits = (
        log.rows()
        .selectExpr(
            entity,
            f"{log.ladder.order(log.stage_sql)} AS stage_order",
            f"{hour_number(log.at_sql)} AS hour_no",
        )
        .groupBy(log.entity, "stage_order", "hour_no")
        .agg(*columns(["count(1) AS copies"]))
    )
    in_order = f"(PARTITION BY {entity} ORDER BY stage_order, hour_no)"
    onward = f"""named_struct(
        'next_order', next_order, 'hours', next_hour - hour_no,
        'days', {day_of_hour("next_hour")} - {day_of_hour("hour_no")}, 'weight', 1L)"""
    among_copies = """named_struct(
        'next_order', stage_order, 'hours', 0L, 'days', 0L, 'weight', copies - 1)"""
    return (
        visits.selectExpr(
            "*",
            f"lead(stage_order) OVER {in_order} AS next_order",
            f"lead(hour_no) OVER {in_order} AS next_hour",
        )
        .selectExpr(
            entity,
            "stage_order",
            f"inline(IF(copies > 1, array({onward}, {among_copies}), array({onward})))",
        )
        .where("next_order IS NOT NULL")
    )


def _first_visit_steps(log: StageLog) -> DataFrame:
    from_hour, to_hour = hour_number("at"), hour_number("next_at")
    return (
        next_stages(log)
        .where("next_order IS NOT NULL")
        .selectExpr(
            name(log.entity),
            "stage_order",
            "next_order",
            f"{to_hour} - {from_hour} AS hours",
            f"{days_between('at', 'next_at')} AS days",
            "1L AS weight",
        )
    )


def next_stages(log: StageLog) -> DataFrame:
    """``entity, stage_order, at, next_order, next_at``: the first visit of each stage reached and
    the first visit of the next stage present; NULL after the furthest stage.

    One aggregation gives an entity's first visits side by side, so no window sorts the log.
    """
    stages = log.ladder.stages
    rows = []
    for position, stage in enumerate(stages, 1):
        later = [(position + k, first_of_stage(s)) for k, s in enumerate(stages[position:], 1)]
        cases = " ".join(f"WHEN {at} IS NOT NULL THEN {order}" for order, at in later)
        next_order = f"CASE {cases} END" if later else "CAST(NULL AS INT)"
        next_at = f"coalesce({', '.join(at for _, at in later)})" if later else "NULL"
        rows.append((position, first_of_stage(stage), next_order, next_at))
    return (
        entity_progress(log, first_of=stages)
        .selectExpr(name(log.entity), rows_of(rows, ("stage_order", "at", "next_order", "next_at")))
        .where("at IS NOT NULL")
    )


def transition_summary(steps: DataFrame) -> DataFrame:
    """``stage_order, next_order, median_days, transitions, avg_hours, avg_days, min_days,
    max_days`` of :func:`stage_transitions`.

    The median is taken per stage over all its onward steps.  Steps are first counted per
    (stage, next, days): that histogram has a few thousand rows at any data size, and every
    figure, the exact interpolated median included, follows from it.
    """
    median = "percentile(days, 0.5D, n) OVER (PARTITION BY stage_order)"
    return (
        steps.groupBy("stage_order", "next_order", "days")
        .agg(*columns(["sum(weight) AS n", "sum(hours * weight) AS hours"]))
        .selectExpr("*", f"{settled_round(median)} AS median_days")
        .groupBy("stage_order", "next_order", "median_days")
        .agg(
            *columns(
                [
                    "sum(n) AS transitions",
                    f"{mean_of('sum(hours)', 'sum(n)', 1)} AS avg_hours",
                    f"{mean_of('sum(days * n)', 'sum(n)', 1)} AS avg_days",
                    "min(days) AS min_days",
                    "max(days) AS max_days",
                ]
            )
        )
    )
