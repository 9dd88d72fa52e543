"""One row per entity: which stages it reached and when.

This is the only step that shuffles the event log, and nearly every report starts from it.  All
its aggregates are fixed-width (a long bit set and timestamps), so Spark combines them on the map
side in generated code: an entity holding a large share of all events leaves each task as one row.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

from ..functions import StageLog, columns, days_between, name, text

STAGES = "stage_set"


def entity_progress(
    log: StageLog,
    first_of: Iterable[str] = (),
    last_of: Iterable[str] = (),
    by: Iterable[str] = (),
) -> DataFrame:
    """``entity, [by...], stage_set, first_<s>..., last_<s>...``.

    ``first_of``/``last_of`` name the stages whose earliest/latest time is wanted.  ``by`` adds
    grouping expressions, such as the month of the event.
    """
    stage, at = log.stage_sql, log.at_sql
    measures = [f"bit_or({log.ladder.bit(stage)}) AS {STAGES}"]
    measures += [f"min({at}) FILTER (WHERE {stage} = {text(s)}) AS {first_of_stage(s)}" for s in first_of]
    measures += [f"max({at}) FILTER (WHERE {stage} = {text(s)}) AS {last_of_stage(s)}" for s in last_of]
    return log.rows().groupBy(log.entity, *columns(by)).agg(*columns(measures))


def first_of_stage(stage: str) -> str:
    """SQL name of a stage's earliest time."""
    return name(f"first_{stage}")


def last_of_stage(stage: str) -> str:
    """SQL name of a stage's latest time."""
    return name(f"last_{stage}")


def reached(log: StageLog, stage: str) -> str:
    """SQL 0/1 flag over a row of :func:`entity_progress`."""
    return log.ladder.reached(STAGES, stage)


def journeys(log: StageLog, start: str | None = None, end: str | None = None) -> DataFrame:
    """Finished entities: ``entity, started_at, ended_at, total_days``.

    From the first ``start`` event to the last ``end`` event (default: the ladder's two ends).
    """
    start, end = start or log.ladder.first, end or log.ladder.last
    opened, closed = first_of_stage(start), last_of_stage(end)
    ends = log.where(log.ladder.holds(log.stage_sql, start, end))
    return (
        entity_progress(ends, first_of=[start], last_of=[end])
        .where(f"{opened} IS NOT NULL AND {closed} IS NOT NULL")
        .selectExpr(
            name(log.entity),
            f"{opened} AS started_at",
            f"{closed} AS ended_at",
            f"{days_between(opened, closed)} AS total_days",
        )
    )


def furthest_stage(log: StageLog) -> DataFrame:
    """``entity, stage_order, last_activity``: the highest stage reached and its latest event."""
    stages = log.ladder.stages
    tests = [f"WHEN {reached(log, s)} = 1 THEN" for s in stages]
    orders = [f"{test} {position}" for position, test in enumerate(tests, 1)]
    times = [f"{test} {last_of_stage(s)}" for s, test in zip(stages, tests)]
    return entity_progress(log, last_of=stages).selectExpr(
        name(log.entity),
        f"CASE {' '.join(reversed(orders))} END AS stage_order",
        f"CASE {' '.join(reversed(times))} END AS last_activity",
    )
