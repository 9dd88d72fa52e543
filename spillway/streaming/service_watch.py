"""Alerts for entities that wait too long for a decision, raised while events arrive.

An outer join of two streams, the waits and the decisions.  A wait whose due date passes without a
decision from its day on leaves the join unmatched, and that row is the alert.  "Passes" is judged
by the watermark, never by the wall clock, and both sides drop their state as it advances.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import StageLog, name, weekdays_after


def service_alerts(
    log: StageLog, waiting: str, decided: str, working_days: int, late: str = "1 day"
) -> DataFrame:
    """Streaming rows ``entity, waiting_since, due_date``, append mode: the rows of
    :func:`~spillway.operators.service_breaches` whose due date the stream has left behind.

    A decision counts from the wait's day to its due date, so a decision is remembered for as long
    as ``working_days`` can last in calendar days, and no setting limits it further.  ``late`` is
    how much later than a newer event an older one may still arrive; rows beyond it are dropped by
    the watermark and counted, see :func:`late_rows`.  Time advances with the slower side: the
    newest decision, or the newest due date.

    Waits and decisions are reduced to one per entity and day before the join, so an entity that
    repeats them all day brings no more rows to it than one that does so once.
    """
    entity, day = name(log.entity), f"CAST({log.at_sql} AS DATE)"
    due = weekdays_after(day, working_days)
    waits = (
        log.rows(waiting)
        .selectExpr(
            entity,
            f"{day} AS waiting_since",
            f"{due} AS due_date",
            f"CAST(date_add({due}, 1) AS TIMESTAMP) AS due_time",
        )
        .withWatermark("due_time", late)
        .dropDuplicates([log.entity, "waiting_since", "due_time"])
    )
    decisions = (
        log.rows(decided)
        .selectExpr(f"{entity} AS decided_entity", f"CAST({day} AS TIMESTAMP) AS decided_time")
        .withWatermark("decided_time", late)
        .dropDuplicates(["decided_entity", "decided_time"])
    )
    # Implied by the exact condition before it; Spark derives from it when a decision can go.
    in_time = F.expr(
        f"""{entity} = decided_entity AND decided_time < due_time
            AND decided_time >= CAST(waiting_since AS TIMESTAMP)
            AND due_time <= decided_time + INTERVAL {longest_wait(working_days)} DAYS"""
    )
    return (
        waits.join(decisions, in_time, "leftOuter")
        .where("decided_time IS NULL")
        .select(log.entity, "waiting_since", "due_date")
    )


def longest_wait(working_days: int) -> int:
    """The most calendar days from a wait's first midnight to the midnight after its due date."""
    return working_days + 2 * (working_days // 5 + 1) + 1


def late_rows(run: StreamingQuery) -> int:
    """How many rows the watermark has dropped in the batches whose progress the query remembers
    (``spark.sql.streaming.numRecentProgressUpdates`` of them)."""
    return sum(
        operator["numRowsDroppedByWatermark"]
        for progress in run.recentProgress
        for operator in progress["stateOperators"]
    )
