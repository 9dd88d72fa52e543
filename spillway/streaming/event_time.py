"""Funnels by event time whose state stays bounded: windows and sessions that close.

A watermark follows the newest event; a window or session that lies behind it is closed, emitted
once in append mode, and its state is dropped.  Entities are reduced to one bit set per window or
session first, and a second aggregation adds those up, so the state holds the entities of open
windows and one row per open period.  Rows behind the watermark are dropped and counted, see
:func:`~spillway.streaming.late_rows`.

Event time here is the log's wall-clock time read as if it were UTC, so days begin at the log's own
midnight whatever the session time zone.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import StageLog, columns, hour_number, name
from ..operators.progress import STAGES

_TIME = "_event_time"


def _timed(log: StageLog) -> DataFrame:
    """``entity, bit, _event_time``: ladder rows with a time, cut to whole seconds."""
    at = log.at_sql
    seconds = f"{hour_number(at)} * 3600 + minute({at}) * 60 + CAST(floor(second({at})) AS INT)"
    return (
        log.rows()
        .where(f"{at} IS NOT NULL AND {name(log.entity)} IS NOT NULL")
        .selectExpr(
            f"{name(log.entity)} AS entity",
            f"{log.ladder.bit(log.stage_sql)} AS bit",
            f"timestamp_seconds({seconds}) AS {_TIME}",
        )
    )


def _sums(log: StageLog) -> list[str]:
    return [f"sum({log.ladder.reached(STAGES, s)}) AS {name(s)}" for s in log.ladder.stages]


def windowed_funnel(log: StageLog, every: str = "1 day", late: str = "1 day") -> DataFrame:
    """Streaming rows ``period_start, period_end, <stages...>``: how many distinct entities visited
    each stage in a period, once the period is closed.  Run in append mode.

    ``every`` is a period's length and ``late`` how much later than a newer event an older one may
    still arrive.  Periods without visits have no row.
    """
    per_entity = (
        _timed(log)
        .withWatermark(_TIME, late)
        .groupBy(F.window(_TIME, every).alias("period"), "entity")
        .agg(*columns([f"bit_or(bit) AS {STAGES}"]))
    )
    counts = per_entity.groupBy("period").agg(*columns(_sums(log)))
    return counts.selectExpr(
        f"{_wall_clock('period.start')} AS period_start",
        f"{_wall_clock('period.end')} AS period_end",
        *[name(s) for s in log.ladder.stages],
    )


def session_funnel(log: StageLog, gap: str = "30 minutes", every: str = "1 day", late: str = "1 day") -> DataFrame:
    """Streaming rows ``period_start, period_end, sessions, <stages...>``: the sessions that ended in
    a period, and how many of them visited each stage.  Run in append mode.

    An entity's visits belong to one session while each comes at most ``gap`` after the one before;
    a session ends ``gap`` after its last visit, and belongs to the period of the last moment before
    that.
    """
    sessions = (
        _timed(log)
        .withWatermark(_TIME, late)
        .groupBy(F.session_window(_TIME, gap).alias("session"), "entity")
        .agg(*columns([f"bit_or(bit) AS {STAGES}"]))
    )
    ended = sessions.select(F.window_time("session").alias("ended"), STAGES)
    counts = ended.groupBy(F.window("ended", every).alias("period")).agg(
        *columns(["count(1) AS sessions", *_sums(log)])
    )
    return counts.selectExpr(
        f"{_wall_clock('period.start')} AS period_start",
        f"{_wall_clock('period.end')} AS period_end",
        "sessions",
        *[name(s) for s in log.ladder.stages],
    )


def _wall_clock(utc: str) -> str:
    """A zoneless time that reads like ``utc`` does in UTC."""
    return f"timestampadd(SECOND, unix_seconds({utc}), TIMESTAMP_NTZ'1970-01-01')"


def closed_periods(log: StageLog, every: dt.timedelta, late: dt.timedelta, gap: dt.timedelta | None = None) -> DataFrame:
    """The batch report a finished stream has to equal: the rows of :func:`windowed_funnel`, or with
    ``gap`` of :func:`session_funnel`, whose period ends at or before the newest event less ``late``.
    """
    rows = _timed(log)
    seconds = f"unix_seconds({_TIME})"
    clock = rows.agg(*columns([f"max({seconds}) - {int(late.total_seconds())} AS clock"]))
    length = int(every.total_seconds())
    if gap is None:
        periods = rows.selectExpr("entity", "bit", f"{seconds} - pmod({seconds}, {length}) AS start")
        counted = periods.groupBy("start", "entity").agg(*columns([f"bit_or(bit) AS {STAGES}"]))
        measures = _sums(log)
    else:
        pause = int(gap.total_seconds())
        sessions = rows.groupBy(F.session_window(_TIME, f"{pause} seconds").alias("session"), "entity").agg(
            *columns([f"bit_or(bit) AS {STAGES}"])
        )
        # The last moment of a session lies in the period before its end, to the microsecond.
        ended = sessions.selectExpr(STAGES, "unix_seconds(session.end) - 1 AS last")
        counted = ended.selectExpr(STAGES, f"last - pmod(last, {length}) AS start")
        measures = ["count(1) AS sessions", *_sums(log)]
    begin = "timestampadd(SECOND, {}, TIMESTAMP_NTZ'1970-01-01')"
    return (
        counted.groupBy("start")
        .agg(*columns(measures))
        .join(F.broadcast(clock), F.expr(f"start + {length} <= clock"))  # one row
        .selectExpr(
            f"{begin.format('start')} AS period_start",
            f"{begin.format(f'start + {length}')} AS period_end",
            *(["sessions"] if gap is not None else []),
            *[name(s) for s in log.ladder.stages],
        )
    )
