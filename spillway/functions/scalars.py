"""SQL expressions shared by the reports.

Each helper takes and returns SQL text, for ``selectExpr`` and ``expr``: one call into the JVM per
select list, and the same expressions in DataFrame code and in ``spark.sql``.  Only built-in
functions are used, so everything stays inside generated code.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Digits kept before the reporting digits are cut.  Rounding twice removes the binary noise of a
#: double (9/2000*100 is a hair under 0.45) so that ties go away from zero on every engine.
_SETTLE_DIGITS = 8


def text(value: str) -> str:
    """A string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def name(column: str) -> str:
    """A quoted column name."""
    return "`" + column.replace("`", "``") + "`"


def columns(expressions: Iterable[str]) -> list[Column]:
    """Columns for ``agg`` and ``groupBy``, which take no SQL text."""
    return [F.expr(e) for e in expressions]


def rows_of(rows: Iterable[Iterable[object]], names: Iterable[str]) -> str:
    """A select item that turns each input row into the given rows of SQL values."""
    rows = list(rows)
    values = ", ".join(str(v) for row in rows for v in row)
    return f"stack({len(rows)}, {values}) AS ({', '.join(names)})"


def settled_round(value: str, digits: int = 1) -> str:
    """Round a double half away from zero, insensitive to its last few binary digits."""
    return f"round(round(CAST({value} AS DOUBLE), {_SETTLE_DIGITS}), {digits})"


def ratio(part: str, whole: str) -> str:
    """``part / whole`` as a double; NULL when ``whole`` is 0 (ANSI division would raise)."""
    return f"(CAST({part} AS DOUBLE) / nullif(CAST({whole} AS DOUBLE), 0D))"


def percent(part: str, whole: str, digits: int = 1) -> str:
    """``part`` as a rounded percentage of ``whole``."""
    return settled_round(f"{ratio(part, whole)} * 100", digits)


def mean_of(total: str, count: str, digits: int) -> str:
    """Rounded mean from an additive (sum, count) pair."""
    return settled_round(ratio(total, count), digits)


def whole_mean(total: str, count: str) -> str:
    """Mean of integers that stays an integer: the fraction is dropped, not rounded."""
    return f"({total} div nullif({count}, 0))"


def days_between(start: str, end: str) -> str:
    """Midnights crossed from ``start`` to ``end`` (23:59 to 00:01 is one day)."""
    return f"CAST(datediff({end}, {start}) AS BIGINT)"


def hours_between(start: str, end: str) -> str:
    """Full-hour marks crossed from ``start`` to ``end`` (10:59 to 11:01 is one hour).

    Built from calendar fields, so it does not depend on the session time zone.
    """
    return f"({days_between(start, end)} * 24 + hour({end}) - hour({start}))"


def hour_number(at: str) -> str:
    """Serial number of the clock hour of ``at``; differences equal :func:`hours_between`."""
    return f"(CAST(unix_date(CAST({at} AS DATE)) AS BIGINT) * 24 + hour({at}))"


def day_of_hour(hour_no: str) -> str:
    """Serial day number of an :func:`hour_number`."""
    return f"(({hour_no} - pmod({hour_no}, 24)) div 24)"


def display_name(column: str) -> str:
    """``under_review`` -> ``under review``."""
    return f"replace({column}, '_', ' ')"


def month_label(at: str) -> str:
    """``Sep 2023``; goes through the date so that the session time zone plays no part."""
    return f"date_format(CAST({at} AS DATE), 'MMM yyyy')"


def weekdays_after(day: str, count: int) -> str:
    """The date ``count`` working days (Monday to Friday) after ``day``.

    A weekend start counts from the Friday before it.
    """
    weekday = f"least(weekday({day}), 4)"
    weekend_days = f"2 * CAST(floor(({weekday} + {count}) / 5) AS INT)"
    return f"date_add({day}, {count} + {weekend_days} + {weekday} - weekday({day}))"
