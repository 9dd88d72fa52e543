"""Table constraints as a data-quality job.

Files enforce neither keys nor checks, so the constraints are counted after a load.  As in SQL, a
check passes when its value is NULL, and a NULL reference points nowhere and is not an orphan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame

from ..functions import by_merge, columns, name, rows_of, text


@dataclass(frozen=True)
class NotNull:
    column: str

    @property
    def rule(self) -> str:
        return f"not_null({self.column})"

    def broken(self) -> str:
        return f"{name(self.column)} IS NULL"


@dataclass(frozen=True)
class InRange:
    """Inclusive range; an open end is ``None``."""

    column: str
    low: float | None = None
    high: float | None = None

    @property
    def rule(self) -> str:
        return f"in_range({self.column})"

    def broken(self) -> str:
        outside = []
        if self.low is not None:
            outside.append(f"{name(self.column)} < {self.low}")
        if self.high is not None:
            outside.append(f"{name(self.column)} > {self.high}")
        return " OR ".join(outside)


@dataclass(frozen=True)
class OneOf:
    column: str
    values: tuple

    @property
    def rule(self) -> str:
        return f"one_of({self.column})"

    def broken(self) -> str:
        allowed = ", ".join(text(v) if isinstance(v, str) else str(v) for v in self.values)
        return f"{name(self.column)} NOT IN ({allowed})"


@dataclass(frozen=True)
class Unique:
    """Counts the key values that occur more than once."""

    column: str

    @property
    def rule(self) -> str:
        return f"unique({self.column})"


@dataclass(frozen=True)
class References:
    """Counts the rows whose value is missing from ``parent.parent_column``."""

    column: str
    parent: str
    parent_column: str

    @property
    def rule(self) -> str:
        return f"references({self.column}, {self.parent})"


def primary_key(column: str) -> tuple:
    return NotNull(column), Unique(column)


def constraint_violations(
    tables: Mapping[str, DataFrame], rules: Mapping[str, Sequence]
) -> DataFrame:
    """``table, rule, violations``: one row per rule, zero counts included."""
    parts = []
    for table, table_rules in rules.items():
        frame = tables[table]
        checks = [r for r in table_rules if hasattr(r, "broken")]
        if checks:
            parts.append(_check_counts(table, frame, checks))
        for rule in table_rules:
            if isinstance(rule, Unique):
                parts.append(_duplicate_keys(table, frame, rule))
            elif isinstance(rule, References):
                parts.append(_orphans(table, frame, rule, tables[rule.parent]))
    return reduce(DataFrame.unionByName, parts)


def _check_counts(table, frame, checks) -> DataFrame:
    """All row-level checks of a table in one pass over it."""
    counts = [f"count_if({check.broken()}) AS c{i}" for i, check in enumerate(checks)]
    rows = [(text(table), text(check.rule), f"c{i}") for i, check in enumerate(checks)]
    return frame.agg(*columns(counts)).selectExpr(rows_of(rows, ("table", "rule", "violations")))


def _duplicate_keys(table, frame, rule) -> DataFrame:
    key = name(rule.column)
    repeated = frame.where(f"{key} IS NOT NULL").groupBy(rule.column).count().where("count > 1")
    return _one_count(table, rule, repeated, "count(1)")


def _orphans(table, frame, rule, parent) -> DataFrame:
    # Child rows are counted per reference first: a reference shared by a third of the rows
    # reaches the join as one row.
    key = name(rule.column)
    used = frame.where(f"{key} IS NOT NULL").selectExpr(f"{key} AS reference").groupBy("reference")
    known = parent.selectExpr(f"{name(rule.parent_column)} AS reference")
    lost = used.count().join(by_merge(known), "reference", "left_anti")
    return _one_count(table, rule, lost, "coalesce(sum(count), 0L)")


def _one_count(table, rule, rows, measure) -> DataFrame:
    return rows.agg(*columns([f"{measure} AS violations"])).selectExpr(
        f"{text(table)} AS table", f"{text(rule.rule)} AS rule", "violations"
    )


def table_row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """``table, row_count``: the check after a load."""
    counts = [
        frame.agg(*columns(["count(1) AS row_count"])).selectExpr(
            f"{text(table)} AS table", "row_count"
        )
        for table, frame in tables.items()
    ]
    return reduce(DataFrame.unionAll, counts)
