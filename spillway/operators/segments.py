"""Conversion by segment, as additive tallies.

Events are first reduced to one row per entity, joined to the entity's fact row, and summed per
dimension key *before* the dimension is joined.  The dimension join then sees each key once on
both sides, so one person or account holding a third of all facts costs one row, and no side has
to be small enough to broadcast.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from ..functions import StageLog, by_merge, columns, name, percent, ratio, settled_round
from .progress import entity_progress, reached

TOTAL = "total_applications"


def outcomes(log: StageLog, facts: DataFrame, **progress) -> DataFrame:
    """Fact rows whose entity has events, with the columns of :func:`entity_progress`."""
    return facts.join(by_merge(entity_progress(log, **progress)), log.entity)


def tally(
    log: StageLog,
    facts: DataFrame,
    by: Sequence[str],
    stages: Sequence[str],
    sums: Mapping[str, str] | None = None,
) -> DataFrame:
    """``by..., total_applications, <stages...>, <sums...>`` over :func:`outcomes`.

    ``sums`` maps output names to SQL amounts per row.
    """
    measures = [f"count(1) AS {TOTAL}"]
    measures += [f"sum({reached(log, s)}) AS {name(s)}" for s in stages]
    measures += [f"sum({amount}) AS {out}" for out, amount in (sums or {}).items()]
    return facts.groupBy(*by).agg(*columns(measures))


def roll_up(tallies: DataFrame, by: Sequence[str], additive: Sequence[str]) -> DataFrame:
    """Sum tallies to a coarser key."""
    return tallies.groupBy(*by).agg(*columns(f"sum({name(c)}) AS {name(c)}" for c in additive))


def segment_conversion(
    log: StageLog,
    facts: DataFrame,
    dimension: DataFrame,
    on: str,
    by: Sequence[str],
    stages: Sequence[str],
    keep: Sequence[str] = (),
    weighted: Sequence[str] = (),
) -> DataFrame:
    """Conversion by columns of a dimension joined on ``on``.

    ``keep`` are fact columns that are part of ``by``.  Each ``weighted`` dimension column ``c``
    comes out as ``sum_c`` and ``n_c``, summed over facts, so its mean skips NULLs.
    """
    per_key = tally(log, outcomes(log, facts.select(log.entity, on, *keep)), [on, *keep], stages)
    measures = [f"sum({name(c)}) AS {name(c)}" for c in (TOTAL, *stages)]
    for c in weighted:
        measures.append(f"sum(CAST({name(c)} AS BIGINT) * {TOTAL}) AS {name(f'sum_{c}')}")
        measures.append(f"sum({TOTAL}) FILTER (WHERE {name(c)} IS NOT NULL) AS {name(f'n_{c}')}")
    return per_key.join(by_merge(dimension), on).groupBy(*by).agg(*columns(measures))


# Report columns over a finished tally (one row per segment, so whole-table windows are small).


def conversion_pct(converted: str, total: str = TOTAL) -> str:
    return percent(converted, total)


def share_pct(total: str = TOTAL) -> str:
    return percent(total, f"sum({total}) OVER ()")


def overall_pct(converted: str, total: str = TOTAL) -> str:
    return percent(f"sum({converted}) OVER ()", f"sum({total}) OVER ()")


def delta_of_rounded(converted: str, total: str = TOTAL) -> str:
    """Rounded rate minus rounded overall rate."""
    return settled_round(f"{percent(converted, total)} - {overall_pct(converted, total)}")


def rounded_delta(converted: str, total: str = TOTAL) -> str:
    """Rate minus overall rate, rounded once at the end."""
    overall = ratio(f"sum({converted}) OVER ()", f"sum({total}) OVER ()")
    return settled_round(f"{ratio(converted, total)} * 100 - {overall} * 100")


def conversion_rank(converted: str, total: str = TOTAL) -> str:
    """Rank by the unrounded rate, best first."""
    return f"CAST(rank() OVER (ORDER BY {ratio(converted, total)} DESC) AS BIGINT)"
