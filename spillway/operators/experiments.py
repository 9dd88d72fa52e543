"""Comparisons of a treated and a control group: two proportions, and an interval for the lift."""

from __future__ import annotations

from math import exp

from pyspark.sql import DataFrame

from ..functions import columns, name, percent, ratio, settled_round

#: Fixed value: two-sided 95 % point of the standard normal distribution.
Z_95 = 1.959963984540054


def two_proportion_test(rows: DataFrame, treated: str, converted: str) -> DataFrame:
    """One row: sizes, conversions and rates of both groups, the lift in points, the pooled z
    value and whether it is significant at 95 %.  ``treated`` and ``converted`` are SQL
    conditions over a row."""
    counts = [
        f"count_if({treated}) AS treated_n",
        f"count_if({treated} AND {converted}) AS treated_converted",
        f"count_if(NOT ({treated})) AS control_n",
        f"count_if(NOT ({treated}) AND {converted}) AS control_converted",
    ]
    return (
        rows.agg(*columns(counts))
        .selectExpr(
            "*",
            f"{ratio('treated_converted', 'treated_n')} AS p1",
            f"{ratio('control_converted', 'control_n')} AS p2",
            f"{ratio('treated_converted + control_converted', 'treated_n + control_n')} AS p",
            f"{ratio('1', 'treated_n')} + {ratio('1', 'control_n')} AS spread",
        )
        .selectExpr("*", f"{ratio('p1 - p2', 'sqrt(p * (1 - p) * spread)')} AS z")
        .selectExpr(
            "treated_n",
            "treated_converted",
            "control_n",
            "control_converted",
            f"{percent('treated_converted', 'treated_n')} AS treated_pct",
            f"{percent('control_converted', 'control_n')} AS control_pct",
            f"{settled_round('(p1 - p2) * 100', 2)} AS lift_points",
            f"{settled_round('z', 4)} AS z_value",
            f"abs(z) > {Z_95}D AS significant_95",
        )
    )


#: Replicates that one hash of an entity gives: 128 binary digits, 32 for each.
_PER_HASH = 4


def poisson_steps(digits: int = 32) -> list[int]:
    """Where a uniform whole number of so many binary digits passes to the next weight: the
    distribution function of a Poisson variable of mean one, as far as it differs from 1."""
    steps, part, below = [], exp(-1), 0.0
    for weight in range(1, 20):
        below += part
        part /= weight
        step = int(below * (1 << digits))
        if steps and (step == steps[-1] or step >= 1 << digits):
            break
        steps.append(step)
    return steps


def bootstrap_lift(
    rows: DataFrame,
    entity: str,
    stratum: str,
    treated: str,
    converted: str,
    replicates: int = 200,
    seed: int = 42,
    level: float = 0.95,
) -> DataFrame:
    """One row: the lift stratified by ``stratum``, and the bootstrap interval around it.

    In a replicate each entity weighs as much as a Poisson variable of mean one says, drawn from a
    hash of seed, entity and replicate: the same weights on any engine, in any order, after any
    retry, and one pass over the rows for all replicates.  An entity's rows share its weights.  The
    lift is the mean of the strata's differences of rates, each weighing as many entities as it has;
    a stratum without treated or without control rows has no difference and is left out.

    ``entity`` is a column (its text is hashed; NULL is one entity), ``stratum`` a column of few
    values, NULL among them; ``treated`` and ``converted`` are SQL conditions that are never NULL.
    What is shuffled is one row per task, stratum and replicate, whatever the sizes of the strata.
    """
    # Rows with one entity and one outcome are one row with a count before they are multiplied.
    units = rows.groupBy(
        *columns(
            [
                f"coalesce(CAST({name(entity)} AS STRING), '') AS _entity",
                f"{name(stratum)} AS _stratum",
                f"({treated}) AS _treated",
                f"({converted}) AS _converted",
            ]
        )
    ).agg(*columns(["count(1) AS _n"]))
    hashes = -(-replicates // _PER_HASH)
    drawn = units.selectExpr("*", f"explode(sequence(0, {hashes - 1})) AS _hash_no").selectExpr(
        "*", f"md5(concat_ws(':', '{seed}', _entity, _hash_no)) AS _hash"
    )
    uniform = drawn.selectExpr("*", f"explode(sequence(0, {_PER_HASH - 1})) AS _part").selectExpr(
        "_stratum", "_treated", "_converted", "_n",
        f"_hash_no * {_PER_HASH} + _part AS replicate",
        "CAST(conv(substr(_hash, 8 * _part + 1, 8), 16, 10) AS BIGINT) AS _uniform",
    )
    weight = " + ".join(f"IF(_uniform >= {step}L, 1L, 0L)" for step in poisson_steps())
    weighted = uniform.where(f"replicate < {replicates}").selectExpr("*", f"_n * ({weight}) AS _w")
    sides = {"t": "_treated", "c": "NOT _treated"}
    sums = [
        f"coalesce(sum({value}) FILTER (WHERE {side}{extra}), 0L) AS {out}{s}{hit}"
        for out, value in (("w", "_w"), ("n", "_n"))
        for s, side in sides.items()
        for hit, extra in (("", ""), ("_hit", " AND _converted"))
    ]
    tallies = weighted.groupBy("_stratum", "replicate").agg(*columns(sums))
    differences = tallies.selectExpr(
        "*",
        f"{ratio('wt_hit', 'wt')} - {ratio('wc_hit', 'wc')} AS _wd",
        f"{ratio('nt_hit', 'nt')} - {ratio('nc_hit', 'nc')} AS _nd",
    )
    lifts = differences.groupBy("replicate").agg(
        *columns(
            [
                f"{ratio('sum((wt + wc) * _wd)', 'sum(IF(_wd IS NULL, 0, wt + wc))')} AS _lift",
                f"{ratio('sum((nt + nc) * _nd)', 'sum(IF(_nd IS NULL, 0, nt + nc))')} AS _plain",
                "count(_nd) AS _strata",
                "sum(IF(_nd IS NULL, 0, nt + nc)) AS _rows",
            ]
        )
    )
    tail = (1 - level) / 2
    return lifts.agg(
        *columns(
            [
                "max(_rows) AS compared",
                "max(_strata) AS strata",
                "count(_lift) AS replicates",
                f"{settled_round('max(_plain) * 100', 2)} AS lift_points",
                f"{settled_round(f'percentile(_lift, {tail:.10g}D) * 100', 2)} AS low_points",
                f"{settled_round(f'percentile(_lift, {1 - tail:.10g}D) * 100', 2)} AS high_points",
            ]
        )
    )
