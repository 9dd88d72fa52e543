"""Strict funnels: each stage after the one before, the whole chain inside a time window.

An entity's visits are folded in time order.  The state says, for every stage, when the latest
chain began that has come this far; a visit carries a chain one stage on if the chain began
within the window.

Folding is done in two levels, so that no entity is one long list.  The visits of an entity and
clock hour, at most one per stage and second, are folded into a summary of fixed size: the chains
that begin in the hour, and for every stage pair the earliest second at which a chain that entered
the hour at one stage leaves it at the other.  Summaries of consecutive hours compose, and an entity
has no more of them than the log has hours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions import StageLog, columns, hour_number, name, percent

#: A window without an end, in seconds.
_ENDLESS = 1 << 61


def strict_progress(log: StageLog, within: int | None = None) -> DataFrame:
    """``entity, stage_order, entered_on``: the stage that a strict chain of the entity reaches, and
    the day of its first visit to the ladder's first stage.

    A chain visits the stages one by one from the first, each in a later second than the one before,
    and its last visit is at most ``within`` seconds after its first.  An entity may start over any
    number of times, and its best chain counts.  Entities that never visit the first stage, and rows
    without entity or time, are left out; stages off the ladder are ignored; of repeats in one second
    one counts.
    """
    window = _ENDLESS if within is None else within
    orders = range(1, len(log.ladder.stages) + 1)
    entity, hour = name(log.entity), hour_number(log.at_sql)
    second = f"{hour} * 3600 + minute({log.at_sql}) * 60 + CAST(floor(second({log.at_sql})) AS INT)"
    visits = (
        log.rows()
        .where(f"{entity} IS NOT NULL AND {log.at_sql} IS NOT NULL")
        .selectExpr(
            f"{entity} AS entity",
            f"{hour} AS hour_no",
            # Later stages of one second come first: they must not follow its earlier ones.
            f"struct({second} AS second, -{log.ladder.order(log.stage_sql)} AS falling) AS visit",
        )
    )
    hours = (
        visits.groupBy("entity", "hour_no")
        .agg(*columns(["sort_array(collect_set(visit)) AS visits"]))  # at most 3,600 per stage
        .selectExpr("entity", "hour_no", f"aggregate(visits, {_nothing(orders)}, {_one_visit(orders, window)}) AS hour")
    )
    chains = (
        hours.groupBy("entity")
        .agg(*columns(["sort_array(collect_list(struct(hour_no, hour))) AS hours"]))  # one per clock hour
        .selectExpr("entity", f"aggregate(hours, {_no_chain(orders)}, {_one_hour(orders, window)}) AS chain")
    )
    reached = " ".join(f"WHEN chain.s{i} IS NOT NULL THEN {i}" for i in reversed(orders))
    return chains.where("chain.s1 IS NOT NULL").selectExpr(
        f"entity AS {entity}",
        f"CASE {reached} END AS stage_order",
        "date_from_unix_date(CAST(floor(chain.first / 86400) AS INT)) AS entered_on",
    )


def strict_cohorts(log: StageLog, within: int | None = None, period: str = "month") -> DataFrame:
    """``cohort_<period>, <stages...>, conv_rate_pct``: the entities that entered in a period, and how
    many of them a strict chain brought to each stage, whenever that was."""
    stages = log.ladder.stages
    cohort = f"cohort_{period}"
    return (
        strict_progress(log, within)
        .groupBy(*columns([f"trunc(entered_on, '{period}') AS {cohort}"]))
        .agg(*columns(f"count_if(stage_order >= {i}) AS {name(s)}" for i, s in enumerate(stages, 1)))
        .selectExpr("*", f"{percent(name(stages[-1]), name(stages[0]))} AS conv_rate_pct")
        .orderBy(cohort)
    )


def _pairs(orders: range) -> list[tuple[int, int]]:
    return [(j, i) for j in orders for i in orders if j < i]


def _struct(fields: dict[str, str]) -> str:
    return f"named_struct({', '.join(f'{text!r}, {value}' for text, value in fields.items())})"


def _nothing(orders: range) -> str:
    """The summary of an hour without visits: ``first`` entry, latest starts ``s<i>`` of chains that
    reach a stage, earliest ends ``t<j>_<i>`` of chains that come in at stage j and reach stage i."""
    fields = ["first", *(f"s{i}" for i in orders), *(f"t{j}_{i}" for j, i in _pairs(orders))]
    return _struct(dict.fromkeys(fields, "CAST(NULL AS BIGINT)"))


def _one_visit(orders: range, window: int) -> str:
    fields = {"first": "IF(v.falling = -1, coalesce(a.first, v.second), a.first)"}
    fields["s1"] = "IF(v.falling = -1, v.second, a.s1)"
    for i in orders[1:]:
        in_time = f"v.falling = -{i} AND v.second - a.s{i - 1} <= {window}L"
        fields[f"s{i}"] = f"IF({in_time}, greatest(a.s{i}, a.s{i - 1}), a.s{i})"
    for j, i in _pairs(orders):
        goes_on = f"v.falling = -{i}" + ("" if i == j + 1 else f" AND a.t{j}_{i - 1} IS NOT NULL")
        fields[f"t{j}_{i}"] = f"IF({goes_on}, coalesce(a.t{j}_{i}, v.second), a.t{j}_{i})"
    return f"(a, v) -> {_struct(fields)}"


def _no_chain(orders: range) -> str:
    return _struct(dict.fromkeys(["first", *(f"s{i}" for i in orders)], "CAST(NULL AS BIGINT)"))


def _one_hour(orders: range, window: int) -> str:
    fields = {"first": "coalesce(a.first, h.hour.first)"}
    for i in orders:
        ways = [f"a.s{i}", f"h.hour.s{i}"]
        ways += [f"IF(h.hour.t{j}_{i} - a.s{j} <= {window}L, a.s{j}, NULL)" for j in orders if j < i]
        fields[f"s{i}"] = f"greatest({', '.join(ways)})"
    return f"(a, h) -> {_struct(fields)}"
