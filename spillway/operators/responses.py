"""How long entities waited between two given stages, all repeats of both stages considered."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions import StageLog, columns, day_of_hour, hour_number, hours_between, name, text
from .progress import STAGES, entity_progress, first_of_stage


def response_gaps(
    log: StageLog, opened: str, answered: str, repeats: str = "keep"
) -> DataFrame:
    """``entity, stage_set, hours``: one row per distinct hour gap of an entity.

    ``repeats="keep"``: the gaps are those between every ``opened`` and every ``answered`` event.
    Sets of clock hours are combined on the map side; their size is bounded by the hours of the
    log's time span, not by the number of events.  ``repeats="first"``: only the first event of
    each stage counts, which is faster and gives the same rows where no stage repeats.
    """
    if repeats == "first":
        return (
            entity_progress(log, first_of=[opened, answered])
            .where(log.ladder.includes(STAGES, opened, answered))
            .selectExpr(
                name(log.entity),
                STAGES,
                f"{hours_between(first_of_stage(opened), first_of_stage(answered))} AS hours",
            )
        )
    if repeats != "keep":
        raise ValueError("repeats is 'keep' or 'first'")
    stage, hour = log.stage_sql, hour_number(log.at_sql)
    # One set for both stages, even numbers for opened and odd ones for answered: half the
    # buffers of two sets.
    marked = f"""CASE {stage} WHEN {text(opened)} THEN {hour} * 2
        WHEN {text(answered)} THEN {hour} * 2 + 1 END"""
    return (
        log.rows()
        .groupBy(log.entity)
        .agg(
            *columns(
                [f"bit_or({log.ladder.bit(stage)}) AS {STAGES}", f"collect_set({marked}) AS hours"]
            )
        )
        .where(log.ladder.includes(STAGES, opened, answered))
        .selectExpr(
            name(log.entity),
            STAGES,
            "transform(filter(hours, h -> pmod(h, 2) = 0), h -> h div 2) AS opened",
            "transform(filter(hours, h -> pmod(h, 2) = 1), h -> (h - 1) div 2) AS answered",
        )
        .selectExpr(
            name(log.entity), STAGES, f"explode({differences('opened', 'answered')}) AS hours"
        )
    )


def differences(starts: str, ends: str) -> str:
    """SQL for the distinct values of ``end - start`` over two non-empty sets of clock hours.

    Where either set has one hour there is one difference per hour of the other.  Otherwise the sets
    are compared day by day, each day of ``ends`` being one bit mask, so the work grows with the days
    squared and the memory with the hours between the extremes, never with the combinations.
    """
    return f"""CASE WHEN size({starts}) = 1 THEN transform({ends}, e -> e - get({starts}, 0))
        WHEN size({ends}) = 1 THEN transform({starts}, s -> get({ends}, 0) - s)
        ELSE {_differences_by_day(starts, ends)} END"""


def _differences_by_day(starts: str, ends: str) -> str:
    earliest = f"least(array_min({starts}), array_min({ends}))"
    mask = "aggregate(hours, 0L, (bits, hour) -> bits | shiftleft(1L, hour))"
    # Bit i of a day shift stands for the gap of that many days and i - 23 hours.
    every_bit = f"{(1 << 47) - 1}L"
    meet = """IF(bits = every_bit OR NOT coalesce(get(days.ends, day + shift) != 0, false), bits,
        aggregate(get(days.starts, day), bits, (found, hour) ->
            found | shiftleft(get(days.ends, day + shift), 23 - hour)))"""
    meet = meet.replace("every_bit", every_bit)
    shifted = f"aggregate(sequence(0, size(days.starts) - 1), 0L, (bits, day) -> {meet})"
    gaps = """transform(filter(sequence(0, 46), i -> getbit(bits, i) = 1),
        i -> CAST(shift * 24 + i - 23 AS BIGINT))"""
    shifts = "sequence(1 - size(days.starts), size(days.ends) - 1)"
    return _let(
        "origin",
        f"{day_of_hour(earliest)} * 24",
        _let(
            "days",
            f"""named_struct('starts', {_hours_by_day(starts)},
                             'ends', transform({_hours_by_day(ends)}, hours -> {mask}))""",
            f"array_distinct(flatten(transform({shifts}, shift -> {_let('bits', shifted, gaps)})))",
        ),
    )


def _hours_by_day(hours: str) -> str:
    """SQL for the sorted hours of day (0 to 23) of each day, from the day of ``origin`` on."""
    in_order = f"concat(array(origin - 1), array_sort({hours}))"
    # One flag per hour from the origin on: false up to the next hour of the set, then true.
    flags = f"""flatten(zip_with(slice({in_order}, 1, size({hours})), array_sort({hours}),
        (before, hour) -> concat(array_repeat(false, CAST(hour - before - 1 AS INT)), array(true))))"""
    return _let(
        "flags",
        flags,
        """transform(sequence(0, (size(flags) - 1) div 24), day ->
            filter(sequence(0, 23), hour -> coalesce(get(flags, CAST(day * 24 + hour AS INT)), false)))""",
    )


def _let(variable: str, value: str, body: str) -> str:
    """SQL for ``body`` with ``variable`` worked out once, however often a lambda in it runs."""
    return f"get(transform(array({value}), {variable} -> {body}), 0)"
