"""Distinct entities per stage over any range of days, from stored bits instead of events.

A day's entities of a stage are a set of bits, 64 ids to a word: ``on_day, stage_order, word,
bits``.  Words are fixed-width, so they are built and merged by ``bit_or`` on the map side in
generated code, and an id that stands alone costs one word, not a block of bits.  Sets of several
days are merged before they are counted, so the counts are exact; sums of daily counts are not.

Sketches are the choice where ids are no whole numbers, or where sets would not fit: fixed size per
day and stage, with a relative error of about ``1.04 / sqrt(2 ** digits)`` each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions import StageLog, columns, name

#: What identifies a stored word.
WORD_KEY = ["on_day", "stage_order", "word"]

#: What a stored day may stand for; through the date, so that no session time zone plays a part.
_PERIODS = {"day": "CAST({0} AS DATE)", "month": "trunc(CAST({0} AS DATE), 'month')"}


def reach_words(log: StageLog, period: str = "day") -> DataFrame:
    """``on_day, stage_order, word, bits`` of a log whose entities are whole numbers.

    ``period`` is what a row's day stands for: the ``day``, or the first of its ``month``.  Events
    without an entity, without a time or off the ladder are in no set; repeats change nothing.
    """
    entity = f"CAST({name(log.entity)} AS BIGINT)"
    by = [
        f"{_PERIODS[period].format(log.at_sql)} AS on_day",
        f"{log.ladder.order(log.stage_sql)} AS stage_order",
        f"shiftright({entity}, 6) AS word",
    ]
    known = f"{name(log.entity)} IS NOT NULL AND {log.at_sql} IS NOT NULL"
    bits = f"bit_or(shiftleft(1L, CAST({entity} & 63 AS INT))) AS bits"
    return log.rows().where(known).groupBy(*columns(by)).agg(*columns([bits]))


def merged_words(words: DataFrame) -> DataFrame:
    """One row per word; indifferent to order and repeats."""
    return words.groupBy(*WORD_KEY).agg(*columns(["bit_or(bits) AS bits"])).select(*WORD_KEY, "bits")


def reach_between(words: DataFrame, stages: tuple[str, ...], first: str, last: str) -> DataFrame:
    """``stage, stage_order, entities, with_stage_before`` over the days ``first`` to ``last``.

    ``with_stage_before`` counts the entities that the range also has in the stage before (NULL for
    the first).  A stage nobody reached has zeros.
    """
    numbers = range(1, len(stages) + 1)
    sets = words.where(f"on_day BETWEEN DATE '{first}' AND DATE '{last}'").groupBy("word").agg(
        *columns(f"coalesce(bit_or(bits) FILTER (WHERE stage_order = {n}), 0L) AS s{n}" for n in numbers)
    )
    counts = [f"coalesce(sum(bit_count(s{n})), 0L) AS n{n}" for n in numbers]
    counts += [f"coalesce(sum(bit_count(s{n} & s{n - 1})), 0L) AS b{n}" for n in numbers[1:]]
    rows = ", ".join(
        f"'{stage}', {n}, n{n}, {f'b{n}' if n > 1 else 'CAST(NULL AS BIGINT)'}"
        for n, stage in zip(numbers, stages)
    )
    return sets.agg(*columns(counts)).selectExpr(
        f"stack({len(stages)}, {rows}) AS (stage, stage_order, entities, with_stage_before)"
    )


def rolling_reach(words: DataFrame, days: int = 7) -> DataFrame:
    """``on_day, stage_order, entities``: the ``days`` days that end on each stored day.

    A stored word is read once and counts in ``days`` windows; a window's words meet by ``bit_or``
    before the shuffle.  Windows end on days on which some stage has entities; a stage nobody reached
    within a window has no row there.
    """
    ends = words.select("on_day").distinct()
    spread = words.selectExpr(
        f"explode(sequence(on_day, date_add(on_day, {days - 1}))) AS on_day", "stage_order", "word", "bits"
    )
    return (
        spread.join(ends, "on_day", "left_semi")
        .groupBy(*WORD_KEY)
        .agg(*columns(["bit_or(bits) AS bits"]))
        .groupBy("on_day", "stage_order")
        .agg(*columns(["sum(bit_count(bits)) AS entities"]))
    )


def reach_sketches(log: StageLog, digits: int = 12, period: str = "day") -> DataFrame:
    """``on_day, stage_order, sketch``: approximate sets of any kind of entity."""
    by = [
        f"{_PERIODS[period].format(log.at_sql)} AS on_day",
        f"{log.ladder.order(log.stage_sql)} AS stage_order",
    ]
    known = f"{name(log.entity)} IS NOT NULL AND {log.at_sql} IS NOT NULL"
    sketch = f"hll_sketch_agg(CAST({name(log.entity)} AS STRING), {digits}) AS sketch"
    return log.rows().where(known).groupBy(*columns(by)).agg(*columns([sketch]))


def sketched_between(sketches: DataFrame, first: str, last: str) -> DataFrame:
    """``stage_order, entities`` (estimated) over the days ``first`` to ``last``."""
    return (
        sketches.where(f"on_day BETWEEN DATE '{first}' AND DATE '{last}'")
        .groupBy("stage_order")
        .agg(*columns(["hll_sketch_estimate(hll_union_agg(sketch)) AS entities"]))
    )
