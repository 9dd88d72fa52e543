"""Strict chains against every way to choose visits."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from helpers import dicts, log

from spillway.functions import LOAN_LADDER
from spillway.operators import strict_cohorts, strict_progress

STAGES = LOAN_LADDER.stages
START = dt.datetime(2023, 4, 1)


def brute(rows, within):
    """The furthest stage over all chains, by following every visit."""
    found = {}
    visits = {}
    for entity, stage, at in rows:
        if entity is not None and at is not None and stage in STAGES:
            second = dt.datetime.fromisoformat(at).replace(microsecond=0)
            visits.setdefault(entity, set()).add((second, STAGES.index(stage)))
    for entity, own in visits.items():
        starts = [t for t, s in own if s == 0]
        if not starts:
            continue
        best = 0
        for first in starts:
            frontier = {first}
            for k in range(1, len(STAGES)):
                frontier = {
                    t for t, s in own if s == k and (within is None or (t - first).total_seconds() <= within)
                    and any(t > before for before in frontier)
                }
                if not frontier:
                    break
                best = max(best, k)
        found[entity] = (best + 1, min(starts).date())
    return found


def strict(spark, rows, within):
    return {r["application_id"]: (r["stage_order"], r["entered_on"]) for r in dicts(strict_progress(log(spark, rows), within))}


def visits(seed, entities=60, hot=0, span=72 * 3600):
    pick = random.Random(seed)
    rows = []
    for n in range(entities * 8):
        entity = 0 if hot and n % 3 == 0 else pick.randrange(entities)
        at = START + dt.timedelta(seconds=pick.randrange(span), milliseconds=pick.randrange(1000))
        rows.append((entity, pick.choice((*STAGES, "withdrawn")), str(at)))
    return rows


@pytest.mark.parametrize("within", [None, 3600, 9 * 3600, 40 * 3600])
@pytest.mark.parametrize("seed,span", [(1, 72 * 3600), (2, 7200), (3, 40)])
def test_all_chains(spark, seed, span, within):
    rows = visits(seed, hot=1, span=span)
    expected = brute(rows, within)
    assert strict(spark, rows, within) == expected
    assert len({o for o, _ in expected.values()}) > 1


def test_order_and_window(spark):
    at = lambda s: str(START + dt.timedelta(seconds=s))
    rows = [
        (1, "submitted", at(0)), (1, "under_review", at(10)), (1, "verified", at(5)),  # verified too early
        (2, "submitted", at(0)), (2, "under_review", at(0)),  # not later
        (3, "submitted", at(0)), (3, "under_review", at(50)), (3, "submitted", at(60)), (3, "under_review", at(100)),
        (3, "verified", at(140)),  # only the second start is in time
        (4, "under_review", at(3)), (4, "verified", at(9)),  # never entered
        (5, "submitted", at(0)), (5, "verified", at(9)),  # a stage is missing
        (6, "submitted", at(3599)), (6, "under_review", at(3600)), (6, "verified", at(7300)),  # over hours
        (7, "submitted", None), (None, "submitted", at(0)), (8, "withdrawn", at(0)),
    ]
    assert strict(spark, rows, 80) == {e: (o, START.date()) for e, o in {1: 2, 2: 1, 3: 3, 5: 1, 6: 2}.items()}
    assert strict(spark, rows, None)[6] == (3, START.date())
    assert strict(spark, rows, None)[3] == (3, START.date())


def test_cohorts_and_empty(spark):
    rows = visits(7, span=90 * 86_400)
    got = {r["cohort_month"]: [r[s] for s in STAGES] for r in dicts(strict_cohorts(log(spark, rows), 30 * 86_400))}
    expected = {}
    for order, day in brute(rows, 30 * 86_400).values():
        counts = expected.setdefault(day.replace(day=1), [0] * 5)
        for k in range(order):
            counts[k] += 1
    assert got == expected
    assert dicts(strict_cohorts(log(spark, []))) == []
