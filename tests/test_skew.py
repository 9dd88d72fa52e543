"""One application or applicant holding a third of all rows: same results, no hot task."""

from __future__ import annotations

import datetime as dt
import random
from collections import Counter, defaultdict

import pytest
from helpers import book, dicts

from spillway import plans
from spillway.functions import LOAN_LADDER
from spillway.operators import differences, response_gaps, stage_transitions, transition_summary

ORDER = {s: i for i, s in enumerate(LOAN_LADDER.stages)}


@pytest.fixture(scope="module")
def rows():
    """A third of the events belong to application 0, many of them at the same time."""
    chance = random.Random(5)
    out = []
    for i in range(1500):
        application = 0 if i % 3 == 0 else 1 + chance.randrange(200)
        minutes = chance.randrange(60 * 24 * 6) // 45 * 45
        at = dt.datetime(2023, 2, 25) + dt.timedelta(minutes=minutes)
        out.append((application, chance.choice(LOAN_LADDER.stages), at))
    return out


@pytest.fixture(scope="module")
def loans(spark, rows):
    applications = [
        {
            "application_id": a,
            "applicant_id": 1 if a % 3 else a,
            "loan_type": "home_loan" if a % 2 else "auto_loan",
            "loan_amount": 100 + a,
        }
        for a in range(201)
    ]
    people = [{"applicant_id": a, "acquisition_channel": "direct" if a else "referral"} for a in range(201)]
    return book(spark, [(a, s, str(t)) for a, s, t in rows], applications, people)


def hour(t):
    return t.replace(minute=0, second=0)


def hours(a, b):
    return int((hour(b) - hour(a)).total_seconds()) // 3600


def test_every_step_of_the_hot_application(loans, rows):
    expected = Counter()
    by_application = defaultdict(list)
    for a, s, t in rows:
        by_application[a].append((ORDER[s] + 1, t))
    for a, visits in by_application.items():
        visits.sort()
        for (s1, t1), (s2, t2) in zip(visits, visits[1:]):
            expected[a, s1, s2, hours(t1, t2), (t2.date() - t1.date()).days] += 1
    found = Counter()
    for r in dicts(stage_transitions(loans.log)):
        key = r["application_id"], r["stage_order"], r["next_order"], r["hours"], r["days"]
        found[key] += r["weight"]
    assert found == expected

    summary = {(r["stage_order"], r["next_order"]): r for r in dicts(transition_summary(stage_transitions(loans.log)))}
    totals = Counter()
    for (_, s1, s2, _, _), n in expected.items():
        totals[s1, s2] += n
    assert {k: r["transitions"] for k, r in summary.items()} == totals
    days = sorted(d for (_, s1, _, _, d), n in expected.items() if s1 == 1 for _ in range(n))
    middle = len(days) // 2
    median = days[middle] if len(days) % 2 else (days[middle - 1] + days[middle]) / 2
    assert {r["median_days"] for k, r in summary.items() if k[0] == 1} == {round(median, 1)}


def test_all_gaps_of_the_hot_application(loans, rows):
    opened, answered = defaultdict(set), defaultdict(set)
    for a, s, t in rows:
        if s == "submitted":
            opened[a].add(hour(t))
        if s == "under_review":
            answered[a].add(hour(t))
    expected = {
        (a, hours(x, y)) for a in opened for x in opened[a] for y in answered.get(a, ())
    }
    found = dicts(response_gaps(loans.log, "submitted", "under_review"))
    assert len(found) == len(expected)
    assert {(r["application_id"], r["hours"]) for r in found} == expected
    tiers = dicts(plans.response_tier_conversion(loans))
    assert sum(r["total_applications"] for r in tiers) == len(expected)


@pytest.mark.parametrize("origin", [0, -50, 467_000])
@pytest.mark.parametrize("size", [1, 2, 7, 40, 300])
def test_differences_listed_or_by_day(spark, size, origin):
    chance = random.Random(size)
    a = [origin + h for h in chance.sample(range(size + 20), size)]
    b = [origin + h for h in chance.sample(range(30, size + 90), size)]
    frame = spark.createDataFrame([(a, b)], "a array<bigint>, b array<bigint>")
    found = frame.selectExpr(f"{differences('a', 'b')} AS d").first().d
    assert len(found) == len(set(found))
    assert set(found) == {y - x for x in a for y in b}


def test_differences_of_sparse_hours_with_far_outliers(spark):
    a = [5, *range(20_000, 21_000, 2)]
    b = [9, *range(30_000, 31_000, 2)]
    frame = spark.createDataFrame([(a, b)], "a array<bigint>, b array<bigint>")
    found = frame.selectExpr(f"{differences('a', 'b')} AS d").first().d
    assert sorted(found) == sorted({y - x for x in a for y in b})


def test_hot_applicant_is_tallied_before_the_lookup(loans, rows):
    seen = {a for a, _, _ in rows}
    paid = {a for a, s, _ in rows if s == "disbursed"}
    channel = {a: "direct" if (1 if a % 3 else a) else "referral" for a in seen}
    expected = {
        c: (sum(channel[a] == c for a in seen), sum(channel[a] == c for a in paid))
        for c in set(channel.values())
    }
    report = dicts(plans.conv_by_channel(loans))
    assert {r["channel"]: (r["total_applications"], r["disbursed"]) for r in report} == expected


def test_rows_are_combined_before_every_shuffle_of_events(spark, loans):
    """What leaves a task for the hot application is one row per group, not its events."""
    reports = (
        plans.funnel_overview,
        plans.stage_month_heatmap,
        plans.conv_by_channel,
        plans.response_tier_conversion,
        plans.stage_durations,
        plans.stuck_applications,
        plans.journey_durations,
    )
    for report in reports:
        plan = report(loans)._jdf.queryExecution().executedPlan().toString().splitlines()
        shuffles = [i for i, line in enumerate(plan) if "Exchange hashpartitioning(" in line]
        assert shuffles
        for i in shuffles:
            source = next(line for line in plan[i + 1 :] if "Scan" in line or "Exchange" in line)
            if "event_id" in source:
                assert "Aggregate" in plan[i + 1] or "Aggregate" in plan[i + 2], plan[i : i + 4]
