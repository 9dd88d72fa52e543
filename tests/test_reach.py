"""Stored sets of entities against plain Python sets."""

from __future__ import annotations

import datetime as dt
import os
import random

import pytest
from helpers import dicts

from spillway import StageLadder, StageLog
from spillway.operators import reach_between, reach_sketches, reach_words, rolling_reach, sketched_between
from spillway.plans import StandingReach

LADDER = StageLadder(("seen", "tried", "bought"))
START = dt.datetime(2024, 3, 1)


def made(count, seed, hot=None, entity=lambda r: r.choice([0, -1, -64, 63, 64, 5_000_000_000, r.randrange(-300, 300)])):
    r = random.Random(seed)
    rows = []
    for n in range(count):
        who = hot if hot is not None and n % 3 == 0 else entity(r)
        rows.append((who, r.choice([*LADDER.stages, "other"]), START + dt.timedelta(minutes=r.randrange(20 * 1440))))
    return rows


def log(spark, rows):
    return StageLog(spark.createDataFrame(rows, "who long, what string, at timestamp_ntz"), LADDER, "who", "what", "at")


def sets(rows, first, last):
    return [
        {w for w, s, t in rows if s == stage and w is not None and t is not None and first <= t.date() <= last}
        for stage in LADDER.stages
    ]


@pytest.mark.parametrize("hot", [None, 7])
def test_any_range_is_exact(spark, hot):
    rows = [*made(900, 1, hot), (None, "seen", START), (3, "seen", None)]
    words = reach_words(log(spark, rows))
    for first, last in [(1, 1), (3, 9), (1, 20), (25, 28)]:
        a, b = dt.date(2024, 3, first), dt.date(2024, 3, last)
        found = sorted(dicts(reach_between(words, LADDER.stages, str(a), str(b))), key=lambda r: r["stage_order"])
        expected = sets(rows, a, b)
        assert [r["entities"] for r in found] == [len(s) for s in expected]
        assert [r["with_stage_before"] for r in found] == [None, *(len(x & y) for x, y in zip(expected, expected[1:]))]


def test_rolling_windows(spark):
    rows = [r for r in made(400, 2, 11) if r[2].day not in (5, 6)]
    found = {(r["on_day"], r["stage_order"]): r["entities"] for r in dicts(rolling_reach(reach_words(log(spark, rows)), 4))}
    days = {t.date() for _, s, t in rows if s != "other"}
    expected = {
        (day, n): len(s)
        for day in days
        for n, s in enumerate(sets(rows, day - dt.timedelta(days=3), day), 1)
        if s
    }
    assert found == expected


def test_loads_late_repeated_and_apart(spark, tmp_path):
    reach = StandingReach(spark, str(tmp_path / "reach"), LADDER)
    assert sum(r["entities"] for r in dicts(reach.between("2024-03-01", "2024-03-31"))) == 0
    rows = made(600, 3, 5)
    early, late = [r for r in rows if r[2].day < 10], [r for r in rows if r[2].day >= 10]
    held_back = early[::4]
    reach.load(log(spark, [r for r in early if r not in held_back]))
    before = {f: os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(tmp_path / "reach") for f in fs}
    assert {d.day for d in reach.load(log(spark, late))} == {r[2].day for r in late if r[1] != "other"}
    after = {f: os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(tmp_path / "reach") for f in fs}
    untouched = {f for f in before if f.startswith("part-")}
    assert untouched and {f: after.get(f) for f in untouched} == {f: before[f] for f in untouched}
    reach.load(log(spark, held_back))
    reach.load(log(spark, held_back))
    whole = sets(rows, dt.date(2024, 3, 1), dt.date(2024, 3, 31))
    found = sorted(dicts(reach.between("2024-03-01", "2024-03-31")), key=lambda r: r["stage_order"])
    assert [r["entities"] for r in found] == [len(s) for s in whole]
    words = reach.words()
    assert words.count() == words.select("on_day", "stage_order", "word").distinct().count()


def test_months(spark):
    rows = [(1, "seen", dt.datetime(2024, 1, 31, 23, 59)), (1, "seen", dt.datetime(2024, 2, 1)), (2, "seen", dt.datetime(2024, 2, 29))]
    words = reach_words(log(spark, rows), "month")
    assert sorted((str(r["on_day"]), r["bits"]) for r in dicts(words)) == [("2024-01-01", 2), ("2024-02-01", 6)]


def test_sketches_come_near(spark):
    events = spark.range(60_000).selectExpr(
        "concat('user ', id % 20000) AS who", "'seen' AS what",
        "timestampadd(HOUR, CAST(id % 240 AS INT), TIMESTAMP_NTZ '2024-03-01 00:00:00') AS at",
    )
    sketches = reach_sketches(StageLog(events, LADDER, "who", "what", "at"))
    exact = events.where("at < '2024-03-06'").select("who").distinct().count()
    (found,) = dicts(sketched_between(sketches, "2024-03-01", "2024-03-05"))
    assert abs(found["entities"] / exact - 1) < 0.05  # three standard errors of 12 digits
