"""Partitioned reloads and the views they keep up to date."""

from __future__ import annotations

import datetime as dt
import os
import random

from helpers import book, dicts, events, table

from spillway import plans
from spillway.functions import LOAN_LADDER
from spillway.plans import StandingViews
from spillway.sources import LoanBook, latest, merge_latest, overwrite_partitions, read_partitions

SCHEMA = "id long, day date, amount long, note string, version int"


def rows(*given):
    return [(i, day and dt.date(2023, 4, day), amount, note, version) for i, day, amount, note, version in given]


def files(place):
    return {os.path.join(d, f) for d, _, names in os.walk(place) for f in names if f.endswith(".parquet")}


def load(spark, place, *given):
    return merge_latest(spark.createDataFrame(rows(*given), SCHEMA), place, "day", ["id"], "version")


def stored(spark, place):
    frame = read_partitions(spark, place, spark.createDataFrame([], SCHEMA))
    return sorted(tuple(r) for r in frame.collect())


def test_a_load_touches_its_partitions_only(spark, tmp_path):
    place = str(tmp_path / "table")
    load(spark, place, (1, 1, 10, "a", 1), (2, 2, 20, "b", 1), (3, 3, 30, "c", 1))
    before = files(place)
    touched = load(spark, place, (2, 2, 21, "b", 2), (4, 4, 40, "d", 1))
    assert {d.day for d in touched} == {2, 4}
    assert stored(spark, place) == rows((1, 1, 10, "a", 1), (2, 2, 21, "b", 2), (3, 3, 30, "c", 1), (4, 4, 40, "d", 1))
    kept = {f for f in before if "day=2023-04-02" not in f}
    assert len(kept) == 2 and kept <= files(place)


def test_the_same_load_twice_and_an_old_one_late(spark, tmp_path):
    place = str(tmp_path / "table")
    for _ in range(2):
        load(spark, place, (1, 1, 10, "a", 2), (1, 1, 9, "z", 1), (2, 1, 20, None, 1), (2, 1, 20, None, 1))
    load(spark, place, (1, 1, 8, "late", 1), (3, None, 1, "no day", None), (3, None, 2, "no day", None))
    expected = rows((1, 1, 10, "a", 2), (2, 1, 20, None, 1))
    assert [r for r in stored(spark, place) if r[0] < 3] == expected
    assert [r for r in stored(spark, place) if r[0] == 3] == rows((3, None, 2, "no day", None))


def test_a_row_moves_and_its_partition_goes(spark, tmp_path):
    place = str(tmp_path / "table")
    load(spark, place, (1, 1, 10, "a", 1), (2, 2, 20, "b", 1), (3, None, 1, "x", 1))
    touched = load(spark, place, (1, 2, 10, "a", 2), (3, 2, 1, "x", 2))
    assert set(touched) == {dt.date(2023, 4, 1), dt.date(2023, 4, 2), None}
    assert stored(spark, place) == rows((1, 2, 10, "a", 2), (2, 2, 20, "b", 1), (3, 2, 1, "x", 2))
    assert {d for d in os.listdir(place) if d.startswith("day=")} == {"day=2023-04-02"}


def test_empty_load_and_intermediate_folders(spark, tmp_path):
    place = str(tmp_path / "table")
    assert load(spark, place) == []
    assert stored(spark, place) == []
    shared = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(shared)) if os.path.isdir(shared) else set()
    load(spark, place, (1, 1, 10, "a", 1))
    load(spark, place)
    assert set(os.listdir(shared)) <= before | {n for n in os.listdir(shared) if not n.startswith("spillway-")}


def test_a_key_with_most_versions(spark, tmp_path):
    given = [(1, 1 + n % 3, n, "v", n) for n in range(500)] + [(2, 1, 5, "w", 0)]
    frame = spark.createDataFrame(rows(*given), SCHEMA)
    assert sorted(tuple(r) for r in latest(frame, ["id"], "version").collect()) == rows((1, 1 + 499 % 3, 499, "v", 499), (2, 1, 5, "w", 0))
    overwrite_partitions(frame, str(tmp_path / "all"), "day", ["id"])
    assert len(stored(spark, str(tmp_path / "all"))) == 501


def whole_book(spark, seed=2, number=120):
    pick = random.Random(seed)
    log, applications = [], []
    for a in range(number):
        at = dt.datetime(2023, 3, 20) + dt.timedelta(hours=pick.randrange(24 * 12))
        if a % 10:
            applications.append(
                {"application_id": a, "applicant_id": 0 if a % 3 else a, "loan_type": pick.choice(["auto_loan", "home_loan", None]),
                 "loan_amount": pick.choice([None, 100, 250]), "application_date": at}
            )
        for s in (*LOAN_LADDER.stages, "withdrawn")[: pick.randrange(7)]:
            log.append((a, s, str(at)))
            at += dt.timedelta(hours=pick.randrange(60))
    people = [{"applicant_id": a, "acquisition_channel": pick.choice(["direct", "referral"])} for a in range(0, number, 2)]
    return log, applications, book(spark, log, applications, people)


def views_of(standing):
    found = (standing.channel_performance(), standing.segment_conversion(), standing.executive_dashboard())
    return [dicts(v) for v in found]


def reports_of(loans):
    return [dicts(r(loans)) for r in (plans.channel_performance, plans.segment_performance, plans.executive_dashboard)]


def test_views_after_every_load(spark, tmp_path):
    log, applications, whole = whole_book(spark)
    standing = StandingViews(spark, str(tmp_path / "views"))
    seen_log, seen_applications = [], []
    shuffled = log[:]
    random.Random(5).shuffle(shuffled)
    loads = [(0, shuffled[:150], applications[:40]), (1, shuffled[150:200], applications[40:]), (2, shuffled[200:], [])]
    for number, some, more in [*loads, loads[1]]:
        standing.load(
            number,
            events(spark, some),
            table(spark, "loan_applications", more) if more else None,
            whole.applicants,
        )
        seen_log += [r for r in some if r not in seen_log]
        seen_applications += [a for a in more if a not in seen_applications]
        tables = {**whole.tables(), "application_events": events(spark, seen_log)}
        tables["loan_applications"] = table(spark, "loan_applications", seen_applications)
        assert views_of(standing) == reports_of(LoanBook(tables))
    assert views_of(standing) == reports_of(whole)


def test_only_touched_days_are_rewritten(spark, tmp_path):
    log, applications, whole = whole_book(spark)
    standing = StandingViews(spark, str(tmp_path / "views"))
    standing.load(0, whole.application_events, whole.loan_applications, whole.applicants)
    before = files(tmp_path / "views")
    one = applications[7]
    touched = standing.load(1, events(spark, [(one["application_id"], "disbursed", "2023-06-01 00:00:00")]))
    day = one["application_date"].date()
    assert set(touched) == {day, None}
    lasting = {f for f in before if f"applied_on={day}" not in f and "HIVE_DEFAULT" not in f}
    assert lasting <= files(tmp_path / "views") and len(lasting) > 10


def test_a_corrected_application_moves_to_its_day(spark, tmp_path):
    log, applications, whole = whole_book(spark)
    standing = StandingViews(spark, str(tmp_path / "views"))
    standing.load(0, whole.application_events, whole.loan_applications, whole.applicants)
    changed = [{**a, "application_date": dt.datetime(2023, 7, 1), "loan_amount": 999} if n % 9 == 0 else a for n, a in enumerate(applications)]
    fixed = table(spark, "loan_applications", changed)
    standing.load(1, None, fixed.where("loan_amount = 999"), whole.applicants)
    assert views_of(standing) == reports_of(LoanBook({**whole.tables(), "loan_applications": fixed}))
    assert standing.tallies().where("applied_on = DATE'2023-07-01'").count() > 0
