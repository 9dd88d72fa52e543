"""Windows and sessions of a stream against the batch report, over restarts, with late rows."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from helpers import dicts, events, log

from spillway.functions import LOAN_LADDER, StageLog
from spillway.sources import SCHEMAS
from spillway.streaming import closed_periods, late_rows, session_funnel, windowed_funnel

DAY, HOUR = dt.timedelta(days=1), dt.timedelta(hours=1)


def stream(spark, folder):
    reader = spark.readStream.schema(SCHEMAS["application_events"]).option("maxFilesPerTrigger", 1)
    return StageLog(reader.parquet(folder), LOAN_LADDER)


def days(seed, number=9, per_day=80):
    """Events day by day, each up to an hour later than its place; one entity has a third of them."""
    pick = random.Random(seed)
    out = []
    for day in range(number):
        rows = []
        for _ in range(per_day):
            entity = 0 if pick.random() < 0.33 else pick.randrange(1, 12)
            at = dt.datetime(2023, 3, 30) + day * DAY + dt.timedelta(seconds=pick.randrange(86_400 - 3600))
            rows.append((entity, pick.choice((*LOAN_LADDER.stages, "withdrawn")), str(at)))
        out.append(rows)
    return out


def run(spark, frame, place):
    query = (
        frame.writeStream.outputMode("append").format("parquet")
        .option("path", f"{place}/out").option("checkpointLocation", f"{place}/checkpoint")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


def stored(spark, frame, place):
    return sorted(dicts(spark.read.schema(frame.schema).parquet(f"{place}/out")), key=lambda r: r["period_start"])


def kept(query):
    """State rows at the end of the newest batch."""
    return sum(o["numRowsTotal"] for o in query.lastProgress["stateOperators"])


KINDS = {
    "windows": (lambda f: windowed_funnel(f, "1 day", "2 hours"), None),
    "sessions": (lambda f: session_funnel(f, "45 minutes", "1 day", "2 hours"), dt.timedelta(minutes=45)),
}


@pytest.mark.parametrize("kind,zone", [("windows", "America/New_York"), ("sessions", "UTC")])
def test_equal_to_the_batch_report_after_restarts(spark, tmp_path, kind, zone):
    make, gap = KINDS[kind]
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        incoming, seen, sizes = str(tmp_path / "in"), [], []
        for rows in days(4, 6):
            events(spark, rows).coalesce(1).write.mode("append").parquet(incoming)
            seen += rows
            query = run(spark, make(stream(spark, incoming)), tmp_path)
            assert late_rows(query) == 0
            sizes.append(kept(query))
        frame = make(stream(spark, incoming))
        expected = dicts(closed_periods(log(spark, seen), DAY, 2 * HOUR, gap).orderBy("period_start"))
        found = stored(spark, frame, tmp_path)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert found == expected
    assert len(found) == 5 and all(r["period_start"].hour == 0 for r in found)
    # Closed windows leave the state: it holds no more after six days than after two.
    assert max(sizes[2:]) <= 1.5 * max(sizes[:2])


@pytest.mark.parametrize("kind", KINDS)
def test_late_rows_are_dropped_and_counted(spark, tmp_path, kind):
    make, _ = KINDS[kind]
    incoming = str(tmp_path / "in")
    early = [(1, "submitted", "2023-04-01 10:00:00"), (2, "submitted", "2023-04-01 11:00:00")]
    later = [(1, "submitted", "2023-04-05 10:00:00")]
    late = [(3, "submitted", "2023-04-01 10:30:00"), (3, "submitted", "2023-04-05 10:30:00")]
    for rows in (early, later, late, [(9, "submitted", "2023-04-09 00:00:00")]):
        events(spark, rows).coalesce(1).write.mode("append").parquet(incoming)
        query = run(spark, make(stream(spark, incoming)), tmp_path)
        dropped = late_rows(query)
        assert dropped == (rows is late)
    found = stored(spark, make(stream(spark, incoming)), tmp_path)
    assert [(r["period_start"].day, r["submitted"]) for r in found] == [(1, 2), (5, 2)]


def test_state_is_empty_after_everything_is_closed(spark, tmp_path):
    incoming = str(tmp_path / "in")
    for rows in (*days(6, 3), [(1, "submitted", "2024-01-01 00:00:00")]):
        events(spark, rows).coalesce(1).write.mode("append").parquet(incoming)
        query = run(spark, windowed_funnel(stream(spark, incoming), "1 day", "2 hours"), tmp_path)
    assert kept(query) <= 2  # the last event's own window


def test_sessions_meet_at_the_gap(spark):
    rows = [(1, "submitted", "2023-04-01 10:00:00"), (1, "verified", "2023-04-01 10:45:00"), (1, "approved", "2023-04-01 11:30:01"), (2, "submitted", "2023-04-09 00:00:00")]
    found = dicts(closed_periods(log(spark, rows), DAY, HOUR, dt.timedelta(minutes=45)))
    assert [(r["sessions"], r["submitted"], r["verified"], r["approved"]) for r in found] == [(2, 1, 1, 1)]
