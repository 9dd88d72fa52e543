"""Streams end where the batch operators end."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from helpers import dicts, events, log

from spillway.functions import LOAN_LADDER, StageLog
from spillway.operators import funnel, service_breaches, stage_counts
from spillway.sources import SCHEMAS
from spillway.streaming import late_rows, live_counts, live_funnel, service_alerts, start_live_funnel


def arrivals(seed=3):
    """Batches of events in which later batches repeat pairs of earlier ones."""
    chance = random.Random(seed)
    batches = []
    for b in range(4):
        rows = []
        for _ in range(120):
            application = 0 if chance.random() < 0.33 else chance.randrange(1, 40)
            at = dt.datetime(2023, 4, 1 + b, chance.randrange(24))
            rows.append((application, chance.choice((*LOAN_LADDER.stages, "withdrawn")), str(at)))
        batches.append(rows)
    return batches


def stream(spark, folder):
    reader = spark.readStream.schema(SCHEMAS["application_events"]).option("maxFilesPerTrigger", 1)
    return StageLog(reader.parquet(folder), LOAN_LADDER)


def deliver(spark, folder, rows):
    events(spark, rows).coalesce(1).write.mode("append").parquet(folder)


def test_live_funnel_over_batches_and_a_restart(spark, tmp_path):
    incoming, counts, checkpoint = (str(tmp_path / n) for n in ("in", "counts", "checkpoint"))
    batches = arrivals()

    def catch_up():
        run = start_live_funnel(stream(spark, incoming), counts, checkpoint, availableNow=True)
        run.awaitTermination()

    seen = []
    for rows in batches:
        deliver(spark, incoming, rows)
        seen += rows
        catch_up()
        expected = dicts(stage_counts(log(spark, seen)).orderBy("stage_order"))
        assert dicts(live_counts(spark, counts, LOAN_LADDER).orderBy("stage_order")) == expected
    assert dicts(live_funnel(spark, counts, LOAN_LADDER).orderBy("stage_order")) == dicts(
        funnel(stage_counts(log(spark, seen))).orderBy("stage_order")
    )


def test_live_funnel_counts_a_rerun_batch_once(spark, tmp_path):
    """A batch whose output was stored but not committed is run again and replaces itself."""
    incoming, counts, checkpoint = (str(tmp_path / n) for n in ("in", "counts", "checkpoint"))
    for rows in arrivals(8):
        deliver(spark, incoming, rows)

    def catch_up():
        run = start_live_funnel(stream(spark, incoming), counts, checkpoint, availableNow=True)
        run.awaitTermination()
        return dicts(live_counts(spark, counts, LOAN_LADDER).orderBy("stage_order"))

    first = catch_up()
    last_commit = max((tmp_path / "checkpoint" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for name in (last_commit.name, f".{last_commit.name}.crc"):
        path = last_commit.parent / name
        if path.exists():
            path.unlink()
    assert catch_up() == first


@pytest.mark.parametrize("split", [1, 3])
def test_alerts_equal_the_batch_report(spark, tmp_path, split):
    chance = random.Random(11)
    rows = []
    for a in range(150):
        start = dt.datetime(2023, 4, 1) + dt.timedelta(hours=chance.randrange(24 * 40))
        rows.append((a, "verified", start))
        if chance.random() < 0.7:
            rows.append((a, "approved", start + dt.timedelta(hours=chance.randrange(24 * 14))))
    rows.sort(key=lambda r: r[2])
    incoming = str(tmp_path / "in")
    size = -(-len(rows) // split)
    for i in range(0, len(rows), size):
        deliver(spark, incoming, [(a, s, str(t)) for a, s, t in rows[i : i + size]])
        run = (
            service_alerts(stream(spark, incoming), "verified", "approved", 5)
            .writeStream.option("checkpointLocation", str(tmp_path / "checkpoint"))
            .trigger(availableNow=True)
            .start(str(tmp_path / "alerts"))
        )
        run.awaitTermination()
    found = dicts(spark.read.parquet(str(tmp_path / "alerts")))
    texts = [(a, s, str(t)) for a, s, t in rows]
    everyone = dicts(service_breaches(log(spark, texts), "verified", "approved", 5, dt.date.max))
    assert late_rows(run) == 0
    last_due = max(r["due_date"] for r in everyone) + dt.timedelta(days=1)
    last_decision = max(t for _, s, t in rows if s == "approved").date()
    clock = min(last_due, last_decision) - dt.timedelta(days=1)
    breaches = dicts(service_breaches(log(spark, texts), "verified", "approved", 5, clock))
    expected = {r["application_id"]: r["due_date"] for r in breaches if r["due_date"] < clock}
    assert len(found) == len(expected) > 10
    assert {r["application_id"]: r["due_date"] for r in found} == expected


def test_a_decision_before_the_wait_does_not_settle_it(spark, tmp_path):
    """Batch and stream agree however long ago the decision was, over several batches."""
    batches = [
        [(1, "approved", "2022-01-01 10:00:00"), (2, "verified", "2022-01-03 09:00:00")],
        [(2, "approved", "2022-01-05 09:00:00"), (1, "verified", "2023-01-02 10:00:00")],
        [(2, "verified", "2023-01-03 08:00:00"), (3, "verified", "2023-01-03 08:00:00")],
        [(3, "approved", "2023-01-04 08:00:00"), (2, "approved", "2023-02-01 08:00:00")],
        [(9, "verified", "2024-01-01 00:00:00"), (9, "approved", "2024-01-02 00:00:00")],
        [(9, "approved", "2024-01-09 00:00:00")],
    ]
    incoming, alerts = str(tmp_path / "in"), str(tmp_path / "alerts")
    for rows in batches:
        deliver(spark, incoming, rows)
        run = (
            service_alerts(stream(spark, incoming), "verified", "approved", 5)
            .writeStream.option("checkpointLocation", str(tmp_path / "checkpoint"))
            .trigger(availableNow=True)
            .start(alerts)
        )
        run.awaitTermination()
    found = {(r["application_id"], str(r["waiting_since"])) for r in spark.read.parquet(alerts).collect()}
    everything = log(spark, [row for rows in batches for row in rows])
    batch = service_breaches(everything, "verified", "approved", 5, dt.date(2024, 1, 2))
    expected = {(r["application_id"], str(r["waiting_since"])) for r in batch.collect()}
    assert found == expected == {(1, "2023-01-02"), (2, "2023-01-03")}


def test_old_counts_are_removed(spark, tmp_path):
    incoming, counts, checkpoint = (str(tmp_path / n) for n in ("in", "counts", "checkpoint"))
    for rows in arrivals(5):
        deliver(spark, incoming, rows)
    start_live_funnel(stream(spark, incoming), counts, checkpoint, availableNow=True).awaitTermination()
    assert len(list((tmp_path / "counts").glob("batch=*"))) <= 2
