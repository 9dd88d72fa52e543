"""Streaming queries, run to the end of the data at hand."""

from __future__ import annotations

from ..functions import LOAN_LADDER, StageLog
from ..sources import read_table, shared_folder
from ..sources.orders import application_events, clickstream_log
from ..streaming import (
    live_funnel,
    service_alerts,
    session_funnel,
    start_live_funnel,
    state_partitions,
    windowed_funnel,
)


def _stream(spark, folder, table):
    # A stream reads folders and patterns only; this pattern fits the table's own name and no other.
    schema = read_table(spark, folder, table).schema
    return spark.readStream.schema(schema).parquet(f"{folder}/{table}.parque[t]")


def _run_live_funnel(spark, log):
    place = shared_folder(spark, "live-funnel")
    with state_partitions(spark):
        run = start_live_funnel(log, f"{place}/counts", f"{place}/checkpoint", availableNow=True)
    run.awaitTermination()
    return live_funnel(spark, f"{place}/counts", log.ladder)


def live_loan_funnel(spark, folder):
    events = application_events(_stream(spark, folder, "orders"))
    return _run_live_funnel(spark, StageLog(events, LOAN_LADDER))


def live_click_funnel(spark, folder):
    return _run_live_funnel(spark, clickstream_log(_stream(spark, folder, "events")))


def _appended(spark, rows, purpose):
    """All rows that a streaming frame emits in append mode."""
    place = shared_folder(spark, purpose)
    with state_partitions(spark):
        run = (
            rows.writeStream.outputMode("append")
            .format("parquet")
            .option("path", f"{place}/rows")
            .option("checkpointLocation", f"{place}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
    run.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{place}/rows")


def live_approval_alerts(spark, folder):
    events = application_events(_stream(spark, folder, "orders"))
    alerts = service_alerts(StageLog(events, LOAN_LADDER), "verified", "approved", 5)
    return _appended(spark, alerts, "alerts")


def live_loan_days(spark, folder):
    """The funnel of each closed day, in event time."""
    events = application_events(_stream(spark, folder, "orders"))
    return _appended(spark, windowed_funnel(StageLog(events, LOAN_LADDER), "1 day", "36 hours"), "loan-days")


def live_click_sessions(spark, folder):
    """Sessions by the day they ended."""
    clicks = clickstream_log(_stream(spark, folder, "events"))
    return _appended(spark, session_funnel(clicks, "40 minutes", "1 day", "3 hours"), "click-sessions")


STREAMS = {
    "live_loan_funnel": live_loan_funnel,
    "live_click_funnel": live_click_funnel,
    "live_approval_alerts": live_approval_alerts,
    "live_loan_days": live_loan_days,
    "live_click_sessions": live_click_sessions,
}
