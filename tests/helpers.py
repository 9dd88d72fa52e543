"""Short ways to write small tables of a loan book."""

from __future__ import annotations

from spillway.functions import LOAN_LADDER, StageLog
from spillway.sources import SCHEMAS, LoanBook

SMALL = "/root/testdata/sf0.001"


def table(spark, name, rows):
    """A loan-book table from dicts; missing columns are NULL, times are text."""
    fields = SCHEMAS[name].fields
    text = [tuple(None if r.get(f.name) is None else str(r[f.name]) for f in fields) for r in rows]
    raw = spark.createDataFrame(text, ", ".join(f"{f.name} string" for f in fields))
    return raw.selectExpr(*[f"CAST({f.name} AS {f.dataType.simpleString()}) {f.name}" for f in fields])


def events(spark, rows):
    """Events from (application_id, stage, time) tuples."""
    return table(
        spark,
        "application_events",
        [
            {"event_id": i, "application_id": a, "stage": s, "event_timestamp": t}
            for i, (a, s, t) in enumerate(rows)
        ],
    )


def book(spark, event_rows, applications=None, applicants=(), profiles=()):
    """A loan book; applications default to one per application id in the events."""
    if applications is None:
        ids = sorted({a for a, _, _ in event_rows})
        applications = [
            {"application_id": a, "applicant_id": a, "loan_type": "auto_loan", "loan_amount": 100}
            for a in ids
        ]
    return LoanBook(
        {
            "applicants": table(spark, "applicants", applicants),
            "loan_applications": table(spark, "loan_applications", applications),
            "application_events": events(spark, event_rows),
            "credit_profiles": table(spark, "credit_profiles", profiles),
        }
    )


def log(spark, rows):
    return StageLog(events(spark, rows), LOAN_LADDER)


def dicts(frame):
    return [r.asDict() for r in frame.collect()]
