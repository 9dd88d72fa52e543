"""Loads, sinks, views and constraint checks over the derived loan book."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame

from ..functions import LOAN_LADDER, StageLog, columns, text
from ..operators import (
    NotNull,
    OneOf,
    Unique,
    constraint_violations,
)
from ..plans import StandingReach, StandingViews, conv_by_loan_type, create_views, funnel_overview
from ..sources import (
    CLUSTERING,
    CONSTRAINTS,
    accepted,
    conform,
    load_delimited,
    load_or_reject,
    loan_book_from_orders,
    merge_latest,
    read_delimited_book,
    read_parquet_book,
    read_partitions,
    read_table,
    read_table_book,
    reject_counts,
    shared_folder,
    write_bucketed_book,
    write_interleaved,
    write_parquet_book,
    write_report,
)
from ..sources.orders import CLICK_LADDER

from .reports import over_book


def load_csv(spark, folder):
    """Write the applications as delimited files and bulk-load them under the declared schema."""
    place = shared_folder(spark, "load")
    write_report(loan_book_from_orders(spark, folder).loan_applications, place, "csv")
    return load_delimited(spark, place, "loan_applications")


def load_csv_book(spark, folder):
    """All four tables written as delimited files and bulk-loaded: rows, keys and a number each."""
    place = shared_folder(spark, "load")
    for table, frame in loan_book_from_orders(spark, folder).tables().items():
        write_report(frame, f"{place}/{table}.csv", "csv")
    numbers = {
        "applicants": "annual_income",
        "loan_applications": "loan_amount",
        "application_events": "event_id",
        "credit_profiles": "credit_score",
    }
    loaded = read_delimited_book(spark, place).tables()
    parts = [
        loaded[table].selectExpr(
            f"{text(table)} AS `table`",
            "count(1) AS n",
            f"sum({CLUSTERING[table]}) AS key_sum",
            f"CAST(sum({number}) AS BIGINT) AS number_sum",
        )
        for table, number in numbers.items()
    ]
    return reduce(DataFrame.unionAll, parts)


def load_csv_events(spark, folder):
    """The same for events, with stage names that differ in case and outer blanks."""
    place = shared_folder(spark, "load")
    events = loan_book_from_orders(spark, folder).application_events.selectExpr(
        "event_id",
        "application_id",
        "IF(event_id % 2 = 0, upper(stage), concat(stage, ' ')) AS stage",
        "event_timestamp",
        "notes",
    )
    write_report(events, place, "csv")
    loaded = load_delimited(spark, place, "application_events")
    return loaded.groupBy("stage").agg(
        *columns(["count(1) AS n", "min(event_timestamp) AS first_at", "max(event_timestamp) AS last_at"])
    )


def load_defaults(spark, folder):
    """Empty fields take the column default on load."""
    place = shared_folder(spark, "load")
    gaps = loan_book_from_orders(spark, folder).credit_profiles.selectExpr(
        "applicant_id",
        "credit_score",
        "debt_to_income_ratio",
        "IF(applicant_id % 4 = 0, NULL, existing_loans) AS existing_loans",
        "IF(applicant_id % 5 = 0, NULL, previous_defaults) AS previous_defaults",
    )
    write_report(gaps, place, "csv")
    loaded = load_delimited(spark, place, "credit_profiles")
    return loaded.groupBy("existing_loans", "previous_defaults").agg(*columns(["count(1) AS n"]))


def status_default(book):
    """The same default applied to a table already loaded."""
    gaps = book.loan_applications.selectExpr(
        "application_id", "loan_type", "IF(application_id % 3 = 0, NULL, status) AS status"
    )
    return conform(gaps, "loan_applications").groupBy("status").agg(*columns(["count(1) AS n"]))


def parquet_sink(spark, folder):
    """Write the whole book twice (the second write replaces the first) and read it back."""
    place = shared_folder(spark, "book")
    book = loan_book_from_orders(spark, folder)
    write_parquet_book(book, place)
    write_parquet_book(book, place)
    stored = read_parquet_book(spark, place)
    return stored.application_events.groupBy("stage").agg(
        *columns(["count(1) AS n", "sum(application_id) AS application_sum"])
    )


def bucketed_tables(spark, folder):
    """The book as managed, bucketed tables, and a report that joins them by application."""
    database = f"spillway_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {database}")
    write_bucketed_book(loan_book_from_orders(spark, folder), database, 4)
    return conv_by_loan_type(read_table_book(spark, database))


def report_output(spark, folder):
    """A report stored as CSV with a header, read back by its column names."""
    place = shared_folder(spark, "report")
    report = funnel_overview(loan_book_from_orders(spark, folder))
    write_report(report, place, "csv")
    return spark.read.schema(report.schema).option("header", True).csv(place)


def read_all_views(spark, folder):
    """Define the five views, twice, and count the rows each one gives."""
    book = loan_book_from_orders(spark, folder)
    create_views(book)
    create_views(book)
    names = (
        "vw_funnel_kpi_summary",
        "vw_stage_dropoff",
        "vw_channel_performance",
        "vw_segment_conversion",
        "vw_executive_dashboard",
    )
    return spark.sql(
        " UNION ALL ".join(f"SELECT '{v}' AS view_name, count(*) AS n FROM {v}" for v in names)
    )


def tables_in_sql(spark, folder):
    """The four tables under their names in ``spark.sql``."""
    loan_book_from_orders(spark, folder).create_views()
    return spark.sql(
        """SELECT loan_type, count(*) AS `applications per type`, max(loan_amount) AS `max`
           FROM loan_applications GROUP BY loan_type"""
    )


def dq_constraint_violations(book):
    return constraint_violations(book.tables(), CONSTRAINTS)


#: Expressions that break rules of every kind, by table and column.
BREAKERS = {
    "applicants": {
        "applicant_id": "IF(applicant_id % 31 = 0, applicant_id - 1, applicant_id)",
        "email": "IF(applicant_id % 40 = 0, NULL, email)",
        "age": "IF(applicant_id % 50 = 0, 130, age)",
        "acquisition_channel": "IF(applicant_id % 60 = 0, 'billboard', acquisition_channel)",
    },
    "loan_applications": {
        "applicant_id": "IF(application_id % 97 = 0, -application_id, applicant_id)",
        "loan_amount": "IF(application_id % 89 = 0, -loan_amount, loan_amount)",
        "status": "IF(application_id % 83 = 0, NULL, status)",
    },
    "application_events": {
        "event_id": "IF(event_id % 101 = 0, event_id - 1, event_id)",
        "application_id": "IF(event_id % 103 = 0, -application_id, application_id)",
        "stage": "IF(event_id % 107 = 0, 'lost', stage)",
        "event_timestamp": "IF(event_id % 109 = 0, NULL, event_timestamp)",
    },
    "credit_profiles": {
        "credit_score": "IF(applicant_id % 37 = 0, credit_score + 600, credit_score)",
        "debt_to_income_ratio": "IF(applicant_id % 41 = 0, 1.5, debt_to_income_ratio)",
    },
}


def dq_broken_book(book):
    """The book's own rows with some values broken: every kind of rule has something to count."""
    broken = {
        table: frame.selectExpr(
            *[f"{BREAKERS[table].get(c, c)} AS {c}" for c in frame.columns]
        )
        for table, frame in book.tables().items()
    }
    return constraint_violations(broken, CONSTRAINTS)


def dq_clickstream(spark, folder):
    """Rules that this log does break: stray stages, repeated users, missing values."""
    events = read_table(spark, folder, "events")
    rules = (
        NotNull("ts"),
        Unique("event_id"),
        Unique("user_id"),
        OneOf("event_type", CLICK_LADDER.stages),
        OneOf("event_type", LOAN_LADDER.stages),
    )
    return constraint_violations({"events": events}, {"events": rules})


def partition_reload(spark, folder):
    """Events in partitions by day: a first load with wrong stages and days, then corrections of some
    days, loaded twice; the latest version of every event is what stays."""
    place = shared_folder(spark, "event-days")
    events = loan_book_from_orders(spark, folder).application_events
    right = events.selectExpr("event_id", "application_id", "stage", "event_timestamp", "2 AS version")
    wrong = right.selectExpr(
        "event_id",
        "application_id",
        "IF(event_id % 11 = 0, 'lost', stage) AS stage",
        "IF(event_id % 13 = 0, event_timestamp + INTERVAL 400 DAYS, event_timestamp) AS event_timestamp",
        "1 AS version",
    )
    day = "CAST(trunc(event_timestamp, 'month') AS DATE) AS event_month"
    corrections = right.where("event_id % 11 = 0 OR event_id % 13 = 0").selectExpr("*", day)
    for load in (wrong.selectExpr("*", day), corrections, corrections):
        merge_latest(load, place, "event_month", ["event_id"], "version")
    return (
        read_partitions(spark, place, corrections)
        .groupBy("event_month", "stage")
        .agg(*columns(["count(1) AS n", "sum(event_id) AS event_sum", "max(event_timestamp) AS last_at"]))
    )


def _standing(view):
    """A view after three loads, of which one brings late events of the others, and the last comes
    twice."""

    def query(spark, folder):
        book = loan_book_from_orders(spark, folder)
        views = StandingViews(spark, shared_folder(spark, "standing-views"), "month")
        late = "event_id % 7 = 3 AND application_id % 3 < 2"
        for number in (0, 1, 2, 2):
            events = book.application_events.where(
                f"IF({late}, {number} = 2, application_id % 3 = {number})"
            )
            applications = book.loan_applications.where(f"application_id % 3 = {number}")
            views.load(number, events, applications, book.applicants)
        return getattr(views, view)()

    return query


def rolling_click_reach(spark, folder):
    """Users per click stage in the seven days up to each day, kept up to date by three loads: the
    second brings late events of the first one's days, the third comes twice."""
    reach = StandingReach(spark, shared_folder(spark, "reach"), CLICK_LADDER)
    clicks = read_table(spark, folder, "events")
    for part in ("event_id % 3 = 0", "event_id % 3 = 1", "event_id % 3 = 2", "event_id % 3 = 2"):
        reach.load(StageLog(clicks.where(part), CLICK_LADDER, "user_id", "event_type", "ts"))
    return reach.rolling(7)


#: Months of the range report: the first and the last.
REACH_MONTHS = ("1996-02-01", "1997-04-01")


def loan_reach_between(spark, folder):
    """Applications per stage, and those with the stage before, over a range of stored months."""
    reach = StandingReach(spark, shared_folder(spark, "reach"), LOAN_LADDER, "month")
    events = loan_book_from_orders(spark, folder).application_events
    for part in ("application_id % 2 = 1 OR stage = 'verified'", "application_id % 2 = 0"):
        reach.load(StageLog(events.where(part), LOAN_LADDER))
    return reach.between(*REACH_MONTHS)


def layout_for_two_keys(spark, folder):
    """Events clustered by application and time alike, read back by either and by reference."""
    place = shared_folder(spark, "layout")
    events = loan_book_from_orders(spark, folder).application_events
    write_interleaved(
        events.selectExpr(
            "*", "CAST(event_timestamp AS DATE) AS event_day", "md5(CAST(event_id AS STRING)) AS reference"
        ),
        place,
        {"application_id": "application_id", "event_day": "unix_date(event_day)"},
        spread=["event_id"],
        lookups={"reference": 100_000},
    )
    stored = spark.read.parquet(place)
    filters = {
        "application": "application_id BETWEEN 1000 AND 2000",
        "time": """event_day BETWEEN DATE '1996-03-01' AND DATE '1996-03-31'
            AND event_timestamp < TIMESTAMP_NTZ '1996-03-31 18:00:00'""",
        "reference": "reference IN (md5('10011'), md5('10012'), md5('11'))",
    }
    parts = [
        stored.where(f).groupBy("stage").agg(*columns(["count(1) AS n", "sum(event_id) AS id_sum"])).selectExpr(f"{text(k)} AS filtered_by", "*")
        for k, f in filters.items()
    ]
    return reduce(DataFrame.unionAll, parts)


#: Texts that break a field's type or a row's rule, by column.
BAD_FIELDS = {
    "application_id": "IF(application_id % 41 = 0, NULL, application_id)",
    "loan_type": "IF(application_id % 23 = 0, 'boat', IF(application_id % 10 = 0, concat(' ', upper(loan_type)), loan_type))",
    "loan_amount": "IF(application_id % 17 = 0, 'much', IF(application_id % 19 = 0, concat('-', loan_amount), loan_amount))",
    "loan_term_months": "IF(application_id % 29 = 0, '13', loan_term_months)",
    "status": "IF(application_id % 7 = 0, NULL, status)",
    "application_date": "IF(application_id % 31 = 0, 'soon', application_date)",
}


def _rejecting_load(spark, folder):
    place = shared_folder(spark, "rejects")
    applications = loan_book_from_orders(spark, folder).loan_applications
    texts = applications.selectExpr(*[f"CAST({c} AS STRING) AS {c}" for c in applications.columns])
    broken = texts.selectExpr(*[f"{BAD_FIELDS.get(c, c)} AS {c}" for c in texts.columns])
    write_report(broken, f"{place}/in", "csv")
    load_or_reject(spark, f"{place}/in", "loan_applications", f"{place}/loaded")
    return f"{place}/loaded"


def load_reject_reasons(spark, folder):
    """How many rows of a partly broken file are accepted, and how many rejected for each reason."""
    return reject_counts(spark, _rejecting_load(spark, folder), "loan_applications")


def load_accepted(spark, folder):
    """The rows of the same file that fit, with defaults and spellings applied."""
    rows = accepted(spark, _rejecting_load(spark, folder), "loan_applications")
    return rows.groupBy("loan_type", "status").agg(
        *columns(["count(1) AS n", "sum(application_id) AS application_sum", "sum(loan_amount) AS amount"])
    )


SOURCES = {
    "load_reject_reasons": load_reject_reasons,
    "load_accepted": load_accepted,
    "partition_reload": partition_reload,
    "rolling_click_reach": rolling_click_reach,
    "loan_reach_between": loan_reach_between,
    "layout_for_two_keys": layout_for_two_keys,
    "standing_channel_performance": _standing("channel_performance"),
    "standing_segment_conversion": _standing("segment_conversion"),
    "standing_executive_dashboard": _standing("executive_dashboard"),
    "load_csv": load_csv,
    "load_csv_book": load_csv_book,
    "bucketed_tables": bucketed_tables,
    "load_csv_events": load_csv_events,
    "load_defaults": load_defaults,
    "status_default": over_book(status_default),
    "parquet_sink": parquet_sink,
    "report_output": report_output,
    "read_all_views": read_all_views,
    "tables_in_sql": tables_in_sql,
    "dq_constraint_violations": over_book(dq_constraint_violations),
    "dq_broken_book": over_book(dq_broken_book),
    "dq_clickstream": dq_clickstream,
}
