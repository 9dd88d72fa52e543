"""Loads, defaults, sinks, constraints, shared folders."""

from __future__ import annotations

import datetime as dt

import pytest
from helpers import SMALL, book, dicts, events, table

from spillway import plans
from spillway.operators import constraint_violations, stage_counts
from spillway.sources import (
    CONSTRAINTS,
    LoanBook,
    load_delimited,
    loan_book_from_orders,
    read_delimited_book,
    read_parquet_book,
    shared_folder,
    write_parquet_book,
    write_report,
)

FILES = {
    "applicants": [
        "id,first,last,mail,phone,age,city,job,income,channel,registered",
        "1,Ada,Lane,ada@x.example,,34,Leeds,employed,41000,referral,2022-12-01 08:00:00",
    ],
    "loan_applications": [
        "anything,may,stand,in,the,header,line",
        "1,1,home_loan,250000,48,submitted,2023-02-25 11:47:00",
        "2,1,Auto_Loan ,9000,12,,2023-03-01 06:45:00",
    ],
    "application_events": [
        "event_id,application_id,stage,event_timestamp,notes",
        "1,1,Submitted,2023-02-25 11:47:00,first",
        "2,1,under_review ,2023-02-25 15:00:00,",
        "3,2,SUBMITTED,2023-03-01 06:45:00,",
    ],
    "credit_profiles": ["a,b,c,d,e", "1,529,0.33,,"],
}


@pytest.fixture
def folder(tmp_path):
    for name, lines in FILES.items():
        (tmp_path / f"{name}.csv").write_text("\n".join(lines) + "\n")
    return tmp_path


def test_load_by_position_with_defaults_and_one_spelling(spark, folder):
    loans = read_delimited_book(spark, str(folder))
    assert dicts(loans.loan_applications)[1] == {
        "application_id": 2,
        "applicant_id": 1,
        "loan_type": "auto_loan",
        "loan_amount": 9000,
        "loan_term_months": 12,
        "status": "submitted",
        "application_date": dt.datetime(2023, 3, 1, 6, 45),
    }
    profile = dicts(loans.credit_profiles)[0]
    assert (profile["existing_loans"], profile["previous_defaults"]) == (0, 0)
    assert [r["reached"] for r in dicts(stage_counts(loans.log))] == [2, 1]
    assert dicts(plans.response_tier_conversion(loans))[0]["avg_hours_to_review"] == 4.0


@pytest.mark.parametrize(
    "line",
    ["3,1,home_loan,much,48,submitted,2023-02-25 11:47:00", "3,1,home_loan", "3,1,a,5,12,b,soon"],
)
def test_a_row_that_does_not_fit_fails_the_load(spark, folder, line):
    with (folder / "loan_applications.csv").open("a") as out:
        out.write(line + "\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        load_delimited(spark, str(folder / "loan_applications.csv"), "loan_applications").collect()


def test_loan_book_names(spark, folder):
    with pytest.raises(ValueError, match="loan book"):
        LoanBook({"applicants": None})
    read_delimited_book(spark, str(folder)).create_views()
    assert spark.sql("SELECT count(*) AS n FROM application_events").first().n == 3


def test_parquet_book_round_trip_and_overwrite(spark, tmp_path):
    loans = loan_book_from_orders(spark, SMALL)
    place = str(tmp_path / "book")
    for _ in range(2):
        write_parquet_book(loans, place)
    stored = read_parquet_book(spark, place)
    for name, frame in loans.tables().items():
        assert frame.schema.simpleString() == stored.table(name).schema.simpleString()
        assert frame.exceptAll(stored.table(name)).isEmpty()
        assert stored.table(name).exceptAll(frame).isEmpty()


def test_report_as_csv(spark, tmp_path):
    report = plans.funnel_overview(loan_book_from_orders(spark, SMALL))
    write_report(report, str(tmp_path / "r"), "csv")
    again = spark.read.schema(report.schema).option("header", True).csv(str(tmp_path / "r"))
    assert sorted(again.collect()) == sorted(report.collect())


def test_shared_folder_follows_the_session(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    first, second = shared_folder(spark, "x"), shared_folder(spark, "x")
    assert first.startswith(base) and first != second


def test_constraint_breakers(spark):
    good = {
        "application_id": 1,
        "applicant_id": 1,
        "loan_type": "home_loan",
        "loan_amount": 5,
        "loan_term_months": 12,
        "status": "submitted",
        "application_date": "2023-01-01 00:00:00",
    }
    person = {
        "applicant_id": 1,
        "first_name": "a",
        "last_name": "b",
        "email": "a@b.example",
        "age": 30,
        "registration_date": "2023-01-01 00:00:00",
    }
    applications = [
        good,
        {**good, "loan_amount": 0},
        {**good, "application_id": 2, "applicant_id": 77},
        {**good, "application_id": 3, "loan_term_months": 13},
        {**good, "application_id": 4, "loan_type": None},
    ]
    people = [person, {**person, "applicant_id": 2, "email": None}, {**person, "applicant_id": 3, "age": 17}]
    profiles = [{"applicant_id": 1, "credit_score": 851, "debt_to_income_ratio": "0.5"}]
    small = book(spark, [], applications, people, profiles)
    tables = {**small.tables(), "application_events": events(spark, [(1, "withdrawn", "2023-01-01 00:00:00")])}
    found = {
        (r["table"], r["rule"]): r["violations"]
        for r in dicts(constraint_violations(tables, CONSTRAINTS))
        if r["violations"]
    }
    assert found == {
        ("loan_applications", "unique(application_id)"): 1,
        ("loan_applications", "references(applicant_id, applicants)"): 1,
        ("loan_applications", "in_range(loan_amount)"): 1,
        ("loan_applications", "one_of(loan_term_months)"): 1,
        ("applicants", "not_null(email)"): 1,
        ("applicants", "unique(email)"): 1,
        ("applicants", "in_range(age)"): 1,
        ("application_events", "one_of(stage)"): 1,
        ("credit_profiles", "in_range(credit_score)"): 1,
    }


def test_table_types(spark):
    frame = table(spark, "credit_profiles", [{"applicant_id": 1, "debt_to_income_ratio": "0.25"}])
    assert dict(frame.dtypes)["debt_to_income_ratio"] == "decimal(5,2)"


def test_buckets_grow_with_the_largest_table(spark):
    """A bucket has about so many rows at most; the given number of buckets is the least."""
    from spillway.sources import read_table_book, write_bucketed_book

    loans = book(spark, [(a, s, "2023-01-02 08:00:00") for a in range(20) for s in ("submitted", "verified")])
    spark.sql("CREATE DATABASE growing")
    try:
        for rows, buckets in ((20, 2), (19, 4), (5, 8)):
            write_bucketed_book(loans, "growing", 2, rows=rows)
            stored = read_table_book(spark, "growing")
            assert stored.application_events.exceptAll(loans.application_events).isEmpty()
            assert stored.application_events.count() == 40
            for table in ("application_events", "loan_applications"):
                told = spark.sql(f"DESCRIBE EXTENDED growing.{table}").where("col_name = 'Num Buckets'").first()
                assert int(told["data_type"]) == buckets
    finally:
        spark.sql("DROP DATABASE growing CASCADE")
