"""A loan book and a click log derived from order, customer and event tables.

Integer arithmetic only, so the same rows come out on any engine.
"""

from __future__ import annotations

from functools import cache, partial

from pyspark.sql import DataFrame, SparkSession

from ..functions import LOAN_LADDER, StageLadder, StageLog, rows_of, text
from .book import LoanBook
from .schemas import ACQUISITION_CHANNELS, SCHEMAS

# Fixed values of the mapping.
LOAN_TYPE_OF_PRIORITY = {
    "1-URGENT": "personal_loan",
    "2-HIGH": "home_loan",
    "3-MEDIUM": "auto_loan",
    "4-NOT SPECIFIED": "business_loan",
    "5-LOW": "education_loan",
}
EMPLOYMENT_OF_SEGMENT = {
    "AUTOMOBILE": "employed",
    "BUILDING": "self_employed",
    "FURNITURE": "unemployed",
    "HOUSEHOLD": "student",
    "MACHINERY": "retired",
}
#: An order reaches a stage when its score, 0 to 99, is at least this.
REACH_SCORE = {"submitted": 0, "under_review": 8, "verified": 34, "approved": 60, "disbursed": 63}

#: The click log's funnel; other event types are outside it.
CLICK_LADDER = StageLadder(("view", "click", "signup", "purchase"))


def read_table(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def loan_book_from_orders(spark: SparkSession, folder: str) -> LoanBook:
    read = cache(partial(read_table, spark, folder))

    def derived(make, source):
        return lambda: make(read(source))

    return LoanBook(
        {
            "applicants": derived(applicants, "customer"),
            "loan_applications": derived(loan_applications, "orders"),
            "application_events": derived(application_events, "orders"),
            "credit_profiles": derived(credit_profiles, "customer"),
        }
    )


def loan_applications(orders: DataFrame) -> DataFrame:
    return _typed(
        orders,
        "loan_applications",
        application_id="o_orderkey",
        applicant_id="o_custkey",
        loan_type=_translated("o_orderpriority", LOAN_TYPE_OF_PRIORITY),
        loan_amount="floor(o_totalprice)",
        loan_term_months="12 * (1 + o_orderkey % 5)",
        status=text(LOAN_LADDER.first),
        application_date=_APPLIED_AT,
    )


def application_events(orders: DataFrame) -> DataFrame:
    """One row per stage an order reaches, each stage some minutes after the one before."""
    delays = {
        "submitted": "0L",
        "under_review": "60 + (o_orderkey * 53) % 3900",
        "verified": "720 + (o_orderkey * 71) % 5000",
        "approved": "600 + (o_orderkey * 89) % 3500",
        "disbursed": """1440 + (o_orderkey * 97) % 4800
            + IF(o_orderkey % 8 = 0, ((o_orderkey div 8) % 25) * 1440, 0L)""",
    }
    entries, minutes = [], "0L"
    for number, stage in enumerate(LOAN_LADDER.stages, 1):
        minutes = f"{minutes} + {delays[stage]}"
        entries.append((number, text(stage), REACH_SCORE[stage], minutes))
    steps = orders.selectExpr(
        "o_orderkey",
        f"{_APPLIED_AT} AS applied_at",
        "(o_orderkey * 31 + 7) % 100 AS score",
        rows_of(entries, ("number", "stage", "needed", "minutes")),
    )
    return _typed(
        steps.where("score >= needed"),
        "application_events",
        event_id="o_orderkey * 10 + number",
        application_id="o_orderkey",
        stage="stage",
        event_timestamp="timestampadd(MINUTE, minutes, applied_at)",
    )


def applicants(customers: DataFrame) -> DataFrame:
    channels = dict(enumerate(ACQUISITION_CHANNELS))
    return _typed(
        customers,
        "applicants",
        applicant_id="c_custkey",
        first_name="c_name",
        last_name="'n/a'",
        email="lower(c_name)",
        age="18 + (c_custkey * 7) % 60",
        employment_status=_translated("c_mktsegment", EMPLOYMENT_OF_SEGMENT),
        annual_income="20000 + (c_custkey * 37) % 80000",
        acquisition_channel=_translated("c_nationkey % 6", channels),
        registration_date="date_add(DATE '1995-01-01', CAST((c_custkey * 13) % 365 AS INT))",
    )


def credit_profiles(customers: DataFrame) -> DataFrame:
    return _typed(
        customers,
        "credit_profiles",
        applicant_id="c_custkey",
        credit_score="300 + (c_custkey * 131) % 551",
        debt_to_income_ratio="((c_custkey * 17) % 61 + 5) / 100",
        existing_loans="c_custkey % 6",
        previous_defaults="c_custkey % 3",
    )


def clickstream_log(events: DataFrame) -> StageLog:
    """User-days as entities; repeated, skipped and out-of-order stages are usual here."""
    visits = events.selectExpr(
        "user_id * 100 + day(ts) AS visit_id", "event_type AS stage", "ts AS event_timestamp"
    )
    return StageLog(visits, CLICK_LADDER, entity="visit_id")


_APPLIED_AT = (
    "timestampadd(MINUTE, (o_orderkey * 37) % 1440, CAST(o_orderdate AS TIMESTAMP_NTZ))"
)


def _translated(column: str, names: dict) -> str:
    keys = [text(key) if isinstance(key, str) else key for key in names]
    cases = " ".join(f"WHEN {key} THEN {text(to)}" for key, to in zip(keys, names.values()))
    return f"CASE {column} {cases} END"


def _typed(frame: DataFrame, table: str, **expressions: str) -> DataFrame:
    """The table's declared columns; those without an expression are NULL."""
    return frame.selectExpr(
        *[
            f"CAST({expressions.get(f.name, 'NULL')} AS {f.dataType.simpleString()}) AS {f.name}"
            for f in SCHEMAS[table].fields
        ]
    )
