"""The four tables of a loan book: declared types, defaults and constraints.

Keys are longs, where 32 bits would not number the rows of a large log.  Times are wall-clock
times without a zone.
"""

from __future__ import annotations

from pyspark.sql import types as T

from ..functions import LOAN_LADDER
from ..operators.quality import InRange, NotNull, OneOf, References, Unique, primary_key

_LONG, _INT, _TEXT, _TIME = T.LongType(), T.IntegerType(), T.StringType(), T.TimestampNTZType()


def _schema(**columns) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


SCHEMAS = {
    "applicants": _schema(
        applicant_id=_LONG,
        first_name=_TEXT,
        last_name=_TEXT,
        email=_TEXT,
        phone=_TEXT,
        age=_INT,
        city=_TEXT,
        employment_status=_TEXT,
        annual_income=_INT,
        acquisition_channel=_TEXT,
        registration_date=_TIME,
    ),
    "loan_applications": _schema(
        application_id=_LONG,
        applicant_id=_LONG,
        loan_type=_TEXT,
        loan_amount=_LONG,
        loan_term_months=_INT,
        status=_TEXT,
        application_date=_TIME,
    ),
    "application_events": _schema(
        event_id=_LONG,
        application_id=_LONG,
        stage=_TEXT,
        event_timestamp=_TIME,
        notes=_TEXT,
    ),
    "credit_profiles": _schema(
        applicant_id=_LONG,
        credit_score=_INT,
        debt_to_income_ratio=T.DecimalType(5, 2),
        existing_loans=_INT,
        previous_defaults=_INT,
    ),
}

#: Values an empty field takes on load.
DEFAULTS = {
    "loan_applications": {"status": "submitted"},
    "credit_profiles": {"existing_loans": 0, "previous_defaults": 0},
}

#: Name columns compared case-insensitively and without outer blanks: normalised on load.
NAMES = {
    "applicants": ("employment_status", "acquisition_channel"),
    "loan_applications": ("loan_type", "status"),
    "application_events": ("stage",),
}

#: Column the table is clustered by when written for co-located joins.
CLUSTERING = {
    "applicants": "applicant_id",
    "loan_applications": "application_id",
    "application_events": "application_id",
    "credit_profiles": "applicant_id",
}

# The permitted names and limits of each column.
EMPLOYMENT_STATUSES = ("employed", "self_employed", "unemployed", "student", "retired")
ACQUISITION_CHANNELS = (
    "organic_search",
    "paid_search",
    "referral",
    "social_media",
    "email_campaign",
    "direct",
)
LOAN_TYPES = ("personal_loan", "home_loan", "auto_loan", "business_loan", "education_loan")
LOAN_TERMS = (12, 24, 36, 48, 60)

CONSTRAINTS = {
    "applicants": (
        *primary_key("applicant_id"),
        NotNull("first_name"),
        NotNull("last_name"),
        NotNull("email"),
        Unique("email"),
        InRange("age", 18, 100),
        OneOf("employment_status", EMPLOYMENT_STATUSES),
        OneOf("acquisition_channel", ACQUISITION_CHANNELS),
        NotNull("registration_date"),
    ),
    "loan_applications": (
        *primary_key("application_id"),
        NotNull("applicant_id"),
        References("applicant_id", "applicants", "applicant_id"),
        OneOf("loan_type", LOAN_TYPES),
        NotNull("loan_amount"),
        InRange("loan_amount", 1, None),
        OneOf("loan_term_months", LOAN_TERMS),
        NotNull("status"),
        NotNull("application_date"),
    ),
    "application_events": (
        *primary_key("event_id"),
        NotNull("application_id"),
        References("application_id", "loan_applications", "application_id"),
        NotNull("stage"),
        OneOf("stage", LOAN_LADDER.stages),
        NotNull("event_timestamp"),
    ),
    "credit_profiles": (
        *primary_key("applicant_id"),
        References("applicant_id", "applicants", "applicant_id"),
        InRange("credit_score", 300, 850),
        InRange("debt_to_income_ratio", 0, 1),
    ),
}
