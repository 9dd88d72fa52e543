"""How likely an application is to be approved, by logistic regression over the whole book."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import by_merge
from ..operators import area_under_curve, calibration, entity_progress, reached
from ..sources import LoanBook

_NUMBERS = ("credit_score", "debt_to_income_ratio", "loan_amount")


def approval_features(book: LoanBook) -> DataFrame:
    """``application_id``, score, debt to income, amount, employment and whether it was approved,
    for applications with events.  Missing numbers are 0, missing employment a value of its own."""
    log = book.log
    outcome = entity_progress(log).selectExpr(
        "application_id", f"CAST({reached(log, 'approved')} AS DOUBLE) AS approved"
    )
    return (
        book.loan_applications.select("application_id", "applicant_id", "loan_amount")
        .join(by_merge(outcome), "application_id")
        .join(by_merge(book.applicants.select("applicant_id", "employment_status")), "applicant_id", "left")
        .join(
            by_merge(book.credit_profiles.select("applicant_id", "credit_score", "debt_to_income_ratio")),
            "applicant_id",
            "left",
        )
        .selectExpr(
            "application_id",
            *[f"coalesce(CAST({c} AS DOUBLE), 0D) AS {c}" for c in _NUMBERS],
            "coalesce(employment_status, 'unknown') AS employment_status",
            "approved",
        )
    )


def fit_approval(features: DataFrame, steps: int = 30) -> PipelineModel:
    """A Spark ML pipeline over :func:`approval_features`; every pass sums gradients by task."""
    return Pipeline(
        stages=[
            StringIndexer(
                inputCol="employment_status", outputCol="employment_no", handleInvalid="keep",
                stringOrderType="alphabetAsc",
            ),
            OneHotEncoder(inputCol="employment_no", outputCol="employment", handleInvalid="keep"),
            VectorAssembler(inputCols=[*_NUMBERS, "employment"], outputCol="features"),
            LogisticRegression(
                labelCol="approved", featuresCol="features", maxIter=steps, regParam=1e-4
            ),
        ]
    ).fit(features)


def _scored(features: DataFrame, learned_from: DataFrame) -> DataFrame:
    scored = fit_approval(learned_from).transform(features)
    return scored.select(
        "application_id",
        F.col("approved").cast("int").alias("approved"),
        vector_to_array("probability")[1].alias("probability"),
    )


def approval_probability(book: LoanBook) -> DataFrame:
    """``application_id, approved, probability`` for every application with events."""
    features = approval_features(book)
    return _scored(features, features)


#: One application in five is held out, whichever load or run it comes in.
_HELD_OUT = "pmod(crc32(CAST(CAST(application_id AS STRING) AS BINARY)), 5) = 1"


def held_out_probability(book: LoanBook) -> DataFrame:
    """The same for the held-out applications only, by a model that has not seen them."""
    features = approval_features(book)
    return _scored(features.where(_HELD_OUT), features.where(f"NOT {_HELD_OUT}"))


def approval_evaluation(book: LoanBook) -> DataFrame:
    """``n, positives, auc`` of the model on applications it has not seen."""
    return area_under_curve(held_out_probability(book), "probability", "approved")


def approval_calibration(book: LoanBook, bins: int = 10) -> DataFrame:
    """Predicted and actual shares of approval by bin, on applications the model has not seen."""
    return calibration(held_out_probability(book), "probability", "approved", bins)
