"""The approval model against a plain gradient descent and the outcomes themselves."""

from __future__ import annotations

import numpy as np
from helpers import SMALL, book

from spillway import plans
from spillway.catalog import QUERIES
from spillway.sources import loan_book_from_orders


def learned_book(spark, count=300):
    """Applications of applicants with a good score are approved, with a few exceptions."""
    pick = np.random.default_rng(3)
    scores = pick.integers(300, 850, count)
    rows, profiles, people = [], [], []
    for n, score in enumerate(scores.tolist()):
        rows.append((n, "submitted", "2023-01-02 08:00:00"))
        if (score > 600) != (n % 25 == 0):
            rows.append((n, "approved", "2023-01-05 08:00:00"))
        profiles.append({"applicant_id": n, "credit_score": score, "debt_to_income_ratio": n % 50 / 100})
        people.append({"applicant_id": n, "employment_status": ["employed", "student", None][n % 3]})
    return book(spark, rows, None, people, profiles)


def test_probabilities_follow_the_score(spark):
    loans = learned_book(spark)
    rows = plans.approval_probability(loans).toPandas()
    assert len(rows) == 300 and rows["probability"].between(0, 1).all()
    assert ((rows["probability"] > 0.5) == (rows["approved"] == 1)).mean() > 0.93


def test_mean_probability_is_the_share_approved(spark):
    """The optimum of a logistic regression with an intercept (the penalty spares it)."""
    rows = QUERIES["approval_probability"](spark, SMALL).toPandas()
    assert len(rows) == rows["application_id"].nunique() > 1000
    assert abs(rows["probability"].mean() - rows["approved"].mean()) < 1e-3


def test_features_are_joined_without_a_broadcast(spark):
    """However small the files of the people look; the driver holds none of the tables."""
    plan = plans.approval_features(loan_book_from_orders(spark, SMALL))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 3 and "Broadcast" not in plan
