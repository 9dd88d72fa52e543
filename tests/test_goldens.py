"""Published results of the 2023 loan funnel, from logs built to its published volumes."""

from __future__ import annotations

import datetime as dt

import pytest
from helpers import book, dicts

from spillway import plans
from spillway.functions import LOAN_LADDER

# Published volumes.
REACHED = {"submitted": 413, "under_review": 379, "verified": 274, "approved": 166, "disbursed": 154}
APPLICATIONS = {
    "education_loan": (36, 15),
    "personal_loan": (151, 60),
    "home_loan": (101, 39),
    "auto_loan": (73, 24),
    "business_loan": (52, 16),
}
REVIEWED = {3: (36, 17), 20: (140, 61), 40: (203, 76)}  # hours to review: (applications, disbursed)


@pytest.fixture(scope="module")
def loans(spark):
    """Disbursed applications come first; each of the rest stops at its own stage."""
    applications, rows = [], []
    disbursed = [(t, True) for t, (_, paid) in APPLICATIONS.items() for _ in range(paid)]
    lost = [(t, False) for t, (n, paid) in APPLICATIONS.items() for _ in range(n - paid)]
    hours = [h for h, (_, paid) in REVIEWED.items() for _ in range(paid)]
    hours += [h for h, (n, paid) in REVIEWED.items() for _ in range(n - paid)]
    for a, (loan_type, _) in enumerate(disbursed + lost):
        applications.append(
            {"application_id": a, "applicant_id": a, "loan_type": loan_type, "loan_amount": 1000 + a}
        )
        start = dt.datetime(2023, 5, 1, 9)
        for i, stage in enumerate(LOAN_LADDER.stages):
            if a < REACHED[stage]:
                wait = 0 if i == 0 else hours[a] + 24 * (i - 1)
                rows.append((a, stage, str(start + dt.timedelta(hours=wait))))
    return book(spark, rows, applications)


def test_funnel(loans):
    report = dicts(plans.funnel_overview(loans))
    assert [r["applications_reached"] for r in report] == list(REACHED.values())
    assert [r["drop_off_count"] for r in report] == [0, 34, 105, 108, 12]
    assert [r["stage_conv_rate_pct"] for r in report] == [100.0, 91.8, 72.3, 60.6, 92.8]
    assert [r["overall_conv_rate_pct"] for r in report] == [100.0, 91.8, 66.3, 40.2, 37.3]


def test_biggest_dropoff(loans):
    assert dicts(plans.biggest_dropoff(loans)) == [
        {
            "biggest_drop_off_stage": "approved",
            "entered_stage": 274,
            "passed_stage": 166,
            "lost_applicants": 108,
            "pct_of_stage_lost": 39.4,
            "flag": "PRIORITY ACTION REQUIRED",
        }
    ]


def test_loan_types(loans):
    report = dicts(plans.conv_by_loan_type(loans))
    assert [(r["loan_type"], r["total_applications"], r["conv_rate_pct"]) for r in report] == [
        ("education loan", 36, 41.7),
        ("personal loan", 151, 39.7),
        ("home loan", 101, 38.6),
        ("auto loan", 73, 32.9),
        ("business loan", 52, 30.8),
    ]


def test_response_tiers(loans):
    report = dicts(plans.response_tier_conversion(loans))
    assert [(r["total_applications"], r["conv_rate_pct"]) for r in report] == [
        (36, 47.2),
        (140, 43.6),
        (203, 37.4),
    ]


def test_stuck_applications(loans):
    report = dicts(plans.stuck_applications(loans))
    assert [(r["stuck_at_stage"], r["abandoned_applications"]) for r in report] == [
        ("submitted", 34),
        ("under review", 105),
        ("verified", 108),
        ("approved", 12),
    ]


def test_reports_agree_with_each_other(loans):
    steps = {r["stage_name"]: r["applications_reached"] for r in dicts(plans.funnel_overview(loans))}
    summary = dicts(plans.funnel_summary(loans))[0]
    assert summary["total_applications"] == steps["submitted"]
    assert summary["total_disbursed"] == steps["disbursed"]
    assert summary["end_to_end_conv_pct"] == 37.3 and summary["pct_lost_overall"] == 62.7
    stuck = dicts(plans.stuck_applications(loans))
    board = dicts(plans.executive_dashboard(loans))[0]
    assert sum(r["abandoned_applications"] for r in stuck) == board["total_lost"] == 259
    assert sum(r["total_revenue_at_risk"] for r in stuck) == board["pipeline_at_risk"]
    types = dicts(plans.conv_by_loan_type(loans))
    assert sum(r["total_disbursed_value"] for r in types) == board["total_disbursed_value"]


def test_views_equal_their_reports(spark, loans):
    plans.create_views(loans)
    kpi = dicts(spark.table("vw_funnel_kpi_summary").withColumnRenamed("dropped_at_stage", "drop_off_count"))
    assert kpi == dicts(plans.funnel_overview(loans))
    assert dicts(spark.table("vw_executive_dashboard")) == dicts(plans.executive_dashboard(loans))
    assert dicts(plans.read_view(loans, "vw_stage_dropoff")) == dicts(plans.stage_dropoff(loans))


def test_amounts_of_one_type(spark):
    amounts = [18_994] * 18 + [18_995] * 18
    applications = [
        {"application_id": a, "applicant_id": a, "loan_type": "education_loan", "loan_amount": amount}
        for a, amount in enumerate(amounts)
    ]
    rows = [(a, "submitted", "2023-05-01 00:00:00") for a in range(36)]
    report = dicts(plans.conv_by_loan_type(book(spark, rows, applications)))
    assert report[0]["avg_loan_amount"] == 18_995.0
