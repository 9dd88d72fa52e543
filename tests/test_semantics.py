"""The rules that decide between plausible but different numbers, on hand-made rows."""

from __future__ import annotations

import datetime as dt

import pytest
from helpers import book, dicts, log

from spillway import plans
from spillway.functions import (
    AGE_GROUPS,
    CREDIT_BANDS,
    JOURNEY_SPEEDS,
    RESPONSE_TIERS,
    StageLadder,
    StageLog,
    hours_between,
    percent,
    settled_round,
    weekdays_after,
    whole_mean,
)
from spillway.operators import (
    furthest_stage,
    journeys,
    next_stages,
    period_reach,
    period_trend,
    response_gaps,
    stage_counts,
    stage_transitions,
    table_row_counts,
)

DAY = "2023-03-0"


def value(spark, sql):
    return spark.range(1).selectExpr(f"{sql} AS v").first().v


def journey(application, days, start="2023-01-01 08:00:00"):
    first = dt.datetime.fromisoformat(start)
    return [
        (application, "submitted", str(first)),
        (application, "disbursed", str(first + dt.timedelta(days=days))),
    ]


def test_hours_and_days_count_boundaries(spark):
    rows = dicts(
        stage_transitions(
            log(
                spark,
                [
                    (1, "submitted", "2023-01-01 10:59:00"),
                    (1, "under_review", "2023-01-01 11:01:00"),
                    (2, "submitted", "2023-01-01 23:59:00"),
                    (2, "disbursed", "2023-01-02 00:01:00"),
                ],
            )
        )
    )
    found = {r["application_id"]: (r["hours"], r["days"]) for r in rows}
    assert found == {1: (1, 0), 2: (1, 1)}


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_hours_do_not_depend_on_the_session_zone(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        a, b = "TIMESTAMP_NTZ'2023-03-12 01:30:00'", "TIMESTAMP_NTZ'2023-03-12 03:10:00'"
        assert value(spark, hours_between(a, b)) == 2
        assert value(spark, hours_between(b, a)) == -2
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_outlier_threshold_uses_the_integer_mean(spark):
    rows = [e for a, d in enumerate([1, 1, 1, 3]) for e in journey(a, d)]
    report = dicts(plans.journey_durations(book(spark, rows)))
    assert [r["outlier_flag"] for r in report] == ["OUTLIER", "Normal", "Normal", "Normal"]
    assert {r["overall_avg_days"] for r in report} == {1.5}
    assert report[0]["total_days"] == 3


def test_whole_mean_truncates_towards_zero(spark):
    assert value(spark, whole_mean("7L", "4L")) == 1
    assert value(spark, whole_mean("-7L", "4L")) == -1
    assert value(spark, whole_mean("7L", "0L")) is None


def test_rounding_is_half_away_from_zero(spark):
    assert value(spark, percent("9", "2000")) == 0.5
    assert value(spark, settled_round("44.2D - 37.3D")) == 6.9
    assert value(spark, settled_round("-0.25D")) == -0.3
    assert value(spark, settled_round("18994.5D", 0)) == 18995.0


def test_division_by_zero_gives_null(spark):
    rows = [(1, "disbursed", "2023-05-02 00:00:00"), (2, "submitted", "2023-06-01 00:00:00")]
    heat = dicts(plans.stage_month_heatmap(book(spark, rows)))
    assert [(r["month_label"], r["monthly_end_to_end_pct"]) for r in heat] == [
        ("May 2023", None),
        ("Jun 2023", 0.0),
    ]
    months = dicts(plans.monthly_trend_by_date(book(spark, rows)))
    assert [r["period"] for r in months] == ["Jun 2023"]


def test_equal_losses_go_to_the_earlier_stage(spark):
    rows = [(a, "submitted", f"{DAY}1 00:00:00") for a in range(4)]
    rows += [(a, "under_review", f"{DAY}2 00:00:00") for a in range(3)]
    rows += [(a, "verified", f"{DAY}3 00:00:00") for a in range(2)]
    worst = dicts(plans.biggest_dropoff(book(spark, rows)))
    assert [(r["biggest_drop_off_stage"], r["lost_applicants"]) for r in worst] == [("under review", 1)]
    ranks = dicts(plans.stage_dropoff(book(spark, rows)))
    assert [r["severity_rank"] for r in ranks] == [1, 1]


def test_partitioned_rank_uses_the_rounded_rate(spark):
    applications, rows = [], []

    def cell(loan_type, converted, total):
        for i in range(total):
            a = len(applications)
            applications.append(
                {"application_id": a, "applicant_id": 1, "loan_type": loan_type, "loan_amount": 1}
            )
            rows.append((a, "submitted", f"{DAY}1 00:00:00"))
            if i < converted:
                rows.append((a, "disbursed", f"{DAY}2 00:00:00"))

    cell("auto_loan", 2, 6)
    cell("home_loan", 333, 1000)
    cell("business_loan", 1, 4)
    people = [{"applicant_id": 1, "acquisition_channel": "direct"}]
    cells = dicts(plans.conv_channel_x_loan(book(spark, rows, applications, people)))
    assert {(r["loan_type"], r["conv_rate_pct"], r["rank_within_channel"]) for r in cells} == {
        ("auto loan", 33.3, 1),
        ("home loan", 33.3, 1),
    }
    types = dicts(plans.segment_performance(book(spark, rows, applications, people)))
    assert {r["loan_type"]: r["conv_rank"] for r in types} == {
        "auto loan": 1,
        "home loan": 2,
        "business loan": 3,
    }


def test_large_sums_are_bigint(spark):
    applications = [
        {"application_id": a, "applicant_id": a, "loan_type": "home_loan", "loan_amount": 2_000_000_000}
        for a in range(3)
    ]
    rows = [(a, "submitted", f"{DAY}1 00:00:00") for a in range(3)]
    stuck = dicts(plans.stuck_applications(book(spark, rows, applications)))
    assert stuck[0]["total_revenue_at_risk"] == 6_000_000_000


def test_year_filter_comes_before_the_windows(spark):
    rows, a = [], 0
    for month, n in (("2022-12", 9), ("2023-01", 1), ("2023-02", 2), ("2023-03", 6), ("2024-01", 5)):
        for _ in range(n):
            a += 1
            rows.append((a, "submitted", f"{month}-15 00:00:00"))
    report = dicts(plans.monthly_trend_by_date(book(spark, rows)))
    assert [(r["mth"], r["mom_change"], r["rolling_3m_avg"]) for r in report] == [
        (1, None, 1.0),
        (2, 1, 1.5),
        (3, 4, 3.0),
    ]
    full = dicts(plans.monthly_trend(book(spark, rows)))
    assert [r["period"] for r in full] == [
        "Feb 2023",
        "Jan 2023",
        "Mar 2023",
        "Full-year avg (2023)",
    ]
    assert full[-1]["monthly_conv_pct"] == 0.0 and full[-1]["applications_submitted"] is None


def test_benchmark_row_exists_for_an_empty_year(spark):
    report = dicts(plans.monthly_trend(book(spark, journey(1, 2)), year=1999))
    assert [(r["period"], r["monthly_conv_pct"]) for r in report] == [("Full-year avg (1999)", None)]


def test_median_belongs_to_the_stage_not_to_the_pair(spark):
    rows = [
        (1, "submitted", f"{DAY}1 00:00:00"),
        (1, "verified", f"{DAY}7 00:00:00"),
        (2, "submitted", f"{DAY}1 00:00:00"),
        (2, "under_review", f"{DAY}2 00:00:00"),
    ]
    report = dicts(plans.stage_durations(book(spark, rows)))
    assert [(r["stage"], r["transitions_to"], r["avg_days"], r["median_days"]) for r in report] == [
        ("submitted", "under review", 1.0, 3.5),
        ("submitted", "verified", 6.0, 3.5),
    ]


def test_absent_stage_is_skipped_and_unknown_stage_ignored(spark):
    rows = [(a, "submitted", f"{DAY}1 00:00:00") for a in range(4)]
    rows += [(a, "under_review", f"{DAY}2 00:00:00") for a in range(3)]
    rows += [(0, "approved", f"{DAY}3 00:00:00")]
    rows += [(a, "withdrawn", f"{DAY}4 00:00:00") for a in range(9)]
    report = dicts(plans.funnel_overview(book(spark, rows)))
    assert [(r["stage_order"], r["applications_reached"], r["drop_off_count"]) for r in report] == [
        (1, 4, 0),
        (2, 3, 1),
        (4, 1, 2),
    ]
    assert [r["stage_conv_rate_pct"] for r in report] == [100.0, 75.0, 33.3]
    assert report[-1]["overall_conv_rate_pct"] == 25.0


def test_repeated_stage(spark):
    rows = [
        (1, "submitted", f"{DAY}1 00:00:00"),
        (1, "under_review", f"{DAY}1 03:00:00"),
        (1, "under_review", f"{DAY}1 05:10:00"),
        (1, "under_review", f"{DAY}1 05:50:00"),
        (2, "submitted", f"{DAY}1 00:00:00"),
        (2, "under_review", f"{DAY}1 04:00:00"),
    ]
    gaps = dicts(response_gaps(log(spark, rows), "submitted", "under_review"))
    assert sorted((r["application_id"], r["hours"]) for r in gaps) == [(1, 3), (1, 5), (2, 4)]
    tiers = dicts(plans.response_tier_conversion(book(spark, rows)))
    assert [(r["total_applications"], r["avg_hours_to_review"]) for r in tiers] == [(3, 4.0)]
    once = dicts(plans.response_tier_conversion(book(spark, rows), repeats="first"))
    assert [(r["total_applications"], r["avg_hours_to_review"]) for r in once] == [(2, 3.5)]
    every = dicts(stage_transitions(log(spark, rows)))
    assert sorted((r["application_id"], r["next_order"], r["hours"], r["weight"]) for r in every) == [
        (1, 2, 0, 1),
        (1, 2, 2, 1),
        (1, 2, 3, 1),
        (2, 2, 4, 1),
    ]
    first = dicts(stage_transitions(log(spark, rows), repeats="first"))
    assert sorted((r["application_id"], r["hours"]) for r in first) == [(1, 3), (2, 4)]


def test_journey_ends_with_the_last_disbursement(spark):
    rows = journey(1, 2) + [(1, "disbursed", "2023-01-09 00:00:00")]
    assert [r["total_days"] for r in dicts(plans.journey_durations(book(spark, rows)))] == [8]


def test_negative_durations_are_kept(spark):
    rows = [(1, "submitted", f"{DAY}5 00:00:00"), (1, "under_review", f"{DAY}3 23:00:00")]
    step = dicts(stage_transitions(log(spark, rows)))[0]
    assert (step["hours"], step["days"]) == (-25, -2)
    tier = dicts(plans.response_tier_conversion(book(spark, rows)))[0]
    assert tier["response_tier"].startswith("1.") and tier["avg_hours_to_review"] == -25.0


def test_applications_without_events_are_left_out(spark):
    applications = [
        {"application_id": a, "applicant_id": a, "loan_type": "home_loan", "loan_amount": 7}
        for a in (1, 2)
    ]
    small = book(spark, [(1, "submitted", f"{DAY}1 00:00:00")], applications)
    assert dicts(plans.conv_by_loan_type(small))[0]["total_applications"] == 1
    assert dicts(plans.executive_dashboard(small))[0]["pipeline_at_risk"] == 7


def test_journey_days_need_a_submission(spark):
    rows = journey(1, 4) + [(2, "disbursed", "2023-01-02 00:00:00")]
    row = dicts(plans.time_to_convert_by_loan_type(book(spark, rows)))[0]
    assert (row["total_applications"], row["disbursed"], row["avg_days_to_disburse"]) == (2, 2, 4.0)


@pytest.mark.parametrize(
    ("bands", "expected"),
    [
        (
            AGE_GROUPS,
            {17: None, 18: "18–25", 25: "18–25", 26: "26–35", 55: "46–55", 56: "56+", "NULL": None},
        ),
        (
            CREDIT_BANDS,
            {
                599: "300–599  Very Poor",
                600: "600–649  Poor",
                649: "600–649  Poor",
                650: "650–699  Fair",
                699: "650–699  Fair",
                700: "700–749  Good",
                749: "700–749  Good",
                750: "750–850  Excellent",
                "NULL": None,
            },
        ),
        (
            JOURNEY_SPEEDS,
            {
                7: "Fast    (≤7 days)",
                8: "Average (8–14 days)",
                14: "Average (8–14 days)",
                15: "Slow    (15–21 days)",
                21: "Slow    (15–21 days)",
                22: "Very slow (>21 days)",
            },
        ),
        (
            RESPONSE_TIERS,
            {
                6: "1. Same day     (≤6 hrs)",
                7: "2. Next day     (7–24 hrs)",
                24: "2. Next day     (7–24 hrs)",
                25: "3. Two days     (25–48 hrs)",
                48: "3. Two days     (25–48 hrs)",
                49: "4. Slow         (>48 hrs)",
                "NULL": "4. Slow         (>48 hrs)",
            },
        ),
    ],
)
def test_band_edges(spark, bands, expected):
    for number, label in expected.items():
        assert value(spark, bands.label(f"CAST({number} AS INT)")) == label


def test_age_groups_without_a_band_form_their_own_row(spark):
    people = [{"applicant_id": a, "age": age} for a, age in ((1, 17), (2, 30))]
    rows = [(1, "submitted", f"{DAY}1 00:00:00"), (2, "disbursed", f"{DAY}1 00:00:00")]
    report = dicts(plans.conv_by_age_group(book(spark, rows, None, people)))
    assert [(r["age_group"], r["conv_rate_pct"], r["diff_from_avg_pct"]) for r in report] == [
        (None, 0.0, -50.0),
        ("26–35", 100.0, 50.0),
    ]


def test_means_skip_null_measures(spark):
    people = [
        {"applicant_id": 1, "employment_status": "retired", "annual_income": 10},
        {"applicant_id": 2, "employment_status": "retired", "annual_income": None},
    ]
    rows = [(1, "submitted", f"{DAY}1 00:00:00"), (2, "submitted", f"{DAY}1 00:00:00")]
    report = dicts(plans.conv_by_employment(book(spark, rows, None, people)))
    assert [(r["total_applications"], r["avg_annual_income"]) for r in report] == [(2, 10.0)]


def test_furthest_stage_and_last_activity(spark):
    rows = [
        (1, "verified", f"{DAY}4 00:00:00"),
        (1, "verified", f"{DAY}6 00:00:00"),
        (1, "submitted", f"{DAY}9 00:00:00"),
    ]
    assert dicts(furthest_stage(log(spark, rows))) == [
        {"application_id": 1, "stage_order": 3, "last_activity": dt.datetime(2023, 3, 6)}
    ]
    stuck = dicts(plans.stuck_applications(book(spark, rows), dt.date(2023, 3, 10)))
    assert [(r["stuck_at_stage"], r["avg_days_inactive"]) for r in stuck] == [("verified", 4.0)]


def test_next_stage_of_the_last_stage_is_null(spark):
    rows = dicts(next_stages(log(spark, journey(1, 3))))
    assert [(r["stage_order"], r["next_order"]) for r in rows] == [(1, 5), (5, None)]
    reports = plans.stage_durations(book(spark, journey(1, 3)))
    assert [r["transitions_to"] for r in dicts(reports)] == ["disbursed"]


@pytest.mark.parametrize(
    ("grain", "starts"),
    [
        ("day", ["2023-05-17"]),
        ("week", ["2023-05-15"]),
        ("month", ["2023-05-01"]),
        ("quarter", ["2023-04-01"]),
        ("year", ["2023-01-01"]),
    ],
)
def test_period_grains(spark, grain, starts):
    rows = dicts(period_reach(log(spark, [(1, "submitted", "2023-05-17 23:59:59")]), grain))
    assert [str(r["period_start"]) for r in rows] == starts


@pytest.mark.parametrize("first", [dt.date(2023, 9, 1) + dt.timedelta(days=i) for i in range(7)])
@pytest.mark.parametrize("count", [1, 2, 5, 7, 12])
def test_working_days(spark, first, count):
    day, left = first, count
    while left:
        day += dt.timedelta(days=1)
        left -= day.weekday() < 5
    assert value(spark, weekdays_after(f"DATE'{first}'", count)) == day


def test_service_breaches(spark):
    rows = [
        (1, "verified", "2023-09-01 10:00:00"),  # a Friday: due the next Friday
        (1, "approved", "2023-09-08 23:00:00"),
        (2, "verified", "2023-09-01 10:00:00"),
        (2, "approved", "2023-09-09 00:00:00"),
        (3, "verified", "2023-09-01 10:00:00"),
        (4, "verified", "2023-09-04 10:00:00"),
    ]
    found = dicts(plans.approval_breaches(book(spark, rows), as_of=dt.date(2023, 9, 11)))
    assert sorted(r["application_id"] for r in found) == [2, 3]


def test_any_stage_names_and_columns(spark):
    rows = [(1, "it's on", "2023-01-01"), (1, "sign up!", "2023-01-04"), (2, "it's on", "2023-01-02")]
    frame = spark.createDataFrame(rows, "`who is it` int, `what` string, day string").selectExpr(
        "`who is it`", "what", "CAST(day AS TIMESTAMP_NTZ) AS `at time`"
    )
    names = ("it's on", "a\\b", "sign up!")
    odd = StageLog(frame, StageLadder(names), "who is it", "what", "at time")
    assert [(r["stage"], r["reached"]) for r in dicts(stage_counts(odd))] == [
        ("it's on", 2),
        ("sign up!", 1),
    ]
    for repeats in ("keep", "first"):
        steps = dicts(stage_transitions(odd, repeats))
        assert [(r["who is it"], r["next_order"], r["days"]) for r in steps] == [(1, 3, 3)]
        gaps = dicts(response_gaps(odd, names[0], names[2], repeats))
        assert [r["hours"] for r in gaps] == [72]
    assert dicts(journeys(odd))[0]["total_days"] == 3
    assert sorted(r["stage_order"] for r in dicts(furthest_stage(odd))) == [1, 3]
    assert dicts(period_trend(odd, names[0], names[2]))[0]["conv_pct"] == 50.0
    with pytest.raises(ValueError, match="keep"):
        stage_transitions(odd, "last")
    with pytest.raises(ValueError, match="differ"):
        StageLadder(("a", "a"))


def test_empty_log(spark):
    empty = book(spark, [], [])
    assert dicts(stage_counts(empty.log)) == []
    assert dicts(plans.funnel_overview(empty)) == []
    summary = dicts(plans.funnel_summary(empty))[0]
    assert summary["total_applications"] == 0 and summary["end_to_end_conv_pct"] is None
    board = dicts(plans.executive_dashboard(empty))[0]
    assert board["total_lost"] == 0 and board["total_disbursed_value"] is None
    assert dicts(plans.stage_durations(empty)) == []
    assert dicts(plans.journey_durations(empty)) == []
    assert {r["row_count"] for r in dicts(table_row_counts(empty.tables()))} == {0}


def test_experiment_counts_an_application_once(spark):
    from spillway.plans import fast_review_experiment

    rows = [(1, "submitted", "2023-01-02 08:00:00"), (1, "under_review", "2023-01-02 09:00:00")]
    rows += [(1, "under_review", "2023-01-05 09:00:00"), (1, "disbursed", "2023-01-09 09:00:00")]
    rows += [(2, "submitted", "2023-01-02 08:00:00"), (2, "under_review", "2023-01-04 08:00:00")]
    found = dicts(fast_review_experiment(book(spark, rows)))[0]
    assert (found["treated_n"], found["treated_converted"]) == (1, 1)
    assert (found["control_n"], found["control_converted"]) == (1, 0)


def test_every_event_has_its_step(spark):
    from spillway.catalog.operators import lead_every_event

    rows = [(1, "submitted", f"2023-01-02 08:{m}:00") for m in (10, 20, 30, 40)]
    rows.append((1, "under_review", "2023-01-02 11:00:00"))
    steps = dicts(lead_every_event(book(spark, rows)))
    assert sum(s["steps"] for s in steps) == 4
    assert {(s["next_order"], s["hours"], s["steps"]) for s in steps} == {(1, 0, 3), (2, 3, 1)}


def test_settings_for_large_jobs(spark):
    from spillway.session import RECOMMENDED, initial_partitions

    assert initial_partitions(0) == 200 and initial_partitions(100 << 40) == 819_200
    assert "RocksDB" in RECOMMENDED["spark.sql.streaming.stateStore.providerClass"]
    for name, value in RECOMMENDED.items():
        assert spark.conf.get(name) == value


def test_shared_folder_is_the_same_on_every_master(spark, tmp_path):
    from spillway.sources import remove_folder, shared_folder

    path = shared_folder(spark, "test", str(tmp_path))
    spark.range(3).write.parquet(path)
    assert spark.read.parquet(path).count() == 3
    remove_folder(spark, path)
    assert not list(tmp_path.iterdir())
    assert shared_folder(spark, "test").startswith(spark.conf.get("spark.checkpoint.dir"))
    with pytest.raises(ValueError):
        remove_folder(spark, "/some/other/folder")
