"""Loads with bad rows: accepted and rejected rows are the input."""

from __future__ import annotations

import pytest
from helpers import dicts

from spillway.operators import InRange, NotNull
from spillway.sources import accepted, load_or_reject, reject_counts, rejected

HEADER = "applicant_id,credit_score,debt_to_income_ratio,existing_loans,previous_defaults"
GOOD = ["1,700,0.20,,1", "2,300,0.00,2,0", "3,,,,"]
BAD = {
    "4,high,0.20,1,1": ["malformed"],
    "5,700,0.20,1": ["malformed"],
    "6,700,0.20,1,1,9": ["malformed"],
    ",700,0.20,1,1": ["not_null(applicant_id)"],
    "8,900,0.20,1,1": ["in_range(credit_score)"],
    ",200,3.00,1,1": ["not_null(applicant_id)", "in_range(credit_score)", "in_range(debt_to_income_ratio)"],
}


@pytest.fixture
def files(tmp_path):
    place = tmp_path / "in"
    place.mkdir()
    lines = [*GOOD, *BAD]
    for n in range(2):
        (place / f"{n}.csv").write_text("\n".join([HEADER, *lines[n::2]]) + "\n")
    return str(place), str(tmp_path / "out")


def test_every_row_is_accepted_or_rejected_with_its_reasons(spark, files):
    source, into = files
    for _ in range(2):  # loading again replaces the load
        load_or_reject(spark, source, "credit_profiles", into)
        good = sorted(dicts(accepted(spark, into, "credit_profiles")), key=lambda r: r["applicant_id"])
        assert [r["applicant_id"] for r in good] == [1, 2, 3]
        assert [(r["existing_loans"], r["previous_defaults"]) for r in good] == [(0, 1), (2, 0), (0, 0)]
        bad = dicts(rejected(spark, into, "credit_profiles"))
        assert len(good) + len(bad) == len(GOOD) + len(BAD)
        assert sorted(map(tuple, (r["reasons"] for r in bad))) == sorted(map(tuple, BAD.values()))
        assert {r["line"] for r in bad if r["reasons"] == ["malformed"]} == {l for l, why in BAD.items() if why == ["malformed"]}
    counts = {r["reason"]: r["n"] for r in dicts(reject_counts(spark, into, "credit_profiles"))}
    assert counts["accepted"] == 3 and counts["malformed"] == 3 and counts["not_null(applicant_id)"] == 2


def test_other_rules_and_none(spark, files):
    source, into = files
    load_or_reject(spark, source, "credit_profiles", into, [NotNull("credit_score"), InRange("credit_score", 500, None)])
    assert sorted(r["applicant_id"] or 0 for r in dicts(accepted(spark, into, "credit_profiles"))) == [0, 1, 8]
    load_or_reject(spark, source, "credit_profiles", into, [])
    assert accepted(spark, into, "credit_profiles").count() == len(GOOD) + len(BAD) - 3


def test_a_file_without_rows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text(HEADER + "\n")
    load_or_reject(spark, str(tmp_path / "in"), "credit_profiles", str(tmp_path / "out"))
    assert accepted(spark, str(tmp_path / "out"), "credit_profiles").count() == 0
    assert rejected(spark, str(tmp_path / "out"), "credit_profiles").count() == 0
