"""Areas and bins recomputed by DuckDB from the scored rows, and by all pairs."""

from __future__ import annotations

import random

import duckdb
import pytest
from helpers import SMALL, dicts

from spillway import plans
from spillway.operators import area_under_curve, calibration
from spillway.sources import loan_book_from_orders


def all_pairs(rows):
    good = [s for s, y in rows if y == 1 and s is not None]
    bad = [s for s, y in rows if y == 0 and s is not None]
    if not good or not bad:
        return None
    return sum((a > b) + (a == b) / 2 for a in good for b in bad) / len(good) / len(bad)


@pytest.mark.parametrize("kinds", [2, 10, 10**6])
def test_area_with_ties_and_gaps(spark, kinds):
    pick = random.Random(kinds)
    rows = []
    for _ in range(500):
        label = pick.choice([0, 1, 1, None])
        score = None if pick.random() < 0.05 else (pick.randrange(kinds) + (label or 0) * kinds // 3) / (2 * kinds)
        rows.append((0.5 if pick.random() < 0.3 else score, label))
    got = dicts(area_under_curve(spark.createDataFrame(rows, "p double, y int"), "p", "y"))[0]
    assert got["auc"] == pytest.approx(all_pairs(rows), abs=1e-12)
    assert got["n"] == sum(s is not None and y is not None for s, y in rows)


def test_one_kind_only_and_nothing(spark):
    frame = spark.createDataFrame([(0.5, 1), (0.7, 1)], "p double, y int")
    assert dicts(area_under_curve(frame, "p", "y")) == [{"n": 2, "positives": 2, "auc": None}]
    assert dicts(area_under_curve(frame.limit(0), "p", "y")) == [{"n": 0, "positives": 0, "auc": None}]
    assert dicts(calibration(frame.limit(0), "p", "y")) == []


def test_bins(spark):
    rows = [(0.0, 0), (0.19, 1), (0.2, 1), (1.0, 1), (0.95, 0), (1.5, 1), (None, 1), (0.3, None)]
    got = dicts(calibration(spark.createDataFrame(rows, "p double, y int"), "p", "y", 5))
    assert [(r["bin"], r["n"], r["share"]) for r in got] == [(0, 2, 0.5), (1, 1, 1.0), (4, 2, 0.5)]
    assert (got[0]["low"], got[-1]["high"]) == (0.0, 1.0)


def test_held_out_model_against_duckdb(spark):
    loans = loan_book_from_orders(spark, SMALL)
    scored = plans.held_out_probability(loans).toPandas()
    everyone = plans.approval_features(loans).count()
    assert 0.15 * everyone < len(scored) < 0.25 * everyone
    db = duckdb.connect()
    db.register("scored", scored)
    area = """
        WITH r AS (SELECT approved, rank() OVER (ORDER BY probability)
                     + (count(*) OVER (PARTITION BY probability) - 1) / 2.0 AS place FROM scored)
        SELECT count(*), sum(approved), (sum(place) FILTER (WHERE approved = 1) - sum(approved) * (sum(approved) + 1) / 2.0)
               / (sum(approved) * (count(*) - sum(approved))) FROM r"""
    n, positives, auc = db.execute(area).fetchone()
    got = dicts(area_under_curve(spark.createDataFrame(scored), "probability", "approved"))[0]
    assert (got["n"], got["positives"]) == (n, positives) and got["auc"] == pytest.approx(auc, abs=1e-12)
    bins = db.execute(
        """SELECT least(CAST(floor(probability * 10) AS INT), 9) AS bin, count(*), avg(probability), avg(approved)
           FROM scored GROUP BY 1 ORDER BY 1"""
    ).fetchall()
    found = dicts(plans.approval_calibration(loans))
    assert [(r["bin"], r["n"]) for r in found] == [b[:2] for b in bins]
    for r, b in zip(found, bins):
        assert (r["mean_score"], r["share"]) == pytest.approx(b[2:], abs=1e-9)
    assert dicts(plans.approval_evaluation(loans))[0]["auc"] == pytest.approx(auc, abs=1e-6)
