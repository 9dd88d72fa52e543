"""Ranks and percentiles against Python, with ties, NULL and one group with half the rows."""

from __future__ import annotations

import random

import numpy as np
import pytest
from helpers import dicts

from spillway.operators import exact_percentiles, ranked


def values(seed, number=900, kinds=40):
    pick = random.Random(seed)
    out = []
    for n in range(number):
        value = None if pick.random() < 0.05 else 7 if pick.random() < 0.3 else pick.randrange(-kinds, kinds)
        out.append((n, value))
    return out


@pytest.mark.parametrize("descending", [True, False])
@pytest.mark.parametrize("kinds", [3, 40, 10**9])
def test_rank(spark, kinds, descending):
    rows = values(kinds, kinds=kinds)
    frame = spark.createDataFrame(rows, "id long, value long").repartition(7)
    got = {r["id"]: r["place"] for r in dicts(ranked(frame, "value", "place", descending))}
    known = [v for _, v in rows if v is not None]
    for n, v in rows:
        ahead = len(known) if v is None else sum((w > v) if descending else (w < v) for w in known)
        assert got[n] == ahead + 1


def test_no_task_ranks_all_rows(spark):
    frame = spark.range(20_000).selectExpr("id", "pmod(xxhash64(id), 15000) AS value")
    plan = ranked(frame, "value")._jdf.queryExecution().executedPlan().toString()
    # The one exchange into a single partition is above the sums per range.
    single = [line for line in plan.split("\n") if "SinglePartition" in line]
    assert len(single) == 1 and "_rows" in plan
    assert ranked(frame, "value").where("rank = 1").count() >= 1


def test_rank_of_nothing(spark):
    assert ranked(spark.createDataFrame([], "id long, value double"), "value").count() == 0


@pytest.mark.parametrize("span", [1, 50, 5000, 1 << 30, 1 << 60])
def test_percentiles(spark, span):
    pick = random.Random(span)
    rows = [(pick.choice(["a", "a", "a", None, "b"]), pick.choice([pick.randrange(-span, span), 0, None, span - 1])) for _ in range(700)]
    rows += [("one", 5), ("none", None)]
    frame = spark.createDataFrame(rows, "g string, v long")
    fractions = (0.0, 0.1, 0.5, 0.99, 1.0)
    got = {(r["g"], r["fraction"]): (r["n"], r["percentile"]) for r in dicts(exact_percentiles(frame, ["g"], "v", fractions))}
    for g in ("a", None, "b", "one"):
        own = sorted(v for k, v in rows if k == g and v is not None)
        for f in fractions:
            n, found = got.pop((g, f))
            at = (len(own) - 1) * f
            low, high = own[int(np.floor(at))], own[int(np.ceil(at))]
            assert n == len(own)
            assert found == pytest.approx(low + (high - low) * (at - np.floor(at)), rel=1e-12, abs=1e-9)
    assert not got


def test_percentiles_of_several_keys_and_of_nothing(spark):
    frame = spark.createDataFrame([(1, "x", 3), (1, "x", 5), (1, None, 9)], "a int, b string, v int")
    got = sorted((tuple(r) for r in exact_percentiles(frame, ["a", "b"], "v").collect()), key=str)
    assert set(got) == {(1, "x", 0.5, 2, 4.0), (1, None, 0.5, 1, 9.0)}
    assert exact_percentiles(frame.limit(0), ["a"], "v").count() == 0
    with pytest.raises(ValueError):
        exact_percentiles(spark.createDataFrame([(-(1 << 62),), (1 << 62,)], "v long"), [], "v").count()
