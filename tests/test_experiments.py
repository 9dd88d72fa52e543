"""The bootstrap interval against plain Python with the same weights, and against theory."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
from helpers import dicts

from spillway.operators import bootstrap_lift
from spillway.operators.experiments import poisson_steps


def weight(entity, replicate, seed=42):
    digest = hashlib.md5(f"{seed}:{entity}:{replicate // 4}".encode()).hexdigest()
    u = int(digest[replicate % 4 * 8 : replicate % 4 * 8 + 8], 16) / 2**32
    k, below = 0, math.exp(-1)
    while u >= below and k < 12:
        k += 1
        below += math.exp(-1) / math.factorial(k)
    return k


def brute(rows, replicates):
    def lift(weigh):
        parts = []
        for stratum in {r[1] for r in rows}:
            sums = {(t, c): 0 for t in (True, False) for c in (True, False)}
            for e, s, t, c in rows:
                if s == stratum:
                    sums[t, c] += weigh(e)
            ns = [sums[t, True] + sums[t, False] for t in (True, False)]
            if all(ns):
                parts.append((sum(ns), sums[True, True] / ns[0] - sums[False, True] / ns[1]))
        total = sum(n for n, _ in parts)
        return sum(n * d for n, d in parts) / total if total else None

    found = [v for v in (lift(lambda e, b=b: weight(e, b)) for b in range(replicates)) if v is not None]
    ends = np.percentile(found, [2.5, 97.5]) * 100
    return lift(lambda e: 1) * 100, *ends, len(found)


def compared(spark, rows, replicates):
    frame = spark.createDataFrame(rows, "unit long, channel string, early boolean, paid boolean")
    return dicts(bootstrap_lift(frame, "unit", "channel", "early", "paid", replicates))[0]


def close(found, expected):
    lift, low, high, count = expected
    assert abs(found["lift_points"] - lift) < 0.0051
    assert abs(found["low_points"] - low) < 0.0051 and abs(found["high_points"] - high) < 0.0051
    assert found["replicates"] == count


def made(count, seed):
    r = random.Random(seed)
    return [
        (n // 2 if n % 5 == 0 else n, r.choice(["a", "a", "b", None]), r.random() < 0.4, r.random() < 0.5)
        for n in range(count)
    ]


def test_steps_are_those_of_the_distribution():
    exact = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(20)]) * 2**32
    assert np.allclose(poisson_steps(), exact[: len(poisson_steps())], atol=1.5)
    assert len(poisson_steps()) >= 11 and poisson_steps() == sorted(set(poisson_steps()))


def test_against_plain_python(spark):
    rows = made(240, 1) + [(9000 + n, "only treated", True, True) for n in range(7)]
    found = compared(spark, rows, 50)
    close(found, brute(rows, 50))
    assert found["strata"] == 3 and found["compared"] == 240


def test_one_stratum_with_most_rows_and_a_thin_one(spark):
    rows = made(150, 2) + [(5000 + n, "hot", n % 3 == 0, n % 4 == 0) for n in range(300)]
    rows += [(8000, "thin", True, True), (8001, "thin", False, False)]
    close(compared(spark, rows, 42), brute(rows, 42))


def test_width_is_that_of_theory(spark):
    found = compared(spark, [(n, "a", n % 2 == 0, n % 20 < 8 + n % 2 * 2) for n in range(4000)], 200)
    p1, p2 = (sum(n % 20 < 8 + n % 2 * 2 for n in range(side, 4000, 2)) / 2000 for side in (0, 1))
    half = 1.96 * math.sqrt(p1 * (1 - p1) / 2000 + p2 * (1 - p2) / 2000) * 100
    assert abs((found["high_points"] - found["low_points"]) / 2 / half - 1) < 0.2
    assert found["low_points"] < found["lift_points"] < found["high_points"]


def test_nothing_to_compare(spark):
    none = compared(spark, [(1, "a", True, True)], 8)
    assert none["replicates"] == 0 and none["lift_points"] is None and none["low_points"] is None
    frame = spark.createDataFrame([], "unit long, channel string, early boolean, paid boolean")
    assert dicts(bootstrap_lift(frame, "unit", "channel", "early", "paid"))[0]["replicates"] == 0
