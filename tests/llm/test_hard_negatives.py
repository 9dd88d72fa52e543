"""Mined triples against plain Python over all pairs."""

import math
import random

import pytest
from llm_helpers import rows_of

from spillway.llm import hard_negatives as module
from spillway.llm.hard_negatives import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, score long, anchor string, row int"
RULE = "CASE WHEN id % 7 = 0 THEN (label + 1) % 10 ELSE label END"


def vectors(seed, count, size=8, labels=4, first=0):
    pick = random.Random(seed)
    return [
        (first + n, [pick.choice([-1, 1]) * pick.random() for _ in range(size)], pick.randrange(labels), 1, "x", 2)
        for n in range(count)
    ]


AWKWARD = [
    (100_000, None, 0, 1, "x", 2), (100_050, [0.5] * 8, None, 1, "x", 2), (100_100, [float("nan")] * 8, 1, 1, "x", 2),
    (100_150, [None] + [0.5] * 7, 1, 1, "x", 2), (100_200, [float("-inf")] * 8, 1, 1, "x", 2),
    (None, [0.5] * 8, 1, 1, "x", 2), (100_250, [], 1, 1, "x", 2), (100_300, [1.0, 2.0], 1, 1, "x", 2),
    (100_301, [1.0, 2.0], 1, 1, "x", 2), (100_302, [1.0, 1.0], 2, 1, "x", 2), (100_350, [0.0] * 8, 1, 1, "x", 2),
]


def brute(rows, every=50):
    sound = []
    for row, (name, vector, label, *_) in enumerate(rows):
        if name is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        if name % 7 == 0:
            label = (label + 1) % 10
        sound.append((name, row, label, [math.floor(256 * x) for x in vector]))
    out = []
    for name, row, label, vector in sound:
        if name % every:
            continue
        met = [
            (-sum(x * y for x, y in zip(vector, v)), i, r, other)
            for i, r, other, v in sound
            if r != row and len(v) == len(vector)
        ]
        met.sort()
        for score, i, _, _ in [m for m in met if m[3] == label][:5]:
            fits = [m for m in met if m[3] != label and 50 * -score <= 100 * -m[0] <= 95 * -score]
            out += [(name, i, k, m[1], -score, -m[0]) for k, m in enumerate(fits[:3], 1)]
    return sorted(out)


def mined(frame, **more):
    names = "anchor_id positive_id rank negative_id positive_score negative_score".split()
    return sorted(tuple(r[n] for n in names) for r in rows_of(hard_negatives(frame, label_rule=RULE, **more)))


def as_floats(spark, rows):
    """The rows as the table holds them: components in single precision."""
    frame = spark.createDataFrame(rows, SCHEMA)
    return frame, [(r["vec_id"], r["embedding"], r["label"]) for r in frame.collect()]


@pytest.mark.parametrize("blocks", [(32_768, 16_384, 1 << 20), (40, 3, 64)])
def test_all_pairs(spark, monkeypatch, blocks):
    for name, value in zip(("ROWS", "ANCHORS", "SCORES"), blocks):
        monkeypatch.setattr(module, name, value)
    frame, rows = as_floats(spark, vectors(1, 700) + AWKWARD)
    expected = brute(rows)
    assert mined(frame) == expected
    assert len(expected) > 100


def test_ties_copies_and_one_label_with_most_rows(spark):
    same = [(n, [0.25, 0.5], 0 if n % 3 else n % 5, 1, "x", 2) for n in range(400)]
    steps = [(1000 + n, [0.25 - n / 1000, 0.45], 3, 1, "x", 2) for n in range(150)]
    twice = steps[:20] + [(1000, [0.25, 0.45], 3, 1, "x", 2), (50, [0.25, 0.5], 0, 1, "x", 2)]
    frame, rows = as_floats(spark, same + steps + twice)
    assert mined(frame) == brute(rows) != []


def test_zero_and_negative_scores(spark):
    rows = [(50, [1.0, 0.0], 0), (51, [0.0, 1.0], 0), (53, [-1.0, 0.0], 0), (40, [0.0, 2.0], 1), (60, [0.0, 0.5], 1), (70, [-0.6, 0.0], 2)]
    frame, rows = as_floats(spark, [(*r, 1, "x", 2) for r in rows])
    found = mined(frame)
    assert found == brute(rows)
    assert (50, 51, 1, 40, 0, 0) in found  # score 0 is between 0 and 0, though its id is smaller


def test_large_components(spark):
    schema = "vec_id long, embedding array<double>, label int"
    rows = [(n, [(n + 1) * 1.5e5, (n % 7) * 2.0e5 + 0.1, 3e4], n % 2) for n in range(60)]
    assert mined(spark.createDataFrame(rows, schema)) == brute(rows) != []


def test_empty(spark):
    assert mined(spark.createDataFrame([], SCHEMA)) == []
    assert mined(spark.createDataFrame([(50, [1.0], 1, 1, "x", 2)], SCHEMA)) == []
