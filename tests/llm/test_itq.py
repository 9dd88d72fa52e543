"""Linked vectors against all pairs."""

import numpy as np
import pytest
from llm_helpers import rows_of
from test_components import brute as components_of

from spillway.llm.itq import RECALL, at_limit, fitted, learn, learn_rotation, near_vectors, unit

SCHEMA = "vec_id long, embedding array<float>, label int, class string"


def vectors(seed=1, groups=(40, 3, 2, 2), noise=0.08):
    pick = np.random.default_rng(seed)
    rows = []
    for label in (0, 1):
        for _ in range(150):
            rows.append((pick.normal(size=32), label))
        for size in groups:
            centre = pick.normal(size=32)
            rows += [(centre + noise * pick.normal(size=32), label) for _ in range(size)]
    rows += [(rows[0][0], 0), (rows[0][0], 0), (rows[0][0], 1), (rows[5][0] * 3, 0)]
    return [(n, v.astype(np.float32).tolist(), label, "x") for n, (v, label) in enumerate(rows)]


AWKWARD = [
    (9001, None, 0, "x"), (9002, [0.0] * 32, 0, "x"), (9003, [float("nan")] + [1.0] * 31, 0, "x"),
    (9004, [float("inf")] + [1.0] * 31, 0, "x"), (9005, [None] + [1.0] * 31, 0, "x"),
    (9006, [1.0] * 32, None, "x"), (9007, [1.0] * 32, None, "x"), (9008, [1.0, 2.0], 0, "x"), (9009, [], 0, "x"),
]


def brute(rows, least=0.98):
    found = np.array([v for _, v, _, _ in rows], np.float64)
    found /= np.linalg.norm(found, axis=1, keepdims=True)
    label = np.array([x for _, _, x, _ in rows])
    near = (found @ found.T >= least) & (label[:, None] == label)
    np.fill_diagonal(near, False)
    root = components_of([(a, a) for a in range(len(rows))] + list(zip(*np.nonzero(near))))
    return {rows[n][0]: (int(near[n].sum()), rows[root[n]][0]) for n in range(len(rows))}


@pytest.mark.parametrize("block", [1024, 7])
def test_links_and_components(spark, block):
    rows = vectors()
    frame = spark.createDataFrame(rows + AWKWARD, SCHEMA)
    got = rows_of(near_vectors(frame, block=block))
    assert len(got) == len(rows) + len(AWKWARD)
    expected = brute(rows) | {i: (0, i) for i, *_ in AWKWARD}
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got}
    assert found == expected
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    assert sum(n for n, _ in expected.values()) > 3000


def test_every_dimension_is_indexed(spark):
    rows = vectors()
    pick = np.random.default_rng(7)
    short = [(v, n % 2) for n in range(90) for v in [pick.normal(size=20)]]
    short += [(v * 2.5, label) for v, label in short[:30]]
    short += [(v + 0.08 * pick.normal(size=20), label) for v, label in short[:40]]
    short = [(5000 + n, v.astype(np.float32).tolist(), label, "x") for n, (v, label) in enumerate(short)]
    expected = brute(rows) | brute(short)
    got = near_vectors(spark.createDataFrame(rows + short, SCHEMA)).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == expected
    assert sum(expected[i][0] for i, *_ in short) > 100


def test_recall_close_to_the_limit(spark):
    rows = vectors(5, (2,) * 200, 0.095)
    expected = brute(rows)
    got = {r["vec_id"]: r["n_links"] for r in near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i] <= n for i, (n, _) in expected.items())
    assert sum(got.values()) >= 0.98 * sum(n for n, _ in expected.values()) > 100


def off_centre(norm, count=6000, size=64):
    pick = np.random.default_rng(4)
    centre = unit(pick.normal(size=size), size) * norm / np.sqrt(1 - norm * norm)
    return unit(unit(pick.normal(size=(count, size)), size) + centre, size)


@pytest.mark.parametrize("norm", [0.0, 0.83, 0.9, 0.95, 0.99])
def test_recall_off_centre(norm):
    sample = off_centre(norm)
    model = fitted(sample[:4000], 0.98, 16, 20, 1_000_000)
    for a, b in at_limit(sample[4000:], 0.98, 9):
        assert (model.segments(a) == model.segments(b)).any(axis=1).mean() >= RECALL - 0.002
    assert norm or (model.width, model.tables) == (16, 20)
    assert norm > 0.95 or model.width >= 8


def test_links_off_centre(spark):
    own = off_centre(0.95, 500)
    every = np.concatenate([own] + [b[:500] for a, b in at_limit(own, 0.981)])
    rows = [(n, v.astype(np.float32).tolist(), 0, "x") for n, v in enumerate(every)]
    rows += [(9000, [1.0, 2.0, 3.0], 0, "x"), (9001, [1.0, 2.1, 3.0], 0, "x")]
    expected = brute(rows[:-2]) | {9000: (1, 9000), 9001: (1, 9000)}
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got.keys() == expected.keys() and all(got[i][0] <= n for i, (n, _) in expected.items())
    assert got[9001] == expected[9001]
    assert sum(n for n, _ in got.values()) >= 0.99 * sum(n for n, _ in expected.values()) > 500


def test_null_ids_and_empty_table(spark):
    rows = [(None, [1.0, 2.0], 0, "x"), (None, [1.0, 2.0], 0, "x"), (3, [1.0, 2.0], 0, "x"), (4, [1.0, 2.0], 0, "x")]
    got = [tuple(r) for r in near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got, key=str) == sorted([(None, 0, None, True)] * 2 + [(3, 1, 3, True), (4, 1, 3, False)], key=str)
    assert near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_codes_are_balanced_and_rotations_orthogonal():
    sample = unit([v for _, v, _, _ in vectors()], 32)
    turn = learn_rotation(sample - sample.mean(axis=0), 20, 0)
    assert np.allclose(turn @ turn.T, np.eye(32))
    model = learn(sample, 64, 16)
    bits = (sample - model.mean) @ model.rotations > 0
    assert model.tables == 4 and (abs(bits.mean(axis=0) - 0.5) < 0.25).all()
    error = lambda t: ((np.sign((sample - model.mean) @ t) / np.sqrt(32) - (sample - model.mean) @ t) ** 2).sum()
    assert error(turn) < error(learn_rotation(sample - sample.mean(axis=0), 0, 0))
