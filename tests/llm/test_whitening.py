"""Whitened vectors against numpy's eigenvectors and exact whole numbers; inertia against eigenvalues."""

import math
from fractions import Fraction

import numpy as np
import pytest
from llm_helpers import rows_of

from spillway.llm import whitening
from spillway.llm.queries import QUERIES
from spillway.llm.spectrum import above, leading
from spillway.llm.whitening import whitened

SCHEMA = "vec_id long, embedding array<float>, n string, size string, deviation int"
AWKWARD = [
    (9001, None, "x", "y", 1), (9002, [float("nan")] * 12, "x", "y", 1), (9003, [None] + [1.0] * 11, "x", "y", 1),
    (9004, [float("inf")] * 12, "x", "y", 1), (9005, [], "x", "y", 1),
]


def vectors(seed=1, count=500, size=12):
    pick = np.random.default_rng(seed)
    spread = np.linspace(1, 3, size) ** 2
    found = (pick.normal(size=(count, size)) * spread + 0.5).astype(np.float32)
    return [(n, v.tolist(), "x", "y", 1) for n, v in enumerate(found)]


def expected(rows, number=8):
    x = np.array([[math.floor(1024 * c) + 100_000 for c in v] for _, v, *_ in rows], object)
    n, total = len(x), x.sum(axis=0)
    mean = np.array([float(Fraction(int(t), n)) for t in total])
    centred = x.astype(float) - mean
    covariance = centred.T @ centred / n
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1][:number], axes[:, ::-1][:, :number]
    deviations = ((n * x - total) ** 2).sum(axis=1)
    return n, deviations, centred @ axes / np.sqrt(values), values / np.trace(covariance)


def check(rows, got):
    n, deviations, projected, shares = expected(rows)
    assert [r["vec_id"] for r in got] == [r[0] for r in rows]
    found = np.array([r["whitened"] for r in got])
    turned = np.sign((found * projected).sum(axis=0))
    assert np.allclose(found, projected * turned, rtol=1e-8, atol=1e-8)
    assert [int(r["deviation"]) for r in got] == deviations.tolist()
    assert {r["n"] for r in got} == {n}
    assert np.allclose([r["explained"] for r in got], shares, rtol=1e-9)
    error = np.abs(np.cov(found.T, bias=True) - np.eye(found.shape[1])).max()
    assert {r["identity_error"] for r in got} == {got[0]["identity_error"]} and got[0]["identity_error"] < 1e-8
    assert error < 1e-8


def ordered(frame):
    return sorted(rows_of(frame), key=lambda r: r["vec_id"])


def test_against_numpy(spark):
    rows = vectors()
    check(rows, ordered(whitened(spark.createDataFrame(rows + AWKWARD, SCHEMA).repartition(7))))


def test_each_length_is_a_fit_of_its_own(spark):
    rows, short = vectors(), [(2000 + i, v, *rest) for i, v, *rest in vectors(3, 200, 10)]
    got = ordered(whitened(spark.createDataFrame(rows + short, SCHEMA)))
    check(rows, [r for r in got if r["vec_id"] < 2000])
    check(short, [r for r in got if r["vec_id"] >= 2000])


def test_large_entries_and_exact_deviations(spark):
    rows = [(n, [1e9 * (n % 13) + n, -1e11 * (n % 7), n * n * 0.5], "x", "y", 1) for n in range(300)]
    schema = SCHEMA.replace("float", "double")
    got = ordered(whitened(spark.createDataFrame(rows, schema)))
    n, deviations, projected, _ = expected(rows)
    assert [int(r["deviation"]) for r in got] == deviations.tolist()
    assert max(deviations) > 2**63
    found = np.array([r["whitened"] for r in got])
    assert np.allclose(np.abs(found[:, :2]), np.abs(projected[:, :2]), rtol=1e-6, atol=1e-6)


def test_few_dimensions_equal_rows_and_ties(spark):
    flat = [(n, [0.5, 0.25, (-1.0) ** n], "x", "y", 1) for n in range(10)]
    got = ordered(whitened(spark.createDataFrame(flat, SCHEMA)))
    assert [len(r["whitened"]) for r in got] == [1] * 10
    assert all(abs(abs(r["whitened"][0]) - 1) < 1e-12 and r["explained"] == [1.0] for r in got)
    same = [(n, [0.5, 0.25], "x", "y", 1) for n in (1, 1, 1)] + [(None, [0.5, 0.25], "x", "y", 1)]
    got = rows_of(whitened(spark.createDataFrame(same, SCHEMA)))
    assert [(r["whitened"], r["n"], int(r["deviation"])) for r in got] == [([], 4, 0)] * 4
    square = [(n, [a, b, c], "x", "y", 1) for n, (a, b, c) in enumerate([(1.0, 0, 0), (-1.0, 0, 0), (0, 1.0, 0), (0, -1.0, 0), (0, 0, 1.0), (0, 0, -1.0)])]
    got = ordered(whitened(spark.createDataFrame([(n, [float(x) for x in v], *rest) for n, v, *rest in square], SCHEMA)))
    assert np.allclose(np.cov(np.array([r["whitened"] for r in got]).T, bias=True), np.eye(3), atol=1e-9)
    assert got[0]["identity_error"] < 1e-9


def test_empty(spark):
    assert whitened(spark.createDataFrame([], SCHEMA)).count() == 0
    assert whitened(spark.createDataFrame(AWKWARD, SCHEMA)).count() == 0


def test_exact_route_equals_the_short_one(monkeypatch):
    x = np.array([[5.0, 100_003.0], [7.0, -9.0], [1e6, 3.0]])
    total = [int(t) for t in x.sum(axis=0)]
    long = [sum((3 * int(v) - t) ** 2 for v, t in zip(row, total)) for row in x]
    assert whitening._deviations(x, 3, total) == long
    assert whitening._deviations(x * 2.0**40, 3, [t << 40 for t in total]) == [d << 80 for d in long]


@pytest.mark.parametrize("seed", range(20))
def test_inertia_and_leading_pairs(seed):
    pick = np.random.default_rng(seed)
    size = int(pick.integers(1, 30))
    a = pick.normal(size=(size, size))
    a = np.round(a + a.T, seed % 3)
    if seed % 4 == 0:
        a = a - np.diag(np.diag(a))
    shift = float(pick.normal())
    assert above(a, shift) == (np.linalg.eigvalsh(a) > shift).sum()
    turn, _ = np.linalg.qr(pick.normal(size=(size, size)))
    values = np.sort(pick.choice([0.0, 1.0, 2.0, 2.0 + 1e-9, 3.0, 1e4], size=size))[::-1]
    matrix = turn @ np.diag(values) @ turn.T
    pairs = leading(matrix, 5)
    positive = values[values > 0][:5]
    assert len(pairs.values) == len(positive)
    assert np.allclose(pairs.values, positive, rtol=1e-10, atol=1e-10 * values[0])
    assert np.abs(pairs.vectors.T @ pairs.vectors - np.eye(len(positive))).max(initial=0) < 1e-7
    assert np.linalg.norm(matrix @ pairs.vectors - pairs.vectors * pairs.values, axis=0).max(initial=0) < 1e-10 * max(1, values[0])


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/embeddings.parquet").orderBy("vec_id").collect()]
    n, deviations, projected, shares = expected(rows)
    got = rows_of(QUERIES["op11_embedding_whitening"](spark, folder).orderBy("vec_id", "component"))
    assert [(r["vec_id"], r["component"], r["n"], r["deviation"]) for r in got] == [
        (row[0], k, n, d) for row, d in zip(rows, deviations) for k in range(1, 9)
    ]
    found = np.array([r["whitened"] for r in got]).reshape(-1, 8)
    assert np.allclose(found, projected * np.sign((found * projected).sum(axis=0)), rtol=1e-7, atol=1e-7)
    assert np.allclose(np.array([r["explained"] for r in got]).reshape(-1, 8), shares)
    assert 0 < got[0]["identity_error"] < 1e-8
