"""Components against union-find."""

import random

import pytest

from spillway.llm.components import components


def brute(links):
    parent = {n: n for link in links for n in link}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        low, high = sorted((find(a), find(b)))
        parent[high] = low
    return {n: find(n) for n in parent}


def shuffled(size, seed):
    names = list(range(size))
    random.Random(seed).shuffle(names)
    return names


CASES = {
    "path": list(zip(range(60), range(1, 61))),
    "mixed path": list(zip(shuffled(60, 1), shuffled(60, 1)[1:])),
    "star": [(500, n) for n in range(300)],
    "random": [(random.Random(n).randrange(200), random.Random(n + 999).randrange(200)) for n in range(150)],
    "repeats and loops": [(1, 1), (2, 3), (3, 2), (2, 3), (-5, 3)],
}


@pytest.mark.parametrize("name", CASES)
def test_components(spark, name):
    found = components(spark.createDataFrame(CASES[name], "a long, b long"))
    assert {r["node"]: r["component"] for r in found.collect()} == {
        n: c for n, c in brute([x for x in CASES[name] if x[0] != x[1]]).items()
    }


def test_none_and_nulls(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert components(spark.createDataFrame([(None, 1), (2, None)], "a long, b long")).count() == 0
