"""Boosted trees and the classifier built on them."""

import numpy as np
import pytest
from llm_helpers import TEXTS, rows_of

from spillway.llm.boosting import Settings, fitted
from spillway.llm.quality_model import FEATURES, accepted, fit_quality, quality_scores, statistics

SMALL = "/root/testdata/sf0.01"


def walk(trees, row):
    """One row, one node after the other."""
    total = trees.start
    for node in trees.roots:
        while trees.left[node] != node:
            goes_left = row[trees.feature[node]] <= trees.threshold[node]
            node = trees.left[node] if goes_left else trees.right[node]
        total += trees.value[node]
    return total


def test_flat_traversal_and_learning():
    pick = np.random.default_rng(1)
    rows = pick.normal(size=(600, 5))
    rows[:, 3] = rows[:, 3].round()
    labels = ((rows[:, 0] > 0.3) ^ (rows[:, 3] > 0)).astype(float)
    trees = fitted(rows, labels)
    assert ((trees.probabilities(rows) >= 0.5) == labels).mean() > 0.97
    assert np.allclose(trees.margins(rows[:50]), [walk(trees, r) for r in rows[:50]])
    again = fitted(rows, labels)
    assert (again.threshold == trees.threshold).all() and (again.value == trees.value).all()


def test_first_split_is_the_best_of_all():
    pick = np.random.default_rng(2)
    rows = pick.integers(0, 6, (80, 3)).astype(float)
    labels = (rows[:, 1] > 2).astype(float)
    settings = Settings(trees=1, depth=1)
    trees = fitted(rows, labels, settings)
    start = 1 / (1 + np.exp(-trees.start))
    gradient, weight = labels - start, start * (1 - start) * np.ones(80)

    def gain(f, cut):
        parts = [rows[:, f] <= cut, rows[:, f] > cut]
        return sum(gradient[p].sum() ** 2 / (weight[p].sum() + settings.shrinkage) for p in parts)

    best = max(((gain(f, c), f, c) for f in range(3) for c in range(5)), key=lambda x: (x[0], -x[1]))
    assert (trees.feature[0], trees.threshold[0]) == best[1:]


@pytest.mark.parametrize("labels", [[], [1.0, 1.0], [0.0]])
def test_without_two_labels(labels):
    trees = fitted(np.zeros((len(labels), 2)), np.array(labels))
    expected = (sum(labels) + 0.5) / (len(labels) + 1)
    assert np.allclose(trees.probabilities(np.zeros((3, 2))), expected)


def test_statistics_of_any_text():
    for _, text in TEXTS:
        found = statistics((text or "").encode())
        assert found.shape == (len(FEATURES),) and np.isfinite(found).all()
    assert not statistics(b" \n ").any()


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    model = fit_quality(docs, labels)
    rows = quality_scores(docs, model).join(labels, "doc_id").where("held_out").toPandas()
    assert len(rows) > 50 and (rows["predicted"] == rows["quality"]).mean() >= 0.95
    assert accepted(docs, model).count() == quality_scores(docs, model).where("predicted = 1").count()


def test_awkward_rows(spark, docs, empty):
    labels = spark.createDataFrame(
        [(1, 1), (1, 1), (5, 0), (9, None), (None, 1), (12, 1), (7, 3), (404, 0)], "doc_id long, quality int"
    )
    model = fit_quality(docs, labels)
    rows = rows_of(quality_scores(docs, model))
    assert len(rows) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert not any(r["held_out"] for r in rows if r["doc_id"] is None)
    assert accepted(docs, model).schema == docs.schema
    assert quality_scores(empty, fit_quality(empty, labels)).count() == 0


def test_a_repeated_id_is_gathered_once_for_each_label(spark, monkeypatch):
    from spillway.llm import quality_model

    seen = []

    def kept_apart(rows, labels, settings):
        seen.append((rows, labels))
        return fitted(rows, labels, settings)

    monkeypatch.setattr(quality_model, "fitted", kept_apart)
    texts = [(n, f"some words of text {n}") for n in range(60)]
    texts += [(3, f"another text of this id {n % 7}") for n in range(400)] + [(3, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(n, n % 2) for n in range(60)] + [(3, n % 2) for n in range(500)], "doc_id long, quality int")
    quality_model.fit_quality(docs, labels)
    quality_model.fit_quality(docs.orderBy("text"), labels, sample=20)
    (rows, found), (fewer, _) = seen
    used = labels.distinct().where(~quality_model.held_out("doc_id", 3)).count()
    assert len(rows) == used and 0 < len(fewer) < len(rows)
    assert {tuple(r) for r in fewer.tolist()} <= {tuple(r) for r in rows.tolist()}
