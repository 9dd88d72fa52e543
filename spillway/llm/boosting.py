"""Histogram gradient-boosted trees for two classes, kept as flat arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Settings:
    trees: int = 40
    depth: int = 4
    bins: int = 64
    rate: float = 0.25
    shrinkage: float = 1.0
    least_weight: float = 2.0


@dataclass(frozen=True)
class Trees:
    """All nodes of all trees side by side.  A row goes left where ``row[feature] <= threshold``;
    a leaf points to itself.  ``roots`` are the trees' first nodes."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    start: float

    def margins(self, rows: np.ndarray) -> np.ndarray:
        """The log odds of every row: all rows go down one level at a time."""
        out = np.full(len(rows), self.start)
        every = np.arange(len(rows))
        for root in self.roots:
            at = np.full(len(rows), root)
            for _ in range(self.depth):
                goes_left = rows[every, self.feature[at]] <= self.threshold[at]
                at = np.where(goes_left, self.left[at], self.right[at])
            out += self.value[at]
        return out

    def probabilities(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(rows), -500, 500)))


def fitted(rows: np.ndarray, labels: np.ndarray, settings: Settings = Settings()) -> Trees:
    """Trees for ``labels`` of 0 and 1.  Features are cut into at most ``bins`` ranges of equally
    many rows; a split's gain comes from per-range sums of gradients.  Ties take the first feature
    and the lowest cut, so equal input gives equal trees.  Without rows, or with one label only,
    there are no trees and every row gets the smoothed share of label 1 (one half without rows)."""
    start = float(np.log((labels.sum() + 0.5) / (len(labels) - labels.sum() + 0.5)))
    none = np.empty(0, np.int64)
    if len(labels) == 0 or labels.min() == labels.max():
        return Trees(none, np.empty(0), none, none, np.empty(0), none, 0, start)
    edges = [np.unique(np.quantile(column, np.linspace(0, 1, settings.bins + 1)[1:-1])) for column in rows.T]
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, rows.T)], axis=1)
    nodes: list[list] = []
    roots = []
    margins = np.full(len(rows), start)
    for _ in range(settings.trees):
        chance = 1 / (1 + np.exp(-margins))
        roots.append(len(nodes))
        margins += _grow(nodes, binned, edges, labels - chance, chance * (1 - chance), settings)
    feature, threshold, left, right, value = (np.array(x) for x in zip(*nodes))
    return Trees(feature, threshold, left, right, value, np.array(roots), settings.depth, start)


def _grow(nodes, binned, edges, gradient, weight, settings) -> np.ndarray:
    """Add one tree, level by level; what it adds to each row's margin."""
    size, features, bins = len(binned), binned.shape[1], settings.bins
    cells = binned + np.arange(features) * bins
    place = np.full(size, len(nodes))
    nodes.append(None)
    level = [len(nodes) - 1]
    for depth in range(settings.depth + 1):
        number = np.full(len(nodes), -1)
        number[level] = np.arange(len(level))
        local = number[place]
        here = local >= 0
        total = np.stack([np.bincount(local[here], x[here], len(level)) for x in (gradient, weight)])
        values = settings.rate * total[0] / (total[1] + settings.shrinkage)
        for node, value in zip(level, values):
            nodes[node] = [0, np.inf, node, node, value]
        if depth == settings.depth:
            break
        flat = (local[here, None] * features * bins + cells[here]).ravel()
        shape = (len(level), features, bins)
        sums = [
            np.bincount(flat, np.repeat(x[here], features), np.prod(shape)).reshape(shape).cumsum(axis=2)
            for x in (gradient, weight)
        ]
        gain = _gain(sums[0], sums[1], total, settings)
        best = gain.reshape(len(level), -1).argmax(axis=1)
        following = []
        for k, node in enumerate(level):
            f, cut = divmod(int(best[k]), bins)
            if gain[k, f, cut] <= 1e-9:
                continue
            mine = place == node
            goes_left = binned[:, f] <= cut
            children = [len(nodes), len(nodes) + 1]
            nodes.extend([None, None])
            nodes[node] = [f, float(edges[f][cut]), *children, 0.0]
            place[mine] = np.where(goes_left[mine], *children)
            following += children
        level = following
        if not level:
            break
    return np.array([node[4] for node in nodes])[place]


def _gain(gradient, weight, total, settings) -> np.ndarray:
    """What cutting after each bin gains; nothing for a cut after the last used bin."""
    all_gradient, all_weight = (t[:, None, None] for t in total)
    other_gradient, other_weight = all_gradient - gradient, all_weight - weight

    def score(g, w):
        return g * g / (w + settings.shrinkage)

    gain = score(gradient, weight) + score(other_gradient, other_weight) - score(all_gradient, all_weight)
    return np.where(np.minimum(weight, other_weight) < settings.least_weight, 0.0, gain)
