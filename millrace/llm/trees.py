"""Gradient-boosted trees in numpy, flattened into node arrays.

Trees are grown level by level on binned features for the logistic loss.  A feature
with constraint +1 (-1) can only raise (lower) the score: a split on it is refused
unless its two leaf values are ordered, and both sides then stay on their side of the
middle, so that the order holds for whole subtrees.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """All trees' nodes in flat arrays; a leaf points to itself."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds per row: all rows go down all trees a level at a time."""
        node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            low = x[rows, self.feature[node]] <= self.threshold[node]
            node = np.where(low, self.left[node], self.right[node])
        return self.base + self.value[node].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.margin(x))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def constant(probability: float) -> Forest:
    """A forest without trees, for labels of one class or none."""
    p = min(max(probability, 1e-6), 1 - 1e-6)
    none = np.zeros(0, np.int64)
    return Forest(none, none, none.astype(float), none, none, none.astype(float), float(np.log(p / (1 - p))), 0)


def fit(
    x: np.ndarray,
    y: np.ndarray,
    constraints: np.ndarray,
    rounds: int = 60,
    depth: int = 3,
    rate: float = 0.2,
    bins: int = 64,
    ridge: float = 1.0,
    least: int = 20,
) -> Forest:
    """Boosted trees for 0/1 labels ``y``; at least ``least`` rows in each leaf."""
    if not len(y) or y.min() == y.max():
        return constant(float(y[0]) if len(y) else 1.0)
    cuts = [np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) for column in x.T]
    binned = np.stack([np.searchsorted(c, column, "left") for c, column in zip(cuts, x.T)], 1)
    base = float(np.log(y.mean() / (1 - y.mean())))
    margin = np.full(len(y), base)
    nodes: list[list[float]] = []  # feature, threshold, left, right, value
    roots = []
    for _ in range(rounds):
        p = sigmoid(margin)
        gradient, curve = y - p, p * (1 - p)
        root = len(nodes)
        roots.append(root)
        nodes.append([0, 0.0, root, root, 0.0])
        grow = [(root, np.arange(len(y)), -np.inf, np.inf)]
        for level in range(depth + 1):
            below = []
            for node, rows, low, high in grow:
                g, h = gradient[rows], curve[rows]
                value = np.clip(g.sum() / (h.sum() + ridge), low, high)
                nodes[node][4] = rate * value
                split = level < depth and best_split(
                    binned[rows], g, h, cuts, constraints, low, high, ridge, least
                )
                if not split:
                    margin[rows] += rate * value
                    continue
                feature, cut, value_left, value_right = split
                a, b = len(nodes), len(nodes) + 1
                nodes[node] = [feature, cuts[feature][cut], a, b, 0.0]
                nodes += [[0, 0.0, a, a, 0.0], [0, 0.0, b, b, 0.0]]
                goes_left = binned[rows, feature] <= cut
                middle = (value_left + value_right) / 2
                bounds = {0: ((low, high),) * 2, 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}
                for child, part, bound in zip((a, b), (rows[goes_left], rows[~goes_left]), bounds[int(constraints[feature])]):
                    below.append((child, part, *bound))
            grow = below
    flat = np.array(nodes)
    whole = flat[:, [0, 2, 3]].astype(np.int64)
    return Forest(np.array(roots), whole[:, 0], flat[:, 1], whole[:, 1], whole[:, 2], flat[:, 4], base, depth)


def best_split(binned, g, h, cuts, constraints, low, high, ridge, least):
    """``(feature, cut, left value, right value)`` of the largest gain, or None."""
    best, found = 1e-6, None
    if len(g) < 2 * least:
        return None
    whole = g.sum() ** 2 / (h.sum() + ridge)
    for feature, feature_cuts in enumerate(cuts):
        size = len(feature_cuts) + 1
        if size < 2:
            continue
        column = binned[:, feature]
        gs, hs, ns = (
            np.cumsum(np.bincount(column, weights, size))[:-1] for weights in (g, h, np.ones(len(g)))
        )
        left = np.clip(gs / (hs + ridge), low, high)
        right = np.clip((g.sum() - gs) / (h.sum() - hs + ridge), low, high)
        gain = gs**2 / (hs + ridge) + (g.sum() - gs) ** 2 / (h.sum() - hs + ridge) - whole
        allowed = (ns >= least) & (len(g) - ns >= least) & (constraints[feature] * (right - left) >= 0)
        gain = np.where(allowed, gain, -np.inf)
        cut = int(np.argmax(gain))
        if gain[cut] > best:
            best, found = gain[cut], (feature, cut, left[cut], right[cut])
    return found
