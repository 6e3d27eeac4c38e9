"""Gradient-boosted trees on weighted numeric rows, and their score as one Column expression.

Training runs in numpy on the driver over the rows it is given, equal ones as one with their number as weight. Scoring
has no Python at all: a tree is a nested CASE on feature columns.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Boosted:
    """trees: nested (feature, cut, left, right) with floats as leaves; a value up to the cut goes left."""

    names: list[str]
    base: float = 0.0
    trees: list = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        def walk(node, rows):
            if isinstance(node, float):
                return np.full(len(rows), node)
            left = x[rows, node[0]] <= node[1]
            out = np.empty(len(rows))
            out[left], out[~left] = walk(node[2], rows[left]), walk(node[3], rows[~left])
            return out

        every = np.arange(len(x))
        return self.base + sum((walk(t, every) for t in self.trees), np.zeros(len(x)))

    def column(self, feature: Callable[[str], Column]) -> Column:
        """The probability, from a function that gives a feature's column by name."""

        def walk(node) -> Column:
            if isinstance(node, float):
                return F.lit(node)
            return F.when(feature(self.names[node[0]]) <= node[1], walk(node[2])).otherwise(walk(node[3]))

        total = F.lit(float(self.base))
        for t in self.trees:
            total = total + walk(t)
        return 1.0 / (1.0 + F.exp(-total))


def fit(
    x: np.ndarray, y: np.ndarray, names: list[str], rounds: int = 20, depth: int = 2, rate: float = 0.3, cuts: int = 16, l2: float = 1.0,
    weight: np.ndarray | None = None, edges: list[np.ndarray] | None = None,
) -> Boosted:
    """Newton boosting of the logistic loss; splits at up to `cuts` quantiles of each feature, or at the given edges."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    w = np.ones(len(y)) if weight is None else np.asarray(weight, float)
    p0 = ((w * y).sum() + 1) / (w.sum() + 2)
    model = Boosted(list(names), float(np.log(p0 / (1 - p0))))
    if not len(y):
        return model
    if edges is None:
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, cuts + 1)[:-1])) for j in range(x.shape[1])]
    bins = [np.searchsorted(at, x[:, j]) for j, at in enumerate(edges)]  # of bin b: at most the edge b
    margin = np.full(len(y), model.base)

    def grow(rows, g, h, left_depth):
        total_g, total_h = g[rows].sum(), h[rows].sum()
        best = (1e-6, None, None)
        if left_depth:
            for j, at in enumerate(edges):
                gl, hl = (np.cumsum(np.bincount(bins[j][rows], v[rows], len(at) + 1))[:-1] for v in (g, h))
                gr, hr = total_g - gl, total_h - hl
                gain = np.where(np.minimum(hl, hr) < 0.5, 0.0, gl**2 / (hl + l2) + gr**2 / (hr + l2) - total_g**2 / (total_h + l2))
                if len(at) and gain.max() > best[0]:
                    best = (gain.max(), j, float(at[gain.argmax()]))
        if best[1] is None:
            return float(-rate * total_g / (total_h + l2))
        left = x[rows, best[1]] <= best[2]
        return (best[1], best[2], grow(rows[left], g, h, left_depth - 1), grow(rows[~left], g, h, left_depth - 1))

    every = np.arange(len(y))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        tree = grow(every, w * (p - y), w * p * (1 - p), depth)
        model.trees.append(tree)
        margin = margin + Boosted(model.names, 0.0, [tree]).margin(x)
    return model


def threshold(scores: np.ndarray, y: np.ndarray, precision: float, least: int = 5) -> float:
    """The lowest score at which at least `precision` of the held-out rows from there on are positive; above 1 if none."""
    order = np.argsort(-scores, kind="stable")
    s, hits = scores[order], np.cumsum(y[order])
    n = np.arange(1, len(s) + 1)
    last = np.r_[s[1:] != s[:-1], True] if len(s) else np.zeros(0, bool)
    good = last & (hits >= precision * n) & (n >= least)
    return float(s[np.flatnonzero(good)[-1]]) if good.any() else 2.0
