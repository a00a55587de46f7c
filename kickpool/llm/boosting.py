"""Gradient-boosted trees for two classes: histogram splits, logistic loss, level by level."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 32


@dataclass
class Trees:
    base: float
    depth: int
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    value: np.ndarray  # trees x leaves

    def logit(self, rows: np.ndarray) -> np.ndarray:
        total = np.full(len(rows), self.base)
        every = np.arange(len(rows))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            at = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (rows[every, feature[at]] > threshold[at])
            total += value[at - (2**self.depth - 1)]
        return total


def fit(
    rows: np.ndarray,
    labels: np.ndarray,
    weights: np.ndarray,
    trees: int = 100,
    depth: int = 4,
    rate: float = 0.25,
    smooth: float = 5.0,
) -> Trees:
    """Trees that add up to the log odds of ``labels`` (0 or 1)."""
    edges = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(rows.shape[1])]
    binned = np.stack([np.searchsorted(e, rows[:, f], "left") for f, e in enumerate(edges)], axis=1)
    mean = np.clip(np.average(labels, weights=weights), 1e-3, 1 - 1e-3)
    base = float(np.log(mean / (1 - mean)))
    logit = np.full(len(rows), base)
    inner, leaves = 2**depth - 1, 2**depth
    made = Trees(base, depth, np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves)))
    for tree in range(trees):
        chance = 1 / (1 + np.exp(-logit))
        slope, curve = weights * (labels - chance), weights * chance * (1 - chance)
        at = np.zeros(len(rows), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            best = np.full(width, 1e-6)
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                key = (at - first) * BINS + binned[:, f]
                g = np.bincount(key, slope, width * BINS).reshape(width, BINS).cumsum(axis=1)
                h = np.bincount(key, curve, width * BINS).reshape(width, BINS).cumsum(axis=1)
                g_all, h_all = g[:, -1:], h[:, -1:]
                gain = g**2 / (h + smooth) + (g_all - g) ** 2 / (h_all - h + smooth) - g_all**2 / (h_all + smooth)
                gain = gain[:, : len(e)]
                split = gain.argmax(axis=1)
                top = gain[np.arange(width), split]
                for node in np.flatnonzero(top > best):
                    best[node] = top[node]
                    made.feature[tree, first + node] = f
                    made.threshold[tree, first + node] = e[split[node]]
            at = 2 * at + 1 + (rows[np.arange(len(rows)), made.feature[tree, at]] > made.threshold[tree, at])
        leaf = at - inner
        g, h = np.bincount(leaf, slope, leaves), np.bincount(leaf, curve, leaves)
        made.value[tree] = rate * g / (h + smooth)
        logit += made.value[tree][leaf]
    return made
