"""Gradient-boosted regression trees on a few hundred rows, compiled to SQL.

The trees are fitted on the driver from a small fixed training set and become
nested CASE expressions, so that scoring stays inside the plan.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Tree:
    """A split (feature below a cut goes left) or a leaf (no feature)."""

    value: float
    feature: int | None = None
    cut: float = 0.0
    left: "Tree | None" = None
    right: "Tree | None" = None

    def sql(self, names: list[str]) -> str:
        if self.feature is None:
            return f"{self.value!r}D"
        return f"CASE WHEN {names[self.feature]} < {self.cut!r}D THEN {self.left.sql(names)} ELSE {self.right.sql(names)} END"

    def apply(self, x: np.ndarray) -> np.ndarray:
        if self.feature is None:
            return np.full(len(x), self.value)
        return np.where(x[:, self.feature] < self.cut, self.left.apply(x), self.right.apply(x))


@dataclass
class Boosted:
    base: float
    trees: list[Tree]

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum((t.apply(x) for t in self.trees), np.zeros(len(x)))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logit(x)))

    def sql(self, names: list[str]) -> str:
        """Probability as a SQL expression over the named features."""
        total = " + ".join([f"{self.base!r}D", *(f"({t.sql(names)})" for t in self.trees)])
        return f"1 / (1 + exp(-({total})))"


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, rate: float, least: int) -> Tree:
    leaf = Tree(float(rate * g.sum() / (h.sum() + 1.0)))
    if depth == 0 or len(x) < 2 * least:
        return leaf
    best, gain = None, 1e-6
    whole = g.sum() ** 2 / (h.sum() + 1.0)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, gs, hs = x[order, f], np.cumsum(g[order]), np.cumsum(h[order])
        for i in np.flatnonzero(v[1:] > v[:-1]):
            if i + 1 < least or len(v) - i - 1 < least:
                continue
            now = gs[i] ** 2 / (hs[i] + 1) + (gs[-1] - gs[i]) ** 2 / (hs[-1] - hs[i] + 1) - whole
            if now > gain + 1e-9:
                best, gain = (f, float((v[i] + v[i + 1]) / 2)), now
    if best is None:
        return leaf
    low = x[:, best[0]] < best[1]
    return Tree(0.0, best[0], best[1], _grow(x[low], g[low], h[low], depth - 1, rate, least), _grow(x[~low], g[~low], h[~low], depth - 1, rate, least))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 24, depth: int = 3, rate: float = 0.3, least: int = 5) -> Boosted:
    """Logistic gradient boosting with Newton leaves."""
    mean = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    model = Boosted(float(np.log(mean / (1 - mean))), [])
    for _ in range(rounds):
        p = model.probability(x)
        model.trees.append(_grow(x, y - p, p * (1 - p), depth, rate, least))
    return model


def calibrated_threshold(p: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The lowest cut at which held-out rows at or above it reach the wanted
    precision; above 1, which accepts nothing, if there is none."""
    order = np.argsort(-p, kind="stable")
    right = np.cumsum(y[order]) / np.arange(1, len(p) + 1)
    last = np.append(p[order][1:] < p[order][:-1], True) if len(p) else np.zeros(0, bool)
    good = np.flatnonzero((right >= precision) & last)
    return float(p[order][good[-1]]) if len(good) else 2.0
