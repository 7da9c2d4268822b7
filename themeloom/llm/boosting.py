"""Gradient boosted trees of weighted rows, and thresholds from held-out rows.

Logistic loss, histogram splits over at most 32 values of a feature, trees of fixed depth kept as
arrays; scoring is a few array operations and runs inside Arrow batches. A tree needs only sums over the
rows, level by level: ``grow`` asks for them, and they may come from arrays (``Rows``) or be added up over
the tasks of a Spark job. They are sums of integers, so that both give the same trees in any order.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np

BINS = 32
UNIT = float(1 << 24)  # gradients are summed as multiples of 1 / UNIT
STEPS = 1024.0  # margins are multiples of 1 / STEPS, so that held-out rows can be counted by margin


class Boosted(NamedTuple):
    start: float
    feature: np.ndarray  # trees x inner nodes; -1 where a node sends all rows left
    cut: np.ndarray
    leaf: np.ndarray  # trees x leaves
    bend: tuple[float, float]  # calibration: p = sigmoid(a + b * margin)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            out += leaf[place(x, feature, cut, int(np.log2(len(leaf))))]
        return np.rint(out * STEPS) / STEPS

    def probability(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.bend[0] + self.bend[1] * self.margin(x))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def place(x: np.ndarray, feature: np.ndarray, cut: np.ndarray, level: int) -> np.ndarray:
    """The node of every row among those of a level of a tree."""
    rows, node = np.arange(len(x)), np.zeros(len(x), np.int64)
    for _ in range(level):
        f = feature[node]
        node = 2 * node + 1 + ((f >= 0) & (x[rows, np.maximum(f, 0)] > cut[node]))
    return node - (2**level - 1)


def cuts_of(values: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Quantiles of distinct, sorted values, each of which stands for ``weight`` rows."""
    if not len(values):
        return np.zeros(1)
    last = np.cumsum(weight)
    at = np.linspace(0, 1, BINS + 1)[:-1] * (last[-1] - 1)
    low = values[np.searchsorted(last, np.floor(at), "right")]
    high = values[np.searchsorted(last, np.ceil(at), "right")]
    return np.unique(low + (high - low) * (at - np.floor(at)))


class Rows:
    """Sums over rows that are held as arrays."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, cuts: list[np.ndarray], start: float):
        self.x, self.y, self.weight = x, y, weight
        self.bins = [np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)]
        self.total, self.done = np.full(len(x), start), 0

    def sums(self, model: Boosted, feature: np.ndarray, cut: np.ndarray, level: int) -> np.ndarray:
        """Gradients and curvatures by node of the level, feature and bin."""
        for f, c, leaf in zip(model.feature[self.done :], model.cut[self.done :], model.leaf[self.done :]):
            self.total += leaf[place(self.x, f, c, int(np.log2(len(leaf))))]
        self.done = len(model.leaf)
        p = _sigmoid(self.total)
        parts = [np.rint(v * UNIT) * self.weight for v in (p - self.y, p * (1 - p))]
        nodes, width = 2**level, BINS + 1
        node = place(self.x, feature, cut, level) * width
        out = [[np.bincount(node + b, v, nodes * width).reshape(nodes, width) for b in self.bins] for v in parts]
        return np.array(out).transpose(2, 1, 3, 0)


def start_of(right: float, total: float) -> float:
    share = np.clip(right / total if total else 0.5, 1e-3, 1 - 1e-3)
    return float(np.log(share / (1 - share)))


def grow(
    sums: Callable, cuts: list[np.ndarray], start: float, trees: int = 30, depth: int = 3, rate: float = 0.3, ridge: float = 1.0
) -> Boosted:
    """Trees from ``sums(model, feature, cut, level)``, the sums over all rows for a level of the tree that is being made."""
    inner = 2**depth - 1
    model = Boosted(start, np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, inner + 1)), (0.0, 1.0))
    for _ in range(trees):
        feature, cut, leaf = np.full(inner, -1), np.zeros(inner), np.zeros(inner + 1)
        for level in range(depth):
            found = sums(model, feature, cut, level) / UNIT
            for n, own in enumerate(found):
                k, (g, h) = 2**level - 1 + n, own[0].sum(axis=0)
                best, split = (1e-6, -1, 0.0), (g, h)
                for f, c in enumerate(cuts):
                    if len(c) < 2:
                        continue
                    left_g, left_h = own[f, : len(c)].cumsum(axis=0).T
                    gain = left_g**2 / (left_h + ridge) + (g - left_g) ** 2 / (h - left_h + ridge) - g**2 / (h + ridge)
                    at = int(gain.argmax())
                    if gain[at] > best[0]:
                        best, split = (gain[at], f, c[at]), (left_g[at], left_h[at])
                _, feature[k], cut[k] = best
                if level == depth - 1:
                    leaf[2 * n] = -rate * split[0] / (split[1] + ridge)
                    leaf[2 * n + 1] = -rate * (g - split[0]) / (h - split[1] + ridge)
        model = model._replace(
            feature=np.append(model.feature, [feature], 0), cut=np.append(model.cut, [cut], 0), leaf=np.append(model.leaf, [leaf], 0)
        )
    return model


def counted(values: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, at = np.unique(values, return_inverse=True)
    return distinct, np.bincount(at, weight, len(distinct))


def boost(
    x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 3, rate: float = 0.3, ridge: float = 1.0, weight: np.ndarray | None = None
) -> Boosted:
    weight = np.ones(len(x)) if weight is None else weight
    cuts = [cuts_of(*counted(x[:, f], weight)) for f in range(x.shape[1])]
    start = start_of((y * weight).sum(), weight.sum())
    return grow(Rows(x, y, weight, cuts, start).sums, cuts, start, trees, depth, rate, ridge)


def calibrate(model: Boosted, x: np.ndarray, y: np.ndarray, steps: int = 60) -> Boosted:
    """Two-parameter calibration on rows that the trees haven't seen."""
    return bend(model, model.margin(x), y, np.ones(len(x)), steps)


def bend(model: Boosted, margin: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 60) -> Boosted:
    """The same from margins, each of which stands for ``weight`` rows."""
    right, total = (y * weight).sum(), weight.sum()
    if not 0 < right < total:
        return model
    z = np.stack([np.ones(len(margin)), margin], 1)
    # Targets a little inside 0 and 1, so that separable rows have a finite optimum.
    goal = np.where(y > 0, (right + 1) / (right + 2), 1 / (total - right + 2))
    w = np.array([0.0, 1.0])
    for _ in range(steps):
        p = _sigmoid(z @ w)
        hess = (z * (weight * p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, z.T @ (weight * (p - goal)) + 1e-3 * (w - [0, 1]))
        w = w - np.clip(step, -0.5, 0.5)  # far from the optimum a full step overshoots
    return model._replace(bend=(float(w[0]), float(max(w[1], 1e-3))))


def threshold_for(p: np.ndarray, y: np.ndarray, precision: float, least: float = 0.5, weight: np.ndarray | None = None) -> float:
    """The lowest threshold from which on the held-out rows reach the precision; above 1 if none does."""
    weight = np.ones(len(p)) if weight is None else weight
    if not len(p) or not (y * weight).sum():
        return 2.0
    order = np.argsort(-p, kind="stable")
    right = np.cumsum((y * weight)[order]) / np.cumsum(weight[order])
    last = np.append(p[order][1:] < p[order][:-1], True)  # equal scores are taken together
    good = np.flatnonzero((right >= precision) & last)
    return max(least, float(p[order][good[-1]])) if len(good) else 2.0
