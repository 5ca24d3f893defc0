"""Small decision trees: fitted on the driver to a bounded labelled sample, evaluated as SQL expressions.

A tree is a leaf (a number) or (feature, threshold, low, high): a row goes low where its feature is at most the threshold.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Candidate thresholds of a feature.
BINS = 24


def _thresholds(x: np.ndarray) -> list[np.ndarray]:
    """Midpoints between distinct values, at most BINS - 1 of them by quantile."""
    out = []
    for column in x.T:
        values = np.unique(column)
        middle = (values[1:] + values[:-1]) / 2
        out.append(middle if len(middle) < BINS else np.unique(np.quantile(middle, np.linspace(0, 1, BINS - 1), method="nearest")))
    return out


def _grown(x, target, weight, rows, depth, least, features, cuts, leaf):
    """A tree that splits where the weighted squared error of ``target`` falls most."""
    t, w = target[rows], weight[rows]
    if depth == 0 or len(rows) < 2 * least or np.ptp(t) == 0:
        return leaf(rows)
    total_w, total_t = w.sum(), (w * t).sum()
    best = (1e-9, None, None)
    for f in features():
        for cut in cuts[f]:
            low = x[rows, f] <= cut
            n = int(low.sum())
            if n < least or len(rows) - n < least:
                continue
            w_low, t_low = w[low].sum(), (w[low] * t[low]).sum()
            gain = t_low**2 / w_low + (total_t - t_low) ** 2 / (total_w - w_low) - total_t**2 / total_w
            if gain > best[0]:
                best = (gain, f, float(cut))
    if best[1] is None:
        return leaf(rows)
    low = x[rows, best[1]] <= best[2]
    again = (depth - 1, least, features, cuts, leaf)
    return best[1], best[2], _grown(x, target, weight, rows[low], *again), _grown(x, target, weight, rows[~low], *again)


def value(tree, row) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def values(tree, x: np.ndarray) -> np.ndarray:
    return np.array([value(tree, row) for row in x])


def column(tree, feature) -> Column:
    """The tree as nested CASE; ``feature(i)`` is the column of feature i."""
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    return F.when(feature(tree[0]) <= F.lit(tree[1]), column(tree[2], feature)).otherwise(column(tree[3], feature))


def boosted(x: np.ndarray, y: np.ndarray, trees: int = 20, depth: int = 3, rate: float = 0.3, least: int = 8) -> list:
    """Gradient boosting of the logistic loss; the score is the sum of the trees, leaves being Newton steps."""
    cuts, score, out = _thresholds(x), np.zeros(len(y)), []
    every = np.arange(len(y))
    prior = float(np.clip(y.mean(), 0.01, 0.99))
    out.append(float(np.log(prior / (1 - prior))))
    score += out[0]
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        weight = np.maximum(p * (1 - p), 1e-4)
        target = (y - p) / weight
        leaf = lambda rows, t=target, w=weight: float(rate * np.clip((w[rows] * t[rows]).sum() / (w[rows].sum() + 1.0), -4, 4))
        tree = _grown(x, target, weight, every, depth, least, lambda: range(x.shape[1]), cuts, leaf)
        out.append(tree)
        score += values(tree, x)
    return out


def forest(x: np.ndarray, y: np.ndarray, trees: int = 15, depth: int = 5, least: int = 3, seed: int = 3) -> list:
    """A random forest: bootstrap rows, a random third of the features at each node, leaves hold the share of label 1."""
    rng, cuts, out = np.random.default_rng(seed), _thresholds(x), []
    some = max(2, x.shape[1] // 3)
    one = np.ones(len(y))
    for _ in range(trees):
        rows = rng.integers(0, len(y), len(y))
        chosen = lambda: rng.choice(x.shape[1], some, replace=False)
        out.append(_grown(x, y.astype(float), one, rows, depth, least, chosen, cuts, lambda r: float(y[r].mean())))
    return out


def platt(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic calibration of scores on rows held out from the fit."""
    x, beta = np.stack((score, np.ones(len(score))), axis=1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        beta += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2), x.T @ (y - p) - 1e-2 * (beta - np.array([1.0, 0.0])))
    return float(beta[0]), float(beta[1])


def least_threshold(p: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The lowest probability from which on the held-out rows reach the precision; 0.5 at least."""
    for t in sorted(set(np.round(p, 6).tolist())):
        chosen = p >= t
        if t >= 0.5 and y[chosen].mean() >= precision:
            return float(t)
    return 0.5 if not len(p) else max(0.5, float(p.max()))
