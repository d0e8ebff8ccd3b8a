"""Small gradient-boosted trees: fitted on the driver on a bounded table, scored as a SQL expression."""

from __future__ import annotations

import numpy as np


def best_split(x: np.ndarray, g: np.ndarray, h: np.ndarray, ridge: float, leaf: int) -> tuple[float, int, float] | None:
    """Gain, feature and threshold (left: at most) of the best split of rows ``x`` by gradient and curvature."""
    best, total = None, g.sum() ** 2 / (h.sum() + ridge)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, gs, hs = x[order, f], np.cumsum(g[order]), np.cumsum(h[order])
        cut = np.flatnonzero(v[1:] > v[:-1])
        cut = cut[(cut + 1 >= leaf) & (len(v) - cut - 1 >= leaf)]
        if len(cut):
            gain = gs[cut] ** 2 / (hs[cut] + ridge) + (gs[-1] - gs[cut]) ** 2 / (hs[-1] - hs[cut] + ridge) - total
            k = gain.argmax()
            if best is None or gain[k] > best[0] + 1e-12:
                best = float(gain[k]), f, float((v[cut[k]] + v[cut[k] + 1]) / 2)
    return best if best and best[0] > 1e-9 else None


def grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, rate: float, ridge: float = 1.0, leaf: int = 5):
    """A tree: a number, or (feature, threshold, at most, above)."""
    split = best_split(x, g, h, ridge, leaf) if depth else None
    if split is None:
        return float(rate * g.sum() / (h.sum() + ridge))
    _, f, t = split
    low = x[:, f] <= t
    return f, t, *(grow(x[side], g[side], h[side], depth - 1, rate, ridge, leaf) for side in (low, ~low))


def value(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    f, t, low, high = tree
    return np.where(x[:, f] <= t, value(low, x), value(high, x))


def boost(x: np.ndarray, y: np.ndarray, *, trees: int = 40, depth: int = 3, rate: float = 0.3) -> tuple[float, list]:
    """Start margin and trees of logistic boosting."""
    start = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    z, grown = np.full(len(y), start), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        tree = grow(x, y - p, p * (1 - p), depth, rate)
        grown.append(tree)
        z += value(tree, x)
    return start, grown


def margin(model: tuple[float, list], x: np.ndarray) -> np.ndarray:
    return model[0] + sum(value(t, x) for t in model[1])


def calibrated_threshold(scores: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The lowest score at which all that reach it are right in ``precision`` of cases or more; above all scores if there is none."""
    order = np.argsort(-scores, kind="stable")
    right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    last = np.append(scores[order][1:] < scores[order][:-1], True)
    good = np.flatnonzero((right >= precision) & last)
    return float(scores[order][good[-1]]) if len(good) else float(scores.max(initial=0) + 1)


def sql(model: tuple[float, list], names: list[str]) -> str:
    """The margin as SQL over the features' expressions."""

    def node(tree) -> str:
        if not isinstance(tree, tuple):
            return f"{tree!r}D"
        f, t, low, high = tree
        return f"CASE WHEN {names[f]} <= {t!r}D THEN {node(low)} ELSE {node(high)} END"

    return " + ".join([f"{model[0]!r}D", *(f"({node(t)})" for t in model[1])])
