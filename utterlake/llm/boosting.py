"""Gradient-boosted trees for a yes or no, in NumPy: small tables, few columns."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Boosted:
    """Trees of equal depth: in node n of a level, values above ``cuts[n]`` in column ``columns[n]`` go right."""

    start: float
    columns: np.ndarray
    cuts: np.ndarray
    leaves: np.ndarray
    depth: int
    levels: list[tuple[float, float]]

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for columns, cuts, leaves in zip(self.columns, self.cuts, self.leaves, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, columns[at]] > cuts[at])
            out += leaves[at - (2**self.depth - 1)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Calibrated: the share of yes among calibration rows of like raw score, without inversions."""
        points = np.array(self.levels)
        return np.interp(self.raw(x), points[:, 0], points[:, 1])


def isotonic(score: np.ndarray, y: np.ndarray) -> list[tuple[float, float]]:
    """Steps of the best rising fit of ``y`` by ``score`` (pool adjacent violators), smoothed by one row of each kind."""
    order = np.argsort(score, kind="stable")
    pools: list[list[float]] = []
    for s, v in zip(score[order].tolist(), y[order].tolist(), strict=True):
        pools.append([v, 1.0, s, s])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            top = pools.pop()
            pools[-1] = [pools[-1][0] + top[0], pools[-1][1] + top[1], pools[-1][2], top[3]]
    points = []
    for total, n, low, high in pools:
        p = (total + 0.5) / (n + 1.0)
        points += [(low, p), (high, p)]
    return points or [(0.0, 0.5)]


def fit_boosted(x: np.ndarray, y: np.ndarray, calibrate: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3, least: int = 5) -> Boosted:
    """Logistic boosting on rows outside ``calibrate``; those inside give the probabilities."""
    fit = ~calibrate if (~calibrate).any() else np.ones(len(y), bool)
    held = calibrate if calibrate.any() else fit
    xf, yf = x[fit], y[fit].astype(float)
    base = float(np.log((yf.sum() + 0.5) / (len(yf) - yf.sum() + 0.5))) if len(yf) else 0.0
    edges = [np.unique(np.quantile(xf[:, c], np.linspace(0, 1, 33)[1:-1])) if len(xf) else np.zeros(1) for c in range(x.shape[1])]
    score = np.full(len(yf), base)
    columns, cuts, leaves = [], [], []
    inner = 2**depth - 1
    for _ in range(trees if 0 < yf.sum() < len(yf) else 0):
        p = _sigmoid(score)
        grad, hess = yf - p, p * (1 - p)
        column, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        at = np.zeros(len(yf), np.int64)
        for node in range(inner):
            rows = np.flatnonzero(at == node)
            best = 1e-6
            total_g, total_h = grad[rows].sum(), hess[rows].sum()
            for c in range(x.shape[1]) if len(rows) >= 2 * least else ():
                place = np.searchsorted(edges[c], xf[rows, c], "left")
                g = np.cumsum(np.bincount(place, grad[rows], len(edges[c]) + 1))[:-1]
                h = np.cumsum(np.bincount(place, hess[rows], len(edges[c]) + 1))[:-1]
                n = np.cumsum(np.bincount(place, minlength=len(edges[c]) + 1))[:-1]
                gain = g**2 / (h + 1) + (total_g - g) ** 2 / (total_h - h + 1) - total_g**2 / (total_h + 1)
                gain[(n < least) | (len(rows) - n < least)] = 0
                if len(gain) and gain.max() > best:
                    best = float(gain.max())
                    column[node], cut[node] = c, edges[c][int(gain.argmax())]
            at[rows] = 2 * node + 1 + (xf[rows, column[node]] > cut[node])
        leaf = at - inner
        value = np.bincount(leaf, grad, inner + 1) / (np.bincount(leaf, hess, inner + 1) + 1.0)
        score += rate * value[leaf]
        columns.append(column)
        cuts.append(cut)
        leaves.append(rate * value)
    shape = (len(columns), inner)
    model = Boosted(base, np.array(columns, np.int64).reshape(shape), np.array(cuts).reshape(shape), np.array(leaves).reshape(len(columns), inner + 1), depth, [])
    model.levels = isotonic(model.raw(x[held]), y[held].astype(float)) if held.any() else [(0.0, 0.5)]
    return model
