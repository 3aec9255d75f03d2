"""Gradient-boosted trees for a binary label, as flat node arrays.

Trees are grown level by level on binned features with the logistic loss.  A feature may be
constrained to raise (+1) or lower (-1) the score only: splits that would order their children the
other way are not taken, and the midpoint between the children bounds both subtrees.
Training is for a bounded sample held in memory; scoring is vectorised over any number of rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

BINS = 64


@dataclass(frozen=True)
class Forest:
    """All trees' nodes in flat arrays; a leaf leads to itself."""

    base: float
    depth: int
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row of ``x``."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                low = x[rows, self.feature[at]] <= self.threshold[at]
                at = np.where(low, self.left[at], self.right[at])
            out += self.value[at]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def _edges(x: np.ndarray) -> list[np.ndarray]:
    """Thresholds tried for each feature: midpoints of up to BINS quantiles."""
    out = []
    for column in x.T:
        values = np.unique(np.quantile(column, np.linspace(0, 1, BINS), method="nearest"))
        out.append((values[:-1] + values[1:]) / 2)
    return out


def fit(
    x: np.ndarray,
    y: np.ndarray,
    monotone: Sequence[int] = (),
    trees: int = 80,
    depth: int = 4,
    rate: float = 0.15,
    smooth: float = 1.0,
    least_rows: int = 8,
) -> Forest:
    """Fit on ``x`` (rows by features) and labels 0/1.  Without both labels the base rate is all."""
    n, width = x.shape
    direction = np.array([*monotone] + [0] * (width - len(monotone)))
    rate_of_ones = (y.sum() + 0.5) / (n + 1)
    base = float(np.log(rate_of_ones / (1 - rate_of_ones)))
    edges = _edges(x) if n else [np.empty(0)] * width
    binned = np.stack([np.searchsorted(e, c) for e, c in zip(edges, x.T, strict=True)]) if n else None
    nodes: list[list[float]] = []  # feature, threshold, left, right, value
    roots: list[int] = []
    margin = np.full(n, base)
    for _ in range(trees if 0 < y.sum() < n else 0):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        roots.append(len(nodes))
        nodes.append([0, 0.0, len(nodes), len(nodes), 0.0])
        level = [(len(nodes) - 1, np.arange(n), -np.inf, np.inf)]
        for deep in range(depth + 1):
            following = []
            for node, rows, low, high in level:
                value = np.clip(-grad[rows].sum() / (hess[rows].sum() + smooth), low, high)
                split = _best_split(binned, grad, hess, rows, edges, direction, low, high, smooth, least_rows)
                if deep == depth or split is None:
                    nodes[node][4] = rate * value
                    margin[rows] += rate * value
                    continue
                f, cut, a, b = split
                goes = binned[f, rows] <= cut
                kids = len(nodes), len(nodes) + 1
                nodes[node][:4] = [f, edges[f][cut], *kids]
                for kid in kids:
                    nodes.append([0, 0.0, kid, kid, 0.0])
                middle = (a + b) / 2
                bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}.get(
                    int(direction[f]), ((low, high), (low, high))
                )
                following += [(kids[0], rows[goes], *bounds[0]), (kids[1], rows[~goes], *bounds[1])]
            level = following
    table = np.array(nodes) if nodes else np.zeros((0, 5))
    return Forest(
        base, depth, np.array(roots, np.int64), table[:, 0].astype(np.int64), table[:, 1],
        table[:, 2].astype(np.int64), table[:, 3].astype(np.int64), table[:, 4],
    )


def _best_split(binned, grad, hess, rows, edges, direction, low, high, smooth, least_rows):
    """Feature, bin, and the values of both sides of the best allowed split, or None."""
    if len(rows) < 2 * least_rows:
        return None
    width = len(edges)
    at = (binned[:, rows] + np.arange(width)[:, None] * BINS).ravel()
    sums = [
        np.bincount(at, np.tile(w, width), width * BINS).reshape(width, BINS).cumsum(1)
        for w in (grad[rows], hess[rows], np.ones(len(rows)))
    ]
    g, h, count = (s[:, :-1] for s in sums)
    all_g, all_h = grad[rows].sum(), hess[rows].sum()
    a = np.clip(-g / (h + smooth), low, high)
    b = np.clip(-(all_g - g) / (all_h - h + smooth), low, high)
    whole = np.clip(-all_g / (all_h + smooth), low, high)

    def gain(g, h, v):
        return -(g * v + 0.5 * (h + smooth) * v * v)

    won = gain(g, h, a) + gain(all_g - g, all_h - h, b) - gain(all_g, all_h, whole)
    allowed = (count >= least_rows) & (len(rows) - count >= least_rows)
    allowed &= (b - a) * direction[:, None] >= 0
    won = np.where(allowed, won, -np.inf)
    f, cut = np.unravel_index(np.argmax(won), won.shape)
    return (int(f), int(cut), float(a[f, cut]), float(b[f, cut])) if won[f, cut] > 1e-6 else None


@dataclass(frozen=True)
class Isotonic:
    """A rising step function through pooled means, straight between its points."""

    at: np.ndarray
    level: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.interp(x, self.at, self.level) if len(self.at) else x


def fit_isotonic(score: np.ndarray, y: np.ndarray) -> Isotonic:
    """Pool adjacent violators; a level is the mean of its pool, smoothed by half a row either way."""
    if not len(y):
        return Isotonic(np.empty(0), np.empty(0))
    order = np.argsort(score, kind="stable")
    pools: list[list[float]] = []  # mean, rows, first and last score
    for s, label in zip(score[order], y[order].astype(float), strict=True):
        if pools and s == pools[-1][3]:
            mean, rows = pools[-1][0], pools[-1][1]
            pools[-1][:2] = [(mean * rows + label) / (rows + 1), rows + 1]
        else:
            pools.append([label, 1, s, s])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            mean, rows, _, last = pools.pop()
            m, r, first, _ = pools[-1]
            pools[-1] = [(m * r + mean * rows) / (r + rows), r + rows, first, last]
    means = np.array([(m * r + 0.5) / (r + 1) for m, r, _, _ in pools])
    means = np.maximum.accumulate(means)
    at = np.array([x for _, _, first, last in pools for x in (first, last)])
    return Isotonic(at, np.repeat(means, 2))
