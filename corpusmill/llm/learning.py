"""Small numpy learners: boosted trees, isotonic regression, quantile bins. They see only bounded samples."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def bin_edges(values: np.ndarray, bins: int) -> np.ndarray:
    """Inner edges at the quantiles of the distinct-enough values; ties never straddle an edge."""
    if not len(values):
        return np.zeros(0)
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def to_bins(table: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    out = np.empty(table.shape, dtype=np.int64)
    for j, e in enumerate(edges):
        out[:, j] = np.searchsorted(e, table[:, j], side="left")
    return out


@dataclass
class Trees:
    """Complete binary trees of one depth. Tree t asks at its node k: is feature > value?"""

    base: float
    depth: int
    feature: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), dtype=np.int64))
    value: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    leaf: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    def margin(self, table: np.ndarray) -> np.ndarray:
        out = np.full(len(table), self.base)
        row = np.arange(len(table))
        for f, v, leaf in zip(self.feature, self.value, self.leaf):
            at = np.zeros(len(table), dtype=np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (table[row, f[at]] > v[at])
            out += leaf[at - len(f)]
        return out


def fit_trees(table: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 1.0) -> Trees:
    """Logistic boosting with second-order leaf values over quantile bins."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(share / (1 - share)))
    if len(y) == 0 or y.min() == y.max():
        return Trees(base if len(y) else -40.0, depth)
    edges = [np.append(bin_edges(table[:, j], bins), np.inf) for j in range(table.shape[1])]
    # zero-heavy columns: one edge just at their most common value keeps "any at all" a possible split
    edges = [np.unique(np.append(e, table[:, j].min())) for j, e in enumerate(edges)]
    code = to_bins(table, edges)
    width = max(len(e) for e in edges) + 1
    inner = 2**depth - 1
    margin = np.full(len(y), base)
    features, values, leaves = [], [], []
    for _ in range(rounds):
        p = sigmoid(margin)
        grad, hess = y - p, p * (1 - p)
        node = np.zeros(len(y), dtype=np.int64)
        f_of, v_of = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            gain = np.full((count, table.shape[1], width), -np.inf)
            for j in range(table.shape[1]):
                key = (node - first) * width + code[:, j]
                g = np.bincount(key, grad, count * width).reshape(count, width).cumsum(1)
                h = np.bincount(key, hess, count * width).reshape(count, width).cumsum(1)
                right_g, right_h = g[:, -1:] - g, h[:, -1:] - h
                worth = g**2 / (h + ridge) + right_g**2 / (right_h + ridge) - g[:, -1:] ** 2 / (h[:, -1:] + ridge)
                gain[:, j] = np.where((h > 1e-3) & (right_h > 1e-3), worth, -np.inf)
            for k in range(count):
                best = int(gain[k].argmax())
                j, b = divmod(best, width)
                if gain[k, j, b] > 1e-6 and b < len(edges[j]):
                    f_of[first + k], v_of[first + k] = j, edges[j][b]
            node = 2 * node + 1 + (table[np.arange(len(y)), f_of[node]] > v_of[node])
        at = node - inner
        g, h = np.bincount(at, grad, inner + 1), np.bincount(at, hess, inner + 1)
        leaf = rate * g / (h + ridge)
        margin += leaf[at]
        features.append(f_of)
        values.append(v_of)
        leaves.append(leaf)
    return Trees(base, depth, np.array(features), np.array(values), np.array(leaves))


@dataclass
class Isotonic:
    """A rising step function with straight lines between the steps."""

    x: np.ndarray
    y: np.ndarray

    def apply(self, margin: np.ndarray) -> np.ndarray:
        return np.interp(margin, self.x, self.y) if len(self.x) else np.zeros(len(margin))


def fit_isotonic(x: np.ndarray, y: np.ndarray) -> Isotonic:
    """Pool adjacent violators over equal-margin groups; one pseudo-row at each end keeps the values off 0 and 1."""
    if not len(x):
        return Isotonic(np.zeros(0), np.zeros(0))
    at, group = np.unique(x, return_inverse=True)
    weight, total = np.bincount(group).astype(float), np.bincount(group, y)
    weight[0] += 1  # a clean row at the low end, a marked one at the high end
    weight[-1] += 1
    total[-1] += 1
    blocks: list[list[float]] = []  # mean, weight, first, last
    for i in range(len(at)):
        blocks.append([total[i] / weight[i], weight[i], i, i])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m, w, _, last = blocks.pop()
            p = blocks[-1]
            blocks[-1] = [(p[0] * p[1] + m * w) / (p[1] + w), p[1] + w, p[2], last]
    xs = np.array([at[int(i)] for b in blocks for i in (b[2], b[3])])
    ys = np.array([b[0] for b in blocks for _ in (0, 1)])
    keep = np.append(True, (np.diff(xs) > 0) | (np.diff(ys) > 0))
    return Isotonic(xs[keep], ys[keep])
