"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees are boosted feature by feature in a cycle, so each feature ends as a lookup table over its bins; then the
pairs that explain most of what is left get tables of their own. A score is the sum of table entries.

Null texts count as empty and get the score of an empty text; rows without a label are scored but not learned from;
several labels of one id count as their largest; with no labels at all every score is 0. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import crc_remainder, labelled_sample, stored, whole_text
from corpusmill.llm.learning import bin_edges, sigmoid, to_bins

# Very common words of English, German, French and Spanish.
COMMON_WORDS = frozenset("the of and to in a is that it for on was with as be by this from or at der die das und ist von den mit zu ein eine nicht des im auf dem le la les de et un une est que dans pour du en au sur el los las y por con para del se lo no su".split())
FEATURES = [
    "log_words", "word_length", "capitals", "digits", "symbols", "exclamations", "bars", "marked_words", "distinct_words", "top_word",
    "repeated_next", "repeated_lines", "line_words", "short_lines", "common_words", "sentence_ends", "longest_word", "other_letters",
]


def features(text: str) -> list[float]:
    words = text.split()
    n, counts = max(len(words), 1), Counter(words)
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    chars = max(int((code > 32).sum()), 1)
    share = lambda low, high: int(((code >= low) & (code <= high)).sum()) / chars
    lower, upper, digit = share(97, 122), share(65, 90), share(48, 57)
    lines = [x for x in text.split("\n") if x.strip()]
    per_line = [x.count(" ") + 1 for x in lines]
    marked = sum(1 for w in words if len(w) > 2 and not w[-1].isalnum() and not w[-2].isalnum())
    return [
        math.log1p(len(words)),
        chars / n,
        upper,
        digit,
        share(33, 126) - lower - upper - digit,
        int((code == 33).sum()) / n,
        int((code == 124).sum()) / n,
        marked / n,
        len(counts) / n,
        max(counts.values(), default=0) / n,
        sum(a == b for a, b in zip(words, words[1:])) / n,
        1 - len(set(lines)) / max(len(lines), 1),
        math.log1p(sum(per_line) / max(len(lines), 1)),
        sum(x < 4 for x in per_line) / max(len(lines), 1),
        sum(counts[w] for w in COMMON_WORDS) / n,
        sum(1 for w in words if w[-1] in ".?!") / n,
        math.log1p(max(map(len, counts), default=0)),
        int((code > 127).sum()) / chars,
    ]


@dataclass
class Gam:
    base: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, table: np.ndarray) -> np.ndarray:
        if not self.edges:
            return np.full(len(table), float(sigmoid(np.array([self.base]))[0]) if self.base > -40 else 0.0)
        bins = to_bins(table, self.edges)
        margin = np.full(len(table), self.base)
        for j, entries in enumerate(self.tables):
            margin += entries[bins[:, j]]
        for (a, b), entries in zip(self.pairs, self.pair_tables):
            margin += entries[bins[:, a], bins[:, b]]
        return sigmoid(margin)


def _cuts(g: np.ndarray, h: np.ndarray, depth: int, ridge: float) -> np.ndarray:
    """Values of a shallow tree over the bins of one feature."""
    if depth and len(g) > 1:
        left_g, left_h = g.cumsum()[:-1], h.cumsum()[:-1]
        gain = left_g**2 / (left_h + ridge) + (g.sum() - left_g) ** 2 / (h.sum() - left_h + ridge)
        at = int(gain.argmax()) + 1
        if gain[at - 1] > g.sum() ** 2 / (h.sum() + ridge) + 1e-9:
            return np.append(_cuts(g[:at], h[:at], depth - 1, ridge), _cuts(g[at:], h[at:], depth - 1, ridge))
    return np.full(len(g), g.sum() / (h.sum() + ridge))


def _quadrants(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """The best cut of both features of a pair at once: its gain, and the four values over the bins."""
    G, H = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    total = lambda C: (C[:-1, :-1], C[:-1, -1:] - C[:-1, :-1], C[-1:, :-1] - C[:-1, :-1], C[-1, -1] - C[:-1, -1:] - C[-1:, :-1] + C[:-1, :-1])
    if g.shape[0] < 2 or g.shape[1] < 2:
        return 0.0, np.zeros(g.shape)
    parts = list(zip(total(G), total(H)))
    gain = sum(x**2 / (y + ridge) for x, y in parts) - G[-1, -1] ** 2 / (H[-1, -1] + ridge)
    a, b = np.unravel_index(int(gain.argmax()), gain.shape)
    values = [x[a, b] / (y[a, b] + ridge) for x, y in parts]
    out = np.empty(g.shape)
    out[: a + 1, : b + 1], out[: a + 1, b + 1 :], out[a + 1 :, : b + 1], out[a + 1 :, b + 1 :] = values
    return float(gain[a, b]), out


def fit_gam(table: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 120, pair_rounds: int = 40, most_pairs: int = 8, rate: float = 0.1, depth: int = 2, ridge: float = 2.0) -> Gam:
    share = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(share / (1 - share)))
    if not len(y) or y.min() == y.max():
        return Gam(base if len(y) else -40.0)
    # the least value of a column is an edge as well, so "none at all" is a bin of its own
    edges = [np.unique(np.append(bin_edges(table[:, j], bins), table[:, j].min())) for j in range(table.shape[1])]
    code = to_bins(table, edges)
    tables = [np.zeros(len(e) + 1) for e in edges]
    margin = np.full(len(y), base)
    for _ in range(rounds):
        for j in range(table.shape[1]):
            p = sigmoid(margin)
            step = rate * _cuts(np.bincount(code[:, j], y - p, len(tables[j])), np.bincount(code[:, j], p * (1 - p), len(tables[j])), depth, ridge)
            tables[j] += step
            margin += step[code[:, j]]

    def grids(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        p, shape = sigmoid(margin), (len(tables[a]), len(tables[b]))
        key = code[:, a] * shape[1] + code[:, b]
        return np.bincount(key, y - p, shape[0] * shape[1]).reshape(shape), np.bincount(key, p * (1 - p), shape[0] * shape[1]).reshape(shape)

    worth = {pair: _quadrants(*grids(*pair), ridge)[0] for pair in combinations(range(table.shape[1]), 2)}
    pairs = sorted(worth, key=lambda p: (-worth[p], p))[:most_pairs]
    pair_tables = [np.zeros((len(tables[a]), len(tables[b]))) for a, b in pairs]
    for _ in range(pair_rounds):
        for (a, b), entries in zip(pairs, pair_tables):
            step = rate * _quadrants(*grids(a, b), ridge)[1]
            entries += step
            margin += step[code[:, a], code[:, b]]
    return Gam(base, edges, tables, pairs, pair_tables)


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, max_rows: int = 30_000) -> Gam:
    """Learn from at most about ``max_rows`` labelled rows outside the held-out fold; only their features reach the driver."""

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "y": batch["y"], "x": [features(t) for t in batch["text"]]})

    sample = labelled_sample(docs, labels, "quality", folds, max_rows)
    rows = stored(sample.mapInPandas(measured, "doc_id long, y int, x array<double>"), "quality-sample").collect()
    rows = sorted(rows, key=lambda r: (r["doc_id"], r["y"], r["x"]))
    return fit_gam(np.array([r["x"] for r in rows], dtype=np.float64).reshape(len(rows), len(FEATURES)), np.array([float(r["y"] > 0) for r in rows]))


def judged(docs: DataFrame, model: Gam, folds: int = 5, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row, in one pass without a shuffle."""

    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.score(np.array([features(t) for t in texts], dtype=np.float64).reshape(len(texts), len(FEATURES))))

    udf = F.pandas_udf(scored, "double")
    rows = docs.select("doc_id", (crc_remainder("doc_id", folds) == 0).alias("held_out"), udf(whole_text()).alias("score"))
    return rows.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
