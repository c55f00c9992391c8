"""Toxicity: gradient-boosted trees over dense features of whole texts, with isotonic calibration.

The lexicon is a short seed list plus terms (words and their beginnings) that the labelled rows mark as toxic. A row
that is learned from never votes for its own terms: its features come from counts without its own label.

Nulls and empty texts have zero features and get the score the trees give to those; rows without a label are scored
but not learned from; several labels of one id count as their largest; repeated documents are scored alike; with no
labels at all every score is the share 0. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import crc_remainder, fresh, labelled_sample, stored, whole_text
from corpusmill.llm.learning import Isotonic, Trees, fit_isotonic, fit_trees

# Common insults, and second-person pronouns of English, German, French and Spanish.
SEED_INSULTS = ["bastard", "clown", "dumb", "fool", "garbage", "idiot", "imbecile", "jerk", "loser", "moron", "pathetic", "scum", "stupid", "trash", "ugly", "worthless"]
SECOND_PERSON = ["you", "your", "yours", "du", "dich", "dir", "dein", "ihr", "euch", "tu", "toi", "te", "ton", "vous", "votre", "tú", "ti", "tus", "usted", "ustedes", "vosotros"]
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
EDGES = ".,;:!?\"'()[]{}<>|*#%&-_…«»“”¡¿"

FEATURES = ["lexicon_density", "lexicon_most", "lexicon_hits", "seed_density", "second_person_nearness", "capitals", "exclamations", "punctuation", "obfuscated", "disguised_hits", "log_words"]
BEGINNINGS = range(3, 8)
NEAR = 12  # words around a term in which a second-person pronoun counts


def terms_of(word: str) -> tuple[str, ...]:
    """The bare word and its beginnings; a star marks a beginning."""
    bare = word.strip(EDGES)
    return (bare, *(f"{bare[:n]}*" for n in BEGINNINGS if n < len(bare))) if bare else ()


class WordCodes(dict):
    """Word to code, worked out once for each distinct word: 0 nothing, above 0 the weight of its strongest term
    (plus 100 if only visible without its disguise), -1 second person, -2 disguised but harmless."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon, self.you = lexicon, set(SECOND_PERSON)

    def __missing__(self, word: str) -> float:
        bare = word.strip(EDGES)
        code = max((self.lexicon.get(t, 0.0) for t in terms_of(word)), default=0.0)
        if not code and bare in self.you:
            code = -1.0
        mixed = any(c.isalpha() for c in bare) and not bare.isalpha() and "-" not in bare and "'" not in bare
        if not code and mixed:
            plain = "".join(c for c in bare.translate(LEET) if c.isalpha())
            shown = self.lexicon.get(plain, 0.0)
            code = 100.0 + shown if shown else -2.0
        if len(self) < 400_000:
            self[word] = code
        return code


def features(text: str, codes: WordCodes, seeds: frozenset[str]) -> list[float]:
    words = text.lower().split()
    code = np.array([codes[w] for w in words], dtype=np.float64)
    n = max(len(words), 1)
    hit = np.flatnonzero(code > 0)
    weight = np.where(code > 50, code - 100, code)
    near = 0.0
    you = np.flatnonzero(code == -1)
    if len(hit) and len(you):
        at = np.searchsorted(you, hit)
        gap = np.minimum(np.abs(hit - you[np.maximum(at - 1, 0)]), np.abs(you[np.minimum(at, len(you) - 1)] - hit))
        near = float(np.maximum(0, 1 - gap / NEAR).max())
    letters = max(sum(map(len, words)), 1)
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    capitals = int(((raw >= 65) & (raw <= 90)).sum())
    marks = int((((raw >= 33) & (raw <= 47)) | ((raw >= 58) & (raw <= 64)) | ((raw >= 91) & (raw <= 96)) | ((raw >= 123) & (raw <= 126))).sum())
    return [
        float(weight[hit].sum()) / n,
        float(weight[hit].max()) if len(hit) else 0.0,
        math.log1p(len(hit)),
        sum(words[i].strip(EDGES) in seeds for i in hit) / n,
        near,
        capitals / letters,
        int((raw == 33).sum()) / letters,
        marks / letters,
        float(((code == -2) | (code > 50)).sum()) / n,
        float((code > 50).sum()),
        math.log1p(len(words)),
    ]


@dataclass
class Model:
    lexicon: dict[str, float]
    trees: Trees
    calibration: Isotonic

    def score(self, table: np.ndarray) -> np.ndarray:
        return self.calibration.apply(self.trees.margin(table))


def _weight(toxic: int, clean: int, all_toxic: int, all_clean: int) -> float:
    """Log odds of a term, less twice its standard error; below the cut a term is not in the lexicon."""
    if toxic < 3:
        return 0.0
    odds = math.log((toxic + 0.5) / (all_toxic + 1)) - math.log((clean + 0.5) / (all_clean + 1))
    least = odds - 2 * math.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))
    return odds if least >= 1.5 else 0.0


def count_terms(sample: DataFrame) -> DataFrame:
    """In how many toxic and clean sample rows each term occurs; every batch adds up its own rows before the shuffle."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict[str, tuple[str, ...]] = {}
        for batch in batches:
            seen = Counter(), Counter()
            for text, y in zip(batch["text"], batch["y"]):
                terms: set[str] = set()
                for word in set(text.lower().split()):
                    got = cache.get(word)
                    if got is None:
                        got = terms_of(word)
                        if len(cache) < 200_000:
                            cache[word] = got
                    terms.update(got)
                seen[int(y > 0)].update(terms)
            for i in (i for i in (0, 1) if seen[i]):
                names = list(seen[i])
                yield pd.DataFrame({"term": names, "toxic": [seen[i][t] * i for t in names], "clean": [seen[i][t] * (1 - i) for t in names]})

    counted = sample.select("text", "y").mapInPandas(count, "term string, toxic long, clean long")
    return counted.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, max_rows: int = 30_000, max_terms: int = 20_000) -> Model:
    """Learn lexicon, trees and calibration from at most about ``max_rows`` labelled rows outside the held-out fold."""
    sample = stored(labelled_sample(docs, labels, "toxic", folds, max_rows), "toxic-sample")
    sizes = {int(r["y"] > 0): r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    ratio = (F.col("toxic") + 0.5) / (F.col("clean") + 0.5)
    # a cut below any useful weight first, then the strongest terms: what reaches the driver has at most max_terms rows
    rows = count_terms(sample).where((F.col("toxic") >= 3) & (ratio > 4 * (toxic + 1) / (clean + 1))).orderBy(F.desc(ratio), "term").limit(max_terms).collect()
    lexicons: list[dict[str, float]] = [{}, {}, {}]  # for clean rows learned from, for toxic ones, for all others
    for r in rows:
        for i, (t, c) in enumerate(((r["toxic"], max(r["clean"] - 1, 0)), (r["toxic"] - 1, r["clean"]), (r["toxic"], r["clean"]))):
            if w := _weight(t, c, toxic, clean):
                lexicons[i][r["term"]] = w
    for lexicon in lexicons:
        for word in SEED_INSULTS:
            lexicon.setdefault(word, 1.5)
    seeds = frozenset(SEED_INSULTS)

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes = [WordCodes(x) for x in lexicons[:2]]
        for batch in batches:
            own = [features(t, codes[int(y > 0)], seeds) for t, y in zip(batch["text"], batch["y"])]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "y": batch["y"], "x": own})

    rows = sample.mapInPandas(measured, "doc_id long, y int, x array<double>").collect()
    rows = sorted(rows, key=lambda r: (r["doc_id"], r["y"]))
    table = np.array([r["x"] for r in rows], dtype=np.float64).reshape(len(rows), len(FEATURES))
    y = np.array([float(r["y"] > 0) for r in rows])
    half = np.arange(len(y)) % 2 == 0
    crossed = np.zeros(len(y))
    for part in (half, ~half):
        if part.any():
            crossed[~part] = fit_trees(table[part], y[part]).margin(table[~part])
    return Model(lexicons[2], fit_trees(table, y), fit_isotonic(crossed, y))


def score(docs: DataFrame, model: Model, out: str = "score", text: Column | None = None) -> DataFrame:
    """All rows and columns of ``docs`` plus the score, in one pass without a shuffle."""
    seeds = frozenset(SEED_INSULTS)

    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codes = WordCodes(model.lexicon)
        for texts in batches:
            table = np.array([features(t, codes, seeds) for t in texts], dtype=np.float64).reshape(len(texts), len(FEATURES))
            yield pd.Series(model.score(table))

    udf = F.pandas_udf(scored, "double")
    return docs.withColumn(out, udf(whole_text() if text is None else text))


def judged(docs: DataFrame, model: Model, folds: int = 5, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    out = score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (crc_remainder("doc_id", folds) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows that score below the threshold, columns unchanged."""
    mark = fresh(docs, "score")
    return score(docs, model, mark).where(F.col(mark) < threshold).drop(mark)
