"""Language-model scores: a gated recurrent network with class-factored softmax, beside smoothed unigram scores.

Words and counts come from all training documents. The most frequent words are the network's own, in classes of similar
frequency; every other word belongs to one of the suffix classes, and its share of the class follows its count. The
network is trained by truncated backpropagation over all training documents: a hash deals them into shares of bounded
size, whose number grows with the input, and the shares into a few rounds an epoch. In a round each share starts from the
same weights on its own, and the mean of what they arrive at, weighted by tokens, is where the next round starts. Scoring
runs over whole documents: texts are laid end to end in lanes, the state is carried from window to window and reset where
a document starts.

Null and empty texts consist of the end token only; repeated rows are scored alike; with no training documents every
token has the same probability. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import crc_remainder, most_frequent, stored, whole_text

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SMOOTH = 0.1
SUFFIX_CLASSES = 24
CLASS_WORDS = 40
WINDOW = 32
ROUNDS = 4
# tasks of a round at most, and rows of summed weights that reach the driver; a task takes several shares in turn
ROUND_TASKS = 512
SUMS = 16
# numbers that Adam takes at once
ADAM_BLOCK = 1 << 14
WEIGHTS = ["gate", "turn", "candidate", "class_weight", "class_bias", "word_weight", "word_bias"]
LN10 = math.log(10)


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split()


def suffix_class(word: bytes) -> int:
    """Class of a word by its last two characters."""
    return zlib.crc32(word.decode("utf-8", "surrogatepass")[-2:].encode("utf-8", "surrogatepass")) % SUFFIX_CLASSES


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


@dataclass
class Network:
    """Gated recurrent units. Inputs and targets are symbols: own words, then suffix classes, then the end.

    Class c of the own words holds the symbols from first[c] to first[c + 1]; suffix classes and the end are classes
    of one symbol.
    """

    own: int
    first: np.ndarray
    gate: np.ndarray  # symbols x 3h: what a symbol adds to update gate, reset gate and candidate
    turn: np.ndarray  # h x 2h: what the state adds to the two gates
    candidate: np.ndarray  # h x h
    class_weight: np.ndarray  # h x classes
    class_bias: np.ndarray
    word_weight: np.ndarray  # h x own words
    word_bias: np.ndarray

    @property
    def class_of(self) -> np.ndarray:
        own = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        return np.append(own, len(self.first) - 1 + np.arange(SUFFIX_CLASSES + 1)).astype(np.int64)

    @property
    def end(self) -> int:
        return self.own + SUFFIX_CLASSES

    def step(self, state: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, ...]:
        h = state.shape[1]
        given = self.gate[symbols]
        gates = sigmoid(given[:, : 2 * h] + state @ self.turn)
        z, r = gates[:, :h], gates[:, h:]
        n = 2 * sigmoid(2 * (given[:, 2 * h :] + (r * state) @ self.candidate)) - 1
        return state + z * (n - state), z, r, n

    def window(self, state: np.ndarray, sources: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, ...]:
        """``step`` over the rows of ``sources`` (steps x lanes), state by columns (h x lanes).

        Before, both gates, candidate and after of every step, each steps x h x lanes.
        """
        (w, lanes), h = sources.shape, state.shape[0]
        # 1 / (1 + exp(x)) needs the signs turned; the candidate is 2 / (1 + exp(2x)) - 1
        given = np.ascontiguousarray(self.gate[sources.ravel()].reshape(w, lanes, 3 * h).transpose(0, 2, 1))
        given *= np.repeat(np.array([-1, -2], dtype=given.dtype), [2 * h, h])[:, None]
        turn, candidate = np.ascontiguousarray(-self.turn.T), np.ascontiguousarray(-2 * self.candidate.T)
        before, after, new, gates = (np.empty((w, n * h, lanes), dtype=state.dtype) for n in (1, 1, 1, 2))
        reset = np.empty_like(state)
        for s in range(w):
            b, a, n, g = before[s], after[s], new[s], gates[s]
            np.multiply(state, keep[s], out=b)
            np.matmul(turn, b, out=g)
            g += given[s, : 2 * h]
            np.exp(g, out=g)
            g += 1
            np.reciprocal(g, out=g)
            np.multiply(g[h:], b, out=reset)
            np.matmul(candidate, reset, out=n)
            n += given[s, 2 * h :]
            np.exp(n, out=n)
            n += 1
            np.divide(2, n, out=n)
            n -= 1
            np.subtract(n, b, out=a)
            a *= g[:h]
            a += b
            state = a
        return before, gates, new, after

    def loss(self, states: np.ndarray, targets: np.ndarray, class_of: np.ndarray, learn: bool = False):
        """ln P of each target after each state; with ``learn`` also the gradients of -sum ln P."""
        found = self.column_loss(np.ascontiguousarray(states.T), targets, class_of, learn)
        return (found[0], [found[1][0].T, *found[1][1:]]) if learn else found

    def column_loss(self, states: np.ndarray, targets: np.ndarray, class_of: np.ndarray, learn: bool = False):
        """``loss`` with states and their gradient by columns (h x targets).

        Targets stand class after class, the own words first; their logits share one table, so only the products run class
        by class. A row of ones under the states carries the biases.
        """
        classes, groups, h = class_of[targets], len(self.first) - 1, len(states)
        order = np.argsort(classes.astype(np.uint16 if groups + SUFFIX_CLASSES < 2**16 else np.int64), kind="stable")
        classes, every = classes[order], np.arange(len(order))
        seen = np.empty((h + 1, len(order)), dtype=states.dtype)
        np.take(states, order, axis=1, out=seen[:h], mode="clip")
        seen[h] = 1
        weight = np.concatenate([self.class_weight, self.class_bias[None]])
        power = weight.T @ seen
        gain = _log_shares(power, classes, every, learn)
        if learn:
            back, class_grad = self.class_weight @ power, seen @ power.T
        bounds = np.searchsorted(classes, np.arange(groups + 1))
        own, spans = bounds[-1], [(self.first[c], self.first[c + 1], bounds[c], bounds[c + 1]) for c in np.flatnonzero(np.diff(bounds))]
        weight, word_grad = np.concatenate([self.word_weight, self.word_bias[None]]), np.zeros((h + 1, self.own), dtype=states.dtype)
        if spans:
            widths = np.diff(self.first)
            power = np.full((widths.max(), own), -np.inf, dtype=seen.dtype) if widths.min() < widths.max() else np.empty((widths[0], own), dtype=seen.dtype)
            for a, b, start, end in spans:
                np.matmul(weight[:, a:b].T, seen[:, start:end], out=power[: b - a, start:end])
            gain[:own] += _log_shares(power, targets[order[:own]] - self.first[classes[:own]], every[:own], learn)
            if learn:
                through = np.empty((h, own), dtype=states.dtype)
                for a, b, start, end in spans:
                    d = power[: b - a, start:end]
                    np.matmul(self.word_weight[:, a:b], d, out=through[:, start:end])
                    np.matmul(seen[:, start:end], d.T, out=word_grad[:, a:b])
                back[:, :own] += through
        place = np.empty_like(order)
        place[order] = every
        out = gain[place]
        return (out, [back.take(place, axis=1), class_grad[:h], class_grad[h], word_grad[:h], word_grad[h]]) if learn else out


def _log_shares(logits: np.ndarray, at: np.ndarray, every: np.ndarray, learn: bool) -> np.ndarray:
    """By column ln of the softmax at the row ``at``; with ``learn`` the gradient of -ln takes the place of the logits."""
    logits -= logits.max(0)
    out = logits[at, every]
    np.exp(logits, out=logits)
    total = logits.sum(0)
    if learn:
        logits *= 1 / total
        logits[at, every] -= 1
    return out - np.log(total)


class Lanes:
    """Documents laid end to end in lanes of about equal length; the end symbol stands before and after each."""

    def __init__(self, docs: Sequence[np.ndarray], end: int, most: int):
        sizes = [len(d) for d in docs]
        lanes = int(min(most, max(1, sum(sizes) // max(max(sizes, default=1), 1))))
        heap = [(0, i) for i in range(lanes)]
        placed: list[list[int]] = [[] for _ in range(lanes)]
        for i in sorted(range(len(docs)), key=lambda i: (-sizes[i], i)):
            load, lane = heapq.heappop(heap)
            placed[lane].append(i)
            heapq.heappush(heap, (load + sizes[i], lane))
        length = max((load for load, _ in heap), default=0)
        self.target = np.full((length, lanes), end, dtype=np.int32)
        self.source = np.full((length, lanes), end, dtype=np.int32)
        self.doc = np.full((length, lanes), -1, dtype=np.int32)
        self.keep = np.ones((length, lanes), dtype=np.float32)
        for lane, members in enumerate(placed):
            t = 0
            for i in members:
                n = sizes[i]
                self.target[t : t + n, lane] = docs[i]
                self.source[t + 1 : t + n, lane] = docs[i][:-1]
                self.doc[t : t + n, lane] = i
                self.keep[t, lane] = 0
                t += n


def start_network(counts: np.ndarray, own: int, hidden: int, seed: int) -> Network:
    """``counts`` of all symbols give the first biases, so learning starts from the unigram shares."""
    rng = np.random.default_rng(seed)
    first = np.append(np.arange(0, own, CLASS_WORDS), own).astype(np.int64) if own else np.zeros(1, dtype=np.int64)
    normal = lambda *shape: (rng.standard_normal(shape) * 0.15).astype(np.float32)
    groups = len(first) - 1
    share = np.log(np.append([counts[a:b].sum() for a, b in zip(first[:-1], first[1:])], counts[own:]) + 1.0)
    return Network(own, first, normal(own + SUFFIX_CLASSES + 1, 3 * hidden), normal(hidden, 2 * hidden), normal(hidden, hidden), normal(hidden, groups + SUFFIX_CLASSES + 1), share.astype(np.float32), normal(hidden, own), np.log(counts[:own] + 1.0).astype(np.float32))


def train(network: Network, docs: Sequence[np.ndarray], epochs: int, lanes: int = 96, rate: float = 0.01, part: tuple[int, int] = (0, 1)) -> Network:
    """The network after Adam over windows of WINDOW steps; gradients stop at a window's start, the state does not.

    ``part``: this call's number among all calls that the falling rate is spread over, and how many they are.
    """
    if not docs:
        return network
    laid, class_of, h, t = Lanes(docs, network.end, lanes), network.class_of, network.turn.shape[0], 0
    # all weights, their gradients and moments lie end to end, so Adam takes them in blocks that stay in the cache
    weights = np.concatenate([getattr(network, n).ravel() for n in WEIGHTS]).astype(np.float32)
    slopes, mean, square = (np.zeros_like(weights) for _ in range(3))
    parts, begin = {}, 0
    for n in WEIGHTS:
        old = getattr(network, n)
        parts[n] = slice(begin, begin + old.size), old.shape
        begin += old.size
    network = replace(network, **{n: weights[at].reshape(shape) for n, (at, shape) in parts.items()})
    total = {n: slopes[at].reshape(shape) for n, (at, shape) in parts.items()}
    blocks = [slice(i, i + ADAM_BLOCK) for i in range(0, len(weights), ADAM_BLOCK)]
    kind = np.uint16 if network.end < 2**16 else np.int32  # short numbers are sorted by digits
    steps = epochs * -(-len(laid.target) // WINDOW)
    for _ in range(epochs):
        state = np.zeros((h, laid.target.shape[1]), dtype=np.float32)
        for begin in range(0, len(laid.target), WINDOW):
            span = slice(begin, begin + WINDOW)
            sources, keep = laid.source[span], laid.keep[span]
            before, gates, new, after = network.window(state, sources, keep)
            state = after[-1]
            valid = np.flatnonzero(laid.doc[span].ravel() >= 0)
            if not len(valid):
                continue
            states, targets = _columns(after), laid.target[span].ravel()
            full = len(valid) == states.shape[1]
            _, grad = network.column_loss(states if full else states[:, valid], targets if full else targets[valid], class_of, learn=True)
            back = np.zeros_like(states)
            back[:, slice(None) if full else valid] = grad[0]
            for n, g in zip(WEIGHTS[3:], grad[1:]):
                total[n][...] = g
            back = np.ascontiguousarray(back.reshape(h, len(sources), -1).transpose(1, 0, 2))
            z, r = gates[:, :h], gates[:, h:]
            held = 1 - z
            to_new, turned = z * (1 - new * new), r * before
            to_z, to_r = (new - before) * z * held, turned * (1 - r)
            change, flow = np.empty((len(sources), 3 * h, state.shape[1]), dtype=np.float32), np.zeros_like(state)
            for s in range(len(sources) - 1, -1, -1):
                d, c = back[s], change[s]
                d += flow
                np.multiply(d, to_new[s], out=c[2 * h :])
                through = network.candidate @ c[2 * h :]
                np.multiply(d, to_z[s], out=c[:h])
                np.multiply(through, to_r[s], out=c[h : 2 * h])
                np.matmul(network.turn, c[: 2 * h], out=flow)
                through *= r[s]
                flow += through
                d *= held[s]
                flow += d
                flow *= keep[s]
            change = _columns(change)
            np.matmul(_columns(before), change[: 2 * h].T, out=total["turn"])
            np.matmul(_columns(turned), change[2 * h :].T, out=total["candidate"])
            order = np.argsort(sources.ravel().astype(kind), kind="stable")
            symbols = sources.ravel()[order]
            starts = np.flatnonzero(np.append(True, symbols[1:] != symbols[:-1]))
            total["gate"][...] = 0
            total["gate"][symbols[starts]] = np.add.reduceat(change.take(order, axis=1), starts, axis=1).T
            t += 1
            pace = rate * (1 - 0.9 * (part[0] + t / steps) / part[1])
            for at in blocks:
                _adam(weights[at], slopes[at], mean[at], square[at], 50 / len(valid), pace, t)
    return network


def _columns(steps: np.ndarray) -> np.ndarray:
    """steps x n x lanes as n x (steps x lanes)."""
    return np.ascontiguousarray(steps.transpose(1, 0, 2)).reshape(steps.shape[1], -1)


def _adam(weights: np.ndarray, slopes: np.ndarray, mean: np.ndarray, square: np.ndarray, scale: float, pace: float, t: int) -> None:
    """One step of Adam in place; ``slopes`` are used up."""
    slopes *= scale
    change = slopes - mean
    change *= 0.1
    mean += change
    slopes *= slopes
    slopes -= square
    slopes *= 0.01
    square += slopes
    np.multiply(square, 1 / (1 - 0.99**t), out=slopes)
    np.sqrt(slopes, out=slopes)
    slopes += 1e-6
    np.multiply(mean, pace / (1 - 0.9**t), out=change)
    change /= slopes
    weights -= change


def log_likelihoods(network: Network, docs: Sequence[np.ndarray], lanes: int = 512) -> np.ndarray:
    """ln P of the symbols of each document, the state carried through the whole of it."""
    out, class_of = np.zeros(len(docs)), network.class_of
    laid = Lanes(docs, network.end, lanes)
    state = np.zeros((network.turn.shape[0], laid.target.shape[1]), dtype=np.float32)
    for begin in range(0, len(laid.target), WINDOW):
        span = slice(begin, begin + WINDOW)
        after = network.window(state, laid.source[span], laid.keep[span])[3]
        state, states, doc, targets = after[-1], _columns(after), laid.doc[span].ravel(), laid.target[span].ravel()
        valid = np.flatnonzero(doc >= 0)
        if len(valid) < len(doc):
            states, doc, targets = states[:, valid], doc[valid], targets[valid]
        out += np.bincount(doc, network.column_loss(states, targets, class_of), len(docs))
    return out


@dataclass
class Model:
    words: dict[bytes, int]  # frequent words and their counts, the network's own first
    network: Network
    tokens: int  # of all training documents, ends included
    distinct: int
    ends: int
    suffix_tokens: np.ndarray  # of words that are not the network's own, by suffix class
    suffix_distinct: np.ndarray


class Codes(dict):
    """Word to its number among the frequent words, or beyond them by suffix class."""

    def __init__(self, words: dict[bytes, int]):
        super().__init__((w, i) for i, w in enumerate(words))
        self.frequent = len(words)

    def __missing__(self, word: bytes) -> int:
        code = self.frequent + suffix_class(word)
        if len(self) < self.frequent + 300_000:
            self[word] = code
        return code


def symbols_of_codes(words: Sequence[bytes], own: int) -> np.ndarray:
    """Network symbol of each code: own words themselves, all others by suffix class."""
    frequent = [i if i < own else own + suffix_class(w) for i, w in enumerate(words)]
    return np.array([*frequent, *range(own, own + SUFFIX_CLASSES)], dtype=np.int32)


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) over all rows; each batch adds up its own words before the shuffle."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen: Counter[bytes] = Counter()
            for text in batch["text"]:
                seen.update(words_of(text))
            if seen:
                yield pd.DataFrame({"word": list(seen), "n": list(seen.values())})

    return docs.select("text").mapInPandas(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def trained_in_rounds(network: Network, docs: DataFrame, names: Sequence[bytes], tokens: int, share: int, epochs: int) -> Network:
    """The network after ``epochs`` passes over all documents (doc_id, text), ``tokens`` in all, in shares of about ``share``.

    Symbols are written once. Equal rows lie in one share only as far as they come in different batches.
    """
    if not tokens:
        return network
    shares = -(-tokens // max(share, 1))
    rounds = min(ROUNDS, shares)
    symbol, end = symbols_of_codes(names, network.own), network.end
    kind = np.uint16 if end < 2**16 else np.int32

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes = Codes({w: 0 for w in names})
        for batch in batches:
            copy = batch.groupby("mark").cumcount()
            found = [np.append(symbol[np.array([codes[w] for w in words_of(t)], dtype=np.int64)], end).astype(kind).tobytes() for t in batch["text"]]
            yield pd.DataFrame({"share": [(int(m) + int(k)) % shares for m, k in zip(batch["mark"], copy)], "mark": batch["mark"], "symbols": found})

    marked = docs.select(F.xxhash64(F.lit("lm"), "doc_id", "text").alias("mark"), "text")
    laid = stored(marked.mapInPandas(encoded, "share long, mark long, symbols binary"), "lm-symbols")
    for turn in range(epochs * rounds):
        at = turn % rounds
        tasks = min(ROUND_TASKS, -(-(shares - at) // rounds))
        here, part = network, (turn, epochs * rounds)

        def learned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            def one(share: int, docs: list[np.ndarray]) -> None:
                order = np.random.default_rng([part[0], share]).permutation(len(docs))
                own = train(here, [docs[i] for i in order], 1, part=part)
                size = float(sum(map(len, docs)))
                seen[0] += size
                for n in WEIGHTS:
                    sums[n] += size * getattr(own, n)

            seen, sums = [0.0], {n: np.zeros(getattr(here, n).shape) for n in WEIGHTS}
            now, held = -1, []
            for batch in batches:
                for share, symbols in zip(batch["share"], batch["symbols"]):
                    if share != now and held:
                        one(now, held)
                        held = []
                    now = share
                    held.append(np.frombuffer(symbols, dtype=kind).astype(np.int32))
            if held:
                one(now, held)
                yield pd.DataFrame({"at": [int(now) // rounds % tasks % SUMS], "tokens": seen, "sums": [b"".join(sums[n].tobytes() for n in WEIGHTS)]})

        def added(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values(["tokens", "sums"])
            sums = sum(np.frombuffer(x) for x in frame["sums"])
            return pd.DataFrame({"at": frame["at"][:1], "tokens": [frame["tokens"].sum()], "sums": [sums.tobytes()]})

        schema = "at long, tokens double, sums binary"
        dealt = laid.where(F.col("share") % rounds == at).repartitionById(tasks, F.expr(f"cast(share div {rounds} % {tasks} as int)"))
        rows = dealt.sortWithinPartitions("share", "mark", "symbols").mapInPandas(learned, schema).groupBy("at").applyInPandas(added, schema).collect()
        rows = sorted(rows, key=lambda r: r["at"])
        if rows:
            mean, begin, got = sum(np.frombuffer(r["sums"]) for r in rows) / sum(r["tokens"] for r in rows), 0, {}
            for n in WEIGHTS:
                old = getattr(network, n)
                got[n] = mean[begin : begin + old.size].reshape(old.shape).astype(np.float32)
                begin += old.size
            network = replace(network, **got)
    return network


def fit(docs: DataFrame, counts: DataFrame, ends: int, frequent: int = 100_000, own: int = 2_000, hidden: int = 24, sample_tokens: int = 1_500_000, epochs: int = 2, seed: int = 7) -> Model:
    """``docs``: the training documents (doc_id, text); ``counts``: their stored word counts; ``ends``: their number.

    ``sample_tokens``: tokens of one share. All documents are trained on, in more shares where there are more tokens.
    """
    suffix = F.crc32(F.right(F.col("word").cast("string"), F.lit(2))) % SUFFIX_CLASSES
    sums = {r["c"]: (r["n"], r["v"]) for r in counts.groupBy(suffix.alias("c")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    top = most_frequent(counts, "n", frequent).collect()
    words = {bytes(r["word"]): r["n"] for r in sorted(top, key=lambda r: (-r["n"], bytes(r["word"])))}
    names = list(words)
    own = min(own, len(names))
    tokens, distinct = np.zeros(SUFFIX_CLASSES), np.zeros(SUFFIX_CLASSES)
    for c, (n, v) in sums.items():
        tokens[c], distinct[c] = n, v
    for w in names[:own]:
        tokens[suffix_class(w)] -= words[w]
        distinct[suffix_class(w)] -= 1
    total = sum(n for n, _ in sums.values()) + ends

    network = start_network(np.array([*[words[w] for w in names[:own]], *tokens, ends], dtype=np.float64), own, hidden, seed)
    network = trained_in_rounds(network, docs, names, total, sample_tokens, epochs)
    return Model(words, network, total, sum(v for _, v in sums.values()) + (ends > 0), ends, tokens, distinct)


def scores(docs: DataFrame, folds: int = 10, **options: int) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    Frequent words, a bounded list, go to every task. Each other word of a document meets its count by a join, so no
    vocabulary is held in one place.
    """
    rows = docs.select("doc_id", whole_text().alias("text"))
    train_rows = rows.where(crc_remainder("doc_id", folds) != 0)
    counts = stored(count_words(train_rows), "lm-counts")
    model = fit(train_rows, counts, train_rows.count(), **options)
    names = list(model.words)
    symbol = symbols_of_codes(names, model.network.own)
    base_total = model.tokens + SMOOTH * (model.distinct + 1)
    # log10 of the numerators of frequent words and of the end; those of other words follow from the join
    numerator = np.append(np.log10(np.array([model.words[w] for w in names], dtype=np.float64) + SMOOTH), np.zeros(SUFFIX_CLASSES))
    end_numerator = math.log10(model.ends + SMOOTH)
    in_class = np.log10(model.suffix_tokens + SMOOTH * (model.suffix_distinct + 1))

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes = Codes(model.words)
        for batch in batches:
            found = [np.array([codes[w] for w in words_of(t)], dtype=np.int64) for t in batch["text"]]
            sizes = np.array([len(x) + 1 for x in found])
            flat, row = np.concatenate([*found, np.zeros(0, np.int64)]), np.repeat(np.arange(len(found)), sizes - 1)
            base = np.bincount(row, numerator[flat], len(found)) + end_numerator - sizes * math.log10(base_total)
            known = np.bincount(row, flat < len(names), len(found)).astype(np.int64) + (model.ends > 0)
            outside = symbol[flat] - model.network.own
            other = outside >= 0  # words that are not the network's own: their share of the suffix class
            share = np.bincount(row[other], (numerator[flat] - in_class[np.maximum(outside, 0)])[other], len(found))
            net = log_likelihoods(model.network, [np.append(symbol[x], np.int32(model.network.end)) for x in found])
            yield pd.DataFrame({"doc_id": batch["doc_id"], "no_id": batch["no_id"], "mark": batch["mark"], "n_tokens": sizes, "known": known, "base": base, "net": net / LN10 + share})

    def others(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frequent = set(model.words)
        for batch in batches:
            word, at, n = [], [], []
            for i, text in enumerate(batch["text"]):
                own = Counter(w for w in words_of(text) if w not in frequent)
                word += [b"", *own]  # one row without a word counts the rows that share id and text
                n += [1, *own.values()]
                at += [i] * (len(own) + 1)
            yield pd.DataFrame({"word": word, "doc_id": batch["doc_id"].to_numpy()[at], "mark": batch["mark"].to_numpy()[at], "n": n})

    no_id = F.col("doc_id").isNull()
    marked = rows.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("doc_id"), no_id.alias("no_id"), F.xxhash64("text", no_id).alias("mark"), "text")
    met = marked.mapInPandas(others, "word binary, doc_id long, mark long, n long").join(counts.withColumnRenamed("n", "c"), "word", "left")
    is_word = F.length("word") > 0
    log_count = F.when(is_word, F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(SMOOTH))).otherwise(0.0)
    met = met.groupBy("doc_id", "mark").agg(F.sum(log_count).alias("more"), F.sum(F.when(is_word & F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("more_known"), F.sum(F.when(is_word, 0).otherwise(1)).alias("rows"))
    scored = marked.mapInPandas(measured, "doc_id long, no_id boolean, mark long, n_tokens long, known long, base double, net double")
    both = scored.join(met.hint("merge"), ["doc_id", "mark"])
    more = F.col("more") / F.col("rows")
    both = both.withColumn("doc_id", F.when(~F.col("no_id"), F.col("doc_id")))
    return both.select(
        "doc_id",
        (crc_remainder("doc_id", folds) == 0).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.col("more_known") / F.col("rows")).cast("long").alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"),
        (F.col("net") + more).alias("score"),
    )
