"""Secret scans with a trigram inverted index.

A Boolean query over trigrams is derived from each rule's regular expression. The index is dealt by document: every
Arrow batch is a shard that posts the trigrams its rules ask for, intersects the postings, and verifies the candidates
with the regular expression over the whole text. A rule without mandatory trigrams is verified on every text.

Null texts count as empty and have no spans; a text with nothing found gives an empty list; repeated rows are scanned
as rows of their own; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from re import _constants as sre
from re import _parser as sre_parser

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import whole_text

ANY = frozenset([frozenset()])  # the query that every text fulfils: one conjunction of nothing
MOST_STRINGS = 64  # spellings kept apart while a query is derived
CHUNK = 1 << 20


@dataclass(frozen=True)
class Rule:
    """A kind of secret. A match shorter than ``least`` characters in ``group`` is dropped."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    ignore_case: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.ignore_case else 0))


@dataclass(frozen=True)
class PivotRule(Rule):
    """A rule that begins with a run of letters of any length and is found from the literal behind that run.

    The run consists of ``letters``, which the literal's first sign is not one of, and a match begins at the first ``begin`` in
    it, ``least_run`` letters before the literal at least. ``rest`` is the pattern from the literal on. Going from the literal
    to both sides reads every letter once, where the plain pattern would begin anew at every letter of a long run.
    """

    pivot: str = ""
    letters: str = ""
    begin: str = ""
    least_run: int = 1
    rest: str = ""

    def spans(self, text: str) -> Iterator[tuple[int, int]]:
        """Leftmost matches that do not overlap."""
        letters, begin, rest = set(self.letters), re.compile(self.begin), re.compile(self.rest, re.ASCII)
        done, at = 0, text.find(self.pivot)
        while at >= 0:
            run = at
            while run > done and text[run - 1] in letters:
                run -= 1
            first = begin.search(text, run, at)
            found = rest.match(text, at) if first and at - first.start() >= self.least_run else None
            if found:
                yield first.start(), found.end()
                done = found.end()
            at = text.find(self.pivot, found.end() if found else at + 1)


LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"

# The first three rules, and the public shapes of well-known keys.
BASE_RULES = [
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", r"[0-9a-f]+", 32),
]
MORE_RULES = [
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    PivotRule(
        "jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
        pivot=".eyJ", letters=LOWER + UPPER + DIGITS + "_-", begin="eyJ", least_run=11, rest=r"\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    ),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    PivotRule(
        "login_url", r"[a-z][a-z0-9+.-]*://[^\s:/@]+:[^\s:/@]+@[A-Za-z0-9.-]+",
        pivot="://", letters=LOWER + DIGITS + "+.-", begin="[a-z]", rest=r"://[^\s:/@]+:[^\s:/@]+@[A-Za-z0-9.-]+",
    ),
]
RULES = [*BASE_RULES, *MORE_RULES]
Query = frozenset[frozenset[str]]


def either(a: Query, b: Query) -> Query:
    """OR; a conjunction that another one already covers is left out."""
    terms = a | b
    return frozenset(t for t in terms if not any(u < t for u in terms))


def both(a: Query, b: Query) -> Query:
    """AND; a product that grows too large keeps the shorter side, which only lets more texts through."""
    if len(a) * len(b) > MOST_STRINGS:
        return min(a, b, key=len)
    return either(frozenset(x | y for x in a for y in b), frozenset())


def trigrams(string: str) -> frozenset[str]:
    return frozenset(string[i : i + 3] for i in range(len(string) - 2))


def of_strings(strings: set[str]) -> Query:
    """Any of these spellings."""
    out: Query = frozenset()
    for s in strings:
        out = either(out, frozenset([trigrams(s)]))
    return out


def _spellings(node: tuple) -> set[str] | None:
    """All lower-case texts that a part of the pattern can match, if they are few."""
    op, arg = node
    if op is sre.LITERAL:
        return {chr(arg).lower()}
    if op is sre.IN:
        chars: set[str] = set()
        for kind, value in arg:
            if kind is sre.LITERAL:
                chars.add(chr(value).lower())
            elif kind is sre.RANGE and value[1] - value[0] < 8:
                chars.update(chr(c).lower() for c in range(value[0], value[1] + 1))
            else:
                return None
        return chars if len(chars) <= 8 else None
    if op is sre.SUBPATTERN:
        return _joined(arg[-1])
    if op is sre.BRANCH:
        parts = [_joined(x) for x in arg[1]]
        return None if None in parts else set().union(*parts)
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[1] != sre.MAXREPEAT and arg[1] <= 3:
        once = _joined(arg[2])
        if once is None:
            return None
        out, power = set(), {""}
        for n in range(arg[1] + 1):
            if n >= arg[0]:
                out |= power
            power = {a + b for a in power for b in once}
        return out
    return None


def _joined(nodes: Sequence[tuple]) -> set[str] | None:
    out = {""}
    for node in nodes:
        more = _spellings(node)
        if more is None or len(out) * len(more) > MOST_STRINGS:
            return None
        out = {a + b for a in out for b in more}
    return out


def _query(nodes: Sequence[tuple]) -> Query:
    """Runs of parts with few spellings give trigrams; what stands between them only separates the runs."""
    query, run = ANY, {""}
    for node in nodes:
        op, arg = node
        more = _spellings(node)
        if more is not None and len(run) * len(more) <= MOST_STRINGS:
            run = {a + b for a in run for b in more}
            continue
        query, run = both(query, of_strings(run)), {""}
        if more is not None:
            run = more
        elif op is sre.SUBPATTERN:
            query = both(query, _query(arg[-1]))
        elif op is sre.BRANCH:
            inner: Query = frozenset()
            for x in arg[1]:
                inner = either(inner, _query(x))
            query = both(query, inner)
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] >= 1:
            query = both(query, _query(arg[2]))
    return both(query, of_strings(run))


def trigram_query(rule: Rule) -> Query:
    """Trigrams, in ASCII lower case, that every match contains: an OR of ANDs. ``ANY`` if there are none."""
    query = _query(list(sre_parser.parse(rule.pattern)))
    return query if all(t.isascii() for term in query for t in term) else ANY


class Shard:
    """Postings of the wanted trigrams over one batch of texts."""

    def __init__(self, texts: Sequence[str], wanted: np.ndarray):
        """``wanted``: for each of the 2**24 byte triples its number among the wanted trigrams, or -1."""
        self.count = len(texts)
        folded = [t.encode("utf-8", "replace").lower() for t in texts]
        found: list[np.ndarray] = []
        first = 0
        while first < len(folded):
            last, size = first, 0
            while last < len(folded) and (size == 0 or size + len(folded[last]) < CHUNK):
                size += len(folded[last]) + 2
                last += 1
            ends = np.cumsum([len(x) + 2 for x in folded[first:last]])
            data = np.frombuffer(b"\0\0".join([*folded[first:last], b""]), dtype=np.uint8).astype(np.uint32)
            which = wanted[(data[:-2] << 16) | (data[1:-1] << 8) | data[2:]]
            at = np.flatnonzero(which >= 0)
            docs = np.searchsorted(ends, at, side="right") + first
            found.append(np.unique(which[at].astype(np.int64) * self.count + docs))
            first = last
        keys = np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.int64)
        self.trigram, self.doc = np.divmod(keys, max(self.count, 1))

    def postings(self, number: int) -> np.ndarray:
        return self.doc[np.searchsorted(self.trigram, number) : np.searchsorted(self.trigram, number, side="right")]

    def candidates(self, query: Sequence[Sequence[int]]) -> np.ndarray:
        """Texts that fulfil one of the conjunctions of trigram numbers."""
        out = np.zeros(self.count, dtype=bool)
        for term in query:
            lists = sorted((self.postings(n) for n in term), key=len)
            hits = lists[0] if lists else np.arange(self.count)
            for other in lists[1:]:
                hits = np.intersect1d(hits, other, assume_unique=True)
            out[hits] = True
        return np.flatnonzero(out)


def matches(rule: Rule, pattern: re.Pattern, text: str) -> list[tuple[int, int]]:
    """Leftmost matches that do not overlap, the too short ones dropped."""
    if isinstance(rule, PivotRule):
        return list(rule.spans(text))
    return [m.span() for m in pattern.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


def scan(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(doc_id, spans) of every row; spans: array of (kind, start, end) in code points, by start, then in rule order."""
    queries = [trigram_query(r) for r in rules]
    names = sorted({t for q in queries for term in q for t in term})
    numbered = [[[names.index(t) for t in term] for term in q] for q in queries]
    rules = list(rules)

    def scanned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted = np.full(1 << 24, -1, dtype=np.int16)
        for n, name in enumerate(names):
            a, b, c = name.encode()
            wanted[(a << 16) | (b << 8) | c] = n
        patterns = [r.compiled() for r in rules]
        for batch in batches:
            texts = batch["text"].tolist()
            spans: list[list[tuple[int, int, int]]] = [[] for _ in texts]
            shard = Shard(texts, wanted)
            for k, (rule, pattern) in enumerate(zip(rules, patterns)):
                for i in shard.candidates(numbered[k]):
                    spans[i] += [(start, k, end) for start, end in matches(rule, pattern, texts[i])]
            out = [[{"kind": rules[k].kind, "start": s, "end": e} for s, k, e in sorted(x)] for x in spans]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "spans": out})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return rows.mapInPandas(scanned, "doc_id long, spans array<struct<kind: string, start: long, end: long>>")


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row."""
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in BASE_RULES]))
    return scan(docs).select("doc_id", *[of(r.kind) for r in BASE_RULES], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
