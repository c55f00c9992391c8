"""Cross-tokenizer alignment: which ids of two tokenizers cover the same bytes, and how often they do.

Both tokenizers encode a text without special tokens: a byte-level one (A) the text behind a space, a piece one (B) the
text, before which it puts that space itself. Byte offsets where tokens of both end cut the text into groups. Nearly all
groups are one A token and the B token of the same bytes; an array from A id to that B id, computed from the vocabularies,
recognises them, and their documents are counted in vectors of vocabulary length. Only the other pairs of a group are
counted through a shuffle.

Every row counts as a document, repeated rows too. Null and empty texts, and texts whose tokens do not spell them, have no
tokens: zeros and an empty hash. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import most_frequent, stored, whole_text

FOLDER = "/opt/tokenizers"
BYTE_LEVEL, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
# Fixed value: the pattern by which the byte-level tokenizer cuts text before it merges bytes.
BEFORE_MERGES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# the regular expression engine of the rank encoder keeps a frame for each space of a run
LONG_RUN = re.compile(r"\s{2000}")
# characters that are aligned at a time, and id pairs
AT_ONCE = 1_000_000
PAIRS_AT_ONCE = 4_000_000
# pairs whose counts every task holds (16 bytes each); the counts of all others are joined
FREQUENT_PAIRS = 500_000


def byte_of_letter() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable bytes stand for themselves, the others
    follow from code point 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


@dataclass
class ByteLevel:
    """Byte-level merges from a vocabulary file; ids are the ranks of the merges."""

    path: str

    def __post_init__(self) -> None:
        import tiktoken

        with open(self.path, encoding="utf-8") as file:
            content = json.load(file)
        special = {t["content"] for t in content["added_tokens"] if t["special"]}
        letters = byte_of_letter()
        vocabulary = content["model"]["vocab"]
        ranks = {bytes(letters[c] for c in entry): i for entry, i in vocabulary.items() if entry not in special}
        self.spelled = [b""] * (max(vocabulary.values()) + 1)
        for spelled, i in ranks.items():
            self.spelled[i] = spelled
        self.ranked = tiktoken.Encoding("byte-level", pat_str=BEFORE_MERGES, mergeable_ranks=ranks, special_tokens={})
        self.slow = None

    def encode(self, text: str) -> list[int]:
        if not LONG_RUN.search(text):
            return self.ranked.encode_ordinary(text)
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path)
            self.slow.encode_special_tokens = True
        return self.slow.encode(text, add_special_tokens=False).ids


@dataclass
class Pieces:
    """Pieces of a sentence model, with bytes for what it has no piece for."""

    path: str

    def __post_init__(self) -> None:
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=self.path)
        ids = range(self.model.get_piece_size())
        spell = lambda i: bytes([int(self.model.id_to_piece(i)[3:5], 16)]) if self.model.is_byte(i) else self.model.id_to_piece(i).replace("▁", " ").encode()
        self.spelled = [b"" if self.model.is_control(i) else spell(i) for i in ids]

    def encode(self, texts: Sequence[str]) -> list[list[int]]:
        return self.model.encode(list(texts), num_threads=1)


def identity_map(a: Sequence[bytes], b: Sequence[bytes], b_is_byte: Sequence[bool]) -> np.ndarray:
    """B id with the same bytes as each A id, -1 where there is none; a piece goes before a byte."""
    of_bytes: dict[bytes, int] = {}
    for i, spelled in sorted(enumerate(b), key=lambda x: b_is_byte[x[0]]):
        of_bytes.setdefault(spelled, i)
    return np.array([of_bytes.get(spelled, -1) if spelled else -1 for spelled in a], dtype=np.int64)


@dataclass
class Linked:
    """What a batch of documents gives: a row a document, and its id pairs in one or more portions."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    groups_sha256: list[str]


def _spans(keys: np.ndarray, size: int, docs: int) -> np.ndarray:
    """Where each document begins among sorted keys of (document, something below ``size``)."""
    return np.searchsorted(keys, np.arange(docs + 1) * size)


def _summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of the weights of each."""
    if not len(keys):
        return keys.astype(np.int64), weights.astype(np.int64)
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[starts], np.add.reduceat(weights, starts)


class Aligner:
    """Both tokenizers and what follows from their vocabularies alone."""

    def __init__(self, folder: str = FOLDER, byte_level: str = BYTE_LEVEL, pieces: str = PIECES):
        self.a, self.b = ByteLevel(f"{folder}/{byte_level}"), Pieces(f"{folder}/{pieces}")
        self.size_a, self.size_b = len(self.a.spelled), len(self.b.spelled)
        self.same = identity_map(self.a.spelled, self.b.spelled, [self.b.model.is_byte(i) for i in range(self.size_b)])
        self.bytes_a, self.bytes_b = (np.array([len(x) for x in t.spelled], dtype=np.int64) for t in (self.a, self.b))
        # every id as it is written: inside a group, and as the last one of its side
        self.written = [f"{i}{sign}" for size, signs in ((self.size_a, ",|"), (self.size_b, ",;")) for sign in signs for i in range(size)]

    def encode(self, texts: Sequence[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both tokenizers; none where one of them does not spell the text behind a space."""
        found_a, found_b = [self.a.encode(f" {t}") if t else [] for t in texts], self.b.encode(texts)
        for i, text in enumerate(texts):
            want = f" {text}".encode()
            spelled = (b"".join([t.spelled[x] for x in ids]) for t, ids in ((self.a, found_a[i]), (self.b, found_b[i])))
            if not text or any(s != want for s in spelled):
                found_a[i], found_b[i] = [], []
        return found_a, found_b

    def align(self, texts: Sequence[str]) -> tuple[Linked, Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]]:
        """The documents' rows, and portions of (identity keys, their links, other keys, their links).

        An identity key is document * size of A + A id, another is (document * size of A + A id) * size of B + B id. No key
        comes in two portions.
        """
        found_a, found_b = self.encode(texts)
        docs = len(texts)
        n_a, n_b = (np.array([len(x) for x in found], dtype=np.int64) for found in (found_a, found_b))
        a, b = (np.array([i for ids in found for i in ids], dtype=np.int64) for found in (found_a, found_b))
        end_a, end_b = np.cumsum(self.bytes_a[a]), np.cumsum(self.bytes_b[b])
        length = int(end_a[-1]) if len(a) else 0
        cuts, mark = np.zeros(length + 1, dtype=bool), np.zeros(length + 1, dtype=bool)
        cuts[end_a], mark[end_b] = True, True
        cuts &= mark
        last_a, last_b = cuts[end_a], cuts[end_b]
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        groups = int(last_a.sum())
        per_a, per_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
        first_a, first_b = np.cumsum(per_a) - per_a, np.cumsum(per_b) - per_b
        doc_a = np.repeat(np.arange(docs), n_a)
        doc = doc_a[first_a]
        rows = Linked(n_a, n_b, np.bincount(doc, minlength=docs), np.bincount(doc, per_a * per_b, docs).astype(np.int64), self._hashes(a, b, last_a, last_b, group_a, group_b, first_a, first_b, per_a, n_a + n_b))

        single = (per_a == 1) & (per_b == 1)
        plain = np.zeros(groups, dtype=bool)
        plain[single] = self.same[a[first_a[single]]] == b[first_b[single]]
        plain_keys = doc[plain] * self.size_a + a[first_a[plain]]
        rest_a, rest_b = ~plain[group_a], ~plain[group_b]
        # distinct ids of a side of an irregular group, and how often they stand there
        keys_a, times_a = _summed(group_a[rest_a] * self.size_a + a[rest_a], np.ones(int(rest_a.sum()), dtype=np.int64))
        keys_b, times_b = _summed(group_b[rest_b] * self.size_b + b[rest_b], np.ones(int(rest_b.sum()), dtype=np.int64))
        begin = np.searchsorted(keys_b, np.arange(groups + 1) * self.size_b)
        partners = np.diff(begin)

        def portions() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
            total = int(partners[keys_a // self.size_a].sum())
            parts = -(-total // PAIRS_AT_ONCE) or 1
            for part in range(parts):
                mine = keys_a % self.size_a % parts == part
                left, times = keys_a[mine], times_a[mine]
                group = left // self.size_a
                n = partners[group]
                at = np.repeat(begin[group] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                pair_a, pair_b = np.repeat(left % self.size_a, n), keys_b[at] % self.size_b
                links, key = np.repeat(times, n) * times_b[at], doc[np.repeat(group, n)] * self.size_a + pair_a
                same = self.same[pair_a] == pair_b
                here = plain_keys[plain_keys % self.size_a % parts == part]
                yield (
                    *_summed(np.concatenate([here, key[same]]), np.concatenate([np.ones(len(here), dtype=np.int64), links[same]])),
                    *_summed(key[~same] * self.size_b + pair_b[~same], links[~same]),
                )

        return rows, portions()

    def _hashes(self, a, b, last_a, last_b, group_a, group_b, first_a, first_b, per_a, sizes) -> list[str]:
        """Hash of each document's groups as they are written: ``a1,a2|b1;a3|b2,b3``."""
        order = np.empty(len(a) + len(b), dtype=np.int64)
        order[np.arange(len(a)) + first_b[group_a]] = a + last_a * self.size_a
        order[np.arange(len(b)) + (first_a + per_a)[group_b]] = 2 * self.size_a + b + last_b * self.size_b
        written, codes, begin, out = self.written, order.tolist(), 0, []
        for size in sizes.tolist():
            spelled = "".join([written[c] for c in codes[begin : begin + size]])
            out.append(hashlib.sha256(spelled[:-1].encode()).hexdigest() if size else "")
            begin += size
        return out


LINKS_SCHEMA = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, same binary, same_links binary, other binary, other_links binary, vector binary"


def _portions_of(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about AT_ONCE characters; a longer text is a run of its own."""
    begin, held = 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text) > AT_ONCE:
            yield begin, i
            begin, held = i, 0
        held += len(text)
    if begin < len(texts):
        yield begin, len(texts)


def links(docs: DataFrame, **files: str) -> DataFrame:
    """Stored rows of LINKS_SCHEMA: one a document, more with only its id pairs where they are very many, and one a task
    with the number of its documents that link each A id to the B id of the same bytes."""
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))

    def aligned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        aligner = None
        for batch in batches:
            aligner = aligner or Aligner(**files)
            vector = np.zeros(aligner.size_a, dtype=np.int64)
            all_texts = batch["text"].tolist()
            for begin, end in _portions_of(all_texts):
                rows, portions = aligner.align(all_texts[begin:end])
                for number, (same, same_links, other, other_links) in enumerate(portions):
                    docs = end - begin
                    vector += np.bincount(same % aligner.size_a, minlength=aligner.size_a)
                    s, o = _spans(same, aligner.size_a, docs), _spans(other, aligner.size_a * aligner.size_b, docs)
                    ids, pairs = (same % aligner.size_a).astype(np.int32), other % (aligner.size_a * aligner.size_b)
                    cut = lambda x, at: [x[i:j].tobytes() for i, j in zip(at[:-1], at[1:])]
                    frame = pd.DataFrame({"row": batch["row"].iloc[begin:end].to_numpy(), "doc_id": batch["doc_id"].iloc[begin:end].astype("Int64").array})
                    for name in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256"):
                        frame[name] = getattr(rows, name) if number == 0 else None
                    frame["same"], frame["same_links"] = cut(ids, s), cut(same_links, s)
                    frame["other"], frame["other_links"], frame["vector"] = cut(pairs, o), cut(other_links, o), None
                    frame = frame if number == 0 else frame[np.diff(s) + np.diff(o) > 0]
                    if len(frame):
                        yield frame
            yield pd.DataFrame({name: [vector.tobytes() if name == "vector" else None] for name in [c.split()[0] for c in LINKS_SCHEMA.split(", ")]})

    return stored(texts.mapInPandas(aligned, LINKS_SCHEMA), "token-links")


def pair_counts(found: DataFrame, size_a: int) -> tuple[np.ndarray, DataFrame]:
    """Documents that link each A id to the B id of the same bytes, and a stored table (pair, n) for all other pairs."""

    def add_vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size_a, dtype=np.int64)
        for batch in batches:
            for vector in batch["vector"]:
                total += np.frombuffer(vector, dtype=np.int64)
        ids = np.flatnonzero(total)
        yield pd.DataFrame({"a": ids, "n": total[ids]})

    def add_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pairs, n = np.unique(np.frombuffer(b"".join(batch["other"]), dtype=np.int64), return_counts=True)
            yield pd.DataFrame({"pair": pairs, "n": n})

    same = np.zeros(size_a, dtype=np.int64)
    for r in found.where("vector IS NOT NULL").select("vector").mapInPandas(add_vectors, "a long, n long").groupBy("a").agg(F.sum("n").alias("n")).collect():
        same[r["a"]] = r["n"]
    pairs = found.where("vector IS NULL").select("other").mapInPandas(add_pairs, "pair long, n long")
    return same, stored(pairs.groupBy("pair").agg(F.sum("n").alias("n")), "token-pairs")


def alignment(docs: DataFrame, **files: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row.

    ``files``: folder, byte_level and pieces name the vocabulary files, which every worker reads.
    """
    aligner = Aligner(**files)
    size_a, size_b = aligner.size_a, aligner.size_b
    found = links(docs, **files)
    same, counts = pair_counts(found, size_a)
    best = same.copy()
    for r in counts.groupBy(F.expr(f"pair div {size_b}").alias("a")).agg(F.max("n").alias("n")).collect():
        best[r["a"]] = max(best[r["a"]], r["n"])
    frequent = most_frequent(counts, "n", FREQUENT_PAIRS).toArrow()
    pairs, n = (frequent.column(c).to_numpy() for c in ("pair", "n"))
    order = np.argsort(pairs)
    pairs, n = pairs[order], n[order]
    is_best = same == best

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = {"n_best": [], "count_sum": [], "rare": [], "rare_links": []}
            for ids, id_links, other, other_links in zip(batch["same"], batch["same_links"], batch["other"], batch["other_links"]):
                ids, id_links, other, other_links = (np.frombuffer(x, dtype=t) for x, t in ((ids, np.int32), (id_links, np.int64), (other, np.int64), (other_links, np.int64)))
                at = np.searchsorted(pairs, other)
                known = at < len(pairs)
                known[known] = pairs[at[known]] == other[known]
                met = n[at[known]]
                out["n_best"].append(int(id_links[is_best[ids]].sum() + other_links[known][met == best[other[known] // size_b]].sum()))
                out["count_sum"].append(int((id_links * same[ids]).sum() + (other_links[known] * met).sum()))
                out["rare"].append(other[~known])
                out["rare_links"].append(other_links[~known])
            yield pd.concat([batch[["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]].reset_index(drop=True), pd.DataFrame(out)], axis=1)

    columns = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    scored = stored(found.where("vector IS NULL").drop("vector").mapInPandas(measured, f"{columns}, rare array<long>, rare_links array<long>"), "token-scores")
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "rare_links")).alias("x")).select("row", F.col("x.rare").alias("pair"), F.col("x.rare_links").alias("links"))
    rare = rare.join(counts, "pair").select("row", (F.col("n") * F.col("links")).alias("count_sum"), F.expr(f"pair div {size_b}").alias("a"), "n", "links")
    top = docs.sparkSession.createDataFrame(pd.DataFrame({"a": np.arange(size_a), "top": best}))
    rare = rare.join(F.broadcast(top), "a").select("row", F.when(F.col("n") == F.col("top"), F.col("links")).otherwise(0).alias("n_best"), "count_sum")
    facts = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    every = scored.select("row", *facts, "n_best", "count_sum").unionByName(rare, allowMissingColumns=True)
    added = every.groupBy("row").agg(*[F.max(c).alias(c) for c in facts], F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return added.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
