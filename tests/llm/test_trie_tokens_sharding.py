import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusmill.llm import prefix_trie, sharding, tokens

# ---- prefix trie ----

TURNS = "conv_id long, turn long, role string, text string, marks string, depth int, name string"


def turns_frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], TURNS)


def expected_nodes(rows):
    """All nodes by the definition: prefixes of the rebuilt conversations in dictionaries."""
    own = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            own[conv_id].append((turn is not None, turn or 0, digest, role, text))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(np.fmod(c, 20))
        turns = tuple(own.get(base, [])[:h] + own[c][h:])
        ends[turns].append(c)
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = Counter(p[:-1] for p in members if p)
    out = []
    for p, ids in members.items():
        under = [q for q in members if q[: len(p)] == p]
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode().split()) for q in under if q)
        listed = ",".join(map(str, sorted(ends.get(p, []))))
        parent = min(members[p[:-1]]) if p else None
        out.append((min(ids), len(p), parent, len(ids), children[p], sum(not children[q] for q in under), saved, hashlib.sha256(listed.encode()).hexdigest()))
    return sorted(out, key=repr)


def nodes_of(spark, rows, **options):
    got = prefix_trie.trie(turns_frame(spark, rows), **options)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(map(tuple, got.collect()), key=repr)


AWKWARD = [
    (0, None, "user", "first of all"), (0, 0, None, "hello there"), (0, 1, "assistant", None), (0, 1, "user", "same number"), (0, 1, "user", "same number"),
    (1, 5, "user", "own words"), (2, 0, None, "hello there"), (2, 1, "assistant", ""), (3, 0, None, None), (None, 0, "user", "nobody"),
    (23, 0, "user", "short"), (24, 0, "user", "a:b"), (25, 0, "user:", "b"), (26, 0, "use", "r b"), (-5, 0, "user", "below zero"), (-5, 1, "user", " \t\n"),
    (40, 0, "user", "w " * 30_000), (41, 7, "user", "naïve 😀 text"), (42, 2, "user", "w " * 30_000),
]


def test_awkward_conversations(spark):
    assert nodes_of(spark, AWKWARD) == expected_nodes(AWKWARD)


@pytest.mark.parametrize("a_shard", [1, 7, 40])
def test_nodes_that_lie_in_several_shards(spark, a_shard):
    r = random.Random(a_shard)
    rows = []
    for c in range(60):
        copy = r.random() < 0.5
        length = 9 if copy else r.randrange(1, 12)
        rows += [(c, t, "user", "the same again" if copy or t < 4 else f"word {r.choice('abc')}") for t in range(length)]
    assert nodes_of(spark, rows, turns_a_shard=a_shard) == expected_nodes(rows)


def test_one_large_group_of_copies_is_hashed_in_order(spark):
    rows = [(c, 0, "user", "hi") for c in range(9000, 200, -1)]
    assert nodes_of(spark, rows) == expected_nodes(rows)


def test_no_conversations(spark):
    assert nodes_of(spark, []) == []


@given(st.lists(st.lists(st.integers(0, 3), max_size=6), max_size=30))
@settings(max_examples=100, deadline=None)
def test_tree_finds_what_was_inserted(strings):
    tree = prefix_trie.Tree()
    ends = {tuple(s): tree.insert(s) for s in strings}
    prefixes = {p[:d] for p in ends for d in range(len(p) + 1)} | {()}
    assert len(tree.turn) == len(prefixes)
    for string, node in ends.items():
        assert [tree.turn[n] for n in tree.path(node)[1:]] == list(string) and tree.insert(string) == node


def test_medians_balance_the_siblings():
    tree = prefix_trie.Tree()
    for i in prefix_trie.medians(1000):
        tree.insert([i])
    heights = {0: 0}
    for node in range(1, 1001):  # links only lead to later nodes
        heights.setdefault(node, 1)
        for link in (tree.less[node], tree.more[node]):
            if link:
                heights[link] = heights[node] + 1
    assert max(heights.values()) == 10 and sorted(prefix_trie.medians(1000)) == list(range(1000))


# ---- cross-tokenizer alignment ----


@pytest.fixture(scope="module")
def aligner():
    return tokens.Aligner()


def expected_alignment(texts):
    """By the definition, with the plain encoders of both libraries."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(f"{tokens.FOLDER}/{tokens.BYTE_LEVEL}")
    slow.encode_special_tokens = True
    pieces = SentencePieceProcessor(model_file=f"{tokens.FOLDER}/{tokens.PIECES}")
    letters = tokens.byte_of_letter()
    a_bytes = lambda i: bytes(letters[c] for c in slow.id_to_token(i))
    b_bytes = lambda i: bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode()
    found, counts = [], Counter()
    for text in texts:
        a = slow.encode(" " + text, add_special_tokens=False).ids if text else []
        b = pieces.encode(text) if text else []
        spelled = (" " + (text or "")).encode()
        if b"".join(map(a_bytes, a)) != spelled or b"".join(map(b_bytes, b)) != spelled:
            a, b = [], []
        ends = [np.cumsum([len(f(i)) for i in ids]).tolist() for f, ids in ((a_bytes, a), (b_bytes, b))]
        groups, i, j = [], 0, 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            x, y = ends[0].index(cut) + 1, ends[1].index(cut) + 1
            groups.append((a[i:x], b[j:y]))
            i, j = x, y
        links = Counter((x, y) for ga, gb in groups for x in ga for y in gb)
        counts.update(links.keys())
        found.append((a, b, groups, links))
    best = {}
    for (x, _), n in counts.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for a, b, groups, links in found:
        written = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out.append((
            len(a), len(b), len(groups), sum(links.values()), sum(n for p, n in links.items() if counts[p] == best[p[0]]),
            sum(counts[p] * n for p, n in links.items()), hashlib.sha256(written.encode()).hexdigest() if a else "",
        ))
    return out


ODD = [
    None, "", " ", "the same text as before", "the same text as before", "<|endoftext|> and <s> </s> <unk> <0x41>", "a ▁ lower block and ▁▁", "naïve café 😀👩‍🚀 Ünïcode",
    "中文字符没有空格的一段文字", "it's we're 12345 3.14 !?!? ...", "tabs\tand\r\nlines\n\n\n", "zero\x00byte", "internationalization antidisestablishmentarianism", "ab" * 300,
    " leading and trailing ", "é combining", "   ideographic", "Donaudampfschifffahrtsgesellschaft qxzjvkw",
]


def alignment_rows(spark, texts):
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, row string, a int")
    got = tokens.alignment(frame).orderBy("doc_id").collect()
    assert [r["doc_id"] for r in got] == list(range(len(texts)))
    return [tuple(r)[1:] for r in got]


def test_alignment_of_odd_texts(spark):
    assert alignment_rows(spark, ODD) == expected_alignment(ODD)


def test_rare_pairs_meet_their_counts_by_a_join(spark, monkeypatch):
    monkeypatch.setattr(tokens, "FREQUENT_PAIRS", 3)
    monkeypatch.setattr(tokens, "PAIRS_AT_ONCE", 5)
    monkeypatch.setattr(tokens, "AT_ONCE", 40)
    assert alignment_rows(spark, ODD) == expected_alignment(ODD)


def test_portions_hold_every_pair_once(aligner, monkeypatch):
    texts = [t or "" for t in ODD]
    rows, whole = aligner.align(texts)
    whole = list(whole)
    monkeypatch.setattr(tokens, "PAIRS_AT_ONCE", 4)
    _, parts = aligner.align(texts)
    parts = list(parts)
    assert len(whole) == 1 and len(parts) > 10
    for keys, weights in ((0, 1), (2, 3)):
        want = dict(zip(whole[0][keys].tolist(), whole[0][weights].tolist()))
        got = [x for p in parts for x in zip(p[keys].tolist(), p[weights].tolist())]
        assert len(got) == len(want) and dict(got) == want


@given(st.lists(st.sampled_from([" ", "  ", "\n", "a", "the", "Ing", "é", "ß", "ж", "中", "1", "42", "'s", "'re", "!", "...", "\t", "😀", "́", " ", "　", "ﬁ", "x_y"]), max_size=60).map("".join))
@settings(max_examples=300, deadline=None)
def test_ranks_and_merges_give_the_same_ids(aligner, text):
    from tokenizers import Tokenizer

    slow = aligner.__dict__.setdefault("slow", Tokenizer.from_file(f"{tokens.FOLDER}/{tokens.BYTE_LEVEL}"))
    assert aligner.a.encode(" " + text) == slow.encode(" " + text, add_special_tokens=False).ids


@pytest.mark.parametrize("run", ["ab" * 500_000, " " * 1_000_000, "\n \t" * 300_000, "字" * 200_000])
def test_very_long_runs(aligner, run):
    rows, portions = aligner.align([run])
    same = sum(int(p[1].sum() + p[3].sum()) for p in portions)
    assert rows.n_links[0] == same >= rows.n_groups[0] > 0


def test_identity_map_names_equal_bytes(aligner):
    ids = np.flatnonzero(aligner.same >= 0)
    assert len(ids) > 10_000
    assert all(aligner.a.spelled[i] == aligner.b.spelled[aligner.same[i]] for i in ids)


def test_alignment_of_awkward_and_no_rows(awkward, nothing):
    got = tokens.alignment(awkward).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in awkward.collect())
    assert tokens.alignment(nothing).count() == 0


# ---- sharding ----


@given(st.integers(0, 3000), st.integers(0, 2**63))
@settings(max_examples=100, deadline=None)
def test_places_are_a_permutation_and_invert(rows, seed):
    a, b = sharding.sides(rows)
    assert rows <= a * b < rows + max(a, 2)
    numbers = np.arange(rows)
    places = sharding.place(numbers, rows, seed)
    assert sorted(places.tolist()) == list(range(rows))
    assert (sharding.row_number_at(places, rows, seed) == numbers).all()


def test_places_look_shuffled():
    places = sharding.place(np.arange(100_000), 100_000)
    near = np.abs(np.diff(places.astype(float))).mean()
    assert 32_000 < near < 34_700  # a third of the rows apart on the average
    assert (places != sharding.place(np.arange(100_000), 100_000, seed=1)).mean() > 0.99
    counts = np.bincount(places[:8000] % 8, minlength=8)  # neighbours in the table are dealt evenly
    assert counts.min() > 900 and counts.max() < 1100


def check_shards(docs, got, shards):
    want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in docs.collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert (r["law"], r["grown_shard"]) == ("rows", None)
    sizes = [len(slots[s]) for s in range(shards)]
    assert set(slots) <= set(range(shards)) and (not got or max(sizes) - min(sizes) <= 1)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_of_awkward_rows(awkward, nothing):
    got = sharding.shard(awkward).collect()
    check_shards(awkward, got, 8)
    assert Counter(map(tuple, sharding.shard(awkward.repartition(5)).collect())) == Counter(map(tuple, got))
    assert sharding.shard(nothing).count() == 0


def test_one_id_on_most_rows(spark):
    docs = spark.range(3000).select(F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id")).alias("doc_id"), F.lit("same").alias("text"))
    got = sharding.shard(docs, shards=5).collect()
    check_shards(docs, got, 5)
    assert sorted(r["row_number"] for r in got) == list(range(3000))


def test_a_slot_names_its_row(spark):
    docs = spark.range(100).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    for r in sharding.shard(docs, shards=8).collect():
        place = np.array([r["slot"] * 8 + r["shard"]])
        assert sharding.row_number_at(place, 100)[0] == r["row_number"] == r["doc_id"]
