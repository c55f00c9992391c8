import random
import tracemalloc
from collections import defaultdict

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from corpusmill.llm import jaccard_join as join
from corpusmill.llm import mixing, packing, toxicity


def plain_set(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def plain_components(rows):
    """Smallest id reachable by links, by comparing all pairs that share a shingle."""
    sets = [(r["doc_id"], plain_set(r["text"])) for r in rows if r["doc_id"] is not None]
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    postings = defaultdict(list)
    for k, (i, own) in enumerate(sets):
        common = defaultdict(int)
        for s in own:
            for j in postings[s]:
                common[j] += 1
            postings[s].append(k)
        for j, n in common.items():
            if 100 * n >= 80 * (len(own) + len(sets[j][1]) - n):
                a, b = find(i), find(sets[j][0])
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in root}


def check(docs):
    rows = docs.select("doc_id", "text").collect()
    want = plain_components(rows)
    got = join.classes(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["component_id"] == want.get(r["doc_id"])
    assert sorted((str(r["doc_id"]), r["n_shingles"]) for r in got) == sorted((str(r["doc_id"]), len(plain_set(r["text"]))) for r in rows)
    return got


def test_awkward_rows(awkward):
    check(awkward)


def test_driver_rows(spark):
    check(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_no_rows(nothing):
    assert join.classes(nothing).count() == 0


def test_edits_around_the_threshold(spark):
    """Families of edited copies of all sizes, with a shared passage, so links and near misses are many."""
    rng, rows = random.Random(7), []
    passage = [f"p{i}" for i in range(30)]
    for family in range(60):
        size = rng.choice([1, 2, 4, 5, 6, 7, 8, 9, 10, 12, 15, 20, 30, 60, 120, 300])
        base = [f"f{family}w{rng.randrange(size * 3)}" for _ in range(size)] + (passage if family % 2 else [])
        for _ in range(12):
            words = list(base)
            for _ in range(rng.randrange(1 + max(1, len(words) // 14))):
                at = rng.randrange(len(words))
                words[at : at + rng.randrange(2)] = [f"e{rng.randrange(9)}"] * rng.randrange(2)
            rows.append((len(rows), " ".join(words)))
    rng.shuffle(rows)
    got = check(spark.createDataFrame(rows, "doc_id long, text string"))
    assert len({r["component_id"] for r in got}) < len(got) - 100


@given(st.integers(1, 400), st.integers(0, 2**32), st.floats(0, 0.25))
@settings(max_examples=400, deadline=None)
def test_linked_sets_share_a_signature(size, seed, edits):
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 2**63, size).astype(np.uint64)
    common = a[rng.random(size) >= edits]
    b = np.append(common, rng.integers(0, 2**63, rng.integers(0, size // 4 + 2)).astype(np.uint64))
    a, b = np.unique(a), np.unique(b)
    both = len(np.intersect1d(a, b))
    frequent = np.unique(a[rng.random(len(a)) < 0.5])
    layouts = {n: join.choose_layout(n, int(rng.integers(1, 10**6))) for n in range(10)}
    sets = object.__new__(join.Sets)
    sets.flat, sets.sizes = np.concatenate([a, b]), np.array([len(a), len(b)])
    sets.text, sets.bounds = np.repeat([0, 1], sets.sizes), np.append(0, np.cumsum(sets.sizes))
    if len(b) and 100 * both >= 80 * (len(a) + len(b) - both):
        sign, text = join.signatures(sets, layouts, frequent)
        assert len(np.intersect1d(sign[text == 0], sign[text == 1]))
    # parities never show more differences than there are
    x, y = sets.parities()
    assert sum(bin(int(v) & (2**64 - 1)).count("1") for v in x ^ y) <= len(a) + len(b) - 2 * both


def test_sets_of_many_texts_are_those_of_each(monkeypatch):
    monkeypatch.setattr(join, "CHUNK_BYTES", 60)
    texts = ["", " ", "a", "A b", "\ta  b\n", "one two three four five six", "one two three four five six seven " * 9, "é ü ñ x y z", "x", "one TWO three four five"]
    together, alone = join.Sets(texts, join.WordHashes()), [join.Sets([t], join.WordHashes())[0] for t in texts]
    assert all((together[i] == alone[i]).all() and len(together[i]) == len(alone[i]) == len(plain_set(t)) for i, t in enumerate(texts))
    assert (together[3] == together[4]).all() and together[9][0] in together[5]
    words = [f"w{i}" for i in range(5000)] + ["ab", "ba", "aab", "aba", "baa", "é", "e"]
    hashes, _ = join.WordHashes().of((" " + " ".join(words) + " ").encode())
    assert len(np.unique(hashes)) == len(words)
    assert len(join.Sets([], join.WordHashes()).sizes) == 0


def test_a_batch_is_profiled_within_few_times_its_shingles():
    rng = np.random.default_rng(5)
    words = np.array([f"w{i}" for i in range(30_000)])
    common = " ".join(words[:40])
    texts = [f"{' '.join(words[rng.integers(0, len(words), 800)])} {common}" for _ in range(3000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    tracemalloc.start()
    try:
        kinds = [(b.column("kind")[0].as_py(), b.num_rows, b.column("n").to_pylist()) for b in join.profile_rows(iter([batch]))]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sum(n for kind, n, _ in kinds if kind == 0) == len(texts)
    assert [c for kind, _, c in kinds if kind == 1] == [[len(texts)] * 36]
    shingles = 8 * sum(sum(c) for kind, _, c in kinds if kind == 0)
    assert peak < 4 * shingles


def test_small_bands_use_deletions():
    assert join.choose_layout(2, 1000).paired and join.choose_layout(9, 1000).plain


def test_one_row_of_each_group_stays(awkward):
    want = plain_components(awkward.collect())
    kept = join.representatives(awkward)
    assert kept.schema == awkward.schema
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in awkward.collect() if want.get(r["doc_id"]) == r["doc_id"])


# ---- pipeline ----


def test_pipeline_equals_its_plain_version(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    toxic = {r["doc_id"] for r in toxicity.judged(docs, model).collect() if r["predicted"]}
    rows = [r for r in docs.collect() if r["doc_id"] not in toxic]
    last = {}
    for r in rows:
        last[r["text"] or ""] = max(r["doc_id"], last.get(r["text"] or "", -1))
    rows = [r for r in rows if last[r["text"] or ""] == r["doc_id"]]
    near = plain_components(rows)
    rows = [r for r in rows if near[r["doc_id"]] == r["doc_id"]]

    sizes = {r["doc_id"]: len((r["text"] or "").encode().split()) for r in rows}
    names = sorted({r["source"] for r in rows})
    total = {s: sum(sizes[r["doc_id"]] for r in rows if r["source"] == s) for s in names}
    goal = dict(zip(names, mixing.quotas([total[s] for s in names], [1 + i % 3 for i in range(len(names))])))
    want = {}
    import hashlib

    for s in names:
        amount = round(goal[s])
        upto = 0
        for i in sorted((r["doc_id"] for r in rows if r["source"] == s), key=lambda i: (hashlib.sha256(f"mix:{i}".encode()).hexdigest(), i)):
            upto += sizes[i]
            rest = amount % total[s] if total[s] else 0
            n = (amount // total[s] if total[s] else 0) + (rest > 0 and sizes[i] > 0 and upto - sizes[i] / 2 <= rest)
            if n and sizes[i]:
                want[i] = sizes[i] * n
    got = corpus_pipeline.run(spark, sf_dir).collect()
    words, bins = defaultdict(int), defaultdict(list)
    for r in got:
        words[r["doc_id"]] += r["n_words"]
        bins[r["bin_id"], r["capacity"], r["bin_words"]].append(r["n_words"])
    assert dict(words) == want
    assert all(sum(x) == n <= c and c in packing.LENGTHS for (_, c, n), x in bins.items())


def test_stages_keep_the_columns(spark, awkward, nothing, tmp_path):
    spark.createDataFrame([(1, 1, 0), (9, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (awkward, nothing):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns or name == corpus_pipeline.STAGES[-1][0]
            docs = out
        docs.count()
