import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import chat, embed, graph, quality, search, similar, topics, trigram_index, vector_cells


def unit(rng, dims=6):
    v = rng.normal(size=dims)
    return (v / np.linalg.norm(v)).tolist()


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, i % 3, unit(rng)) for i in range(120)]
    rows += [(200 + i, 0, rows[5][2]) for i in range(40)]  # a hot group of copies
    return spark.createDataFrame(rows, "chunk_id long, storage_id int, embedding array<double>"), rows


@pytest.mark.parametrize("limit", [10**9, 2000])
def test_nearest_is_exact_in_blocks_of_any_size(vectors, limit, monkeypatch):
    monkeypatch.setattr(vector_cells, "ROWS", 7)
    monkeypatch.setattr(vector_cells, "COLUMNS", 11)
    df, rows = vectors
    queries = df.select(F.col("chunk_id").alias("query_id"), "embedding")
    got = search.nearest(df, queries, k=7, block_bytes=limit).collect()
    for qid, _, q in rows[::17]:
        ranked = sorted((round(float(np.sum((np.array(q) - np.array(v)) ** 2)), 6), cid) for cid, _, v in rows)
        mine = [(r["distance"], r["chunk_id"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == qid]
        assert mine == ranked[:7]


def test_storages_and_queries_without_vectors(spark):
    rng = np.random.default_rng(8)
    rows = [(i, None if i % 4 == 3 else i % 4, None if i == 17 else unit(rng)) for i in range(60)]
    df = spark.createDataFrame(rows, "chunk_id long, storage_id int, embedding array<double>")
    got = search.nearest(df, df.select(F.col("chunk_id").alias("query_id"), "embedding"), k=3, per_storage=True).collect()
    for qid, _, q in rows:
        for storage in (0, 1, 2, None):
            mine = [(r["distance"], r["chunk_id"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == qid and r["storage_id"] == (None if storage is None else str(storage))]
            ranked = sorted((round(float(np.sum((np.array(q) - np.array(v)) ** 2)), 6), cid) for cid, s, v in rows if s == storage and v is not None and q is not None)
            assert mine == ranked[:3]
    assert search.nearest(df.limit(0), df.select(F.col("chunk_id").alias("query_id"), "embedding")).count() == 0


def test_far_pieces_are_not_scored(spark):
    """On clustered data fewer than half of all pairs are scored, and the lists are exact."""
    rng = np.random.default_rng(4)
    middles = rng.normal(size=(30, 16)) * 5
    rows = [(i, "", (middles[i % 30] + rng.normal(size=16) * 0.3).tolist()) for i in range(3000)]
    corpus = spark.createDataFrame(rows, "item_id long, partition_key string, payload array<double>")
    queries = corpus.filter("item_id % 10 = 0").select(F.col("item_id").alias("query_id"), "payload")
    cells = vector_cells.VectorCells(corpus)
    sizes = cells.placed.groupBy("piece").agg(F.count("*").alias("n"))
    found = {r["query_id"]: [] for r in queries.collect()}
    for r in vector_cells.top_k(corpus, queries, 4, cells=cells).orderBy("rank").collect():
        found[r["query_id"]].append((r["cost"], r["item_id"]))
    points = np.array([r[2] for r in rows])
    for query_id, hits in found.items():
        costs = vector_cells.half_up(vector_cells.squared_distances(points[query_id : query_id + 1], points))[0]
        assert hits == sorted(zip(costs.tolist(), range(3000)))[:4]
    bounds = spark.createDataFrame([(q, {"=": hits[-1][0]}) for q, hits in found.items()], "query_id long, bounds map<string,double>")
    visits = cells.first_visits(queries, 4).unionByName(cells.later_visits(queries.join(bounds, "query_id"), 4))
    assert visits.groupBy("query_id", "piece").count().filter("count > 1").count() == 0
    pairs = visits.join(sizes, "piece").agg(F.sum("n")).first()[0]
    assert pairs < 0.5 * 300 * 3000


def test_default_storage_must_exist(spark, vectors):
    df, _ = vectors
    none = spark.createDataFrame([(0, False)], "storage_id int, default_retriever boolean")
    with pytest.raises(ValueError):
        search.nearest_in_default_storage(df, none, df.select(F.col("chunk_id").alias("query_id"), "embedding"))


def test_trigram_search_ranks_by_similarity(spark):
    chunks = spark.createDataFrame([(1, "two words"), (2, "word"), (3, "zzz")], "chunk_id long, page_content string")
    asked = spark.createDataFrame([(9, "word")], "query_id long, text string")
    hits = [(r["chunk_id"], round(r["similarity"], 4)) for r in trigram_index.trigram_search(chunks, asked).orderBy("rank").collect()]
    assert hits == [(2, 1.0), (1, 0.3636), (3, 0.0)]


def test_components_of_chains_and_hubs(spark):
    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(40)]
    hub = [(100, 100 + i) for i in range(1, 60)]
    edges = chain + hub + [(500, 501), (501, 500), (7, 7)]
    rng.shuffle(edges)
    got = {r["node"]: r["component"] for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(41)} | {100 + i: 100 for i in range(60)} | {500: 500, 501: 500}
    assert got == want


def brute_clusters(ids, close):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and close(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    joined = {i: find(i) for i in ids}
    sizes = {c: list(joined.values()).count(c) for c in set(joined.values())}
    return {i: c for i, c in joined.items() if sizes[c] > 1}


def test_no_task_gets_a_whole_hub(spark):
    """A star of 100,000 edges: its rows meet the hub's smallest neighbour where they are, beside pairs that are joined."""
    star = spark.range(1, 100_001).select(F.col("id").alias("u"), F.lit(0).cast("long").alias("v"))
    pairs = spark.range(200_000, 208_000).select(F.col("id").alias("u"), (F.col("id") + 10_000).alias("v"))
    both = star.union(star.select("v", "u")).union(pairs).repartition(8)
    dealt = graph._with_smallest(both, 208_000)
    sizes = [r["n"] for r in dealt.filter("u = 0").groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 100_000 and max(sizes) < 2 * float(np.median(sizes))
    assert dealt.count() == 208_000 and dealt.filter("u = 0 AND m <> 1 OR u > 0 AND m <> v").count() == 0
    joined = graph.connected_components(star.union(pairs).select(F.col("u").alias("a"), F.col("v").alias("b")))
    assert joined.filter("node <= 100000 AND component <> 0").count() == 0 and joined.count() == 116_001


@pytest.mark.parametrize("most, rows", [(1024, 16_384), (3, 5)])
def test_vector_clusters_match_brute_force(spark, most, rows, monkeypatch):
    monkeypatch.setattr(similar, "MOST_LEADERS", most)
    monkeypatch.setattr(vector_cells, "PIECE_ROWS", rows)
    rng = np.random.default_rng(2)
    centres = [np.array(unit(rng)) for _ in range(6)]
    items = {}
    for i in range(90):
        v = centres[0 if i % 3 == 0 else i % 6] + rng.normal(scale=0.06, size=6)  # a third around one centre
        items[i] = v / np.linalg.norm(v)
    for i in range(90, 110):
        items[i] = items[4]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in items.items()], "item_id long, payload array<double>")
    got = {r["item_id"]: r["cluster"] for r in similar.near_duplicate_vectors(df, threshold=0.985).collect()}
    assert got == brute_clusters(list(items), lambda a, b: float(items[a] @ items[b]) > 0.985)


@pytest.mark.parametrize("threshold", [0.99, 0.9])
def test_altered_copies_of_vectors(spark, threshold):
    """Near copies that are not equal, a third of them around one vector, beside vectors without any."""
    rng = np.random.default_rng(11)
    items = [np.array(unit(rng, 24)) for _ in range(60)]
    items += [items[0] + rng.normal(scale=0.02, size=24) for _ in range(60)] + [items[i] + rng.normal(scale=0.02, size=24) for i in range(20, 50)]
    items = [v / np.linalg.norm(v) for v in items]
    df = spark.createDataFrame([(i, (v * (1 + i % 3)).tolist()) for i, v in enumerate(items)], "item_id long, payload array<double>")
    got = {r["item_id"]: r["cluster"] for r in similar.near_duplicate_vectors(df, threshold).collect()}
    assert got == brute_clusters(range(len(items)), lambda a, b: float(items[a] @ items[b]) > threshold)


def test_visited_pairs_grow_slower_than_the_square(spark):
    rng = np.random.default_rng(12)
    middles = rng.normal(size=(80, 16)) * 4

    def pairs(n):
        vectors = middles[np.arange(n) % 80] + rng.normal(size=(n, 16))
        vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
        units = spark.createDataFrame([(i, None, v.tolist()) for i, v in enumerate(vectors)], "item_id long, partition_key string, payload array<double>")
        cells = vector_cells.VectorCells(units)
        sizes = cells.placed.groupBy("piece").agg(F.count("*").alias("n"))
        return cells.near_visits(0.142).join(sizes, "piece").agg(F.sum("n")).first()[0]

    few, many = pairs(500), pairs(2000)
    assert many < 10 * few and many < 2000 * 2000 / 4


@pytest.mark.parametrize("long_block", [256, 3, 1])
def test_text_clusters_match_brute_force(spark, long_block, monkeypatch):
    monkeypatch.setattr(similar, "LONG_BLOCK", long_block)
    r = random.Random(6)
    words = [f"w{i}" for i in range(80)]
    texts = [[r.choice(words) for _ in range(r.randrange(1, 25))] for _ in range(50)]
    texts += [[*texts[3][:-1], r.choice(words)] for _ in range(20)]  # near copies of one text
    texts += [[w if r.random() < 0.9 else r.choice(words) for w in texts[i]] for i in range(30)] + [texts[5], ["solo"], ["solo", "w1"], ["solo", "solo", "solo", "w2"]]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "item_id long, text string")
    n, idf = len(texts), {}
    for w in {w for t in texts for w in t}:
        idf[w] = np.log((1 + n) / (1 + sum(w in t for t in texts))) + 1
    vectors = [{w: t.count(w) * idf[w] for w in t} for t in texts]
    vectors = [{w: x / np.sqrt(sum(y * y for y in v.values())) for w, x in v.items()} for v in vectors]
    got = {r["item_id"]: r["cluster"] for r in similar.near_duplicate_texts(df).collect()}
    assert got == brute_clusters(range(n), lambda a, b: sum(x * vectors[b].get(w, 0.0) for w, x in vectors[a].items()) > 0.8)


def test_text_clusters_find_copies_and_near_copies(spark):
    base = "the quick brown fox jumps over the lazy dog while seven wizards brew quiet magic"
    rows = [(1, base), (2, base.upper() + "!"), (3, base + " again"), (4, "entirely other words stand in this line"), (5, "")]
    df = spark.createDataFrame(rows, "item_id long, text string")
    got = {r["item_id"]: r["cluster"] for r in similar.near_duplicate_texts(df).collect()}
    assert got == {1: 1, 2: 1, 3: 1}


def test_few_questions_are_one_cluster(spark):
    df = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(4)], "item_id long, embedding array<double>")
    assert {r["cluster"] for r in topics.cluster_questions(df).collect()} == {-1}


def test_each_text_is_embedded_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def embed_texts(df):
        def run(batches):
            for b in batches:
                seen.add(len(b))
                yield b.assign(embedding=[[1.0]] * len(b))

        return df.mapInPandas(run, "text_id string, text string, embedding array<double>")

    texts = spark.createDataFrame([(1, "Hi!"), (2, "hi"), (3, "other")], "item_id long, text string")
    assert embed.embed_once(texts, embed_texts).count() == 3
    assert seen.value == 2


def test_empty_text_has_an_error_in_the_report(spark):
    texts = spark.createDataFrame([(1, "12345"), (2, "word word")], "item_id long, text string")
    rows = {r["item_id"]: r for r in quality.quality_report(texts).collect()}
    assert rows[1]["error"] == quality.EMPTY and rows[2]["error"] is None and rows[2]["invalid_words"] == 2


def test_sample_shortage_is_an_error(spark):
    storages = spark.createDataFrame([(1,)], "storage_id long")
    sources = spark.createDataFrame([(10, 1, "active")], "source_id long, storage_id long, status string")
    with pytest.raises(ValueError):
        chat.checked_sample(storages, sources, 2, seed=1)


def test_zero_vectors_and_blank_texts_are_in_no_cluster(spark):
    rows = [(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 0.0]), (4, [1.0, 0.0])]
    found = similar.near_duplicate_vectors(spark.createDataFrame(rows, "item_id long, payload array<double>"))
    assert {r["item_id"]: r["cluster"] for r in found.collect()} == {3: 3, 4: 3}
    texts = spark.createDataFrame([(1, ""), (2, " !"), (3, "a b"), (4, "A, b")], "item_id long, text string")
    assert {r["item_id"] for r in similar.exact_duplicates(texts).collect()} == {3, 4}


def test_a_session_of_any_length_has_one_list(spark):
    facts = spark.createDataFrame([(1, t, "n", [f"v{t % 700}"], f"t{t}.") for t in range(1000)], "session_id long, turn long, name string, value array<string>, text string")
    lists = chat.fact_lists(facts).collect()
    assert len(lists) == 1 and lists[0]["items"] == [f"v{t}" for t in range(700)]
    texts = chat.fact_texts(facts).collect()
    assert len(texts) == 1 and texts[0]["text"] == "t0.. " + ". ".join(f"t{t}" for t in range(1, 1000))


def test_places_of_an_order(spark):
    from corpusmill.operators import catalog

    rows = [(i, i % 7 if i % 11 else None) for i in range(500)]
    df = spark.createDataFrame(rows, "i long, k long")
    got = catalog.numbered(df, [F.desc_nulls_first("k"), F.asc("i")], "place").orderBy("place").collect()
    want = sorted(rows, key=lambda r: (r[1] is not None, -(r[1] or 0), r[0]))
    assert [(r["i"], r["k"]) for r in got] == want and [r["place"] for r in got] == list(range(1, 501))
    assert [r["i"] for r in catalog.page_of(df, 3, 50, [F.asc("i")]).collect()] == list(range(100, 150))
    assert catalog.numbered(df.limit(0), [F.asc("i")], "place").count() == 0


def test_a_visit_carries_a_vector_once_a_region(spark):
    """Vectors without structure are open everywhere: visits grow with the regions, not with the pieces."""
    rng = np.random.default_rng(5)
    rows = [(i, None, unit(rng, 24)) for i in range(3000)]
    corpus = spark.createDataFrame(rows, "item_id long, partition_key string, payload array<double>")
    cells = vector_cells.VectorCells(corpus)
    n_regions = len(set(cells.pieces.region.tolist()))
    assert len(cells.pieces.name) > 3 * n_regions and n_regions <= vector_cells.LEAST_REGIONS + 1
    asked = corpus.select(F.col("item_id").alias("query_id"), "payload")
    visits = cells.in_regions(asked, lambda batch, gaps, bounds: gaps >= 0, 3)
    assert visits.count() == 3000 * n_regions and visits.distinct().count() == 3000 * n_regions


def test_links_of_a_task_are_folded():
    a, b = similar._stars(np.array([5, 3, 9, 9, 2, 7]), np.array([3, 1, 5, 9, 8, 7]))
    assert sorted(zip(a.tolist(), b.tolist())) == [(3, 1), (5, 1), (8, 2), (9, 1)]


def test_terms_are_counted_without_shuffling_them(spark):
    rows = [("c", 1, "b a b a"), ("c", 1, "bb aa bb the aa"), ("c", 2, None), ("c", 3, "x"), (None, 4, "Aa aa")]
    counted = topics.term_counts(spark.createDataFrame(rows, "cluster string, item_id long, text string"), ["the"])
    got = {(r["cluster"], r["item_id"], r["term"]): r["tf"] for r in counted.collect()}
    assert got == {("c", 1, "aa"): 2, ("c", 1, "bb"): 2, ("c", 1, "aa bb"): 1, ("c", 1, "bb aa"): 2, (None, 4, "aa"): 2, (None, 4, "aa aa"): 1}
    plan = counted._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1  # only the texts are grouped


def test_only_postings_that_can_pair_are_written(spark, monkeypatch):
    from corpusmill.operators import similar

    written = []
    monkeypatch.setattr(similar, "cut_lineage", lambda df: written.append(("rows", df.count())) or df)
    monkeypatch.setattr(similar, "_written", lambda df, label: written.append((label, df.count())) or df, raising=False)
    rows = [(1, i, 0.5, 1.0) for i in range(3)] + [(10 + i, i, 0.5, 1.0) for i in range(50)]  # 50 terms stand in one text only
    short, long = similar._by_length(spark.createDataFrame(rows, "block long, item_id long, weight double, rest double"))
    assert short.count() == 3 and long.count() == 0
    assert written == [("postings", 3)]


def tfidf_clusters(texts, threshold=0.8):
    """Clusters of {id: text} by comparing all pairs."""
    counts, idf = {i: Counter(t.split()) for i, t in texts.items()}, {}
    for w in {w for c in counts.values() for w in c}:
        idf[w] = np.log((1 + len(texts)) / (1 + sum(w in c for c in counts.values()))) + 1
    raw = {i: {w: n * idf[w] for w, n in c.items()} for i, c in counts.items()}
    unit = {i: {w: x / np.sqrt(sum(y * y for y in v.values())) for w, x in v.items()} for i, v in raw.items()}
    return brute_clusters(sorted(texts), lambda a, b: sum(x * unit[b].get(w, 0.0) for w, x in unit[a].items()) > threshold)


def test_texts_meet_in_blocks_and_their_words_are_never_rows(spark, monkeypatch):
    from corpusmill.operators import term_blocks

    r = random.Random(9)
    words = [f"w{int(r.paretovariate(0.6))}" for _ in range(4000)]  # a few words stand in most texts
    texts = {i: " ".join(r.choice(words) for _ in range(r.randrange(1, 40))) for i in range(150)}
    texts |= {150 + i: " ".join(w if r.random() < 0.93 else r.choice(words) for w in texts[i].split()) for i in range(100)}
    texts |= {250 + i: texts[7] for i in range(20)}
    for module, name, value in ((term_blocks, "BLOCK_ROWS", 16), (term_blocks, "BLOCK_WORDS", 200), (term_blocks, "RANGE_TERMS", 50), (similar, "STRIP_ROWS", 5), (similar, "MOST_PRODUCTS", 50)):
        monkeypatch.setattr(module, name, value, raising=False)
    rows, write = [], similar._written
    monkeypatch.setattr(similar, "_written", lambda df, label: rows.append((found := write(df, label)).count()) or found)
    df = spark.createDataFrame(sorted(texts.items()), "item_id long, text string")
    assert {r["item_id"]: r["cluster"] for r in similar.near_duplicate_texts(df).collect()} == tfidf_clusters(texts)
    assert sum(rows) < len(texts) / 4  # blocks are written, and neither texts nor postings


def test_texts_of_one_item_are_one_text(spark):
    rows = [(1, "one two three"), (1, "four five six"), (2, "four two five six one three"), (3, "one two three"), (None, "one two three four five six")]
    df = spark.createDataFrame([*rows, (4, "other words"), (4, "other words")], "item_id long, text string")
    assert {r["item_id"]: r["cluster"] for r in similar.near_duplicate_texts(df).collect()} == {1: 1, 2: 1, 3: 1}
    few = spark.createDataFrame([(1, "aa bb cc"), (2, "aa bb dd"), (3, "ee")], "item_id long, text string")
    assert {r["item_id"] for r in similar.near_duplicate_texts(few, max_features=2).collect()} == {1, 2}
    assert similar.near_duplicate_texts(few).count() == 0


def brute_tags(rows, top=5, min_df=2, max_df=0.8):
    """Tags of (cluster, item, text) by hand."""
    tags = {}
    for cluster in {c for c, _, _ in rows}:
        items = {}
        for c, i, text in rows:
            if c == cluster:
                w = re.findall(r"\w\w+", (text or "").lower())
                items.setdefault(i, Counter()).update(w + [f"{a} {b}" for a, b in zip(w, w[1:])])
        df = Counter(t for counts in items.values() for t in counts)
        idf = {t: np.log((1 + len(items)) / (1 + n)) + 1 for t, n in df.items() if min_df <= n <= max_df * len(items)}
        sums = Counter()
        for counts in items.values():
            raw = {t: n * idf[t] for t, n in counts.items() if t in idf}
            for t, x in raw.items():
                sums[t] += x / np.sqrt(sum(y * y for y in raw.values()))
        tags[cluster] = sorted(sums, key=lambda t: (-round(sums[t], 6), t))[:top]
    return tags


@pytest.mark.parametrize("twice", [False, True])
def test_tags_are_summed_in_blocks_and_only_the_best_are_spelled(spark, monkeypatch, twice):
    from corpusmill.operators import term_blocks

    r = random.Random(4)
    words = [f"w{int(r.paretovariate(0.8))}" for _ in range(2000)]
    rows = [(f"c{i % 3}", i, " ".join(r.choice(words) for _ in range(r.randrange(0, 30)))) for i in range(200)]
    rows += [("one", 900, "alone here"), ("two", 901, "same words"), ("two", 902, "same words"), ("two", 903, None), ("two", None, "same words")]
    rows += rows[:5] if twice else []
    for module, name, value in ((term_blocks, "BLOCK_ROWS", 16), (term_blocks, "RANGE_TERMS", 50), (topics, "MOST_LIKELY", 8)):
        monkeypatch.setattr(module, name, value, raising=False)
    spelled, count = [], topics.term_counts
    monkeypatch.setattr(topics, "term_counts", lambda texts, stop: spelled.append(texts.count()) or count(texts, stop))
    df = spark.createDataFrame(rows, "cluster string, item_id long, text string").repartition(3)
    want = {c: tags or ["(не удалось выделить теги)"] for c, tags in brute_tags(rows).items()}
    assert {r["cluster"]: r["tags"] for r in topics.cluster_tags(df, []).collect()} == want
    assert sum(spelled) < len(rows) / 4  # the terms of all others are never rows
    few = {r["cluster"]: r["tags"] for r in topics.cluster_tags(df, [], max_features=2).collect()}
    assert all(len(tags) <= 2 for tags in few.values()) and few["two"] == ["same", "same words"]
