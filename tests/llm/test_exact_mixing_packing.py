import hashlib
import itertools
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from corpusmill.llm import exact, mixing, packing
from corpusmill.sources import buckets


def sha(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


# ---- exact dedup ----


def test_every_row_is_judged(awkward):
    rows = awkward.select("doc_id", "text").collect()
    got = exact.deduplicate(awkward).collect()
    assert sorted((str(r["doc_id"]), r["text_sha256"]) for r in got) == sorted((str(r["doc_id"]), sha(r["text"])) for r in rows)
    for r in got:
        group = [x["doc_id"] for x in rows if sha(x["text"]) == r["text_sha256"]]
        assert r["group_size"] == len(group)
        assert r["keep_id"] == max((i for i in group if i is not None), default=None)
    # one row a text stays, of repeated rows too
    assert sum(r["kept"] for r in got) == len({r["text_sha256"] for r in got})


def test_rows_that_stay_keep_their_columns(awkward):
    got = exact.unique_rows(awkward)
    assert got.schema == awkward.schema
    rows = got.collect()
    assert len(rows) == len({sha(r["text"]) for r in awkward.collect()})
    assert {r["doc_id"] for r in rows} == {2, 3, 6, 7, 8, 9, 10, None, 11, 12}


def docs_of(spark, *rows):
    return spark.createDataFrame([*rows], "doc_id long, text string")


def judged(rows):
    return sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in rows.collect()), key=repr)


def test_later_batches_meet_the_index(spark):
    index = exact.DigestIndex(spark, n_buckets=4)
    first = docs_of(spark, (1, "a"), (2, "b"))
    second = docs_of(spark, (9, "a"), (10, "c"), (11, "c"))
    assert {r["doc_id"] for r in exact.unique_rows(first, index).collect()} == {1, 2}
    assert {r["doc_id"] for r in exact.unique_rows(second, index).collect()} == {11}
    assert index.entries().count() == 3
    assert exact.unique_rows(second, index).count() == 0  # the same rows again are copies


def test_batches_are_judged_as_one_table(spark, awkward):
    rows = awkward.select("doc_id", "text")
    index = exact.DigestIndex(spark, n_buckets=3)
    third = lambda i: rows.where(F.pmod(F.coalesce("doc_id", F.lit(7)), F.lit(3)) == i)
    for i in range(3):
        exact.deduplicate(third(i), index, name=f"part {i}")
    names = {r["batch"] for r in index.commits().collect()}
    got = [row for i in range(3) for row in judged(exact.deduplicate(third(i), index, name=f"part {i}"))]
    assert {r["batch"] for r in index.commits().collect()} == names  # a name that is known adds nothing
    assert sorted(got, key=repr) == judged(exact.deduplicate(rows))


def test_rows_given_again_are_copies(spark):
    index, rows = exact.DigestIndex(spark), docs_of(spark, (1, "a"), (2, "b"), (3, "b"))
    exact.deduplicate(rows, index)
    again = judged(exact.deduplicate(rows, index))
    assert [(r[1], r[2], r[3]) for r in again] == [(1, 2, False), (3, 4, False), (3, 4, False)]
    larger = judged(exact.deduplicate(docs_of(spark, (8, "a")), index))
    assert larger[0][:4] == (8, 8, 3, True)


def test_an_index_is_opened_again_under_other_settings(spark, tmp_path):
    path = f"{tmp_path}/index"
    exact.unique_rows(docs_of(spark, (1, "a"), (2, "b")), exact.DigestIndex(spark, path, n_buckets=5))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        index = exact.DigestIndex(spark, path)
        assert index.entries().count() == 2
        assert [r["doc_id"] for r in exact.unique_rows(docs_of(spark, (5, "b"), (6, "c")), index).collect()] == [6]
        assert exact.DigestIndex(spark, path).entries().count() == 3
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("bucketed_")]


def test_what_a_failed_attempt_left_does_not_count(spark, monkeypatch):
    index, rows = exact.DigestIndex(spark), docs_of(spark, (1, "a"), (2, "a"))
    append = buckets.append

    def failing(frame, path):
        if path == index.log:
            raise RuntimeError("lost")
        append(frame, path)

    monkeypatch.setattr(buckets, "append", failing)
    with pytest.raises(RuntimeError):
        exact.deduplicate(rows, index, name="x")
    assert index.entries().count() == 0
    monkeypatch.setattr(buckets, "append", append)
    assert [r[1:4] for r in judged(exact.deduplicate(rows, index, name="x"))] == [(2, 2, False), (2, 2, True)]


def test_index_side_of_the_anti_join_is_not_shuffled(spark):
    index = exact.DigestIndex(spark, n_buckets=4)
    batch = exact.digests(docs_of(spark, (1, "a")))
    plan = batch.join(index._committed(index.seen).select("digest").hint("merge"), "digest", "left_anti")._jdf.queryExecution().toString()
    assert plan.split("== Physical Plan ==")[1].count("Exchange hashpartitioning") == 1


def test_no_rows(nothing):
    assert exact.deduplicate(nothing).count() == 0
    assert exact.unique_rows(nothing).count() == 0


# ---- mixing ----


@given(st.lists(st.tuples(st.integers(0, 1000), st.integers(1, 3)), min_size=1, max_size=12))
@settings(max_examples=200, deadline=None)
def test_quotas_equal_round_by_round_resharing(sources):
    sizes, weights = [s for s, _ in sources], [w for _, w in sources]
    stopped, got = {}, mixing.quotas(sizes, weights)
    while True:
        free = [i for i in range(len(sizes)) if i not in stopped]
        left = sum(sizes) - sum(stopped.values())
        share = {i: left * weights[i] / sum(weights[j] for j in free) for i in free}
        over = {i: 3 * sizes[i] for i in free if share[i] > 3 * sizes[i]}
        if not over:
            break
        stopped |= over
    want = [stopped.get(i, share.get(i)) for i in range(len(sizes))]
    assert got == pytest.approx(want)


def test_flow_prefers_fresh_words():
    capacity = {("a",): 10, ("a", "b"): 10, ("b",): 2}
    flow = mixing.cheapest_flow(capacity, {"a": 10, "b": 12})
    assert flow == {(("a",), "a"): 10, (("a", "b"), "a"): 0, (("a", "b"), "b"): 10, (("b",), "b"): 2}


@given(st.lists(st.integers(0, 4), min_size=3, max_size=3), st.lists(st.integers(0, 9), min_size=2, max_size=2))
@settings(max_examples=40, deadline=None)
def test_flow_costs_least(sizes, wanted):
    patterns = [("a",), ("a", "b"), ("b",)]
    capacity, quota = dict(zip(patterns, sizes)), dict(zip("ab", wanted))
    cost = lambda n, c: sum(max(0, min(n - k * c, c)) * mixing.REPEAT_COSTS[k] for k in range(3))
    flow = mixing.cheapest_flow(capacity, quota)
    amount = {p: sum(f for (q, _), f in flow.items() if q == p) for p in patterns}
    best = min(
        (-(a + ab + ba + b), cost(a, sizes[0]) + cost(ab + ba, sizes[1]) + cost(b, sizes[2]))
        for a, ab, ba, b in itertools.product(*(range(3 * s + 1) for s in (sizes[0], sizes[1], sizes[1], sizes[2])))
        if ab + ba <= 3 * sizes[1] and a + ab <= wanted[0] and ba + b <= wanted[1]
    )
    assert (-sum(amount.values()), sum(cost(amount[p], capacity[p]) for p in patterns)) == best


def test_mix_of_awkward_rows(awkward):
    rows = mixing.taken(awkward).collect()
    assert len(rows) == awkward.count()
    again = mixing.taken(awkward).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
    sizes = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in awkward.collect()}
    assert all(r["size"] == sizes[r["doc_id"]] for r in rows)
    source, members_of = {r["doc_id"]: r["source"] for r in awkward.collect()}, {}
    for r in rows:
        members_of.setdefault(source[r["doc_id"]], []).append(r)
    for members in members_of.values():
        assert abs(sum(r["taken"] for r in members) - members[0]["target"]) <= max(r["size"] for r in members)


def test_mix_repeats_rows_with_all_columns(awkward):
    got = mixing.mixed_rows(awkward)
    assert got.schema == awkward.schema
    taken = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.taken(awkward).collect() if r["taken"]}
    seen = {}
    for r in got.collect():
        seen[r["doc_id"]] = seen.get(r["doc_id"], 0) + 1
    rows = {}
    for r in awkward.collect():
        rows[r["doc_id"]] = rows.get(r["doc_id"], 0) + 1
    assert seen == {i: n * rows[i] for i, n in taken.items()}


def test_mix_of_nothing(nothing):
    assert mixing.taken(nothing).count() == 0
    assert mixing.mixed_rows(nothing).count() == 0


def test_mix_of_overlapping_sources(spark):
    docs = spark.createDataFrame([(i, "w " * 10, ["a"] if i < 20 else ["a", "b"]) for i in range(40)], "doc_id long, text string, sources array<string>")
    rows = mixing.taken(docs, membership=F.col("sources")).collect()
    # a: 400 words, weight 1; b: 200 words, weight 2; of 600 words a gets 200 and b gets 400
    assert sum(r["taken"] for r in rows) == pytest.approx(600, abs=10)


# ---- packing ----


@given(st.lists(st.integers(1, 4096), max_size=60))
@settings(max_examples=200, deadline=None)
def test_packing_fits(sizes):
    bin_of, capacity = packing.pack(sizes)
    full = [0] * len(capacity)
    for size, b in zip(sizes, bin_of):
        full[b] += size
    assert all(f > 0 for f in full)
    assert capacity == [min(c for c in packing.LENGTHS if c >= f) for f in full]
    assert len(capacity) <= len(sizes)


def test_best_fit_fills_the_tightest_bin():
    bin_of, capacity = packing.pack([4096, 3000, 1096, 500, 500], (4096,))
    assert bin_of[1] == bin_of[2] != bin_of[0] and capacity == [4096, 4096, 4096]


def plain_best_fit(sizes, lengths):
    """The same rule without any order kept among the bins: every bin is looked at for every piece."""
    bins, left = [], sum(sizes)
    for need in sizes:
        fitting = [b for b in range(len(bins)) if bins[b][0] - sum(bins[b][1]) >= need]
        if fitting:
            best = min(fitting, key=lambda b: (bins[b][0] - sum(bins[b][1]), b))
        else:
            costs = [(packing.sequence_cost(c) / min(c, left), c) for c in lengths if c >= need]
            bins.append((min(costs)[1], []))
            best = len(bins) - 1
        bins[best][1].append(need)
        left -= need
    return [(min(c for c in lengths if c >= sum(held)), held) for _, held in bins]


@given(st.lists(st.integers(1, 90), max_size=60))
@settings(max_examples=200, deadline=None)
def test_bins_are_those_of_a_plain_best_fit(sizes):
    lengths = (16, 32, 90)
    ordered = sorted(sizes, reverse=True)
    bin_of, capacity = packing.pack(ordered, lengths)
    held = [[n for n, b in zip(ordered, bin_of) if b == i] for i in range(len(capacity))]
    assert list(zip(capacity, held)) == plain_best_fit(ordered, lengths)


def test_every_shard_is_packed_by_best_fit(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") * 37 % 900 + 1).cast("int")).alias("text"))
    rows = packing.best_fit(docs, shard_words=40_000).collect()
    shards = {}
    for r in rows:
        shards.setdefault(r["bin_id"] >> 32, []).append(r)
    assert len(shards) == 5
    for members in shards.values():
        got = {}
        for r in members:
            got.setdefault(r["bin_id"], (r["capacity"], []))[1].append(r["n_words"])
        want = plain_best_fit(sorted((r["n_words"] for r in members), reverse=True), packing.LENGTHS)
        assert sorted((c, sorted(h)) for c, h in got.values()) == sorted((c, sorted(h)) for c, h in want)


def test_every_word_is_packed_once(awkward):
    rows = packing.best_fit(awkward, shard_words=20_000).collect()
    want = sum(len((r["text"] or "").split()) for r in awkward.collect())
    assert sum(r["n_words"] for r in rows) == want
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in awkward.collect()}
    bins = {}
    for r in rows:
        assert (r["bin_id"] is None) == (r["n_words"] == 0)
        if r["bin_id"] is not None:
            bins.setdefault((r["bin_id"], r["capacity"], r["bin_words"]), []).append(r["n_words"])
    assert len(bins) == len({b for b, _, _ in bins})
    for (_, capacity, words), pieces in bins.items():
        assert sum(pieces) == words <= capacity
    long = sorted((r["first_word"], r["n_words"]) for r in rows if r["doc_id"] == 7)
    assert all(a + n == b for (a, n), (b, _) in zip(long, long[1:])) and sum(n for _, n in long) == 60_000


def test_packing_nothing(nothing):
    assert packing.best_fit(nothing).count() == 0
