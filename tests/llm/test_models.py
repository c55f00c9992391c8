import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from corpusmill.llm import learning, quality_gam, recurrent, toxicity
from corpusmill.llm.common import most_frequent, stored

SF = "/root/testdata/sf0.01"


def held(doc_id, parts):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % parts == 0


def auc(score, y):
    rank = np.argsort(np.argsort(score, kind="stable")) + 1.0
    for v in np.unique(score):
        rank[score == v] = rank[score == v].mean()
    return (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())


# ---- learners ----


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) & (x[:, 1] > 0.3)).astype(float)
    trees = learning.fit_trees(x[:2000], y[:2000])
    assert ((trees.margin(x[2000:]) > 0) == y[2000:]).mean() > 0.97


def test_isotonic_rises_and_pools():
    rng = np.random.default_rng(2)
    x = rng.normal(size=2000)
    y = (rng.random(2000) < learning.sigmoid(3 * x)).astype(float)
    fit = learning.fit_isotonic(x, y)
    assert (np.diff(fit.y) >= 0).all() and (np.diff(fit.x) >= 0).all()
    p = fit.apply(x)
    assert 0 <= p.min() and p.max() <= 1 and abs(p.mean() - y.mean()) < 0.02


def test_additive_model_needs_its_pairs():
    rng = np.random.default_rng(3)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    paired = quality_gam.fit_gam(x[:3000], y[:3000])
    alone = quality_gam.fit_gam(x[:3000], y[:3000], most_pairs=0)
    assert auc(paired.score(x[3000:]), y[3000:]) > 0.95 > 0.7 > auc(alone.score(x[3000:]), y[3000:])
    # a score is the sum of table entries
    one, bins = x[3000:3001], learning.to_bins(x[3000:3001], paired.edges)[0]
    margin = paired.base + sum(t[b] for t, b in zip(paired.tables, bins)) + sum(t[bins[a], bins[b]] for (a, b), t in zip(paired.pairs, paired.pair_tables))
    assert paired.score(one)[0] == pytest.approx(1 / (1 + math.exp(-margin)))


# ---- toxicity and quality ----


@pytest.mark.parametrize("judge, fit, label, least", [(toxicity.judged, toxicity.fit, "toxic", 0.75), (quality_gam.judged, quality_gam.fit, "quality", 0.85)])
def test_held_out_rows_are_ranked_well(spark, judge, fit, label, least):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = {r["doc_id"]: r for r in judge(docs, fit(docs, labels)).collect()}
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows.values())
    assert all(r["held_out"] == held(i, 5) for i, r in rows.items())
    known = [(rows[r["doc_id"]]["score"], r[label]) for r in labels.collect() if held(r["doc_id"], 5)]
    assert auc(np.array([s for s, _ in known]), np.array([y for _, y in known])) > least


@pytest.mark.parametrize("module, label", [(toxicity, "toxic"), (quality_gam, "quality")])
def test_held_out_labels_and_other_columns_have_no_say(spark, module, label):
    from pyspark.sql import functions as F

    docs, labels = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    plain = {r["doc_id"]: r["score"] for r in module.judged(docs, module.fit(docs, labels)).collect()}
    turned = labels.withColumn(label, F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col(label)).otherwise(F.col(label)))
    renamed = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None).cast("string"))
    assert plain == {r["doc_id"]: r["score"] for r in module.judged(renamed, module.fit(renamed, turned)).collect()}


@pytest.mark.parametrize("module", [toxicity, quality_gam])
def test_awkward_rows_are_scored(spark, awkward, nothing, no_labels, module):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (2, None, None), (4, 0, 1), (None, 1, 1), (7, 1, 0), (99, 0, 1)], "doc_id long, quality int, toxic int")
    rows = module.judged(awkward, module.fit(awkward, labels)).collect()
    assert len(rows) == awkward.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["score"] for r in module.judged(awkward, module.fit(awkward, no_labels)).collect()} <= {0.0}
    assert module.judged(nothing, module.fit(nothing, labels)).count() == 0


def test_toxic_rows_go_and_columns_stay(spark, awkward, no_labels):
    kept = toxicity.without_toxic(awkward, toxicity.fit(awkward, no_labels))
    assert kept.schema == awkward.schema and kept.count() == awkward.count()


def test_toxic_features():
    codes, seeds = toxicity.WordCodes({"idiot": 3.0, "loser": 2.0}), frozenset(toxicity.SEED_INSULTS)
    at = dict(zip(toxicity.FEATURES, toxicity.features("You IDIOT, you are a l0ser! x9y ok", codes, seeds)))
    assert at["lexicon_most"] == 3.0 and at["disguised_hits"] == 1 and at["obfuscated"] == 2 / 8
    assert at["second_person_nearness"] == pytest.approx(1 - 1 / toxicity.NEAR)
    assert at["seed_density"] == 1 / 8 and at["capitals"] > 0 and at["exclamations"] > 0
    assert set(toxicity.features("", codes, seeds)) == {0.0}


# ---- language model ----


def test_gradients_match_differences():
    rng = np.random.default_rng(4)
    net = recurrent.start_network(rng.integers(1, 50, 50 + recurrent.SUFFIX_CLASSES + 1).astype(float), 50, 6, 1)
    for name in ("class_weight", "class_bias", "word_weight", "word_bias"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    states, targets = rng.normal(size=(40, 6)), rng.integers(0, net.end + 1, 40)
    _, grad = net.loss(states, targets, net.class_of, learn=True)
    names = ["states", "class_weight", "class_bias", "word_weight", "word_bias"]
    for name, g in zip(names, grad):
        where = states if name == "states" else getattr(net, name)
        for _ in range(5):
            at = tuple(rng.integers(0, n) for n in where.shape)
            keep, eps = where[at], 1e-5
            where[at] = keep + eps
            up = -net.loss(states, targets, net.class_of).sum()
            where[at] = keep - eps
            down = -net.loss(states, targets, net.class_of).sum()
            where[at] = keep
            assert g[at] == pytest.approx((up - down) / (2 * eps), abs=1e-4)


def test_probabilities_sum_to_one():
    net = recurrent.start_network(np.arange(1.0, 90 + recurrent.SUFFIX_CLASSES + 2), 90, 5, 2)
    states = np.random.default_rng(5).normal(size=(1, 5)).astype(np.float32)
    everything = np.arange(net.end + 1)
    assert np.exp(net.loss(np.repeat(states, len(everything), 0), everything, net.class_of)).sum() == pytest.approx(1, abs=1e-4)


def test_lanes_do_not_change_a_document():
    rng = np.random.default_rng(6)
    net = recurrent.start_network(np.ones(40 + recurrent.SUFFIX_CLASSES + 1), 40, 5, 3)
    docs = [np.append(rng.integers(0, net.end, n), net.end).astype(np.int32) for n in (0, 1, 5, 70, 200, 31, 32, 33)]
    together = recurrent.log_likelihoods(net, docs, lanes=3)
    alone = [recurrent.log_likelihoods(net, [d])[0] for d in docs]
    assert together == pytest.approx(alone, rel=1e-4)
    # one step after the other, without windows
    state, total = np.zeros((1, 5), dtype=np.float32), 0.0
    for before, after in zip([net.end, *docs[4][:-1]], docs[4]):
        state = net.step(state, np.array([before]))[0]
        total += net.loss(state, np.array([after]), net.class_of)[0]
    assert together[4] == pytest.approx(total, rel=1e-4)


def test_a_step_of_training_goes_down_the_gradient():
    rng = np.random.default_rng(9)
    net = recurrent.start_network(np.ones(70 + recurrent.SUFFIX_CLASSES + 1), 70, 4, 3)  # the last class is not full
    docs = [np.append(rng.integers(0, net.end, n), net.end).astype(np.int32) for n in [14] * 7 + [9]]
    kept = {n: getattr(net, n).copy() for n in recurrent.WEIGHTS}
    got = recurrent.train(net, docs, 1, lanes=4)
    for name, old in kept.items():
        assert np.array_equal(getattr(net, name), old)  # a share starts from weights that others start from too
        loss = lambda change: -recurrent.log_likelihoods(recurrent.replace(net, **{name: old + change}), docs).sum()  # noqa: B023, E731
        slopes = {}
        for at in {tuple(int(rng.integers(n)) for n in old.shape) for _ in range(40)}:
            change = np.zeros_like(old)
            change[at] = 0.02
            slopes[at] = (loss(change) - loss(-change)) / 0.04
        # the first step of Adam has the size of the rate against the sign of the slope
        steep = [at for at, slope in slopes.items() if abs(slope) > 0.005]
        assert len(steep) > 2
        for at in steep:
            assert (getattr(got, name) - old)[at] == pytest.approx(-0.001 * np.sign(slopes[at]), rel=0.01)


def check_base(docs, got):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = [(r["doc_id"], word.findall((r["text"] or "").translate(lower)) + ["<end>"]) for r in docs.collect()]
    counts = Counter(w for i, words in rows if not held(i, 10) for w in words)
    total, distinct = sum(counts.values()), len(counts)
    want = sorted((str(i), held(i, 10), len(words), sum(w in counts for w in words), total) for i, words in rows)
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) for r in got) == want
    base = {i: sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in words) for i, words in rows}
    for r in got:
        assert r["base_score"] == pytest.approx(base[r["doc_id"]], rel=1e-9)
        assert math.isfinite(r["score"]) and r["score"] < 0


def test_base_scores_and_a_better_model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = recurrent.scores(docs, sample_tokens=150_000).collect()
    check_base(docs, got)
    new = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in new) > sum(r["base_score"] for r in new)


def plain_score(model, counts, text):
    """log10 P of a text, word after word by the definition, in double precision."""
    net, words = model.network, recurrent.words_of(text)
    own = list(model.words)[: net.own]
    share_of = lambda w: (counts.get(w, 0) + 0.1) / (model.suffix_tokens[recurrent.suffix_class(w)] + 0.1 * (model.suffix_distinct[recurrent.suffix_class(w)] + 1))
    symbols = [own.index(w) if w in own else net.own + recurrent.suffix_class(w) for w in words] + [net.end]
    h, total, before = net.turn.shape[0], 0.0, net.end
    state = np.zeros(h)
    wide = {n: getattr(net, n).astype(np.float64) for n in recurrent.WEIGHTS}
    softmax = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    for at, symbol in enumerate(symbols):
        gates = 1 / (1 + np.exp(-(wide["gate"][before][: 2 * h] + state @ wide["turn"])))
        new = np.tanh(wide["gate"][before][2 * h :] + (gates[h:] * state) @ wide["candidate"])
        state = state + gates[:h] * (new - state)
        chances = softmax(state @ wide["class_weight"] + wide["class_bias"])
        if symbol < net.own:
            c = int(np.searchsorted(net.first, symbol, side="right")) - 1
            a, b = net.first[c], net.first[c + 1]
            total += math.log10(chances[c]) + math.log10(softmax(state @ wide["word_weight"][:, a:b] + wide["word_bias"][a:b])[symbol - a])
        else:
            total += math.log10(chances[len(net.first) - 1 + symbol - net.own])
            if symbol != net.end:
                total += math.log10(share_of(words[at]))
        before = symbol
    return total


def test_scores_follow_the_definition(spark):
    options = {"frequent": 60, "own": 50, "hidden": 5, "epochs": 1}
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * 7 + j * j) % (90 if i % 3 else 12)}" for j in range(i % 23))) for i in range(120)], "doc_id long, text string")
    train = docs.where(recurrent.crc_remainder("doc_id", 10) != 0)
    counted = stored(recurrent.count_words(train), "counts")
    counts = {bytes(r["word"]): r["n"] for r in counted.collect()}
    model = recurrent.fit(train, counted, train.count(), **options)
    assert len(counts) > len(model.words) == 60 and model.network.own == 50
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in recurrent.scores(docs, **options).collect():
        assert r["score"] == pytest.approx(plain_score(model, counts, texts[r["doc_id"]]), rel=1e-4, abs=1e-4)


def test_awkward_texts_are_scored(awkward):
    got = recurrent.scores(awkward, frequent=50, own=20, sample_tokens=2000).collect()
    check_base(awkward, got)


def test_no_texts(nothing):
    assert recurrent.scores(nothing).count() == 0


def test_the_network_learns_from_all_documents(spark):
    rng = np.random.default_rng(8)
    after = rng.permutation(120)
    texts = []
    for _ in range(1500):
        words = [int(rng.integers(120))]
        for _ in range(29):
            words.append(int(after[words[-1]]))
        texts.append(" ".join(f"w{w}" for w in words))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    few = {r["doc_id"]: r for r in recurrent.scores(docs, sample_tokens=3000).collect()}
    new = [r for r in few.values() if r["held_out"]]
    # 0.034 when the network saw 3,000 tokens only, 0.101 after all 42,000
    assert sum(r["score"] - r["base_score"] for r in new) / sum(r["n_tokens"] for r in new) > 0.07
    again = {r["doc_id"]: r["score"] for r in recurrent.scores(docs.repartition(2), sample_tokens=3000).collect()}
    assert again == pytest.approx({i: r["score"] for i, r in few.items()}, rel=1e-4)


def test_a_flat_level_fills_the_room(spark):
    words = spark.range(3000).selectExpr("concat('w', id) AS word", "CASE WHEN id < 10 THEN 5000 WHEN id < 300 THEN 1000 + id % 3 ELSE 1000 END AS n")
    got = {r["word"]: r["n"] for r in most_frequent(stored(words, "flat"), "n", 1500).collect()}
    counts = sorted((r["n"] for r in words.collect()), reverse=True)
    assert 1490 <= len(got) <= 1500 and sorted(got.values(), reverse=True) == counts[: len(got)]
    assert len(most_frequent(stored(words, "flat"), "n", 3000).collect()) == 3000
