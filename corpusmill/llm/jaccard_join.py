"""N-gram Jaccard join: all documents that share at least 80 of 100 of their five-word shingles, exactly.

Universe-partition pigeonhole. Two sets of x and y elements that link differ in at most H = (x + y) / 9 elements
(for a similarity of 0.8). Shingles are hashed into the segments of their size band. A plain segment that differs costs
at least 1 of the H differences, a segment with a one-deletion neighbourhood at least 2; so two sets that link agree in a
segment, and even in one of the segments that each of them keeps: those first in one order of all segments, segments of
frequent shingles last. Which segments get neighbourhoods is chosen for each band by cost. Candidates are verified on
the whole shingle sets.

Equal sets are linked without a comparison. Within a group of sets that agree in a segment, all are compared with the
most central one; what then is still in different components is compared too, so no link between components is lost. Pairs whose
parities show too many differences are not compared.

Null, empty and blank texts have an empty set and link with nothing. Repeated rows of one id count once for each
distinct set, and the component of an id is that of all its rows. Empty tables give empty results. Extra columns are
ignored. Sets are held as 64-bit hashes of their shingles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import most_frequent, stored, whole_text
from corpusmill.operators.graph import connected_components

WIDTH = 5
NUMERATOR, DENOMINATOR = 80, 100  # least intersection over union
SHIPPED_IDS = 1_000_000  # a list of ids is shipped to every task up to this many (8 MB), else joined
FREQUENT_SHARE = 0.002  # of the documents of one Arrow batch: shingles above it are put last
FREQUENT_MOST = 200_000  # shingles on that list; any list gives right results
PARITY_BITS = 2048
PART_ROWS = 250
RANGE_BITS = 3
CHUNK_BYTES = 1 << 20
SLACK = 1.25  # segments over those that must be kept

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
FOLD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes:
    """64-bit hashes of words by position sums: byte values times powers of an odd number, over each word.

    Prefix sums give the sum of any word, and a power of the inverse moves it to the origin, so equal words hash alike
    wherever they stand.
    """

    BASE = 0x9E3779B97F4A7C1B
    VALUES = mix(np.arange(256, dtype=np.uint64), 9)
    BLANK = np.isin(np.arange(256), [32, *range(9, 14)])

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def of(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Hash and first byte of every word; ``data`` begins and ends with a blank."""
        if len(self.up) < len(data):
            size = max(len(data), 1 << 20)
            self.up, self.down = (np.full(size, x, dtype=np.uint64) for x in (self.BASE, pow(self.BASE, -1, 2**64)))
            self.up[0] = self.down[0] = 1
            np.cumprod(self.up, out=self.up)
            np.cumprod(self.down, out=self.down)
        code = np.frombuffer(data, dtype=np.uint8)
        edge = np.flatnonzero(np.diff(self.BLANK[code]))  # last byte before each change
        start, end = edge[::2] + 1, edge[1::2]
        total = self.VALUES[code]
        total *= self.up[: len(code)]
        np.cumsum(total, out=total)
        return mix((total[end] - total[start - 1]) * self.down[start] + (end - start).astype(np.uint64)), start


class Sets:
    """Sorted distinct shingle hashes of many texts, end to end; those of text i from bounds[i] to bounds[i + 1].

    A shingle is five neighbouring words, or all words of a text of fewer.
    """

    def __init__(self, texts: Sequence[str], hashes: WordHashes):
        coded = [t.encode("utf-8", "surrogatepass").translate(LOWER) for t in texts]
        h, sizes, first = [], [], 0
        while first < len(coded):  # about a megabyte at a time
            last, length = first, 0
            while last < len(coded) and (last == first or length + len(coded[last]) < CHUNK_BYTES):
                length += len(coded[last]) + 1
                last += 1
            own, start = hashes.of(b" " + b" ".join(coded[first:last]) + b" ")
            ends = np.cumsum([len(x) + 1 for x in coded[first:last]])
            h.append(own)
            sizes.append(np.bincount(np.searchsorted(ends, start, side="right"), minlength=last - first)[: last - first])
            first = last
        h = np.concatenate([*h, np.zeros(0, dtype=np.uint64)])
        sizes = np.concatenate([*sizes, np.zeros(0, dtype=np.int64)]).astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        long = np.flatnonzero(sizes >= WIDTH)
        counts = np.where(sizes >= WIDTH, sizes - WIDTH + 1, np.minimum(sizes, 1))
        first = np.cumsum(counts) - counts
        found = np.zeros(int(counts.sum()), dtype=np.uint64)
        if len(long):
            n = counts[long]
            at = np.repeat(starts[long] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            total = h[at] * FOLD[0]
            for k in range(1, WIDTH):
                total += h[at + k] * FOLD[k]
            found[np.repeat(first[long] - (np.cumsum(n) - n), n) + np.arange(n.sum())] = mix(total, 1)
        for i in np.flatnonzero((sizes > 0) & (sizes < WIDTH)):
            own = h[starts[i] : starts[i] + sizes[i]]
            found[first[i]] = mix((own * FOLD[: len(own)]).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(own)))[0]
        for i in long:
            found[first[i] : first[i] + counts[i]].sort()
        text = np.repeat(np.arange(len(texts)), counts)
        new = np.ones(len(found), dtype=bool)
        new[1:] = (found[1:] != found[:-1]) | (text[1:] != text[:-1])
        self.flat, self.text = found[new], text[new]
        self.sizes = np.bincount(self.text, minlength=len(texts))
        self.bounds = np.append(0, np.cumsum(self.sizes))

    def __getitem__(self, i: int) -> np.ndarray:
        return self.flat[self.bounds[i] : self.bounds[i + 1]]

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sum of a value of each shingle over each set."""
        out = np.zeros(len(self.sizes), dtype=np.uint64)
        filled = self.sizes > 0
        if filled.any():
            out[filled] = np.add.reduceat(values, self.bounds[:-1][filled])
        return out

    def parities(self) -> np.ndarray:
        """Whether an odd number of a set's shingles falls on each of the PARITY_BITS places, as 64-bit words.

        Two sets differ in at least as many elements as their parities differ in bits: an exact filter.
        """
        place = (mix(self.flat, 8) % np.uint64(PARITY_BITS)).astype(np.int64)
        count = np.bincount(self.text * PARITY_BITS + place, minlength=len(self.sizes) * PARITY_BITS)
        return np.packbits((count & 1).astype(np.uint8).reshape(-1, PARITY_BITS), axis=1).view(np.int64)


def shingle_set(text: str, hashes: WordHashes) -> np.ndarray:
    return Sets([text], hashes)[0]


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of a few hundred rows, the last of a batch may be shorter: only the texts of a slice become Python strings."""
    for batch in batches:
        for start in range(0, batch.num_rows, PART_ROWS):
            yield batch.slice(start, PART_ROWS)


def most_differences(x: int, y: int) -> int:
    """Largest symmetric difference of sets of these sizes that link."""
    return (x + y) * (DENOMINATOR - NUMERATOR) // (DENOMINATOR + NUMERATOR)


def largest_partner(x: int) -> int:
    return x * DENOMINATOR // NUMERATOR


def band_of(size: int) -> int:
    """Band b holds the sizes from 2**b to 2**(b+1) - 1."""
    return size.bit_length() - 1


class Layout:
    """Segments of a band: ``paired`` ones with one-deletion neighbourhoods, two slots wide, then ``plain`` ones."""

    def __init__(self, band: int, paired: int, plain: int):
        self.band, self.paired, self.plain = band, paired, plain
        self.slots = 2 * paired + plain

    @cached_property
    def names(self) -> np.ndarray:
        return mix(np.arange(self.paired + self.plain, dtype=np.uint64) + np.uint64(self.band << 32), 4)

    def kept(self, size: int) -> int:
        """How many plain segments a set of this size keeps, as the smaller or the larger of a pair of this band."""
        partner = max(min(largest_partner(size), 2 ** (self.band + 1) - 1), size if size >> self.band else 0)
        return max(0, most_differences(size, partner) + 1 - 2 * self.paired)


def needed(band: int) -> int:
    """Differences that the segments of a band must be able to take, and one more."""
    return most_differences(2 ** (band + 1) - 1, 2 ** (band + 1) - 1) + 1


def choose_layout(band: int, documents: int) -> Layout:
    """The allocation of least cost: rows a document emits, plus the sets it would meet in segments that say nothing.

    A plain segment without shingles, or a neighbourhood that shrinks to nothing, is shared with every set of the band.
    """
    size, least = max(1, 3 * 2**band // 2), needed(band)
    best = None
    most = (least + 1) // 2
    for paired in sorted({*range(min(most, 16) + 1), *(most >> k for k in range(8))}):
        plain = math.ceil(SLACK * max(0, least - 2 * paired))
        layout = Layout(band, paired, plain)
        if not layout.slots:
            continue
        load = size / layout.slots
        kept = layout.kept(size)
        filled = plain * (1 - math.exp(-load))
        spread = math.sqrt(max(filled * math.exp(-load), 1e-9))
        # expected shortage of segments with shingles, as of a normal variable
        z = (kept - filled) / spread
        short = spread * (math.exp(-z * z / 2) / math.sqrt(2 * math.pi) + z * 0.5 * math.erfc(-z / math.sqrt(2))) if plain else 0.0
        void = paired * math.exp(-2 * load) * (1 + 2 * load)
        cost = kept + paired * (1 + 2 * load) + documents * (short + void)
        if best is None or cost < best[0]:
            best = (cost, layout)
    return best[1]


def signatures(sets: Sets, layouts: dict[int, Layout], frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signature, text) of all sets: in their own band and, where a larger partner may be there, in the next one."""
    place, value, rare = mix(sets.flat, 2), mix(sets.flat, 3), np.ones(len(sets.flat), dtype=bool)
    if len(frequent):
        rare = frequent[np.minimum(np.searchsorted(frequent, sets.flat), len(frequent) - 1)] != sets.flat
    signs, texts = [], []
    for step in (0, 1):
        chosen = []
        for i, n in enumerate(sets.sizes.tolist()):
            if n and (step == 0 or largest_partner(n) >> (band_of(n) + 1)) and (layout := layouts.get(band_of(n) + step)):
                chosen.append((i, layout, layout.kept(n)))
        if not chosen:
            continue
        text, count = np.array([i for i, _, _ in chosen]), np.array([len(x.names) for _, x, _ in chosen])
        first = np.cumsum(count) - count  # all segments of the chosen sets, end to end
        names = np.concatenate([x.names for _, x, _ in chosen])
        owner = np.repeat(np.arange(len(chosen)), count)
        paired = np.array([x.paired for _, x, _ in chosen])
        of = np.full(len(sets.sizes), -1)
        of[text] = np.arange(len(chosen))
        of = of[sets.text]
        inside = np.flatnonzero(of >= 0)
        of, own = of[inside], value[inside]
        segment = (place[inside] % np.array([x.slots for _, x, _ in chosen], dtype=np.uint64)[of]).astype(np.int64)
        segment = np.where(segment < 2 * paired[of], segment // 2, segment - paired[of])
        near = np.flatnonzero(segment < paired[of])
        segment += first[of]
        total = np.zeros(len(names), dtype=np.uint64)
        np.add.at(total, segment, own)
        sign = mix(total ^ names, 5)
        # paired segments: whole, and without each one of their shingles
        whole = np.flatnonzero(np.arange(len(names)) - first[owner] < paired[owner])
        signs += [sign[whole], mix((total[segment[near]] - own[near]) ^ names[segment[near]], 5)]
        texts += [text[owner[whole]], text[of[near]]]
        # plain segments: those with a rare shingle first, then by signature; each set keeps as many as it needs
        bare = np.ones(len(names), dtype=bool)
        bare[segment[rare[inside]]] = False
        plain = np.flatnonzero(np.arange(len(names)) - first[owner] >= paired[owner])
        plain = plain[np.lexsort((sign[plain], bare[plain], owner[plain]))]
        before = np.cumsum(count - paired) - (count - paired)
        kept = plain[np.arange(len(plain)) - before[owner[plain]] < np.array([k for _, _, k in chosen])[owner[plain]]]
        signs.append(sign[kept])
        texts.append(text[owner[kept]])
    if not signs:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    return np.concatenate(signs), np.concatenate(texts)


def may_link(a: str, b: str, words: int = PARITY_BITS // 64) -> Column:
    """Whether two sets can link, by their sizes (n_) and parities (bits_), which are so many 64-bit words."""
    differ = sum((F.bit_count(F.col(f"bits_{a}")[i].bitwiseXOR(F.col(f"bits_{b}")[i])) for i in range(words)), F.lit(0))
    return differ * (DENOMINATOR + NUMERATOR) <= (F.col(f"n_{a}") + F.col(f"n_{b}")) * (DENOMINATOR - NUMERATOR)


PROFILE = "kind int, doc_id long, n long, h1 long, h2 long, bits array<long>"
PROFILE_ARROW = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("bits", pa.list_(pa.int64()))])


def counted_often(seen: Sequence[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Values that stand in the arrays at least so often, and how often; counted by ranges, so that no second copy of all is made."""
    found = []
    for k in range(1 << RANGE_BITS):
        value, n = np.unique(np.concatenate([x[x >> np.uint64(64 - RANGE_BITS) == k] for x in seen]), return_counts=True)
        found.append((value[n >= least], n[n >= least]))
    return np.concatenate([v for v, _ in found]), np.concatenate([n for _, n in found])


def profile_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    rows = lambda *columns: pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, PROFILE_ARROW)], schema=PROFILE_ARROW)
    for batch in batches:
        seen = [np.zeros(0, dtype=np.uint64)]
        for part in parts(iter([batch])):
            sets = Sets(part.column("text").to_pylist(), hashes)
            h1, h2 = (sets.sums(mix(sets.flat, k)).astype(np.int64) for k in (6, 7))
            yield rows(np.zeros(part.num_rows, np.int32), part.column("doc_id"), sets.sizes.astype(np.int64), h1, h2, list(sets.parities()))
            seen.append(sets.flat)
        shingle, n = counted_often(seen, max(20, FREQUENT_SHARE * batch.num_rows))
        if len(shingle):
            nothing = [None] * len(shingle)
            yield rows(np.ones(len(n), np.int32), nothing, n.astype(np.int64), shingle.astype(np.int64), np.zeros(len(n), np.int64), nothing)


def profiles(docs: DataFrame) -> DataFrame:
    """(doc_id, n, h1, h2, bits) of rows (kind 0): size, two sums and parities of the set; and (n, h1) of frequent shingles (kind 1)."""
    return docs.select("doc_id", "text").mapInArrow(profile_rows, PROFILE)


def _of_ids(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Rows whose doc_id is (semi) or is not (anti) in ``ids``: shipped if counted small, else joined."""
    few = ids.count() <= SHIPPED_IDS
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", how)


def linked(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose whole shingle sets link. Only the texts of these ids are stored and joined."""
    ids = stored(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "jaccard-ids")
    texts = stored(_of_ids(docs, ids, "left_semi"), "jaccard-texts")
    side = lambda name: texts.select(F.col("doc_id").alias(name), F.col("text").alias(f"text_{name}"))
    both = pairs.join(side("b").hint("merge"), "b").join(side("a").hint("merge"), "a")

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for part in parts(batches):
            texts_a, texts_b = part.column("text_a").to_pylist(), part.column("text_b").to_pylist()
            number = {t: i for i, t in enumerate(dict.fromkeys([*texts_a, *texts_b]))}
            sets = Sets(list(number), hashes)
            keep = []
            for text_a, text_b in zip(texts_a, texts_b):
                a, b = sets[number[text_a]], sets[number[text_b]]
                common = len(a) + len(b) - len(np.union1d(a, b))
                keep.append(DENOMINATOR * common >= NUMERATOR * (len(a) + len(b) - common))
            yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "text_a", "text_b").mapInArrow(verified, "a long, b long")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    measured = stored(profiles(docs), "jaccard-sets")
    sets = measured.where("kind = 0")
    filled = sets.where("n > 0 AND doc_id IS NOT NULL").select("doc_id", "n", "h1", "h2", "bits")
    # stored, so that the join has two shuffled sides and Spark can split a set with very many copies
    same = filled.groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("a"), F.count("*").alias("m"))
    same = stored(same.where("m > 1").drop("m"), "jaccard-same")
    copies = stored(filled.drop("bits").join(same.hint("merge"), ["n", "h1", "h2"]).where("doc_id <> a").select("a", "doc_id").distinct(), "jaccard-copies")
    # an id whose rows differ stays: only one of its rows may be a copy
    plain = filled.groupBy("doc_id").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).where("low = high").select("doc_id")
    dropped = copies.select("doc_id").distinct().join(plain.hint("merge"), "doc_id", "left_semi")
    only = _of_ids(docs.where("doc_id IS NOT NULL"), stored(dropped, "jaccard-dropped"), "left_anti")

    frequent = stored(measured.where("kind = 1").groupBy("h1").agg(F.sum("n").alias("n")), "jaccard-frequent")
    frequent = most_frequent(frequent, "n", FREQUENT_MOST)
    frequent = np.sort(np.array([r["h1"] for r in frequent.select("h1").collect()], dtype=np.int64).astype(np.uint64))
    bands = filled.groupBy(F.floor(F.log2("n") + 1e-12).cast("int").alias("band")).agg(F.count("*").alias("n")).collect()
    population = {r["band"]: r["n"] for r in bands}
    wanted = {b + d for b in population for d in (0, 1)}
    layouts = {b: choose_layout(b, population.get(b, 0)) for b in sorted(wanted) if b in population}

    def emitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for part in parts(batches):
            signs, text = signatures(Sets(part.column("text").to_pylist(), hashes), layouts, frequent)
            yield pa.RecordBatch.from_arrays([pa.array(signs.astype(np.int64)), part.column("doc_id").take(pa.array(text))], ["sign", "doc_id"])

    emit = lambda: only.mapInArrow(emitted, "sign long, doc_id long")
    # Groups of several sets, found by counts that are combined before the shuffle; then their members.
    groups = emit().groupBy("sign").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n"))
    groups = stored(groups.where("low < high").select("sign", "n"), "jaccard-groups")
    found = stored(emit().join(groups.hint("merge"), "sign"), "jaccard-found")
    # The leader of a group is the member that shares most with others in all of its groups: near it, most links are found.
    central = found.groupBy("doc_id").agg(F.sum("n").alias("shared"))
    best = F.max(F.struct("shared", (-F.col("doc_id")).alias("i"))).alias("best")
    leaders = found.join(central.hint("merge"), "doc_id").groupBy("sign").agg(best).select("sign", (-F.col("best.i")).alias("a"))
    members = stored(found.join(stored(leaders, "jaccard-leaders").hint("merge"), "sign").select("sign", "doc_id", "a"), "jaccard-members")
    sketch = lambda name: filled.select(F.col("doc_id").alias(name), F.col("n").alias(f"n_{name}"), F.col("bits").alias(f"bits_{name}"))
    stars = members.where("doc_id <> a").select("a", F.col("doc_id").alias("b")).distinct()
    possible = lambda pairs: pairs.join(sketch("a").hint("merge"), "a").join(sketch("b").hint("merge"), "b").where(may_link("a", "b")).select("a", "b").distinct()
    first = stored(linked(stored(possible(stars), "jaccard-stars"), docs), "jaccard-links")
    copy_links = copies.select("a", F.col("doc_id").alias("b"))
    components = stored(connected_components(first.union(copy_links)), "jaccard-components")

    # Members that are still apart: only groups of three and more can hold such pairs besides those with their leader.
    part = F.coalesce("component", "doc_id")
    placed = members.join(components.select(F.col("node").alias("doc_id"), "component").hint("merge"), "doc_id", "left").select("sign", "doc_id", "a", part.alias("part"))
    apart = placed.groupBy("sign").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count("*").alias("n")).where("low < high AND n > 2").select("sign")
    rest = placed.where("doc_id <> a").join(apart.hint("merge"), "sign")
    # parities folded to half their places are parities too; the shorter condition is one that the JVM compiles
    half = PARITY_BITS // 128
    folded = F.zip_with(F.slice("bits_x", 1, half), F.slice("bits_x", half + 1, half), lambda a, b: a.bitwiseXOR(b))
    rest = rest.withColumnRenamed("doc_id", "x").join(sketch("x").hint("merge"), "x").withColumn("bits_x", folded)
    rest = stored(rest, "jaccard-rest")
    other = rest.select("sign", F.col("x").alias("y"), F.col("part").alias("part_y"), F.col("n_x").alias("n_y"), F.col("bits_x").alias("bits_y"))
    # a join of two shuffled sides: Spark splits large groups, and only pairs that may link leave it
    more = rest.join(other.hint("merge"), (rest["sign"] == other["sign"]) & (F.col("x") < F.col("y")) & (F.col("part") != F.col("part_y")) & may_link("x", "y", half))
    more = stored(more.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "jaccard-near")
    more = stored(possible(more), "jaccard-more")
    if not more.isEmpty():
        second = stored(linked(more, docs), "jaccard-links")
        components = stored(connected_components(first.union(copy_links).union(second)), "jaccard-components")
    out = sets.join(components.select(F.col("node").alias("doc_id"), "component").hint("merge"), "doc_id", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def representatives(docs: DataFrame) -> DataFrame:
    """One row of each component, its smallest id, with all columns; rows without an id stay. No text is shuffled."""
    dropped = stored(classes(docs).where("component_id <> doc_id").select("doc_id").distinct(), "jaccard-dropped")
    return _of_ids(docs, dropped, "left_anti")


CLASSES_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM w),
n AS (SELECT doc_id, count(g) AS n FROM documents LEFT JOIN s USING (doc_id) GROUP BY 1),
edges AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id JOIN n nx ON nx.doc_id = x.doc_id JOIN n ny ON ny.doc_id = y.doc_id
  GROUP BY 1, 2 HAVING 100 * count(*) >= 80 * (any_value(nx.n) + any_value(ny.n) - count(*))),
walk(node, reached) AS (SELECT doc_id, doc_id FROM documents UNION SELECT walk.node, edges.b FROM walk JOIN edges ON edges.a = walk.reached)
SELECT node AS doc_id, any_value(n) AS n_shingles, min(reached) AS component_id FROM walk JOIN n ON n.doc_id = node GROUP BY node
"""
