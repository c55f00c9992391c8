"""Near-duplicate clusters, exact for the threshold, without writing out pairs.

1. Equal payloads are one representative; copies only get an edge to it.
2. Dense vectors near one of a bounded number of leaders are linked to it and need no comparison with each other; the rest
   meets the pieces of balls that it can reach (``vector_links``).
3. Sparse vectors of texts stay in packed blocks of rows. Every two blocks meet without a shuffle, add up what pairs share over
   their rare terms, and compare what can still reach the threshold; the work is quadratic, by a small factor (``text_links``).
4. Clusters are the connected components of the links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions.text import dedupe_key, text_key
from corpusmill.operators.graph import connected_components
from corpusmill.operators.term_blocks import cells_by_row, term_blocks, totals_and_names, with_totals
from corpusmill.operators.term_blocks import written as _written
from corpusmill.operators.vector_cells import ROWS, VectorCells, matrix, means_of, sample_of, squared_distances
from corpusmill.session import cut_lineage

EDGES = "a long, b long"


def clusters(copies: DataFrame, links: DataFrame) -> DataFrame:
    """(item_id, cluster) of everything that has a partner; a cluster is named by its smallest id."""
    return connected_components(copies.union(links)).select(F.col("node").alias("item_id"), F.col("component").alias("cluster"))


# ---- dense vectors ----


def vector_copies(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(representatives, edges from every further copy to its representative)."""
    keyed = vectors.withColumn("_k", F.struct(F.xxhash64("payload"), F.xxhash64(F.reverse("payload")), F.size("payload")))
    first = keyed.groupBy("_k").agg(F.min("item_id").alias("first_id"))
    joined = keyed.join(first, "_k")
    edges = joined.filter("item_id <> first_id").select(F.col("item_id").alias("a"), F.col("first_id").alias("b"))
    return joined.filter("item_id = first_id").select("item_id", "payload"), edges


MOST_LEADERS = 1024
MOST_LINKS = 2_000_000  # links that a task holds before it folds them


def _leaders(units: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of members of the corpus in its dense places, at most MOST_LEADERS and the root of its size."""
    sample = sample_of(units, n)
    ids, vectors = sample.column("item_id").to_numpy(), matrix(sample.column("payload"))
    centres = means_of(vectors, min(MOST_LEADERS, max(1, int(n**0.5)), len(vectors)))
    at = np.unique(squared_distances(vectors, centres).argmin(axis=0))
    return ids[at], vectors[at]


def _homes(pairs: list[tuple[int, int]], n: int) -> list[int]:
    """Number of the component of each leader, named by its smallest one."""
    home = list(range(n))

    def root(i: int) -> int:
        while home[i] != i:
            i = home[i]
        return i

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        home[y] = x
    return [root(i) for i in range(n)]


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from every node to the smallest one of its component: as few as nodes, whatever the number of given links."""
    nodes, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = code[: len(a)], code[len(a) :]
    home = np.arange(len(nodes))
    while len(x):
        least = np.minimum(home[x], home[y])
        for side in (x, y):
            np.minimum.at(home, home[side], least)
        while not np.array_equal(further := home[home], home):
            home = further
        apart = home[x] != home[y]
        x, y = x[apart], y[apart]
    linked = home != np.arange(len(nodes))
    return nodes[linked], nodes[home[linked]]


def vector_links(units: DataFrame, threshold: float) -> DataFrame:
    """Edges that connect exactly what pairs of unit vectors (item_id, payload) above the threshold connect.

    Every vector is linked to a leader above the threshold where there is one. Leaders that share a vector are connected,
    and what has connected leaders needs no comparison with each other: a group of near copies costs one pass. All others
    visit the pieces of balls around centres that their own ball of the threshold's radius reaches.
    """
    n = units.count()
    if not n:
        return units.sparkSession.createDataFrame([], EDGES)
    reach = float(np.sqrt(max(0.0, 2.0 - 2.0 * threshold))) + 1e-6
    leader_ids, leaders = _leaders(units, n)

    def meet(batches):
        for batch in batches:
            near = matrix(batch.column("payload")) @ leaders.T > threshold
            met = pa.array([np.flatnonzero(row) for row in near], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, met], ["item_id", "payload", "met"])

    met = cut_lineage(units.select("item_id", "payload").mapInArrow(meet, "item_id long, payload array<double>, met array<int>"))
    together = F.explode(F.arrays_zip(F.slice("met", 1, F.greatest(F.size("met") - 1, F.lit(0))).alias("a"), F.slice("met", 2, F.size("met")).alias("b")))
    pairs = met.filter(F.size("met") > 1).select(together.alias("p")).select("p.a", "p.b").distinct()  # pairs of leaders
    homes = _homes([(r["a"], r["b"]) for r in pairs.collect()], len(leader_ids))
    spelled = lambda values: F.element_at(F.array(*map(F.lit, values)), F.get("met", F.lit(0)) + 1)
    led = met.filter(F.size("met") > 0)
    to_leader = led.select(F.col("item_id").alias("a"), spelled([int(i) for i in leader_ids]).alias("b"))
    joined = units.sparkSession.createDataFrame([(int(leader_ids[i]), int(leader_ids[h])) for i, h in enumerate(homes)], EDGES)
    home = F.when(F.size("met") > 0, spelled(homes).cast("string"))
    cells = VectorCells(met.select(home.alias("partition_key"), "item_id", "payload"))

    pieces = cells.pieces

    def sent(batch: pa.RecordBatch, gaps: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        # of two regions only the lower one visits; what has connected leaders needs no comparison
        own, known = batch.column("own").to_numpy(), batch.column("known").to_numpy()
        return (gaps <= reach * reach) & (pieces.region[None, :] >= own[:, None]) & (pieces.key[None, :] != known[:, None])

    def compare(asked: pa.Table, items: pa.Table) -> pa.Table:
        a, b, size = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        if asked.num_rows and items.num_rows:
            order = np.argsort(items.column("place").to_numpy(), kind="stable")
            place, right, y = items.column("place").to_numpy()[order], items.column("item_id").to_numpy()[order], matrix(items.column("payload"))[order]
            left, known, x = asked.column("query_id").to_numpy(), asked.column("known").to_numpy(), matrix(asked.column("payload"))
            inside, spans = np.unique(place), pieces.spans(place)
            rows = max(1, min(ROWS, 4_000_000 // len(inside)))
            for start in range(0, len(left), rows):
                gaps = pieces.gaps(x[start : start + rows], inside)
                for first, end in spans:
                    of = np.searchsorted(inside, [place[first], place[end - 1]])
                    near = (gaps[:, of[0] : of[1] + 1].min(axis=1) <= reach * reach) & (known[start : start + rows] != pieces.key[place[first]])
                    open_ = start + np.flatnonzero(near)
                    at, column = np.nonzero(x[open_] @ y[first:end].T > threshold)
                    a.append(left[open_[at]])
                    b.append(right[first + column])
                    size += len(at)
                    if size > MOST_LINKS:
                        a, b = ([side] for side in _stars(np.concatenate(a), np.concatenate(b)))
                        size = 0
        a, b = _stars(np.concatenate(a), np.concatenate(b))
        return pa.table([a, b], ["a", "b"])

    numbered = cells.regional()
    known = F.when(F.col("key").isin([i for i, key in enumerate(cells.keys) if key]), F.col("key")).otherwise(-1)
    asking = numbered.select(F.col("item_id").alias("query_id"), "payload", F.col("region").alias("own"), known.alias("known"))
    found = cells.met(cells.in_regions(asking, sent), n, compare, EDGES)
    return found.union(to_leader).union(joined).filter("a <> b")


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.99) -> DataFrame:
    """Clusters of (item_id, payload array) with cosine above the threshold, by connection."""
    doubles = F.transform("payload", lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(doubles, F.lit(0.0), lambda acc, x: acc + x * x))
    # a zero vector has no cosine, so neither it nor its copies are in a cluster
    distinct, copies = vector_copies(vectors.select("item_id", "payload").filter(norm > 0))
    scaled = distinct.withColumn("norm", norm).withColumn("unit", F.transform("payload", lambda x: x.cast("double") / F.col("norm")))
    units = cut_lineage(scaled.select(F.col("item_id").cast("long").alias("item_id"), F.col("unit").alias("payload")))
    return clusters(copies, vector_links(units, threshold))


# ---- texts ----


# members of a block of postings that can be paired with each other
LONG_BLOCK = 256


def _by_length(postings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of blocks that can be paired, and of longer ones; blocks of one member are left out, and never written."""
    sizes = postings.groupBy("block").agg(F.count("*").alias("n"))
    sized = _written(postings.join(sizes.filter("n > 1"), "block"), "postings")
    return sized.filter(F.col("n") <= LONG_BLOCK).drop("n"), sized.filter(F.col("n") > LONG_BLOCK).drop("n")


STRIP_ROWS = 256  # rows of a block that are compared with another block at once
MOST_PRODUCTS = 500_000  # products that are held at once
HELD_BLOCKS = 2  # blocks that a task keeps ready
MARGIN = 0.03  # what a pair has to gain over its postings
CLOSE = 1e-5  # weights are rounded to 32 bits where they only rule out pairs

TEXT_BLOCK = T.StructType(
    [
        T.StructField("block", T.LongType()),
        T.StructField("ids", T.BinaryType()),  # int64 a row
        T.StructField("rest", T.BinaryType()),  # float64 a row: length of the vector behind its postings
        T.StructField("norms", T.BinaryType()),  # float64 a row
        T.StructField("terms", T.BinaryType()),  # int64, sorted; terms that only one text has are left out
        T.StructField("idf", T.BinaryType()),  # float64 a term
        T.StructField("ends", T.BinaryType()),  # int32 a row: end of its cells
        T.StructField("codes", T.BinaryType()),  # int32 a cell
        T.StructField("posted", T.BinaryType()),  # bool a cell: whether it is a posting
        T.StructField("tf", T.BinaryType()),  # a cell, in as few bytes as the largest one takes
    ]
)


def one_row_an_item(texts: DataFrame) -> tuple[DataFrame, DataFrame | None, int | None]:
    """((item_id, key, n, text), edges from further copies, number of texts) of (item_id, text); ``text`` is normalised.

    ``n`` says how often a row counts. Where every item is one row that is once, and copies are left for later. Otherwise texts of
    one item that stand equally often are one text; if there are more, a row without an id counts each of them and one that counts
    nothing has them all.
    """
    keyed = texts.select("item_id", dedupe_key(F.col("text")).alias("text")).filter("text <> ''")
    keyed = keyed.withColumn("key", text_key(F.col("text")))
    if texts.groupBy("item_id").count().filter("count > 1").isEmpty():
        return keyed.withColumn("n", F.lit(1).cast("long")), None, None
    distinct = keyed.groupBy("key").agg(F.min("item_id").alias("item_id"), F.count("*").alias("n"), F.min_by("text", "item_id").alias("text"))
    distinct = _written(distinct, "texts")
    copies = _copies(keyed.select("item_id", "key"), distinct.select("key", F.col("item_id").alias("first_id")))
    joined = lambda c: F.array_join(F.array_sort(c), " ")
    equal = distinct.groupBy("item_id", "n").agg(F.min("key").alias("key"), joined(F.collect_list("text")).alias("text"))
    own = equal.groupBy("item_id").agg(F.collect_list(F.struct("key", "n", "text")).alias("g"))
    none, parts = F.lit(None).cast("long"), F.col("g")
    row = lambda i, key, n, text: F.struct(i.alias("item_id"), key.alias("key"), n.alias("n"), text.alias("text"))
    whole = row(F.col("item_id"), F.concat(F.lit("+"), parts[0]["key"]), F.lit(0).cast("long"), joined(parts["text"]))
    rows = F.when(F.size("g") == 1, F.transform("g", lambda g: row(F.col("item_id"), g["key"], g["n"], g["text"]))).otherwise(
        F.array_append(F.transform("g", lambda g: row(none, g["key"], g["n"], g["text"])), whole)
    )
    return own.select(F.explode(rows).alias("r")).select("r.*"), copies, distinct.agg(F.sum("n")).first()[0] or 0


def _copies(keyed: DataFrame, first: DataFrame) -> DataFrame:
    met = keyed.join(first, "key").filter("item_id <> first_id")
    return met.select(F.col("item_id").alias("a"), F.col("first_id").alias("b"))


def tfidf_blocks(texts: DataFrame, max_features: int | None = None, n_docs: int | None = None) -> DataFrame:
    """Sparse TF-IDF of (item_id, key, n, text) in blocks of term_blocks: counts, ``totals`` (df) and ``n_docs``.

    Raw counts, smoothed idf ln((1+n)/(1+df))+1, unit length (``text_blocks``). A text counts ``n`` times. Features are all terms; a
    number takes only so many of the most frequent ones.
    """
    words, only = F.regexp_extract_all("text", F.lit(r"([\p{L}\p{N}_]{2,})")), None
    if max_features:
        each = texts.select("n", F.explode(words).alias("word")).groupBy("word").agg(F.sum("n").alias("total"))
        only = [r["h"] for r in each.orderBy(F.desc("total"), "word").limit(max_features).select(F.xxhash64("word").alias("h")).collect()]
    blocks = term_blocks(texts.select("item_id", "key", "n", F.transform(words, lambda w: F.xxhash64(w)).alias("words")), only=only)
    if n_docs is None:
        n_docs = blocks.agg(F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda acc, x: acc + x))).first()[0] or 0
    return with_totals(blocks).withColumn("n_docs", F.lit(n_docs))


def packed(values: np.ndarray, kind: str) -> bytes:
    return np.ascontiguousarray(values, kind).tobytes()


def narrow(values: np.ndarray) -> bytes:
    """Numbers from 0 on in as few bytes as the largest one takes."""
    return packed(values, f"<u{np.min_scalar_type(values.max(initial=0)).itemsize}")


def unpacked(cell: pa.Scalar, kind: str) -> np.ndarray:
    return np.frombuffer(cell.as_buffer() or b"", kind).copy()  # a view would hold the whole batch


def text_blocks(blocks: DataFrame, threshold: float) -> DataFrame:
    """Written blocks as TEXT_BLOCK: unit vectors and which of their cells are postings.

    Terms go from rare to common; a vector is posted up to the term from which on what is left of it is shorter than the threshold
    less MARGIN. A term that stands once is never posted.
    """
    least = threshold - CLOSE - MARGIN

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                yield ready(batch.slice(i, 1))

    def ready(row: pa.RecordBatch) -> pa.RecordBatch:
        ids = row["item_id"][0].values
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        (totals, names), (owner, codes, tf) = totals_and_names(row), cells_by_row(row)
        idf = np.log((1 + row["n_docs"][0].as_py()) / (1 + totals)) + 1
        raw = tf * idf[codes]
        squares = raw * raw
        lengths = np.bincount(owner, squares, len(ids))
        place = np.empty(len(totals), np.int64)
        place[np.argsort(totals, kind="stable")] = np.arange(len(totals))  # from rare to common, equal ones by hash
        order = np.argsort(owner * np.int64(len(totals) + 1) + place[codes])
        through = np.cumsum(squares[order])
        first = np.searchsorted(owner, np.arange(len(ids)))
        before = np.concatenate([[0.0], through])[first]
        rest = np.sqrt(np.maximum(1 - (through - squares[order] - before[owner]) / lengths[owner], 0))
        open_ = rest >= least  # in front of the others of its row
        behind = np.zeros(len(ids))
        np.maximum.at(behind, owner[~open_], rest[~open_])  # the longest one is the first one behind the postings
        posted = np.zeros(len(order), bool)
        posted[order] = open_
        shared = totals > 1  # the others are in no other text
        posted &= known[owner]
        kept = shared[codes]
        codes, tf, posted = (np.cumsum(shared) - 1)[codes[kept]], tf[kept], posted[kept]
        ends = np.cumsum(np.bincount(owner[kept], minlength=len(ids)))
        return pa.RecordBatch.from_arrays(
            [
                row["block"],
                *(
                    pa.array([packed(v, k)], pa.binary())
                    for v, k in (
                        (ids.fill_null(0).to_numpy(), "<i8"), (behind, "<f8"), (np.sqrt(lengths), "<f8"), (names, "<i8"),
                        (idf[shared], "<f8"), (ends, "<i4"), (codes, "<i4"), (posted, "?"),
                    )
                ),
                pa.array([narrow(tf)], pa.binary()),
            ],
            TEXT_BLOCK.names,
        )

    return _written(blocks.mapInArrow(run, TEXT_BLOCK), "text-blocks")


class _Block:
    """A TEXT_BLOCK row ready to be compared: postings by row and by term, cells by row."""

    def __init__(self, row: pa.RecordBatch, side: str):
        get = lambda name, kind: unpacked(row[f"{side}_{name}"][0], kind)
        self.ids, self.rest, self.terms = get("ids", "<i8"), get("rest", "<f8"), get("terms", "<i8")
        self.n, self.ends, self.codes = len(self.ids), get("ends", "<i4"), get("codes", "<i4")
        sizes = np.diff(self.ends, prepend=0)
        self.starts, owner = self.ends - sizes, np.repeat(np.arange(self.n, dtype=np.int32), sizes)
        width = len(row[f"{side}_tf"][0].as_buffer()) // max(len(self.codes), 1)
        self.weight = get("tf", f"<u{max(width, 1)}") * get("idf", "<f8")[self.codes] / get("norms", "<f8")[owner]
        posted = get("posted", "?")
        self.rows, at, self.short = owner[posted], self.codes[posted], self.weight[posted].astype("float32")
        self.row_ends = np.cumsum(np.bincount(self.rows, minlength=self.n))
        counts = np.bincount(at, minlength=len(self.terms))
        used = np.flatnonzero(counts)
        self.posted_terms, self.at = self.terms[used], np.searchsorted(used, at).astype("int32")  # place of a posting's term
        self.term_ends = np.cumsum(counts[used])
        order = np.argsort(at, kind="stable")
        self.by_term, self.by_term_weight = self.rows[order], self.short[order]

    def cells(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the cells of the given rows, and where each row begins."""
        sizes = (self.ends - self.starts)[rows]
        begins = np.cumsum(sizes) - sizes
        return np.repeat(self.starts[rows] - begins, sizes) + np.arange(sizes.sum()), begins


def _pairs(x: _Block, y: _Block, same: bool, threshold: float):
    """Rows (i, j) of pairs above the threshold."""
    _, of_x, of_y = np.intersect1d(x.posted_terms, y.posted_terms, assume_unique=True, return_indices=True)
    met = np.zeros(len(x.posted_terms), np.int64)  # postings in y of a term of x
    first = np.zeros(len(x.posted_terms), np.int64)
    sizes = np.diff(y.term_ends, prepend=0)
    met[of_x], first[of_x] = sizes[of_y], (y.term_ends - sizes)[of_y]
    named, dense = None, np.zeros(len(y.terms))
    least = threshold - CLOSE - max(x.rest.max(initial=0.0), y.rest.max(initial=0.0))
    for start in range(0, x.n, STRIP_ROWS):
        end = min(start + STRIP_ROWS, x.n)
        span = slice(x.row_ends[start - 1] if start else 0, x.row_ends[end - 1])
        times = met[x.at[span]]
        kept = np.flatnonzero(times) + span.start
        times = times[kept - span.start]
        if not len(kept):
            continue
        gained = np.zeros((end - start) * y.n)
        total = np.cumsum(times)
        cuts = np.searchsorted(total, np.arange(MOST_PRODUCTS, total[-1], MOST_PRODUCTS))
        for part in np.split(np.arange(len(kept)), np.unique(cuts)):
            if not len(part):
                continue
            mine, n = kept[part], times[part]
            begins = np.cumsum(n) - n
            at = np.repeat(first[x.at[mine]] - begins, n) + np.arange(n.sum())
            cell = np.repeat((x.rows[mine] - start) * np.int64(y.n), n) + y.by_term[at]
            gained += np.bincount(cell, np.repeat(x.short[mine], n) * y.by_term_weight[at], len(gained))
        # terms behind the postings of one of both bring no more than what is left of it
        found = np.flatnonzero(gained > max(least, 0.0))
        i, j = np.divmod(found, y.n)
        i += start
        near = gained[found] + np.maximum(x.rest[i], y.rest[j]) > threshold - CLOSE
        i, j = i[near], j[near]
        if same:
            i, j = i[i < j], j[i < j]
        if not len(i):
            continue
        if named is None:
            named = np.searchsorted(y.terms, x.terms)
            named[named == len(y.terms)] = 0
            named = np.where(y.terms[named] == x.terms, named, -1)
        for row in np.unique(i):
            others = j[slice(*np.searchsorted(i, [row, row + 1]))]
            own = slice(x.starts[row], x.ends[row])
            place, weight = named[x.codes[own]], x.weight[own]
            place, weight = place[place >= 0], weight[place >= 0]
            dense[place] = weight
            at, begins = y.cells(others)
            close = np.add.reduceat(dense[y.codes[at]] * y.weight[at], begins) > threshold
            dense[place] = 0.0
            if close.any():
                yield np.full(int(close.sum()), row), others[close]


def text_links(blocks: DataFrame, threshold: float) -> DataFrame:
    """Edges that connect exactly what pairs of written TEXT_BLOCK rows above the threshold connect.

    Every two blocks meet, as they are read and without a shuffle. Over the posted terms pairs add up what they share; behind the
    postings a pair cannot gain more than what is left of one of its vectors, and only pairs that can still reach the
    threshold are compared by all their terms. A task holds two blocks, and returns as many links as they have rows at most.
    """
    sides = [blocks.select(*[F.col(c).alias(f"{side}_{c}") for c in blocks.columns]) for side in ("x", "y")]
    met = sides[0].join(sides[1], F.col("x_block") <= F.col("y_block"))

    def compare(batches):
        held: dict[int, _Block] = {}

        def ready(row: pa.RecordBatch, side: str) -> _Block:
            number = row[f"{side}_block"][0].as_py()
            block = held.pop(number, None)
            if block is None:
                while len(held) >= HELD_BLOCKS:
                    del held[next(iter(held))]  # the oldest one goes before another one is made
                block = _Block(row, side)
            held[number] = block  # the last one is the newest
            return block

        for batch in batches:
            for r in range(batch.num_rows):
                row, x, y = batch.slice(r, 1), None, None
                x, y = ready(row, "x"), ready(row, "y")
                a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                size = 0
                for i, j in _pairs(x, y, x is y, threshold):
                    a.append(x.ids[i])
                    b.append(y.ids[j])
                    size += len(i)
                    if size > MOST_LINKS:
                        a, b = ([side] for side in _stars(np.concatenate(a), np.concatenate(b)))
                        size = 0
                a, b = _stars(np.concatenate(a), np.concatenate(b))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return met.mapInArrow(compare, EDGES)


def near_duplicate_texts(texts: DataFrame, threshold: float = 0.8, max_features: int | None = None) -> DataFrame:
    """Clusters of (item_id, text) with TF-IDF cosine above the threshold, by connection."""
    items, copies, n_docs = one_row_an_item(texts)
    blocks = tfidf_blocks(items, max_features, n_docs)
    if copies is None:
        keyed = blocks.select(F.explode(F.arrays_zip("item_id", "key")).alias("r")).select("r.item_id", "r.key")
        copies = _copies(keyed, keyed.groupBy("key").agg(F.min("item_id").alias("first_id")))
    return clusters(copies, text_links(text_blocks(blocks, threshold), threshold))


def exact_duplicates(texts: DataFrame) -> DataFrame:
    """Items whose normalised text stands more than once: item_id, cluster (smallest id), n_copies; blank texts are left out."""
    keyed = texts.select("item_id", dedupe_key(F.col("text")).alias("_t")).filter("_t <> ''").select("item_id", text_key(F.col("_t")).alias("_k"))
    groups = keyed.groupBy("_k").agg(F.min("item_id").alias("cluster"), F.count("*").alias("n_copies")).filter("n_copies > 1")
    return keyed.join(groups, "_k").drop("_k")
