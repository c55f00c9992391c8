"""Mixing sources to target weights: min-cost flow for overlapping sources.

Documents are added up by membership pattern (the set of sources they belong to). Each pattern offers its words once
for nothing, a second time at cost 1 and a third time at cost 3; the cheapest flow routes this capacity to the quotas
of the sources. Documents are then taken whole: every pattern is read as often as its flow fills it, and the rest goes
to the documents with the smallest seeded tickets.

Null texts have size 0 and are taken 0 times; a null source is a source of its own, last in order; repeated rows are
documents of their own with one ticket; an empty table gives an empty result. Extra columns are ignored by ``taken``.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import fresh, stored, whole_text, word_count

REPEAT_COSTS = (0, 1, 3)  # of the first, second and third reading of a word
SHIPPED_PATTERNS = 100_000  # a plan of at most so many rows is shipped to every task
BIN_DIGITS = (2, 4)
PLAN = "pattern array<string>, source_size long, target double, readings long, rest long, prefix string, before long"


def quotas(sizes: Sequence[int], weights: Sequence[float], most: int = len(REPEAT_COSTS)) -> list[float]:
    """Share all words by weight; a source over ``most`` times its size stops there, its excess is shared again.

    Sources stop in the order of size by weight, so one level decides for all that are left.
    """
    order = sorted(range(len(sizes)), key=lambda i: (most * sizes[i] / weights[i], i))
    words, weight = sum(sizes), sum(weights)
    out = [0.0] * len(sizes)
    for n, i in enumerate(order):
        level = words / weight
        if most * sizes[i] > level * weights[i]:
            for j in order[n:]:
                out[j] = level * weights[j]
            break
        out[i] = float(most * sizes[i])
        words -= most * sizes[i]
        weight -= weights[i]
    return out


def cheapest_flow(capacity: dict[tuple, int], quota: dict) -> dict[tuple[tuple, object], int]:
    """Words that each pattern gives to each of its sources: successive shortest paths with potentials.

    Nodes are patterns and sources only, so its size depends on the number of patterns, never on documents.
    """
    patterns, sources = list(capacity), list(quota)
    start, end = 0, 1 + len(patterns) + len(sources)
    graph: list[list[list]] = [[] for _ in range(end + 1)]  # arcs: [to, room, cost, index of the way back]

    def arc(a: int, b: int, room: int, cost: int) -> list:
        graph[a].append([b, room, cost, len(graph[b])])
        graph[b].append([a, 0, -cost, len(graph[a]) - 1])
        return graph[a][-1]

    node = {s: 1 + len(patterns) + i for i, s in enumerate(sources)}
    routes = {}
    for i, p in enumerate(patterns):
        for cost in REPEAT_COSTS:
            arc(start, 1 + i, capacity[p], cost)
        for s in p:
            routes[p, s] = (arc(1 + i, node[s], room := len(REPEAT_COSTS) * capacity[p], 0), room)
    for s in sources:
        arc(node[s], end, quota[s], 0)
    height = [0] * (end + 1)
    while True:
        far, via, queue = [None] * (end + 1), [None] * (end + 1), [(0, start)]
        far[start] = 0
        while queue:
            d, a = heapq.heappop(queue)
            if d > far[a]:
                continue
            for way in graph[a]:
                b, room, cost, _ = way
                if room > 0 and (far[b] is None or d + cost + height[a] - height[b] < far[b]):
                    far[b], via[b] = d + cost + height[a] - height[b], (a, way)
                    heapq.heappush(queue, (far[b], b))
        if far[end] is None:
            break
        for a, d in enumerate(far):
            height[a] += d if d is not None else 0
        path, b = [], end
        while b != start:
            a, way = via[b]
            path.append(way)
            b = a
        push = min(way[1] for way in path)
        for way in path:
            way[1] -= push
            graph[way[0]][way[3]][1] += push
    return {k: room - way[1] for k, (way, room) in routes.items()}


def ticket(seed: str = "mix") -> Column:
    """The seeded place of a document: hexadecimal, the same in every run."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)


def taken(docs: DataFrame, seed: str = "mix", membership: Column | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row.

    ``membership`` is the sorted array of the sources of a row (default: its one ``source``). For a row of several
    sources, source_size and target are those of the first.
    """
    members = F.array(F.col("source").cast("string")) if membership is None else membership
    sized = docs.select("doc_id", members.alias("pattern"), word_count(whole_text()).alias("size"), ticket(seed).alias("ticket"))
    sized = stored(sized, "mix-sizes")

    # One row a pattern reaches the driver: the flow is worked out on sums.
    totals = {tuple(r["pattern"]): int(r["words"] or 0) for r in sized.groupBy("pattern").agg(F.sum("size").alias("words")).collect()}
    names = sorted({s for p in totals for s in p}, key=lambda s: (s is None, s or ""))
    source_size = {s: sum(w for p, w in totals.items() if s in p) for s in names}
    target = dict(zip(names, quotas([source_size[s] for s in names], [1 + i % 3 for i in range(len(names))])))
    flow = cheapest_flow(totals, {s: round(t) for s, t in target.items()})
    amount = {p: sum(flow[p, s] for s in p) for p in totals}
    plan = [(list(p), source_size[p[0]], target[p[0]], amount[p] // w if w else 0, amount[p] % w if w else 0, "", 0) for p, w in totals.items() if p]

    # The rest is filled in the order of tickets. It runs out in one of 256 bins, and there in one of 256 smaller ones.
    for digits in BIN_DIGITS:
        bins = _with_plan(sized, plan).where((F.col("rest") > 0) & F.col("ticket").startswith(F.col("prefix")))
        bins = bins.groupBy("pattern", "rest", "before", F.substring("ticket", 1, digits).alias("bin")).agg(F.sum("size").alias("words"))
        bins = bins.withColumn("upto", F.col("before") + F.sum("words").over(Window.partitionBy("pattern").orderBy("bin")))
        ends = bins.where((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("words") < F.col("rest")))
        found = {tuple(r["pattern"]): (r["bin"], r["upto"] - r["words"]) for r in ends.collect()}  # a row a pattern
        plan = [(*p[:5], *found.get(tuple(p[0]), p[5:])) for p in plan]

    rows = _with_plan(sized, plan)
    place = F.substring("ticket", 1, BIN_DIGITS[-1])
    on_border = (F.col("rest") > 0) & (place == F.col("prefix"))
    # only documents of the one small bin are put in order: 1/65536 of a pattern
    upto = F.sum("size").over(Window.partitionBy("pattern").orderBy("ticket", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0))
    border = rows.where(on_border).withColumn("extra", (F.col("before") + upto - F.col("size") / 2 <= F.col("rest")).cast("long"))
    others = rows.where(~on_border).withColumn("extra", ((F.col("rest") > 0) & (place < F.col("prefix"))).cast("long"))
    return border.unionByName(others).select("doc_id", "size", "source_size", "target", (F.col("size") * (F.col("readings") + F.col("extra"))).alias("taken"))


def _with_plan(sized: DataFrame, plan: list[tuple]) -> DataFrame:
    """Each row with the plan of its pattern. A row of no source gets an empty plan."""
    n, plan = len(plan), sized.sparkSession.createDataFrame([*plan, ([], 0, 0.0, 0, 0, "", 0)], PLAN)
    plan = F.broadcast(plan) if n <= SHIPPED_PATTERNS else plan
    key = lambda column: F.transform(column, _plain)
    return sized.join(plan.withColumnRenamed("pattern", "sources"), key(F.col("pattern")) == key(F.col("sources")), "left").drop("sources")


def _plain(source: Column) -> Column:
    """A null source as a value that joins."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit("null"))


def mixed_rows(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """The rows of the mix, each as often as it is taken, with all their columns. Rows of one id are read alike."""
    mark, key, own = fresh(docs, "readings"), fresh(docs, "mix_id"), fresh(docs, "own_id")
    name = lambda: F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    plan = taken(docs, seed).where(F.col("taken") > 0).groupBy(name().alias(key)).agg(F.max(F.col("taken") / F.col("size")).cast("int").alias(mark))
    kept = docs.withColumn(own, name()).join(plan.hint("merge"), F.col(own) == F.col(key)).drop(key, own)
    return kept.withColumn(mark, F.explode(F.sequence(F.lit(1), F.col(mark)))).drop(mark)


TAKEN_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, sha256('mix:' || doc_id) AS ticket FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS words, (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1 AS weight FROM d GROUP BY source),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY 3.0::DOUBLE * words / weight, encode(source) NULLS LAST) AS n, sum(words) OVER () AS all_words, sum(weight) OVER () AS all_weights FROM s),
levels AS (
  SELECT *, (all_words - 3 * coalesce(sum(words) OVER before, 0))::DOUBLE / (all_weights - coalesce(sum(weight) OVER before, 0))::DOUBLE AS level
  FROM ranked WINDOW before AS (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
final AS (SELECT level AS last_level, n AS last_n FROM levels WHERE 3 * words > level * weight ORDER BY n LIMIT 1),
goals AS (
  SELECT source, words, CASE WHEN n >= last_n THEN last_level * weight ELSE (3 * words)::DOUBLE END AS target FROM levels LEFT JOIN final ON true),
plans AS (SELECT *, least(round_even(target, 0)::BIGINT, 3 * words) AS amount FROM goals),
parts AS (SELECT *, CASE WHEN words = 0 THEN 0 ELSE amount // words END AS readings, CASE WHEN words = 0 THEN 0 ELSE amount % words END AS rest FROM plans),
places AS (
  SELECT d.*, p.words, p.target, p.readings, p.rest, sum(size) OVER (PARTITION BY d.source ORDER BY ticket, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, words AS source_size, coalesce(target, 0) AS target, size * (readings + (size > 0 AND rest > 0 AND upto - size / 2.0 <= rest)::BIGINT)::BIGINT AS taken FROM places
"""
