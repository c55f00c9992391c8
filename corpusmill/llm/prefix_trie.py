"""Prefix trie of conversations: ternary search trees over dictionary-encoded turns, one a range shard.

A conversation is a string of turn marks, 20 bytes a turn: 16 of the digest of role and text, 4 of its number of words.
Equal conversations are counted first, so a conversation with very many copies is one row. The distinct ones are range
partitioned in byte order, where everything below a node is one stretch of neighbours. A shard encodes its marks by rank,
inserts its conversations into a ternary search tree in the order of medians, and adds up members, leaves and savings from
the last node back to the first. Only nodes on the path of a shard's first or last conversation can lie in another shard
too: those that do are merged by the hash of their prefix, and their subtrees are summed by pointer doubling, a round for
every doubling of depth.

Turns are ordered by number, null first, then by the digest of role and text; null roles and texts count as empty; repeated
rows are turns of their own; rows without a conv_id belong to no conversation and are left out. An empty table has no
nodes, not even a root. Extra columns are ignored. A conversation is held as a whole, 20 bytes a turn and never its texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import stored, word_count

MARK = 20
DIGEST = 16
SHARED = 20  # conversations that take their first turns from one
MOST_HEAD = 4  # the head has fewer turns than this
IDS_TOGETHER = 4096
TURNS_A_SHARD = 200_000
# parts a parent's row is copied to, so that the children of one node are dealt to as many tasks
SALT = 64
NOTHING = hashlib.sha256(b"").hexdigest()
NODE_SCHEMA = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
    "ends_sha256 string, words long, node binary, parent binary, leaves_below long, saved_below long"
)


def mark_of(role: Column, text: Column) -> Column:
    """40 hexadecimal digits of a turn: its digest, the length before the role making it unambiguous, and its words."""
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    return F.concat(F.left(digest, F.lit(2 * DIGEST)), F.lower(F.lpad(F.hex(F.least(word_count(text), F.lit(2**32 - 1))), 2 * (MARK - DIGEST), "0")))


def conversations_of(turns: DataFrame) -> DataFrame:
    """(conv_id, marks): the marks of each conversation's turns, one after the other."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = turns.where(F.col("conv_id").isNotNull())
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), mark_of(role, text).alias("mark")).alias("at"))
    listed = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("at")).alias("turns"))
    return listed.select("conv_id", F.unhex(F.array_join("turns.mark", "")).alias("marks"))


def rebuilt(convs: DataFrame) -> DataFrame:
    """(conv_id, marks) with each conversation's first turns taken from the first one of its block of ids."""
    base, head = F.col("conv_id") - F.col("conv_id") % SHARED, F.crc32(F.col("conv_id").cast("string")) % MOST_HEAD
    firsts = convs.where(F.col("conv_id") % SHARED == 0).select(F.col("conv_id").alias("base"), F.substring("marks", 1, MARK * (MOST_HEAD - 1)).alias("given"))
    met = convs.withColumn("base", base).join(firsts, "base", "left")
    taken = F.expr(f"substring(given, 1, cast({MARK} * (crc32(cast(conv_id as string)) % {MOST_HEAD}) as int))")
    own = F.expr(f"substring(marks, cast({MARK} * (crc32(cast(conv_id as string)) % {MOST_HEAD}) + 1 as int), length(marks))")
    whole = F.when(head == 0, F.col("marks")).otherwise(F.concat(F.coalesce(taken, F.lit(b"")), own))
    return met.select("conv_id", whole.alias("marks"))


def hashed_lists(members: DataFrame) -> DataFrame:
    """(name, ends_sha256): hash of the ids of each name in numeric order, comma-joined.

    A hash reads its input in order, so the ids of a name are streamed through one task; they come as lists of up to
    IDS_TOGETHER ids that are made before, and no list is held whole.
    """
    block = F.floor(F.col("conv_id") / IDS_TOGETHER)
    lists = members.groupBy("name", block.alias("block")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda i: i.cast("string")), ",").alias("ids"))
    single = lists.groupBy("name").agg(F.count("*").alias("n"), F.min("ids").alias("ids"))
    alone = single.where("n = 1").select("name", F.sha2("ids", 256).alias("ends_sha256"))

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, running = None, None
        for batch in batches:
            names, hashes = [], []
            for name, ids in zip(batch["name"], batch["ids"]):
                if name == now:
                    running.update(b",")
                else:
                    if now is not None:
                        names.append(now)
                        hashes.append(running.hexdigest())
                    now, running = name, hashlib.sha256()
                running.update(ids.encode())
            if names:
                yield pd.DataFrame({"name": names, "ends_sha256": hashes})
        if now is not None:
            yield pd.DataFrame({"name": [now], "ends_sha256": [running.hexdigest()]})

    several = lists.join(single.where("n > 1").select("name"), "name", "left_semi")
    return alone.unionByName(several.repartition("name").sortWithinPartitions("name", "block").mapInPandas(hashed, "name binary, ends_sha256 string"))


def medians(n: int) -> Iterator[int]:
    """0 to n-1, the middle first, then the middles of both halves and so on."""
    spans = [(0, n)]
    while spans:
        wider = []
        for a, b in spans:
            if a < b:
                middle = (a + b) // 2
                yield middle
                wider += [(a, middle), (middle + 1, b)]
        spans = wider


class Tree:
    """Ternary search tree of strings of turn numbers. Node 0 is the root of the trie; the siblings below a node form a
    binary tree by turn number, linked by ``less`` and ``more``."""

    def __init__(self):
        self.turn, self.less, self.more, self.below, self.up, self.depth = [-1], [0], [0], [0], [-1], [0]

    def _add(self, turn: int, up: int) -> int:
        for column, value in ((self.turn, turn), (self.less, 0), (self.more, 0), (self.below, 0), (self.up, up), (self.depth, self.depth[up] + 1)):
            column.append(value)
        return len(self.turn) - 1

    def insert(self, string: Sequence[int]) -> int:
        """The node at which the string ends."""
        node = 0
        for turn in string:
            link, at = self.below, node
            while (found := link[at]) and self.turn[found] != turn:
                link, at = (self.less if turn < self.turn[found] else self.more), found
            if not found:
                found = link[at] = self._add(turn, node)
            node = found
        return node

    def path(self, node: int) -> list[int]:
        """The nodes from the root to this one."""
        nodes = []
        while node >= 0:
            nodes.append(node)
            node = self.up[node]
        return nodes[::-1]


def shard_nodes(strings: Sequence[bytes], n: Sequence[int], least: Sequence[int], ends: Sequence[str]) -> pd.DataFrame:
    """Rows of NODE_SCHEMA for all nodes of a shard's distinct conversations, which are in byte order.

    ``node`` names the nodes that other shards may hold too; ``parent`` is the name of such a node's parent, or of any
    node's whose parent is one. Their own facts are final where no other shard has the name.
    """
    marks = [[s[i : i + MARK] for i in range(0, len(s), MARK)] for s in strings]
    listed = sorted({m for conversation in marks for m in conversation})
    number = {m: i for i, m in enumerate(listed)}
    tree, end_of = Tree(), [0] * len(strings)
    for i in medians(len(strings)):
        end_of[i] = tree.insert([number[m] for m in marks[i]])
    size = len(tree.turn)
    members, first, end_hash = np.zeros(size, dtype=np.int64), np.full(size, np.iinfo(np.int64).max), [NOTHING] * size
    for i, node in enumerate(end_of):
        members[node], first[node], end_hash[node] = n[i], least[i], ends[i]
    words_of = [int.from_bytes(m[DIGEST:], "big") for m in listed]
    words = np.array([words_of[t] if t >= 0 else 0 for t in tree.turn], dtype=np.int64)
    children, leaves, saved = (np.zeros(size, dtype=np.int64) for _ in range(3))
    up = tree.up
    # a node is made after the one above it, so backwards every subtree is complete before it is handed up
    for node in range(size - 1, 0, -1):
        above = up[node]
        members[above] += members[node]
        first[above] = min(first[above], first[node])
        children[above] += 1
        leaves[above] += leaves[node] or 1
        saved[above] += saved[node] + (members[node] - 1) * words[node]
    names: dict[int, bytes] = {}
    for i in (0, len(strings) - 1):
        running = hashlib.sha256()
        for depth, node in enumerate(tree.path(end_of[i])):
            if depth:
                running.update(marks[i][depth - 1])
            names[node] = running.digest()
    above = np.maximum(np.array(up, dtype=np.int64), 0)
    parent_id = pd.array(first[above], dtype="Int64")
    parent_id[0] = pd.NA
    return pd.DataFrame({
        "conv_id": first, "depth": tree.depth, "parent_conv_id": parent_id, "n_convs": members, "n_children": children,
        "n_leaves": np.maximum(leaves, 1), "saved_tokens": saved + (members - 1) * words, "ends_sha256": end_hash, "words": words,
        "node": [names.get(i) for i in range(size)], "parent": [names.get(u) for u in up], "leaves_below": leaves, "saved_below": saved,
    })


def sharded(groups: DataFrame, turns_a_shard: int) -> DataFrame:
    """Nodes of all shards of the stored distinct conversations (marks, n, conv_id, ends_sha256)."""
    turns = groups.agg(F.coalesce(F.sum(F.length("marks") / MARK + 1), F.lit(0))).first()[0]
    shards = max(1, -(-int(turns) // turns_a_shard))

    def built(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [batch for batch in batches if len(batch)]
        if rows:
            rows = pd.concat(rows)
            yield shard_nodes(rows["marks"].tolist(), rows["n"].tolist(), rows["conv_id"].tolist(), rows["ends_sha256"].tolist())

    return stored(groups.repartitionByRange(shards, "marks").sortWithinPartitions("marks").mapInPandas(built, NODE_SCHEMA), "trie-nodes")


def merged(nodes: DataFrame) -> DataFrame:
    """The nodes that several shards hold, one stored row each, with sums over their whole subtrees."""
    shared = nodes.where("node IS NOT NULL").groupBy("node").agg(
        F.count("*").alias("shards"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("parent").alias("parent"),
        F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"),
        F.max("words").alias("words"), F.sum("leaves_below").alias("leaves_below"), F.sum("saved_below").alias("saved_below"),
        F.max(F.when(F.col("ends_sha256") != NOTHING, F.col("ends_sha256"))).alias("ends_sha256"),
    )
    shared = stored(shared.where("shards > 1"), "trie-shared")
    # what shared children brought into the sums of their parents leaves them again, once a shard
    brought = shared.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(
        F.sum("shards").alias("b_shards"), F.count("*").alias("b_nodes"), F.sum("leaves").alias("b_leaves"), F.sum("saved").alias("b_saved")
    )
    both = shared.join(brought, "node", "left").na.fill(0, ["b_shards", "b_nodes", "b_leaves", "b_saved"])
    children = F.col("children") - F.col("b_shards") + F.col("b_nodes")
    own = both.select(
        "node", "parent", "conv_id", "depth", "n_convs", children.alias("n_children"), F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"),
        (F.col("leaves_below") - F.col("b_leaves") + F.when(children == 0, 1).otherwise(0)).alias("n_leaves"),
        (F.col("saved_below") - F.col("b_saved") + (F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"),
    ).withColumn("jump", F.col("parent"))
    own = stored(own, "trie-merged")
    deepest = own.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]
    reach = 1
    while reach <= deepest:  # every row holds the sum over what lies less than ``reach`` below it
        given = own.where("jump IS NOT NULL").groupBy(F.col("jump").alias("node")).agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"))
        farther = own.select(F.col("node").alias("jump"), F.col("jump").alias("farther"))
        own = own.join(given, "node", "left").join(farther, "jump", "left")
        own = own.withColumn("n_leaves", F.col("n_leaves") + F.coalesce("more_leaves", F.lit(0))).withColumn("saved_tokens", F.col("saved_tokens") + F.coalesce("more_saved", F.lit(0)))
        own = stored(own.withColumn("jump", F.col("farther")).drop("more_leaves", "more_saved", "farther"), "trie-merged")
        reach *= 2
    return own


def trie(turns: DataFrame, turns_a_shard: int = TURNS_A_SHARD) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    convs = stored(conversations_of(turns), "conversations")
    members = stored(rebuilt(convs).withColumn("name", F.unhex(F.sha2("marks", 256))), "rebuilt")
    distinct = members.groupBy("name", "marks").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id"))
    groups = stored(distinct.join(hashed_lists(members), "name").select("marks", "n", "conv_id", "ends_sha256"), "trie-strings")
    nodes = sharded(groups, turns_a_shard)
    joined = merged(nodes)
    facts = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    least = F.explode(F.array(*map(F.lit, range(SALT)))).alias("salt")
    parents = joined.select(F.col("node").alias("parent"), F.col("conv_id").alias("merged_id"), least)
    salted = lambda rows: rows.withColumn("salt", F.pmod(F.xxhash64("conv_id", "depth"), F.lit(SALT)).cast("int")).join(parents, ["parent", "salt"], "left")
    known = F.coalesce("merged_id", "parent_conv_id").alias("parent_conv_id")
    with_parent = [known if c == "parent_conv_id" else F.col(c) for c in facts]
    single = nodes.join(joined.select("node"), "node", "left_anti")
    inner = single.where("parent IS NULL").select(*facts)
    edge = salted(single.where("parent IS NOT NULL")).select(*with_parent)
    shared = salted(joined.withColumn("parent_conv_id", F.lit(None).cast("long"))).select(*with_parent)
    return inner.unionByName(edge).unionByName(shared)


def _trie_sql() -> str:
    """The same table in SQL: prefixes as hashed chains, every node paired with its ancestors."""
    byte_step = "list_reduce([xor(c, x)] || [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, (y & 1) * 3988292384::UBIGINT))"
    crc = f"xor(list_reduce([4294967295::UBIGINT] || list_transform(string_split(conv_id::VARCHAR, ''), lambda p: ascii(p)::UBIGINT), lambda c, x: {byte_step}), 4294967295::UBIGINT)"
    return f"""
WITH given AS (
  SELECT conv_id, turn, coalesce(text, '') AS body, length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') AS content
  FROM conversations WHERE conv_id IS NOT NULL
), t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(content)) AS i FROM given
), c AS (SELECT conv_id, ({crc} % {MOST_HEAD})::BIGINT AS h FROM (SELECT DISTINCT conv_id FROM given)
), r AS (
  SELECT c.conv_id, i, body, content FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % {SHARED} AND i <= h
  UNION ALL SELECT conv_id, i, body, content FROM c JOIN t USING (conv_id) WHERE i > h
), n AS (SELECT conv_id, row_number() OVER o AS depth, len(regexp_extract_all(body, '[^\\x20\\x09-\\x0D]+')) AS words, string_agg(md5(content), '') OVER o AS path FROM r WINDOW o AS (PARTITION BY conv_id ORDER BY i)
), m AS (SELECT conv_id, depth, words, path, lag(path, 1, '') OVER (PARTITION BY conv_id ORDER BY depth) AS up FROM n UNION ALL SELECT conv_id, 0, 0, '', NULL FROM c
), last AS (SELECT conv_id, max(depth) AS depth FROM m GROUP BY 1
), node AS (SELECT path, any_value(depth) AS depth, any_value(up) AS up, any_value(words) AS words, min(conv_id) AS conv_id, count(*) AS n_convs FROM m GROUP BY path
), kids AS (SELECT up AS path, count(*) AS n_children FROM node WHERE up IS NOT NULL GROUP BY 1
), below AS (SELECT DISTINCT a.path AS path, b.path AS under FROM m a JOIN m b ON a.conv_id = b.conv_id AND a.depth <= b.depth
), sums AS (
  SELECT b.path, count(*) FILTER (k.n_children IS NULL) AS n_leaves, sum((x.n_convs - 1) * x.words) AS saved_tokens
  FROM below b JOIN node x ON x.path = b.under LEFT JOIN kids k ON k.path = b.under GROUP BY 1
), ends AS (SELECT m.path, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256 FROM m JOIN last USING (conv_id, depth) GROUP BY 1)
SELECT node.conv_id, node.depth, p.conv_id AS parent_conv_id, node.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens,
  coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM node JOIN sums USING (path) LEFT JOIN kids USING (path) LEFT JOIN ends USING (path) LEFT JOIN node p ON p.path = node.up"""


TRIE_SQL = _trie_sql()
