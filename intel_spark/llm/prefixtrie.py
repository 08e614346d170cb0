"""Prefix trie of conversations in balanced parentheses.

Conversations are sequences of turns, a turn being 16 bytes of MD5 of its role and text. Equal sequences become one,
with the number, the least and the digest of the conversations that are equal; the others are sorted and dealt out in
ranges. A stretch of neighbours in that order is a shard: its trie, walked depth first, is a string of parentheses that
follows from the prefixes that neighbours share. On that string a tree of block minima of the excess finds the closing
parenthesis of every node (findclose), which delimits its subtree; the rank of ``()`` counts the leaves inside, and
differences of running sums over the opening parentheses give conversations and savings.

The path to a shard's first and to its last sequence, its spines, may belong to other shards too. For nodes on them a
shard hands on parts: what hangs off the spine at that node. The spines of all shards, two rows a shard and level, are
merged in one more trie of the same kind, which is as large as there are shards, not conversations; its totals go to the
spine nodes, and their least conversation to the nodes that hang off them.

Turns are in order of ``turn`` (null first); turns of equal number in order of role, then of the hash of their text. Null
roles and texts count as empty; rows without a conv_id take no part; an empty table gives no nodes. A conversation's
turns, 16 bytes each, travel in one row; texts do not travel. The digest of the conversations that end at a node is taken
from a sorted stream and holds no list of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from intel_spark.llm.base import query, settled, table

FAMILY, HEADS = 5, 9
TURN = 16  # bytes of a turn
SHARD = 1 << 20  # turns of a shard
RANGE = 12  # bits of the ids that are joined before they are hashed
BITS = 64  # parentheses of a block of minima
NOTHING = hashlib.sha256(b"").hexdigest()


# ---------------------------------------------------------------- sequences


def turn_mark(role: Column, text: Column) -> Column:
    """MD5 of a turn in hex; the length keeps role and text apart."""
    return F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))


def sequences(turns: DataFrame) -> DataFrame:
    """(conv_id, marks array<struct<mark, size>>): each conversation's turns in order."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = turns.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").alias("turn"), role.alias("role"), turn_mark(role, text).alias("mark"), F.octet_length(text).alias("size")).alias("t"))
    ordered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return ordered.select("conv_id", F.transform("t", lambda t: F.struct(t["mark"].alias("mark"), t["size"].alias("size"))).alias("marks"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, marks) with the first turns of each conversation taken from the first of its family."""
    family, head = F.col("conv_id") - F.col("conv_id") % FAMILY, (F.crc32(F.col("conv_id").cast("string")) % HEADS).cast("int")
    heads = conversations.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("family"), F.slice("marks", 1, HEADS - 1).alias("heads"))
    none = F.array().cast("array<struct<mark:string,size:int>>")
    joined = conversations.select("conv_id", "marks", family.alias("family"), head.alias("h")).join(heads, "family", "left")
    return joined.select("conv_id", F.concat(F.slice(F.coalesce("heads", none), F.lit(1), F.col("h")), F.slice("marks", F.col("h") + 1, F.greatest(F.size("marks"), F.lit(1)))).alias("marks"))


def different(conversations: DataFrame) -> DataFrame:
    """(seq, sizes, n, conv_id, ends): each different sequence, with the conversations that are equal to it."""
    keyed = settled(conversations.select("conv_id", F.unhex(F.array_join(F.col("marks.mark"), "")).alias("seq"), F.col("marks.size").alias("sizes")))
    mark = F.md5("seq").alias("key")

    def run(batches):
        """One row for each stretch of equal keys of a sorted partition."""
        last, count, least, digest = None, 0, 0, None

        def row() -> pa.RecordBatch:
            return pa.record_batch([pa.array([least]), pa.array([count]), pa.array([digest.hexdigest()])], ["conv_id", "n", "ends"])

        for batch in batches:
            for key, ids, size, first in zip(*(batch.column(c).to_pylist() for c in ("key", "ids", "size", "first"))):
                if key != last:
                    if count:
                        yield row()
                    last, count, least, digest = key, 0, first, hashlib.sha256()
                digest.update((f",{ids}" if count else ids).encode())
                count += size
        if count:
            yield row()

    # ids are joined in ranges of 2 ** RANGE first, so that the stream of a large group is short
    ranges = keyed.select(mark, "conv_id").groupBy("key", F.shiftright("conv_id", RANGE).alias("range")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    joined = ranges.select("key", "range", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"), F.size("ids").alias("size"), F.col("ids")[0].alias("first"))
    ends = joined.repartition("key").sortWithinPartitions("key", "range").mapInArrow(run, "conv_id long, n long, ends string")
    return keyed.join(ends, "conv_id")


# ---------------------------------------------------------------- balanced parentheses


class Parentheses:
    """A depth-first walk as a string of parentheses, given how many close before each run of opening ones."""

    def __init__(self, closes: np.ndarray, opens: np.ndarray):
        runs = np.stack([closes, opens], axis=1).ravel()
        self.open = np.concatenate([np.repeat(np.tile([False, True], len(closes)), runs), np.zeros(int(opens.sum() - closes.sum()), bool)])
        self.excess = np.cumsum(np.where(self.open, 1, -1))  # after each parenthesis
        self.at = np.flatnonzero(self.open)
        self.minima = [self.excess]
        while len(self.minima[-1]) > 1:  # blocks of BITS parentheses, then blocks of blocks
            below = self.minima[-1]
            padded = np.concatenate([below, np.full(-len(below) % BITS, np.iinfo(np.int64).max)])
            self.minima.append(padded.reshape(-1, BITS).min(axis=1))

    def findclose(self) -> np.ndarray:
        """Where each opening parenthesis is closed: the first place after it with an excess below its own."""
        wanted = self.excess[self.at] - 1
        out = np.zeros(len(self.at), np.int64)
        place, level, todo = self.at + 1, 0, np.arange(len(self.at))
        while len(todo):  # up: look through the rest of a block, then through the rest of the block of blocks
            minima, pending = self.minima[level], []
            while len(todo):
                hit = minima[place[todo]] <= wanted[todo]
                found = todo[hit]
                out[found] = self._down(level, place[found], wanted[found])
                todo = todo[~hit]
                place[todo] += 1
                over = place[todo] % BITS == 0
                pending.append(todo[over])
                todo = todo[~over]
            todo, level = np.concatenate(pending), level + 1
            place[todo] //= BITS
        return out

    def _down(self, level: int, place: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """The first parenthesis at or below ``wanted`` inside blocks that hold one."""
        while level and len(place):
            level -= 1
            place = place * BITS
            left = np.arange(len(place))
            while len(left):
                left = left[self.minima[level][place[left]] > wanted[left]]
                place[left] += 1
        return place

    def subtrees(self) -> np.ndarray:
        """For each node, in the order of the walk, the number of the first node after its subtree."""
        rank = np.cumsum(self.open)
        return rank[self.findclose()]

    def leaf_pairs(self) -> np.ndarray:
        """Running count of ``()`` over the nodes, beginning with 0."""
        pair = np.zeros(len(self.open), bool)
        pair[:-1] = self.open[:-1] & ~self.open[1:]
        return np.concatenate([[0], np.cumsum(pair[self.at])])


def running(values: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(values)])


class Trie:
    """The trie of sorted sequences: nodes in depth-first order, the root first."""

    def __init__(self, sequences: list[bytes]):
        length = np.array([len(s) // TURN for s in sequences], np.int64)
        self.shared = np.zeros(len(sequences), np.int64)
        for i in range(1, len(sequences)):
            self.shared[i] = common_turns(sequences[i - 1], sequences[i])
        opens = length - self.shared
        closes = np.concatenate([[0], length[:-1] - self.shared[1:]])
        opens[0] += 1  # the root
        self.parens = Parentheses(closes, opens)
        self.owner = np.repeat(np.arange(len(sequences)), opens)  # the first sequence through a node
        self.depth = self.parens.excess[self.parens.at] - 1
        self.after = self.parens.subtrees()
        self.end = np.cumsum(opens) - 1  # the node at which each sequence ends: the last one opened by then
        self.by_depth = np.argsort(self.depth, kind="stable")
        self.bounds = np.searchsorted(self.depth[self.by_depth], np.arange(int(self.depth.max()) + 2))
        self.parent = np.full(len(self.depth), -1, np.int64)
        for d in range(1, len(self.bounds) - 1):  # the latest node before that is one level up
            above, own = self.level(d - 1), self.level(d)
            self.parent[own] = above[np.searchsorted(above, own) - 1]

    def path(self, sequence: int) -> np.ndarray:
        """The nodes from the root to the end of a sequence."""
        out, node = [], int(self.end[sequence])
        while node >= 0:
            out.append(node)
            node = int(self.parent[node])
        return np.array(out[::-1])

    def inside(self, values: np.ndarray) -> np.ndarray:
        """Sums over subtrees."""
        sums = running(values)
        return sums[self.after] - sums[: len(values)]

    def least(self, values: np.ndarray) -> np.ndarray:
        """Minima over subtrees, level by level from below."""
        out = values.copy()
        for d in range(int(self.depth.max()), 0, -1):
            own = self.level(d)
            np.minimum.at(out, self.parent[own], out[own])
        return out

    def level(self, d: int) -> np.ndarray:
        """The nodes of a depth, in order."""
        return self.by_depth[self.bounds[d] : self.bounds[d + 1]]

    def children(self) -> np.ndarray:
        return np.bincount(self.parent[self.parent >= 0], minlength=len(self.parent))


def common_turns(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b)) // TURN
    if a[: n * TURN] == b[: n * TURN]:
        return n
    x, y = np.frombuffer(a, np.uint64, n * 2).reshape(-1, 2), np.frombuffer(b, np.uint64, n * 2).reshape(-1, 2)
    return int((x != y).any(axis=1).argmax())


# ---------------------------------------------------------------- shards and spines

#: side: null for a finished node, else the spine (0 first, 1 last) the row is a part of; ``up`` and ``up_depth`` name the
#: spine node that a finished node hangs off. A part's n_leaves and saved leave its own node and other spine nodes out.
NODE = "shard long, side int, depth long, conv_id long, parent_conv_id long, up int, up_depth long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, mark binary, size long"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def shard_nodes(shard: int, rows: list[tuple[bytes, list[int], int, int, str]]) -> pa.RecordBatch:
    """Finished nodes and spine parts of sorted (seq, sizes, n, conv_id, ends)."""
    trie = Trie([r[0] for r in rows])
    nodes = len(trie.depth)
    owner_depth = trie.depth - 1
    size = np.array([rows[o][1][d] if d >= 0 else 0 for o, d in zip(trie.owner.tolist(), owner_depth.tolist())], np.int64)
    here, least, ends = np.zeros(nodes, np.int64), np.full(nodes, np.iinfo(np.int64).max), np.full(nodes, NOTHING, object)
    here[trie.end], least[trie.end], ends[trie.end] = [r[2] for r in rows], [r[3] for r in rows], [r[4] for r in rows]
    n, least, children = trie.inside(here), trie.least(least), trie.children()
    first, last = trie.path(0), trie.path(len(rows) - 1)
    spine = np.zeros(nodes, bool)
    spine[first] = spine[last] = True
    own = np.where(spine, 0, (n - 1) * size)  # spine nodes are counted when they are merged
    saved = trie.inside(own)
    pairs = trie.parens.leaf_pairs()
    leaves = pairs[trie.after] - pairs[:nodes]
    done = np.flatnonzero(~spine)
    hangs = spine[trie.parent[done]]
    side = np.full(nodes, 1)
    side[first] = 0
    parent = trie.parent[done]

    # what hangs off each spine node: its subtree without the subtrees of the spine nodes below it
    spines = np.flatnonzero(spine)
    below = spines[spines > 0]
    off = {"saved": saved.copy(), "leaves": leaves - (children == 0), "children": children.copy()}
    for name, taken in (("saved", saved), ("leaves", leaves), ("children", np.ones(nodes, np.int64))):
        np.subtract.at(off[name], trie.parent[below], taken[below])

    columns = {name: [] for name in (f.split()[0] for f in NODE.split(", "))}

    def add(count: int, **values) -> None:
        for name in columns:
            value = values.get(name)
            columns[name] += value if isinstance(value, list) else [value] * count

    add(
        len(done), shard=shard, depth=trie.depth[done].tolist(), conv_id=least[done].tolist(), parent_conv_id=[None if h else int(x) for h, x in zip(hangs, least[parent])],
        up=[int(s) if h else None for h, s in zip(hangs, side[parent])], up_depth=[int(d) if h else None for h, d in zip(hangs, trie.depth[parent])],
        n_convs=n[done].tolist(), n_children=children[done].tolist(), n_leaves=leaves[done].tolist(), saved_tokens=saved[done].tolist(), ends_sha256=ends[done].tolist(),
    )
    common = next((i for i, (a, b) in enumerate(zip(first, last)) if a != b), min(len(first), len(last)))
    for which, path, seq in ((0, first, 0), (1, last, len(rows) - 1)):
        fresh = np.arange(len(path)) >= (common if which else 0)  # shared nodes give their parts once
        text = rows[seq][0]
        add(
            len(path), shard=shard, side=which, depth=trie.depth[path].tolist(), conv_id=least[path].tolist(), n_convs=np.where(fresh, n[path], 0).tolist(), n_children=np.where(fresh, off["children"][path], 0).tolist(),
            n_leaves=np.where(fresh, off["leaves"][path], 0).tolist(), saved_tokens=np.where(fresh, off["saved"][path], 0).tolist(), ends_sha256=ends[path].tolist(),
            mark=[text[(d - 1) * TURN : d * TURN] if d else b"" for d in trie.depth[path].tolist()], size=size[path].tolist(),
        )
    schema = pa.schema([(f.split()[0], {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}[f.split()[1]]) for f in NODE.split(", ")])
    return pa.record_batch([pa.array(v, t.type) for v, t in zip(columns.values(), schema)], schema=schema)


def in_shards(batches) -> Iterator[pa.RecordBatch]:
    """The nodes of a sorted partition, a shard of about ``SHARD`` turns at a time."""
    held, turns, shard = [], 0, TaskContext.get().partitionId() << 32
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("seq", "sizes", "n", "conv_id", "ends"))):
            held.append(row)
            turns += len(row[1]) + 1
            if turns >= SHARD:
                yield shard_nodes(shard, held)
                held, turns, shard = [], 0, shard + 1
    if held:
        yield shard_nodes(shard, held)


def merge_spines(parts: pa.Table) -> pa.Table:
    """Totals of the spine nodes, for every part: two rows a shard and level come in, as many go out."""
    parts = parts.sort_by([("shard", "ascending"), ("side", "ascending"), ("depth", "ascending")])
    depth, n, children, leaves, saved, size, least = (parts.column(c).to_numpy() for c in ("depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "size", "conv_id"))
    begin = np.flatnonzero(depth == 0)  # a path begins with the root
    marks, ends = parts.column("mark").to_pylist(), parts.column("ends_sha256").to_pylist()
    stop = np.concatenate([begin[1:], [len(depth)]])
    trie = Trie([b"".join(marks[a:b]) for a, b in zip(begin, stop)])
    node = np.concatenate([trie.path(i) for i in range(len(begin))])
    count = len(trie.depth)
    total = lambda values: np.bincount(node, values, count).astype(np.int64)
    convs, bytes_, low = total(n), np.zeros(count, np.int64), np.full(count, np.iinfo(np.int64).max)
    bytes_[node] = size
    np.minimum.at(low, node, least)
    below = total(children) + trie.children()
    digest = [NOTHING] * count
    for i, e in zip(node.tolist(), ends):
        digest[i] = e if e != NOTHING else digest[i]
    all_saved = trie.inside(total(saved) + (convs - 1) * bytes_)
    all_leaves = trie.inside(total(leaves) + (below == 0))
    up = np.where(trie.parent < 0, -1, low[trie.parent])
    seen = np.zeros(len(node), bool)
    seen[np.unique(node, return_index=True)[1]] = True
    return pa.table({
        "shard": parts.column("shard"), "up": parts.column("side"), "up_depth": parts.column("depth"), "spine_conv_id": pa.array(low[node]), "once": pa.array(seen), "depth": pa.array(trie.depth[node]),
        "parent_conv_id": pa.array(up[node], mask=trie.parent[node] < 0), "n_convs": pa.array(convs[node]), "n_children": pa.array(below[node]), "n_leaves": pa.array(all_leaves[node]),
        "saved_tokens": pa.array(all_saved[node]), "ends_sha256": pa.array([digest[i] for i in node.tolist()], pa.string()),
    })


MERGED = "shard long, up int, up_depth long, spine_conv_id long, once boolean, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def trie_nodes(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node of the trie.

    ``conversations`` holds (conv_id, marks): turns as hex marks with their sizes.
    """
    sorted_ = settled(different(conversations)).repartitionByRange("seq").sortWithinPartitions("seq")
    nodes = settled(sorted_.select("seq", "sizes", "n", "conv_id", "ends").mapInArrow(in_shards, NODE))
    # as many rows as shards have levels
    spines = settled(nodes.where("side is not null").groupBy().applyInArrow(merge_spines, MERGED))
    done = nodes.where("side is null")
    hanging = done.where("up is not null").drop("parent_conv_id").join(spines.select("shard", "up", "up_depth", F.col("spine_conv_id").alias("parent_conv_id")), ["shard", "up", "up_depth"])
    own = spines.where("once").withColumnRenamed("spine_conv_id", "conv_id")
    return done.where("up is null").select(*COLUMNS).unionByName(hanging.select(*COLUMNS)).unionByName(own.select(*COLUMNS))


def conversation_trie(turns: DataFrame) -> DataFrame:
    """The trie nodes of the rebuilt conversations of (conv_id, turn, role, text)."""
    return trie_nodes(rebuilt(sequences(turns)))


_CRC = "list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)), lambda c, b: list_reduce(list_concat([xor(c, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: CASE WHEN (x & 1) = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END))"

ORACLE = f"""
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), o AS (
    SELECT conv_id, list({{'m': md5(CAST(octet_length(encode(role)) AS VARCHAR) || ':' || role || text), 's': octet_length(encode(text))}}
        ORDER BY turn NULLS FIRST, role, md5(CAST(octet_length(encode(role)) AS VARCHAR) || ':' || role || text)) AS l,
        xor({_CRC}, 4294967295::BIGINT) % {HEADS} AS h FROM t GROUP BY conv_id
), r AS MATERIALIZED (
    SELECT o.conv_id, list_concat(coalesce(f.l[1:o.h], []), o.l[o.h + 1:]) AS l FROM o LEFT JOIN o f ON f.conv_id = o.conv_id - o.conv_id % {FAMILY}
), p AS (
    SELECT conv_id, len(l) AS len, unnest(range(0, len(l) + 1)) AS depth, l FROM r
), n AS MATERIALIZED (
    SELECT list_transform(l[1:depth], lambda x: x.m) AS path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
        any_value(CASE WHEN depth = 0 THEN 0 ELSE l[depth].s END) AS size, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len = depth), '')) AS ends_sha256
    FROM p GROUP BY path, depth
), c AS MATERIALIZED (
    SELECT n.*, u.conv_id AS parent_conv_id, (SELECT count(*) FROM n k WHERE k.depth = n.depth + 1 AND k.path[1:n.depth] = n.path) AS n_children
    FROM n LEFT JOIN n u ON u.depth = n.depth - 1 AND u.path = n.path[1:n.depth - 1]
), a AS (
    SELECT path, depth, n_children, (n_convs - 1) * size AS saved, unnest(range(0, depth + 1)) AS up FROM c
), s AS (
    SELECT path[1:up] AS path, CAST(sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM a GROUP BY 1
)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM c JOIN s USING (path)
"""


@query("op12_conversation_trie", ORACLE)
def op12(spark, sf_dir):
    return conversation_trie(table(spark, sf_dir, "conversations"))
