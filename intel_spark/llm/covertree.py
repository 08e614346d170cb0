"""Exact top-k search by integer inner product, by dual-tree cover-tree search.

A cover tree is built over at most ``SAMPLE`` rows: the children of a node are a net of its points, more than 1 / ``BASE``
of its radius apart and covering it within that distance. In many dimensions such a net would be nearly all points, so it
ends with as many as make leaves of the wanted size, and outliers join a neighbour. Every row, query or candidate, then descends the tree to a
leaf, and the covering radii are worked out over all rows, so the sample decides how well the search prunes and not
what it finds. The rows of a leaf are packed into blocks of about ``BLOCK`` rows; queries into query groups, the same way.

Each query group first searches the blocks of its own leaf, which gives every query a k-th score and the group the worst
of them. Pairs of a query node and a data node are then followed down from the roots: with centres q and x and radii r
and s, no score of the pair exceeds q.x + |q| s + r |x| + r s, and pairs that stay under the group's worst k-th score are
pruned together with all pairs below them. The surviving pairs of leaves are narrowed once more block by block, and what
is left is scored exactly, block against block.

Vectors are quantised to floor(256 * component). Null vectors, and vectors with a null or non-finite component, take no
part; shorter vectors count as padded with zeros; several rows of one id count as the least vector; null ids take no
part. Components beyond 2**24 after quantising raise an error, since scores could leave the range of exact arithmetic.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from intel_spark.llm.base import query, settled, table

SAMPLE = 8_192  # rows the tree is built over
LEAF_ROWS = 2_048  # rows of a leaf, about, while there are no more than LEAVES
LEAVES = 512
FEWEST = 4  # leaves wanted of small tables
BASE = 1.5
BLOCK = 4_096
K = 5
SCALE = 256
LARGEST = 1 << 24


class Node:
    def __init__(self, centre: np.ndarray, children: list["Node"]):
        self.centre, self.children = centre, children
        self.leaf = -1
        self.radius = -1.0  # of the rows below, -1 without rows
        self.bound = np.inf  # least of the worst k-th scores of the query groups below


def build_tree(points: np.ndarray, leaf_points: int) -> tuple[Node, list[Node]]:
    """The cover tree of a sample and its leaves; nodes of at most ``leaf_points`` points stay whole."""
    leaves: list[Node] = []

    def node(members: np.ndarray, centre: int) -> Node:
        distance = np.linalg.norm(points[members] - points[centre], axis=1)
        radius = float(distance.max(initial=0.0))
        if len(members) <= leaf_points or radius == 0:
            out = Node(points[centre], [])
            out.leaf = len(leaves)
            leaves.append(out)
            return out
        centres, nearest, owner = [centre], distance, np.zeros(len(members), np.int64)
        most = max(2, len(members) // leaf_points)  # no more children than make leaves of the wanted size
        while nearest.max() > radius / BASE and len(centres) < most:  # the farthest point joins the net until it covers the node
            centres.append(int(members[np.argmax(nearest)]))
            to_new = np.linalg.norm(points[members] - points[centres[-1]], axis=1)
            owner = np.where(to_new < nearest, len(centres) - 1, owner)
            nearest = np.minimum(nearest, to_new)
        # outliers make no leaves of their own: they go to the nearest child that has company
        large = np.flatnonzero(np.bincount(owner, minlength=len(centres)) >= max(1, leaf_points // 4))
        if len(large) >= 2:
            centres = [centres[i] for i in large]
            owner = np.argmin([np.linalg.norm(points[members] - points[c], axis=1) for c in centres], axis=0)
        else:  # no child but one has: halves along the way from the centre to the farthest point
            centres = centres[:2]
            lean = distance - np.linalg.norm(points[members] - points[centres[1]], axis=1)
            owner = np.zeros(len(members), np.int64)
            owner[np.argsort(lean, kind="stable")[len(members) // 2 :]] = 1
        parts = [members[owner == i] for i in range(len(centres))]
        return Node(points[centre], [node(part, c) for part, c in zip(parts, centres) if len(part)])

    return node(np.arange(len(points)), 0), leaves


def descend(root: Node, rows: np.ndarray) -> np.ndarray:
    """The leaf of each row: at every node the nearest child."""
    out = np.zeros(len(rows), np.int32)

    def down(node: Node, at: np.ndarray) -> None:
        if not len(at):
            return
        if node.leaf >= 0:
            out[at] = node.leaf
            return
        centres = np.array([c.centre for c in node.children])
        nearest = np.argmin((centres**2).sum(axis=1) - 2 * rows[at] @ centres.T, axis=1)
        for i, child in enumerate(node.children):
            down(child, at[nearest == i])

    down(root, np.arange(len(rows)))
    return out


def set_radii(node: Node, radii: dict[int, float]) -> float:
    """Covering radii of all nodes from those of the leaves."""
    if node.leaf >= 0:
        node.radius = radii.get(node.leaf, -1.0)
    else:
        below = [(c, set_radii(c, radii)) for c in node.children]
        node.radius = max((float(np.linalg.norm(c.centre - node.centre)) + r for c, r in below if r >= 0), default=-1.0)
    return node.radius


def set_bounds(node: Node, bounds: dict[int, float]) -> float:
    node.bound = bounds.get(node.leaf, np.inf) if node.leaf >= 0 else min(set_bounds(c, bounds) for c in node.children)
    return node.bound


def reach(dot: float, q: float, x: float, r: float, s: float) -> float:
    """No inner product of two nodes' rows exceeds this."""
    return dot + q * s + r * x + r * s


def node_pairs(queries: Node, data: Node) -> list[tuple[int, int, float, float, float]]:
    """(query leaf, data leaf, dot, |query centre|, |data centre|) of the leaf pairs that cannot be pruned."""
    out, todo = [], [(queries, data)]
    while todo:
        a, b = todo.pop()
        if a.radius < 0 or b.radius < 0:
            continue
        dot, q, x = float(a.centre @ b.centre), float(np.linalg.norm(a.centre)), float(np.linalg.norm(b.centre))
        limit = reach(dot, q, x, a.radius, b.radius)
        if limit + abs(limit) * 1e-9 + 1e-6 < a.bound:
            continue
        if a.leaf >= 0 and b.leaf >= 0:
            out.append((a.leaf, b.leaf, dot, q, x))
        elif b.leaf >= 0 or (a.leaf < 0 and a.radius > b.radius):  # the wider node is opened
            todo += [(c, b) for c in a.children]
        else:
            todo += [(a, c) for c in b.children]
    return out


def quantised(embeddings: DataFrame) -> DataFrame:
    """(vec_id, vector array<long>) of the vectors that take part, one row an id."""
    component = lambda x: x.cast("double")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(component(x)) & (F.abs(component(x)) != float("inf")))
    good = embeddings.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(finite)
    vector = F.transform("embedding", lambda x: F.floor(component(x) * SCALE).cast("long"))
    return good.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector")).groupBy("vec_id").agg(F.min("vector").alias("vector"))


def _matrix(vectors: pa.Array, dims: int) -> np.ndarray:
    """Padded rows of an array of integer lists."""
    sizes = np.diff(vectors.offsets.to_numpy())
    out = np.zeros((len(vectors), dims), np.int64)
    at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(vectors)), sizes), at] = vectors.flatten().to_numpy()
    return out


def _best(scores: np.ndarray, queries: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of the k best rows for each query of a block pair, a query's own row left out."""
    own = queries[:, None] == ids[None, :]
    scores = np.where(own, -(1 << 62), scores)
    take = min(k, scores.shape[1])
    order = np.lexsort((np.broadcast_to(ids, scores.shape), -scores.astype(np.float64)), axis=1)[:, :take] if scores.shape[1] <= 64 else None
    if order is None:  # all rows that reach the k-th score, ties included, are put in order
        cut = -np.partition(-scores, take - 1, axis=1)[:, take - 1]
        rows, cols = np.nonzero(scores >= cut[:, None])
        sort = np.lexsort((ids[cols], -scores[rows, cols], rows))
        rows, cols = rows[sort], cols[sort]
        first = np.searchsorted(rows, rows)
        kept = np.arange(len(rows)) - first < take
        rows, cols = rows[kept], cols[kept]
    else:
        rows, cols = np.repeat(np.arange(len(queries)), take), order.ravel()
    real = ~own[rows, cols]
    rows, cols = rows[real], cols[real]
    return queries[rows], ids[cols], scores[rows, cols]


def _packed(rows: DataFrame, counts: dict[int, int], dims: int) -> DataFrame:
    """(leaf, block, ids, data, radius) of rows (leaf, vec_id, vector, distance): about ``BLOCK`` rows of a leaf in each."""
    split = F.create_map(*[F.lit(x) for leaf, n in counts.items() for x in (leaf, -(-n // BLOCK))]) if counts else F.create_map(F.lit(0), F.lit(1))
    blocked = rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.element_at(split, F.col("leaf")).cast("long")).cast("int"))

    def pack(data: pa.Table) -> pa.Table:
        vectors = data.column("vector").combine_chunks()
        vectors = vectors.chunk(0) if isinstance(vectors, pa.ChunkedArray) else vectors
        ids = data.column("vec_id").to_numpy().astype(np.int64)
        return pa.table({
            "leaf": pa.array([data.column("leaf")[0].as_py()], pa.int32()), "block": pa.array([data.column("block")[0].as_py()], pa.int32()),
            "ids": pa.array([ids.tobytes()], pa.binary()), "data": pa.array([_matrix(vectors, dims).astype(np.int32).tobytes()], pa.binary()),
            "radius": pa.array([float(max(data.column("distance").to_numpy()))]),
        })

    return settled(blocked.groupBy("leaf", "block").applyInArrow(pack, "leaf int, block int, ids binary, data binary, radius double"))


def _scored(pairs: DataFrame, dims: int, k: int) -> DataFrame:
    """(query_id, vec_id, score): each query's k best of each block; ``pairs`` hold q_ids, q_data, ids and data."""
    def run(batches):
        for batch in batches:
            for q_ids, q_data, ids, data in zip(*(batch.column(c) for c in ("q_ids", "q_data", "ids", "data"))):
                queries, rows = np.frombuffer(q_ids.as_py(), np.int64), np.frombuffer(ids.as_py(), np.int64)
                # exact in doubles: |component| <= 2**24 and sums under 2**53 are checked before
                a = np.frombuffer(q_data.as_py(), np.int32).reshape(len(queries), dims).astype(np.float64)
                b = np.frombuffer(data.as_py(), np.int32).reshape(len(rows), dims).astype(np.float64)
                for lo in range(0, len(queries), 512):
                    q, i, s = _best(np.rint(a[lo : lo + 512] @ b.T).astype(np.int64), queries[lo : lo + 512], rows, k)
                    yield pa.record_batch([pa.array(q), pa.array(i), pa.array(s)], ["query_id", "vec_id", "score"])

    return pairs.select("q_ids", "q_data", "ids", "data").mapInArrow(run, "query_id long, vec_id long, score long")


def _rank(scores: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scores.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def exact_top_k(embeddings: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for each row of ``embeddings`` that ``is_query`` (on vec_id) picks."""
    spark = embeddings.sparkSession
    rows = settled(quantised(embeddings))
    shape = rows.agg(F.max(F.size("vector")).alias("dims"), F.count("*").alias("n"), F.max(F.array_max(F.transform("vector", F.abs))).alias("largest")).first()
    if not shape["n"] or not shape["dims"]:
        # vectors without components all score 0: ties go to the least ids
        least = [r[0] for r in rows.orderBy("vec_id").limit(k + 1).select("vec_id").collect()]
        few = spark.createDataFrame([(i,) for i in least], "vec_id long").withColumn("score", F.lit(0).cast("long"))
        return _rank(rows.where(is_query).select(F.col("vec_id").alias("query_id")).join(few, F.col("query_id") != F.col("vec_id")), k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
    dims = shape["dims"]
    if shape["largest"] > LARGEST or shape["largest"] ** 2 * dims >= 1 << 53:
        raise ValueError("components are too large for exact scores")
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toPandas()  # at most SAMPLE rows
    sample = np.zeros((len(picked), dims))
    for i, v in enumerate(picked["vector"]):
        sample[i, : len(v)] = v
    wanted = min(LEAVES, max(FEWEST, shape["n"] // LEAF_ROWS))
    root, leaves = build_tree(sample, max(1, len(sample) // wanted))
    shared = spark.sparkContext.broadcast(root)
    centres = np.array([leaf.centre for leaf in leaves])

    def place(batches):
        for batch in batches:
            vectors = batch.column("vector")
            at = _matrix(vectors, dims).astype(np.float64)
            leaf = descend(shared.value, at)
            distance = np.linalg.norm(at - centres[leaf], axis=1)
            yield pa.record_batch([pa.array(leaf), batch.column("vec_id"), vectors, pa.array(distance)], ["leaf", "vec_id", "vector", "distance"])

    placed = settled(rows.mapInArrow(place, "leaf int, vec_id long, vector array<long>, distance double"))
    chosen = placed.where(is_query)
    data = _packed(placed, {r["leaf"]: r["count"] for r in placed.groupBy("leaf").count().collect()}, dims)
    asked = _packed(chosen, {r["leaf"]: r["count"] for r in chosen.groupBy("leaf").count().collect()}, dims)
    asked = asked.select(F.col("leaf").alias("q_leaf"), F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), F.col("radius").alias("q_radius"))

    near = settled(_scored(asked.join(data, F.col("q_leaf") == F.col("leaf")), dims, k))
    kth = _rank(near, k).where(F.col("rank") == k).select("query_id", "score")
    grouped = chosen.select(F.col("vec_id").alias("query_id"), F.col("leaf").alias("q_leaf")).join(kth, "query_id", "left")
    block_of = F.explode(F.col("own")).alias("query_id")
    unpack = F.udf(lambda ids: np.frombuffer(ids, np.int64).tolist(), "array<long>")  # a group's ids, one call a group
    groups = asked.select("q_leaf", "q_block", unpack("q_ids").alias("own")).select("q_leaf", "q_block", block_of)
    worst = groups.join(grouped.select("query_id", F.col("score").cast("double").alias("score")), "query_id").groupBy("q_leaf", "q_block").agg(F.min(F.coalesce("score", F.lit(float("-inf")))).alias("worst"))
    worst = settled(worst)

    # the trees with their radii: as many numbers as the tree has nodes
    leaf_radius = lambda df, name, radius: {r[0]: r[1] for r in df.groupBy(name).agg(F.max(radius)).collect()}
    set_radii(root, leaf_radius(data, "leaf", "radius"))
    own = {r[0]: r[1] for r in worst.groupBy("q_leaf").agg(F.min("worst")).collect()}
    query_root = _copied(root)
    set_radii(query_root, leaf_radius(asked, "q_leaf", "q_radius"))
    set_bounds(query_root, own)
    survivors = [p for p in node_pairs(query_root, root) if p[0] != p[1]]
    pairs = spark.createDataFrame(survivors, "q_leaf int, leaf int, dot double, q double, x double")  # pairs of leaves

    limit = reach(F.col("dot"), F.col("q"), F.col("x"), F.col("q_radius"), F.col("radius"))
    met = asked.select("q_leaf", "q_block", "q_radius").join(worst, ["q_leaf", "q_block"]).join(pairs, "q_leaf").join(data.select("leaf", "block", "radius"), "leaf")
    met = met.where(limit + F.abs(limit) * 1e-9 + 1e-6 >= F.col("worst")).select("q_leaf", "q_block", "leaf", "block")
    # queries travel to the blocks of data, which are not copied before they are scored
    wide = met.join(asked.select("q_leaf", "q_block", "q_ids", "q_data"), ["q_leaf", "q_block"]).join(data.select("leaf", "block", "ids", "data"), ["leaf", "block"])
    best = _rank(near.union(_scored(wide, dims, k)), k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _copied(node: Node) -> Node:
    out = Node(node.centre, [_copied(c) for c in node.children])
    out.leaf = node.leaf
    return out


ORACLE = f"""
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.e, v.e) AS BIGINT) AS score FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= {K}
"""


@query("op7_exact_topk", ORACLE)
def op7(spark, sf_dir):
    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
