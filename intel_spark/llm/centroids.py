"""Exact integer k-means whose distances come from dictionaries of subvectors.

Vectors are kept in packs of at most ``PACK`` rows, as a columnar file keeps row groups. A pack holds, for each block of
dimensions, its distinct subvectors and every row's code among them, which loses nothing. Blocks start one dimension
wide; neighbours are joined while the joined block has few distinct subvectors against the pack's rows, so repeated
vectors end up in wide blocks that cost one lookup. In a round a pack works out the exact squared distance of each
distinct subvector to each centroid's part once, and a row's distances are the sums of those that its codes name. New
centroids are sums over codes as well: how often a centroid's rows use a subvector, times the subvector. A pack hands on
one row a cluster and dimension, which Spark adds up; only centroids travel to the driver and back.

Vectors are quantised to floor(256 * component). Vectors that are null, hold a null or non-finite component, or have
another number of components than ``dims`` take no part. Every row counts, equal ids and equal vectors too; a null id is
hashed as an empty one. Rows of equal hash start as centroids in the order of their vectors; with fewer rows than
``k`` there are as many centroids as rows, and an empty table gives an empty result. Ties go to the smaller centroid
number, a centroid without rows stays. Components beyond 2**24 after quantising raise an error, since distances could
leave the range of exact integers.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intel_spark.llm.base import query, settled, table

DIMS = 64
K = 40
ROUNDS = 5
SCALE = 256
PACK = 8_192  # vectors encoded together
STEP = 2_048  # vectors whose distances are in memory at once
LARGEST = 1 << 24

PACKED = "ids binary, nulls binary, starts binary, widths binary, sizes binary, entries binary, codes binary"


def quantised(embeddings: DataFrame, dims: int = DIMS) -> DataFrame:
    """(vec_id, vector array<long>) of the vectors that take part."""
    real = lambda x: x.cast("double")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(real(x)) & (F.abs(real(x)) != float("inf")))
    kept = embeddings.select("vec_id", "embedding").where(F.col("embedding").isNotNull() & (F.size("embedding") == dims)).where(finite)
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(real(x) * SCALE).cast("long")).alias("vector"))


def first_centroids(rows: DataFrame, k: int = K) -> list[list[int]]:
    """The ``k`` vectors of the smallest id hashes, in the order of the hashes."""
    mark = F.sha2(F.concat(F.lit("2:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return [list(r["vector"]) for r in rows.select(mark.alias("mark"), "vector").orderBy("mark", "vector").limit(k).collect()]


def encode(rows: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(first dimension, distinct subvectors, codes) of the blocks that the rows' dimensions are cut into.

    Two neighbours become one block while that leaves no more distinct subvectors than the two had together.
    """
    blocks = []
    for d in range(rows.shape[1]):
        entries, codes = np.unique(rows[:, d], return_inverse=True)
        blocks.append((d, entries[:, None], codes.ravel()))
    joined = True
    while joined and len(blocks) > 1:
        joined, out, at = False, [], 0
        while at < len(blocks):
            if at + 1 < len(blocks):
                (d, a, x), (_, b, y) = blocks[at : at + 2]
                pairs, codes = np.unique(x.astype(np.int64) * len(b) + y, return_inverse=True)
                if len(pairs) <= len(a) + len(b):
                    out.append((d, np.hstack([a[pairs // len(b)], b[pairs % len(b)]]), codes.ravel()))
                    at, joined = at + 2, True
                    continue
            out.append(blocks[at])
            at += 1
        blocks = out
    return blocks


class Pack:
    """Encoded rows: their ids and, block by block, subvectors and codes."""

    def __init__(self, ids: np.ndarray, nulls: np.ndarray, blocks: list[tuple[int, np.ndarray, np.ndarray]]):
        self.ids, self.nulls, self.blocks = ids, nulls, blocks

    def row(self) -> list[bytes]:
        starts = np.array([b[0] for b in self.blocks], np.int32)
        widths = np.array([b[1].shape[1] for b in self.blocks], np.int32)
        sizes = np.array([len(b[1]) for b in self.blocks], np.int32)
        entries = np.concatenate([b[1].ravel() for b in self.blocks]).astype(np.int32)
        codes = np.concatenate([b[2] for b in self.blocks]).astype(np.uint16)  # a pack has no more than PACK codes
        return [x.tobytes() for x in (self.ids, self.nulls, starts, widths, sizes, entries, codes)]

    @classmethod
    def of(cls, ids, nulls, starts, widths, sizes, entries, codes) -> "Pack":
        read = np.frombuffer
        ids, widths, sizes = read(ids, np.int64), read(widths, np.int32), read(sizes, np.int32)
        entries, codes = read(entries, np.int32).astype(np.int64), read(codes, np.uint16).reshape(len(sizes), len(ids))
        ends = np.cumsum(widths * sizes)
        blocks = [(int(d), entries[end - w * n : end].reshape(n, w), codes[i]) for i, (d, w, n, end) in enumerate(zip(read(starts, np.int32), widths, sizes, ends))]
        return cls(ids, read(nulls, bool), blocks)

    def nearest(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's nearest centroid and its squared distance."""
        parts = [((entries[:, None, :] - centroids[None, :, d : d + entries.shape[1]]) ** 2).sum(axis=2) for d, entries, _ in self.blocks]
        cluster, distance = np.zeros(len(self.ids), np.int64), np.zeros(len(self.ids), np.int64)
        for lo in range(0, len(self.ids), STEP):
            own = slice(lo, lo + STEP)
            total = np.zeros((len(self.ids[own]), len(centroids)), np.int64)
            for part, (_, _, codes) in zip(parts, self.blocks):
                total += part[codes[own]]
            cluster[own] = total.argmin(axis=1)
            distance[own] = total[np.arange(len(total)), cluster[own]]
        return cluster, distance

    def sums(self, cluster: np.ndarray, k: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows of each cluster and the sum of their vectors."""
        out = np.zeros((k, dims), np.int64)
        for d, entries, codes in self.blocks:
            uses = np.bincount(cluster * len(entries) + codes, minlength=k * len(entries)).reshape(k, len(entries))
            out[:, d : d + entries.shape[1]] += uses @ entries
        return np.bincount(cluster, minlength=k), out


def packed(rows: DataFrame, dims: int = DIMS) -> DataFrame:
    """The vectors of (vec_id, vector) in packs, one row each."""
    def run(batches):
        held, n = [], 0

        def pack(ready: list[pa.RecordBatch]) -> pa.RecordBatch:
            ids = pa.concat_arrays([b.column("vec_id") for b in ready])
            vectors = np.concatenate([b.column("vector").flatten().to_numpy(zero_copy_only=False) for b in ready]).reshape(len(ids), dims)
            if len(vectors) and np.abs(vectors).max() > LARGEST:
                raise ValueError("components are too large for exact distances")
            one = Pack(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), np.asarray(ids.is_null()).astype(bool), encode(vectors))
            return pa.record_batch([pa.array([x], pa.binary()) for x in one.row()], ["ids", "nulls", "starts", "widths", "sizes", "entries", "codes"])

        for batch in batches:
            at = 0
            while at < len(batch):
                part = batch.slice(at, PACK - n)
                held.append(part)
                n, at = n + len(part), at + len(part)
                if n == PACK:
                    yield pack(held)
                    held, n = [], 0
        if n:
            yield pack(held)

    return rows.mapInArrow(run, PACKED)


def _packs(batches):
    for batch in batches:
        for i in range(len(batch)):
            yield Pack.of(*(batch.column(c)[i].as_py() for c in range(batch.num_columns)))


def next_centroids(packs: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one more round."""
    k, dims = centroids.shape

    def run(batches):
        count, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for pack in _packs(batches):
            n, sums = pack.sums(pack.nearest(centroids)[0], k, dims)
            count, total = count + n, total + sums
        used = np.flatnonzero(count)
        place = np.tile(np.arange(-1, dims), len(used))  # -1: the number of rows
        value = np.hstack([count[used, None], total[used]]).ravel()
        yield pa.record_batch([pa.array(np.repeat(used, dims + 1), pa.int32()), pa.array(place, pa.int32()), pa.array(value, pa.int64())], ["cluster", "place", "value"])

    found = packs.mapInArrow(run, "cluster int, place int, value long").groupBy("cluster", "place").agg(F.sum("value").alias("value"))
    sums: dict[int, dict[int, int]] = {}
    for r in found.collect():  # k * (dims + 1) numbers at most
        sums.setdefault(r["cluster"], {})[r["place"]] = r["value"]
    out = centroids.copy()
    for cluster, own in sums.items():
        out[cluster] = [own[d] // own[-1] for d in range(dims)]
    return out


def cluster_vectors(embeddings: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that takes part."""
    spark = embeddings.sparkSession
    rows = quantised(embeddings, dims)
    start = first_centroids(rows, k)
    packs = settled(packed(rows, dims))
    centroids = np.array(start, np.int64).reshape(len(start), dims)
    for _ in range(rounds if start else 0):
        centroids = next_centroids(packs, centroids)

    def assign(batches):
        for pack in _packs(batches):
            cluster, distance = pack.nearest(centroids)
            yield pa.record_batch([pa.array(pack.ids, mask=pack.nulls), pa.array(cluster.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    assigned = settled(packs.mapInArrow(assign, "vec_id long, cluster int, distance long"))
    inertia = {r["cluster"]: r["inertia"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}  # k rows
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    named = spark.createDataFrame([(c, n, sum(inertia.values()), digest[c]) for c, n in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows


def _oracle() -> str:
    """The rounds written out, one query each."""
    steps = [
        f"""v AS MATERIALIZED (
    SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
    WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), x AS MATERIALIZED (SELECT row, unnest(e) AS x, generate_subscripts(e, 1) AS d FROM v)""",
        f"""s AS (SELECT e, row_number() OVER (ORDER BY sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')), e) - 1 AS c FROM v QUALIFY c < {K}),
c0 AS MATERIALIZED (SELECT c, unnest(e) AS m, generate_subscripts(e, 1) AS d FROM s)""",
    ]
    for r in range(ROUNDS + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
    SELECT row, min(t) // {K} AS distance, min(t) % {K} AS c
    FROM (SELECT row, c, {K} * CAST(sum((x - m) * (x - m)) AS BIGINT) + c AS t FROM x JOIN c{r} USING (d) GROUP BY row, c) GROUP BY row
)""")
        if r < ROUNDS:
            steps.append(f"""n{r} AS (SELECT c, d, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM x JOIN a{r} USING (row) GROUP BY c, d),
c{r + 1} AS MATERIALIZED (SELECT o.c, o.d, coalesce((s - ((s % n) + n) % n) // n, m) AS m FROM c{r} o LEFT JOIN n{r} n ON n.c = o.c AND n.d = o.d)""")
    return f"""WITH {", ".join(steps)}, h AS (SELECT c, sha256(string_agg(CAST(m AS VARCHAR), ',' ORDER BY d)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{ROUNDS} JOIN v USING (row) JOIN h USING (c)"""


ORACLE = _oracle()


@query("op11_centroid_clustering", ORACLE)
def op11(spark, sf_dir):
    return cluster_vectors(table(spark, sf_dir, "embeddings"))
