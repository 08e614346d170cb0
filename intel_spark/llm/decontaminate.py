"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

A test item is found in a document when the document holds at least ``percent`` of the item's distinct word shingles.
A short item against a long document has a tiny Jaccard similarity, so signatures of whole documents would miss it.
Items are therefore partitioned by their number of shingles, and for each partition every document is cut into blocks of
about the partition's size. Blocks and items get one-permutation MinHash signatures (a hash names a bin, the least hash
of a bin is its value), and an item and a document that agree in any bin are a candidate pair. The number of bins of a
partition is the least for which an item at the threshold is missed with a probability under ``MISS``; where no number
of bins does it (items of few shingles) a block is a single shingle and nothing can be missed. Every candidate is then
checked on the whole sets.

The item signatures are shipped to the tasks in slices of at most ``SLICE`` shingles, so that what a task holds is
bounded however long the benchmark is; each slice is one pass over the documents, without a shuffle.

Items without words match nothing. Items and documents of fewer words than a shingle count as one shingle made of all
their words. Null texts match nothing, equal rows each get their own matches, rows with null ids are matched as well.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intel_spark.llm.base import query, settled, table
from intel_spark.llm.shingles import WORDS, mix, rows_of_words, shingle_hashes, shingle_rows

MISS = 1e-9
SLICE = 2_000_000
SMALLEST = 8  # items up to this size share the partition with single-shingle blocks
FILTER_BITS = 20


def bins_for(least: int, most: int, block: int, percent: int) -> int:
    """The least power of two of bins that misses an item of ``least`` to ``most`` shingles rarely enough, 0 if none."""
    shared, union = ceil(least * percent / 100), most + block
    for power in range(2, 6 + block.bit_length()):
        bins = 1 << power
        kept = bins * (1 - (1 - 1 / bins) ** union) / union  # chance that a member of the union is the least of its bin
        if (1 - kept) ** shared <= MISS:
            return bins
    return 0


class Partition:
    """Signatures of the items of one size class."""

    def __init__(self, number: int, items: list[int], sets: list[np.ndarray], percent: int):
        sizes = [len(s) for s in sets]
        self.block = max(sizes)
        self.bins = bins_for(min(sizes), max(sizes), self.block, percent)
        if number == 0 or not self.bins:
            self.block, self.bins = 1, 0
        self.seed = np.uint64(0x9E3779B97F4A7C15 * (number + 1) % (1 << 64))
        keys, owners = [], []
        for item, own in zip(items, sets):
            values = self.hashes(own)
            values = values if not self.bins else values[self.least(values, np.zeros(len(values), np.int64))]
            keys.append(values)
            owners.append(np.full(len(values), item, np.int64))
        keys, owners = np.concatenate(keys), np.concatenate(owners)
        order = np.argsort(keys, kind="stable")
        self.keys, self.owners = keys[order], owners[order]
        self.maybe = np.zeros(1 << FILTER_BITS, bool)
        self.maybe[self.slots(keys)] = True

    def hashes(self, shingles: np.ndarray) -> np.ndarray:
        return mix(shingles ^ self.seed)

    @staticmethod
    def slots(values: np.ndarray) -> np.ndarray:
        return (values >> np.uint64(20)).astype(np.int64) & ((1 << FILTER_BITS) - 1)

    def least(self, values: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """Places of the least value of every (block, bin)."""
        order = np.lexsort((values, values & np.uint64(self.bins - 1), blocks))
        bins, blocks = (values & np.uint64(self.bins - 1))[order], blocks[order]
        first = np.ones(len(order), bool)
        first[1:] = (bins[1:] != bins[:-1]) | (blocks[1:] != blocks[:-1])
        return order[first]

    def candidates(self, shingles: np.ndarray, bounds: np.ndarray) -> set[tuple[int, int]]:
        """(row, item) pairs of which a block's signature and the item's agree in a bin."""
        values = self.hashes(shingles)
        hits = np.flatnonzero(self.maybe[self.slots(values)])
        at = np.minimum(np.searchsorted(self.keys, values[hits]), len(self.keys) - 1)
        hits = hits[self.keys[at] == values[hits]]
        if not len(hits):
            return set()
        rows = np.searchsorted(bounds, hits, "right") - 1
        if self.bins:  # signatures of the blocks that hold a hit
            block = (hits - bounds[rows]) // self.block
            kept = []
            for row, number in set(zip(rows.tolist(), block.tolist())):
                lo = int(bounds[row]) + number * self.block
                hi = min(lo + self.block, int(bounds[row + 1]))
                kept.append(lo + self.least(values[lo:hi], np.zeros(hi - lo, np.int64)))
            hits = np.intersect1d(hits, np.concatenate(kept))
            rows = np.searchsorted(bounds, hits, "right") - 1
        found = set()
        lo, hi = np.searchsorted(self.keys, values[hits], "left"), np.searchsorted(self.keys, values[hits], "right")
        for row, a, b in zip(rows.tolist(), lo.tolist(), hi.tolist()):
            found.update((row, int(item)) for item in self.owners[a:b])
        return found


def partitions(sets: list[np.ndarray], percent: int) -> list[Partition]:
    groups: dict[int, list[int]] = {}
    for i, own in enumerate(sets):
        if len(own):
            groups.setdefault(0 if len(own) <= SMALLEST else int(len(own) - 1).bit_length(), []).append(i)
    return [Partition(number, members, [sets[i] for i in members], percent) for number, members in sorted(groups.items())]


def _matcher(spark, items: list[tuple[int, np.ndarray]], percent: int, k: int):
    """Arrow UDF: the items of one slice that each text contains."""
    shared = spark.sparkContext.broadcast((items, partitions([own for _, own in items], percent)))
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("n_item", pa.int32()), ("n_shared", pa.int32())]))

    @F.arrow_udf("array<struct<item_id: long, n_item: int, n_shared: int>>")
    def matches(text: pa.Array) -> pa.Array:
        held, parts = shared.value
        out = [[] for _ in range(len(text))]
        for first, words, offsets in rows_of_words(text):
            shingles, bounds = shingle_hashes(words, offsets, k)
            pairs = set().union(*(p.candidates(shingles, bounds) for p in parts)) if len(shingles) else ()
            for row, item in sorted(pairs):
                item_id, own = held[item]
                common = int(np.isin(own, shingles[bounds[row] : bounds[row + 1]]).sum())
                if 100 * common >= percent * len(own):
                    out[first + row].append({"item_id": item_id, "n_item": len(own), "n_shared": common})
        return pa.array(out, kind)

    return matches


def item_slices(items: DataFrame, k: int = WORDS):
    """Lists of (item_id, sorted distinct shingles), each list of at most ``SLICE`` shingles or of one item."""
    def sets(batches):
        for batch in batches:
            ids = batch.column("item_id")
            for row, hashes in shingle_rows(batch.column("text"), k):
                own = np.unique(hashes)
                if len(own):
                    yield pa.record_batch([ids.slice(row, 1), pa.array([own.view(np.int64)], pa.list_(pa.int64()))], ["item_id", "members"])

    held, total = [], 0
    cast = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    for row in settled(cast.mapInArrow(sets, "item_id long, members array<long>")).toLocalIterator():
        own = np.array(row["members"], np.int64).view(np.uint64)
        if held and total + len(own) > SLICE:
            yield held
            held, total = [], 0
        held.append((row["item_id"], own))
        total += len(own)
    if held:
        yield held


def with_matches(docs: DataFrame, items: DataFrame, name: str, percent: int = 75, k: int = WORDS) -> DataFrame:
    """``docs`` with a column ``name``: array of (item_id, n_item, n_shared) for the items each text contains."""
    found = [_matcher(docs.sparkSession, part, percent, k)(F.col("text")) for part in item_slices(items, k)]
    empty = F.array().cast("array<struct<item_id: long, n_item: int, n_shared: int>>")
    return docs.withColumn(name, F.concat(empty, *found) if len(found) != 1 else found[0])


def contaminated(docs: DataFrame, items: DataFrame, percent: int = 75, k: int = WORDS) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared): each pair of a document and a test item that it contains."""
    found = with_matches(docs.select("doc_id", "text"), items, "found", percent, k)
    return found.select("doc_id", F.explode("found").alias("m")).select("doc_id", "m.*")


def decontaminate(docs: DataFrame, items: DataFrame, percent: int = 75, k: int = WORDS) -> DataFrame:
    """The rows of ``docs`` that contain no test item."""
    found = with_matches(docs, items, "__matches", percent, k)
    return found.where(F.size("__matches") == 0).select(*[F.col(f"`{c}`") for c in docs.columns])


_SHINGLES = """
{t}_words AS (
    SELECT {id}, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM {t}
), {t}_shingles AS (
    SELECT DISTINCT {id}, CASE WHEN len(w) < 5 THEN list_aggregate(w, 'string_agg', ' ') ELSE list_aggregate(w[i:i + 4], 'string_agg', ' ') END AS s
    FROM (SELECT {id}, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM {t}_words WHERE len(w) > 0)
)"""

ORACLE = f"""
WITH {_SHINGLES.format(t="documents", id="doc_id")}, {_SHINGLES.format(t="benchmark", id="item_id")},
sizes AS (SELECT item_id, count(*) AS n FROM benchmark_shingles GROUP BY item_id)
SELECT d.doc_id, b.item_id, CAST(n AS INTEGER) AS n_item, CAST(count(*) AS INTEGER) AS n_shared
FROM documents_shingles d JOIN benchmark_shingles b ON d.s = b.s JOIN sizes z ON z.item_id = b.item_id
GROUP BY d.doc_id, b.item_id, n HAVING 100 * count(*) >= 75 * n
"""


@query("op1_benchmark_decontamination", ORACLE)
def op1(spark, sf_dir):
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
