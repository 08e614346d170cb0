"""Sharding by extendible hashing, with DataFrame functions only.

A row's hash is 120 bits: 60 of its key and, for rows that share a key, 60 of its content. A shard is a bucket of the
directory: all rows whose hashes begin with the same bits. Beginning with one bucket without any bits, only buckets over
the byte limit are split on their next bit, so a shard is the shortest prefix whose rows fit the limit.

The directory is found from byte counts, not by moving rows: rows are counted by a prefix long enough for the average
shard, the counts are rolled up to all shorter prefixes, and only cells that are still too large are counted again by
a longer prefix. Counts are summed before the shuffle, so a hot key costs one row a task. Rows then meet their cell by an
equi-join on the prefix, in which cells have about equal numbers of rows.

A bucket whose rows all have one hash (a single row above the limit, or equal rows) cannot be split by any bit: it is a
shard of its own with ``over_limit`` set. A null key hashes as the empty string, a null content as the empty one and has
no bytes. An empty table has no shards.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from intel_spark.llm.base import query, settled, table

LIMIT = 1 << 20  # bytes of text in a shard
HALF = 60
BITS = 2 * HALF
STEP = 8  # bits by which too large cells are counted again
SPARE = 4  # bits beyond the average shard's prefix in the first count
FIRST = 24  # most bits of the first count


def hash60(value: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(value, F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def hashed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``__h1``, ``__h2`` (hash of key and content) and ``__bytes``."""
    return docs.withColumns({"__h1": hash60(F.col(key).cast("string")), "__h2": hash60(F.col(text)), "__bytes": F.coalesce(F.octet_length(text), F.lit(0)).cast("long")})


def _cell(depth: int) -> list[Column]:
    """The first ``depth`` bits as two numbers."""
    return [F.shiftright("__h1", max(0, HALF - depth)).alias("p1"), F.shiftright("__h2", min(HALF, BITS - depth)).alias("p2")]


def _parent(depth: Column, at: int) -> list[Column]:
    """The first ``depth`` bits of a cell of ``at`` bits."""
    one = F.expr(f"shiftright(p1, cast(greatest(0, least({at}, {HALF}) - least(depth, {HALF})) as int))")
    two = F.expr(f"case when depth <= {HALF} then 0L else shiftright(p2, cast({at} - depth as int)) end")
    return [one.alias("q1"), two.alias("q2")]


def _counted(rows: DataFrame, known: int, at: int, limit: int) -> DataFrame:
    """(p1, p2, bytes, depth) of the cells of ``at`` bits; depth is their shard's, null if they are still too large.

    Shorter prefixes than ``known`` bits are known to be too large.
    """
    spread = lambda c: [F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}")]
    cells = settled(rows.groupBy(*_cell(at)).agg(F.sum("__bytes").alias("bytes"), *spread("__h1"), *spread("__h2")))
    every = cells.withColumn("depth", F.explode(F.sequence(F.lit(known), F.lit(at))))
    every = every.select("p1", "p2", "depth", *_parent(F.col("depth"), at), "bytes", "lo___h1", "hi___h1", "lo___h2", "hi___h2")
    sums = every.groupBy("depth", "q1", "q2").agg(F.sum("bytes").alias("total"), *[f(c).alias(c) for c, f in (("lo___h1", F.min), ("hi___h1", F.max), ("lo___h2", F.min), ("hi___h2", F.max))])
    over = sums.where((F.col("total") > limit) & ((F.col("lo___h1") < F.col("hi___h1")) | (F.col("lo___h2") < F.col("hi___h2")))).select("depth", "q1", "q2")
    deepest = every.select("p1", "p2", "depth", "q1", "q2").join(over, ["depth", "q1", "q2"]).groupBy("p1", "p2").agg(F.max("depth").alias("last"))
    depth = F.coalesce(F.col("last") + 1, F.lit(known))
    return settled(cells.select("p1", "p2", "bytes").join(deepest, ["p1", "p2"], "left").select("p1", "p2", "bytes", F.when((depth <= at) | F.lit(at == BITS), F.least(depth, F.lit(BITS))).alias("depth")))


def shard_name(depth: Column) -> Column:
    """The bits of a prefix, spelled out."""
    bits = F.concat(F.lpad(F.bin("__h1"), HALF, "0"), F.lpad(F.bin("__h2"), HALF, "0"))
    return F.substring(bits, F.lit(1), depth)


def assign_shards(rows: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``rows`` (with the columns of ``hashed``) with ``__shard`` and ``__depth``."""
    sizes = rows.select("__h1", "__h2", "__bytes")
    total = sizes.agg(F.sum("__bytes")).first()[0] or 0
    at = min(FIRST, SPARE + max(0, ceil(log2(max(1.0, total / limit)))))
    known, left, levels = 0, sizes, []
    while True:
        cells = _counted(left, known, at, limit)
        levels.append((at, cells))
        open_cells = cells.where("depth is null")
        if open_cells.isEmpty():
            break
        left = left.withColumns({"__p1": _cell(at)[0], "__p2": _cell(at)[1]}).join(open_cells.select(F.col("p1").alias("__p1"), F.col("p2").alias("__p2")), ["__p1", "__p2"], "left_semi").select("__h1", "__h2", "__bytes")
        known, at = at + 1, min(BITS, at + STEP)
    out = rows.withColumn("__depth", F.lit(None).cast("int"))
    for at, cells in levels:
        named = cells.select(F.col("p1").alias("__p1"), F.col("p2").alias("__p2"), F.col("depth").cast("int").alias("__found"))
        out = out.withColumns({"__p1": _cell(at)[0], "__p2": _cell(at)[1]}).join(named, ["__p1", "__p2"], "left")
        out = out.withColumn("__depth", F.coalesce("__depth", "__found")).drop("__p1", "__p2", "__found")
    return out.withColumn("__shard", shard_name(F.col("__depth")))


def shard_documents(docs: DataFrame, limit: int = LIMIT, key: str = "doc_id", text: str = "text", name: str = "shard") -> DataFrame:
    """``docs`` with a column ``name``: the shard of each row as its hash prefix."""
    out = assign_shards(hashed(docs, key, text), limit)
    return out.withColumn(name, F.col("__shard")).select(*[F.col(f"`{c}`") for c in docs.columns if c != name], name)


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT, key: str = "doc_id", text: str = "text") -> None:
    """Write each shard as one folder; a shard's rows meet in one task, which its limit bounds."""
    out = shard_documents(docs, limit, key, text)
    out.repartition("shard").write.partitionBy("shard").parquet(path)


def shard_report(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, shard, depth, shard_bytes, over_limit) of each row of ``docs`` (doc_id, text)."""
    rows = hashed(docs.select("doc_id", "text")).drop("text")
    placed = assign_shards(rows, limit).select("doc_id", F.col("__bytes").alias("n_bytes"), F.col("__shard").alias("shard"), F.col("__depth").alias("depth"))
    sums = placed.groupBy("shard").agg(F.sum("n_bytes").alias("shard_bytes"))
    return placed.join(sums, "shard").select("doc_id", "n_bytes", "shard", "depth", "shard_bytes", (F.col("shard_bytes") > limit).alias("over_limit"))


ORACLE = f"""
WITH rows AS (
    SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n_bytes, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS h FROM documents
), nodes AS (
    SELECT depth, h >> (60 - depth) AS p, sum(n_bytes) AS total, min(h) AS lo, max(h) AS hi FROM rows, (SELECT unnest(range(0, 61)) AS depth) GROUP BY ALL
), over AS (SELECT depth, p FROM nodes WHERE total > {LIMIT} AND lo < hi),
deep AS (
    SELECT r.doc_id, max(o.depth) + 1 AS depth FROM rows r JOIN over o ON o.p = r.h >> (60 - o.depth) GROUP BY r.doc_id
), placed AS (
    SELECT r.doc_id, r.n_bytes, coalesce(d.depth, 0) AS depth, substr(lpad(bin(r.h), 60, '0'), 1, coalesce(d.depth, 0)) AS shard FROM rows r LEFT JOIN deep d USING (doc_id)
)
SELECT doc_id, CAST(n_bytes AS BIGINT) AS n_bytes, shard, CAST(depth AS INTEGER) AS depth, CAST(sum(n_bytes) OVER (PARTITION BY shard) AS BIGINT) AS shard_bytes,
    sum(n_bytes) OVER (PARTITION BY shard) > {LIMIT} AS over_limit
FROM placed
"""


@query("op4_extendible_sharding", ORACLE)
def op4(spark, sf_dir):
    return shard_report(table(spark, sf_dir, "documents"))
