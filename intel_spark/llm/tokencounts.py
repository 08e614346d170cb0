"""Token counts of documents in flat token files, found by scanning for end-of-document identifiers.

A token file is a run of 16-bit little-endian token identifiers, each document followed by the end identifier, without any
index. Files are read in blocks of bytes. A task looks for the end identifier's two bytes with vectorised comparisons, at
even and odd places alike, because a block does not know where it begins in its file. A prefix scan over the blocks'
lengths tells it, which settles the alignment of the hits, and a second one over the numbers of hits and their last
places stitches the documents that run over a block's end. Neither moves tokens.

Writing puts the identifiers of a task's documents beside its tokens, in the same order, so that counts get their
document back by file and number. A null or empty text is a document without tokens; a null id stays null; repeated rows are
documents of their own; an empty table gives no files.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from intel_spark.llm.base import fresh_path, query, settled, table
from intel_spark.llm.blocks import block_rows, placed_blocks, runs

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
END_ID = 50256
LATIN = "ISO-8859-1"
CHUNK = 1 << 20  # tokens in a row of a token file's making


def separator(end_id: int = END_ID) -> str:
    """The end identifier's two bytes, as text of a one-byte encoding."""
    return end_id.to_bytes(2, "little").decode(LATIN)


@lru_cache(maxsize=2)
def encoding(name: str):
    import public_tokenizers
    import tiktoken

    with open(name if "/" in name else public_tokenizers.path(name), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("flat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def write_token_files(docs: DataFrame, folder: str, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> None:
    """Write tokens under ``folder``/kind=tokens and ids under ``folder``/kind=ids, both closed by the end identifier."""
    def rows(batches):
        number = 0
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            encode = encoding(vocabulary)
            held, size, first = [], 0, 0
            for i in range(len(ids)):
                text = texts[i].as_py()
                tokens = encode.encode_to_numpy(text, disallowed_special=()).astype("<u2").tobytes() if text else b""
                held.append(tokens)
                size += len(tokens)
                if size >= 2 * CHUNK or i + 1 == len(ids):
                    known = ["" if x is None else str(x) for x in ids[first : i + 1]]
                    yield pa.record_batch([pa.array(["ids"] * len(known) + ["tokens"] * len(held)), pa.array(list(range(number, number + len(held))) * 2, pa.int64()), pa.array([k.encode() for k in known] + held, pa.binary())], ["kind", "number", "value"])
                    number += len(held)
                    held, size, first = [], 0, i + 1

    made = docs.select("doc_id", "text").mapInArrow(rows, "kind string, number long, value binary")
    ordered = made.sortWithinPartitions("kind", "number").select(F.col("value").cast("string").alias("value"), "kind")
    ordered.write.partitionBy("kind").option("lineSep", separator(end_id)).option("encoding", LATIN).text(folder)


def _hits(end_id: int):
    low, high = end_id.to_bytes(2, "little")
    if b"\n" in end_id.to_bytes(2, "little"):
        raise ValueError("the end identifier must not hold a line feed byte")

    def scan(batches):
        """(file, block, place of a hit); place null in the block's own row, whose length is its bytes, beside the file's."""
        names, kinds = ["file", "block", "place", "length", "bytes"], [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]

        def rows(file, block, places, length, size=None):
            n = len(places)
            return pa.record_batch([pa.array(x, k) for x, k in zip(([file] * n, [block] * n, places, [length] * n, [size] * n), kinds)], names)

        state = None
        for file, block, values, begins, size in runs(batches):
            if begins:
                if state:
                    yield rows(*state[:2], [None], *state[2:])
                state = [file, block, 0, size]
            # the stretch's bytes: its values with line feeds between and after them, which no hit can hold
            data = np.frombuffer(b"\n".join(values.to_pylist()) + b"\n", np.uint8)
            found = np.flatnonzero((data[:-1] == low) & (data[1:] == high)) + state[2]
            if len(found):
                yield rows(file, block, found, None)
            state[2] += len(data)
        if state:
            yield rows(*state[:2], [None], *state[2:])

    return scan


def _part(file: str = "file"):
    return F.regexp_extract(F.col(file), r"part-(\d+)", 1)


def count_tokens(spark: SparkSession, folder: str, end_id: int = END_ID) -> DataFrame:
    """(file, number, n_tokens) of the documents in the token files of ``folder``, numbered from 0 within a file."""
    scanned = settled(block_rows(spark, folder, "\n", LATIN).mapInArrow(_hits(end_id), "file string, block long, place long, length long, bytes long"))
    blocks = placed_blocks(scanned.where("place is null").select("file", "block", "length", "bytes"))
    # the reader leaves out three bytes that look like a byte order mark at a file's start
    whole = Window.partitionBy("file")
    mark = F.when(F.max("bytes").over(whole) - F.sum("length").over(whole) >= 2, 3).otherwise(0)
    blocks = blocks.select("file", "block", (F.col("start") + mark).alias("start"))
    aligned = scanned.where("place is not null").join(blocks, ["file", "block"]).select("file", "block", (F.col("start") + F.col("place")).alias("at")).where("at % 2 = 0")
    aligned = settled(aligned)
    own = aligned.groupBy("file", "block").agg(F.count("*").alias("hits"), F.max("at").alias("last"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = own.select("file", "block", F.coalesce(F.sum("hits").over(earlier), F.lit(0)).alias("hits_before"), F.max("last").over(earlier).alias("last_before"))
    within = Window.partitionBy("file", "block").orderBy("at")
    numbered = aligned.select("file", "block", "at", F.lag("at").over(within).alias("previous"), (F.row_number().over(within) - 1).alias("nth")).join(carried, ["file", "block"])
    begin = F.coalesce("previous", "last_before", F.lit(-2)) + 2
    return numbered.select("file", (F.col("hits_before") + F.col("nth")).alias("number"), ((F.col("at") - begin) / 2).cast("long").alias("n_tokens"))


def file_ids(spark: SparkSession, folder: str, end_id: int = END_ID) -> DataFrame:
    """(file, number, doc_id) from the id files written beside the tokens."""
    def scan(batches):
        state = None
        for file, block, values, begins, _ in runs(batches):
            if begins:
                state = 0
            n = len(values)
            ids = pa.array([int(v) if v else None for v in values.to_pylist()], pa.int64())
            yield pa.record_batch([pa.array([file] * n), pa.array([block] * n, pa.int64()), pa.array(range(state, state + n), pa.int64()), ids], ["file", "block", "nth", "doc_id"])
            state += n

    rows = settled(block_rows(spark, folder, separator(end_id), LATIN).mapInArrow(scan, "file string, block long, nth long, doc_id long"))
    blocks = placed_blocks(rows.groupBy("file", "block").agg(F.count("*").alias("length"))).select("file", "block", "start")
    return rows.join(blocks, ["file", "block"]).select("file", (F.col("start") + F.col("nth")).alias("number"), "doc_id")


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, n_tokens) of each row of ``docs``, by way of flat token files in the shared folder."""
    spark = docs.sparkSession
    folder = fresh_path(spark, "tokens")
    write_token_files(docs, folder, vocabulary, end_id)
    if docs.isEmpty():
        return spark.createDataFrame([], "doc_id long, n_tokens long")
    counts = count_tokens(spark, folder + "/kind=tokens", end_id).select(_part().alias("part"), "number", "n_tokens")
    ids = file_ids(spark, folder + "/kind=ids", end_id).select(_part().alias("part"), "number", "doc_id")
    return ids.join(counts, ["part", "number"]).select("doc_id", "n_tokens")


@query("op10_token_counts")
def op10(spark, sf_dir):
    return token_counts(table(spark, sf_dir, "documents"))
