"""Byte-exact reading of flat files in blocks, through Spark's own file reader.

Spark's text source splits files at a separator of one's choice and reads their blocks in parallel, from any file system.
The rows of a block, with the separators between them, are its bytes; a block's place in its file is the sum of the
lengths of the blocks before it, a prefix scan over a few rows a file.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def block_rows(spark: SparkSession, folder: str, separator: str, encoding: str = "UTF-8") -> DataFrame:
    """(value binary, file, block, bytes) of the files in ``folder``: the bytes between separators, in order within a block."""
    source = spark.read.option("lineSep", separator).option("encoding", encoding).text(folder)
    return source.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("bytes"))


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, pa.Array, bool, int]]:
    """(file, block, values, whether the block begins, the file's size) for each stretch of a task's rows of one block."""
    last = None
    for batch in batches:
        files, blocks, values = batch.column("file"), batch.column("block"), batch.column("value")
        n = len(batch)
        if not n:
            continue
        marks = pc.run_end_encode(pc.binary_join_element_wise(files.cast(pa.string()), blocks.cast(pa.string()), "\n"))
        begin = 0
        for end in marks.run_ends.to_pylist():
            key = (files[begin].as_py(), blocks[begin].as_py())
            yield *key, values.slice(begin, end - begin), key != last, batch.column("bytes")[begin].as_py()
            last, begin = key, end


def placed_blocks(totals: DataFrame, *more: str) -> DataFrame:
    """(file, block, start, ...) from (file, block, length, ...): where blocks begin; ``more`` columns get running sums before."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = [F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in more]
    return totals.select("*", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("start"), *sums)
