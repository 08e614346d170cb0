"""A training-data pipeline over ``documents``: each stage works on all rows that its predecessor kept.

Toxic documents go, one document of each near-duplicate group stays, documents that hold a benchmark item go, personal
data is replaced, and what is left is encoded as sampled piece sequences. Each stage's rows are written as Parquet in
the shared folder and read again by the next. Nulls, empty texts, repeated rows and empty tables are handled as
each stage's operator says; columns beside ``doc_id`` and ``text`` are carried along untouched (``n_chars`` is counted anew
where texts change).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from intel_spark.llm.base import stored, table
from intel_spark.llm.decontaminate import decontaminate
from intel_spark.llm.jaccard import keep_one_per_group
from intel_spark.llm.pieces import sample_encode
from intel_spark.llm.surrogates import anonymise
from intel_spark.llm.toxicity import reject_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return reject_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one_per_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return anonymise(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sample_encode(docs)


STAGES = [("toxicity", toxicity), ("ngram_jaccard_join", near_duplicates), ("benchmark_decontamination", decontamination), ("pii", pii), ("sentencepiece", encoding)]

#: Learned scores and sampled segmentations are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
