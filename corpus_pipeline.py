"""The corpus pipeline: from raw documents to a mixed training set.

Stages, in order: the quality classifier rejects poor documents; exact copies go; one document of each
near-duplicate group stays (five-word shingles, similarity 0.8); documents that hold a benchmark item
go; the sources are mixed to target shares, and what the mix does not take goes. Each stage works on all rows that the one before it kept,
and each result is stored in the shared folder before the next stage reads it. Null texts and
identifiers, repeated rows, empty tables and extra columns are handled as each operator states. Stages get the
documents as a plain read of stored files, whose rows are told apart by file and place, so no stage stores a copy of the texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from yardbook.llm import content_sort, decontaminate, minhash, mixing, quality
from yardbook.llm.common import Scratch, file_rows, read_table

ORACLE_SQL = None


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, quality.ratings(read_table(spark, sf_dir, "labels")))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, key = file_rows(docs)
    return content_sort.keep_first(rows, row_key=key)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, key = file_rows(docs)
    return minhash.keep_one(rows, words_per_shingle=5, percent=80, row_key=key)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix: all columns, the number of copies it takes (at least 1) and their words."""
    rows, key = file_rows(docs)
    return mixing.mix(rows, row_key=key).where("copies > 0")


STAGES = [
    ("quality_classifier", good_documents),
    ("exact_dedup", without_copies),
    ("minhash_near_dedup", without_near_copies),
    ("benchmark_decontamination", without_benchmark),
    ("mixing_sources", mixed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for place, (name, stage) in enumerate(STAGES[:-1]):
        docs = scratch.store(stage(spark, docs, sf_dir), name)
        if place:  # the result before has been read for the last time
            scratch.drop(STAGES[place - 1][0])
    return STAGES[-1][1](spark, docs, sf_dir)
