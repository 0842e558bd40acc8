"""A corpus from documents to packed sequences: quality rules, line, near-duplicate and passage removal, packing.

Every stage but the last returns the columns of documents; each is written as Parquet and read again as the next
one's documents. `n_chars` follows the text. Documents that a stage leaves without any word are dropped there.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmatch.llm import common, line_dedup, minhash, packing, quality, suffix
from glyphmatch.session import ship


def _with_words(docs: DataFrame, columns: list[str]) -> DataFrame:
    """Documents with a word left, their columns in order, and n_chars by the text."""
    left = docs.filter(F.col("text").rlike(common.WORD_PATTERN))
    return left.withColumn("n_chars", F.char_length("text").cast("long")).select(*columns)


def _prepare(spark: SparkSession) -> None:
    ship(spark)
    common.small_batches(spark)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weighed rules accept."""
    _prepare(spark)
    return quality.accepted(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that nearly equal an earlier one."""
    _prepare(spark)
    return _with_words(line_dedup.deduplicated(docs, counts=False), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is alike by shingles of five words at 0.8 or more."""
    _prepare(spark)
    return minhash.one_of_each(docs, width=5, percent=80)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without strings of 200 bytes that occur elsewhere too."""
    _prepare(spark)
    return _with_words(suffix.deduplicated(docs, width=200), docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and offset."""
    _prepare(spark)
    return packing.packed_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality rules", quality_rules), ("line dedup", lines), ("near duplicates", near_duplicates), ("repeated passages", passages), ("packing", packed)]

#: SQL can't express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), common.safe_name(name))
    return STAGES[-1][1](spark, docs, sf_dir)
