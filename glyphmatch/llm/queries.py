"""The training-data operators over the driver tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, common, fingerprint, line_dedup, minhash, oracle, packing, quality, suffix, toxicity, url_filter, warc
from .url_filter import Rule

URL_RULES = [Rule("org", "/", "allow"), Rule("example.org", "/es/", "block"), Rule("example.org", "/en/1", "block"), Rule("com", "/fr/", "allow"), Rule("com", "/de/", "block")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    common.small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    warc.register(spark)
    folder = common.work_path(spark, "warc")
    pages = _table(spark, sf_dir, "pages")
    warc.with_revisits(pages).write.format("warc").mode("append").save(folder)
    records = spark.read.format("warc").load(folder)
    page = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+)$", 1)
    number = lambda c: F.when(page(c) != "", page(c).cast("long"))
    return records.select(
        number(F.col("record_id")).alias("page_id"),
        "payload_bytes",
        F.when(F.col("payload").isNotNull(), warc.base32(F.unhex(F.sha1("payload")))).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        number(F.col("refers_to")).alias("refers_to"),
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicated(_table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    labels = _table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(~toxicity.held_out(F.col("doc_id")))
    model, thresholds = toxicity.fit(docs, labels)
    scored = toxicity.scored(docs, model, thresholds)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "toxic")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(_table(spark, sf_dir, "pages"), URL_RULES)


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), width=3, percent=85)


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix.without_repeats(_table(spark, sf_dir, "documents"), width=200)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = bpe.encode(_table(spark, sf_dir, "documents"), ranks, pattern)
    return bpe.decode(encoded, ranks, pattern).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compared_with_next(_table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judged(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What operator 4 finds without its model: host, path, rule and the rule's verdict of every page."""
    found = op4_url_filter(spark, sf_dir)
    return found.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("verdict"))


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What operator 10 counts in every document, and its base rules."""
    return op10_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_line_dedup": op2_line_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_url_filter": op4_url_filter,
    "op5_minhash_near_dedup": op5_minhash_near_dedup,
    "op6_suffix_array_dedup": op6_suffix_array_dedup,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_fingerprints": op9_fingerprints,
    "op10_quality_rules": op10_quality_rules,
    "url_rules": url_rules,
    "quality_counts": quality_counts,
}

#: SQL for those that it can express.
ORACLE_SQL: dict[str, str] = {
    "op1_warc": oracle.OP1_WARC,
    "op2_line_dedup": oracle.OP2_LINE_DEDUP,
    "op5_minhash_near_dedup": oracle.OP5_MINHASH_NEAR_DEDUP,
    "op6_suffix_array_dedup": oracle.OP6_SUFFIX_ARRAY_DEDUP,
    "url_rules": oracle.URL_RULES,
    "quality_counts": oracle.QUALITY_COUNTS,
}
