"""Counts of q-grams by name, from texts and from integer arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import _present, byte_text, gram_array


def _checked(q: float) -> int:
    if isinstance(q, bool) or q < 0:
        raise ValueError("q must be 0 or more")
    return int(q)


def qgrams(texts: DataFrame, q: float = 1, name_col: str = "name", text_col: str = "s", use_bytes: bool = False) -> DataFrame:
    """(name, qgram, n long): how often each gram occurs in the texts of a name. q = 0: the number of empty texts, as the empty gram.

    In bytes a gram is shown as hexadecimal bytes with bars between. Null texts and those shorter than q give nothing.
    """
    q = _checked(q)
    rows = texts.select(F.col(name_col).alias("name"), F.col(text_col).cast("string").alias("s")).filter("s is not null")
    if q == 0:
        return rows.groupBy("name").agg(F.count_if(F.col("s") == "").alias("n")).select("name", F.lit("").alias("qgram"), "n")
    shown = byte_text(F.col("s")) if use_bytes else F.col("s")
    counted = rows.select("name", F.explode(gram_array(shown, q)).alias("qgram")).groupBy("name", "qgram").agg(F.count("*").alias("n"))
    if not use_bytes:
        return counted
    digits = F.lower(F.hex(F.encode("qgram", "ISO-8859-1")))
    return counted.withColumn("qgram", F.array_join(F.regexp_extract_all(digits, F.lit(".."), F.lit(0)), "|"))


def seq_qgrams(sequences: DataFrame, q: float = 1, name_col: str = "name", seq_col: str = "s") -> DataFrame:
    """(name, qgram array<int>, n long): the same over integer arrays; those whose first element is missing are left out."""
    q = _checked(q)
    rows = sequences.select(F.col(name_col).alias("name"), _present(F.col(seq_col).cast("array<int>")).alias("s")).filter("s is not null")
    if q == 0:
        return rows.groupBy("name").agg(F.count_if(F.size("s") == 0).alias("n")).select("name", F.array().cast("array<int>").alias("qgram"), "n")
    return rows.select("name", F.explode(gram_array(F.col("s"), q, of_text=False)).alias("qgram")).groupBy("name", "qgram").agg(F.count("*").alias("n"))


def wide(counts: DataFrame) -> DataFrame:
    """One row per gram and one column of counts per name (0 where it has none), for few names."""
    return counts.groupBy("qgram").pivot("name").agg(F.first("n")).na.fill(0)
