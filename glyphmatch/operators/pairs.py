"""All pairs, lower triangles, similarity matrices and positional pairing, as long tables.

All-pairs results are as large as their definition says; their inputs are meant to be lookup-sized. The smaller side is broadcast
only if it has at most `MOST_BROADCAST` rows and `MOST_BROADCAST_BYTES` bytes; else Spark's own choice stands.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import _present, seq_dist, seq_sim, similarity, text_distance, text_similarity
from ..options import Options, options
from ..plans.profiles import gram_sets

MOST_BROADCAST = 100_000
MOST_BROADCAST_BYTES = 32_000_000


def _bytes(df: DataFrame) -> Column:
    """About how many bytes a row has."""
    of = lambda c, kind: F.octet_length(c) if kind in ("string", "binary") else F.size(c) * 8 if kind.startswith("array") else F.lit(8)
    return sum((F.coalesce(of(F.col(c), kind), F.lit(0)) for c, kind in df.dtypes), F.lit(0))


def _small(df: DataFrame, rows: int = MOST_BROADCAST, most_bytes: int = MOST_BROADCAST_BYTES) -> DataFrame:
    """The table, to be broadcast if it is proven small: no more rows are looked at than may be broadcast."""
    found = df.select(_bytes(df).cast("long").alias("n")).limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    return F.broadcast(df) if found[0] <= rows and found[1] <= most_bytes else df


def _spread(df: DataFrame) -> DataFrame:
    """Rows dealt over the tasks before they are multiplied; small files come as one partition."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _named(df: DataFrame, pos: str, value: str, label: str | None, side: str) -> DataFrame:
    columns = [F.col(pos).alias(side), F.col(value).alias(f"value_{side}")]
    return df.select(*columns, *([F.col(label).alias(f"label_{side}")] if label else []))


def _matrix(a: DataFrame, b: DataFrame, of: Callable[[Column, Column], Column], name: str, pos: str, value: str, use_names: str, label: str | None) -> DataFrame:
    label = {"none": None, "strings": value, "names": label}[use_names]
    left, right = _named(a, pos, value, label, "i"), _named(b, pos, value, label, "j")
    kept = ["i", "j", *(["label_i", "label_j"] if label else [])]
    return _spread(left).crossJoin(_small(right)).select(*kept, of(F.col("value_i"), F.col("value_j")).alias(name))


def _names(use_names: str | bool) -> str:
    found = {True: "strings", False: "none"}.get(use_names, use_names)
    if found not in ("none", "strings", "names"):
        raise ValueError("use_names must be none, strings or names")
    return found


def distance_matrix(a: DataFrame, b: DataFrame | None = None, pos: str = "pos", value: str = "s", use_names: str | bool = "none", label: str | None = None, **how) -> DataFrame:
    """(i, j, [label_i, label_j], dist): all pairs of a and b, or of a alone those with i > j, where the cost runs from i to j."""
    if b is not None:
        return _matrix(a, b, lambda x, y: text_distance(x, y, **how), "dist", pos, value, _names(use_names), label)
    return lower_triangle(a, lambda x, y: text_distance(y, x, **how), pos, value, _names(use_names), label)


def lower_triangle(a: DataFrame, of: Callable[[Column, Column], Column], pos: str, value: str, use_names: str = "none", label: str | None = None) -> DataFrame:
    label = {"none": None, "strings": value, "names": label}[use_names]
    left, right = _named(a, pos, value, label, "i"), _named(a, pos, value, label, "j")
    kept = ["i", "j", *(["label_i", "label_j"] if label else [])]
    met = _spread(left).join(_small(right), F.col("i") > F.col("j"))
    return met.select(*kept, of(F.col("value_i"), F.col("value_j")).alias("dist"))


def similarity_matrix(a: DataFrame, b: DataFrame | None = None, pos: str = "pos", value: str = "s", use_names: str | bool = "none", label: str | None = None, **how) -> DataFrame:
    """(i, j, [label_i, label_j], sim). Of a alone: the lower triangle, mirrored, with ones for the diagonal (null for null)."""
    of = lambda x, y: text_similarity(x, y, **how)
    if b is not None:
        return _matrix(a, b, of, "sim", pos, value, _names(use_names), label)
    return _mirrored(a, lambda x, y: of(y, x), pos, value, _names(use_names), label)


def _mirrored(a: DataFrame, of: Callable[[Column, Column], Column], pos: str, value: str, use_names: str, label: str | None) -> DataFrame:
    lower = lower_triangle(a, of, pos, value, use_names, label).withColumnRenamed("dist", "sim")
    named = "label_i" in lower.columns
    swapped = lower.select(F.col("j").alias("i"), F.col("i").alias("j"), *([F.col("label_j").alias("label_i"), F.col("label_i").alias("label_j")] if named else []), "sim")
    shown = {"none": None, "strings": value, "names": label}[use_names]
    diagonal = a.select(F.col(pos).alias("i"), F.col(pos).alias("j"), *([F.col(shown).alias("label_i"), F.col(shown).alias("label_j")] if named else []), F.lit(1.0).alias("sim"))
    return lower.unionByName(swapped).unionByName(diagonal)


def seq_distmatrix(a: DataFrame, b: DataFrame | None = None, pos: str = "pos", value: str = "s", use_names: str = "none", label: str | None = None, **how) -> DataFrame:
    """The same over integer arrays."""
    o = options(**how)
    if o.method == "jaccard" and o.q:
        return _of_sets(a, a if b is None else b, o, lambda d: d, "dist", pos, value, use_names, label, b is None)
    if b is not None:
        return _matrix(a, b, lambda x, y: seq_dist(x, y, **how), "dist", pos, value, use_names, label)
    return lower_triangle(a, lambda x, y: seq_dist(y, x, **how), pos, value, use_names, label)


def seq_simmatrix(a: DataFrame, b: DataFrame, pos: str = "pos", value: str = "s", **how) -> DataFrame:
    o = options(**how)
    if o.method == "jaccard" and o.q:
        return _of_sets(a, b, o, lambda d: similarity(d, F.array(), F.array(), o, of_text=False), "sim", pos, value, "none", None, False)
    return _matrix(a, b, lambda x, y: seq_sim(x, y, **how), "sim", pos, value, "none", None)


def _of_sets(a: DataFrame, b: DataFrame, o: Options, of: Callable[[Column], Column], name: str, pos: str, value: str, use_names: str, label: str | None, lower: bool) -> DataFrame:
    """All pairs (or the lower triangle) of sequences by their sets of grams, which are made once a sequence."""
    label = {"none": None, "strings": value, "names": label}[use_names]
    left, right = (_named(df, pos, value, label, side).withColumn(f"value_{side}", _present(F.col(f"value_{side}").cast("array<int>"))) for df, side in ((a, "i"), (b, "j")))
    (left, right), d = gram_sets([(left, "value_i"), (right, "value_j")], o.q)
    kept = ["i", "j", *(["label_i", "label_j"] if label else [])]
    met = _spread(left).join(_small(right), F.col("i") > F.col("j")) if lower else _spread(left).crossJoin(_small(right))
    return met.select(*kept, of(d).alias(name))


def pairwise(a: DataFrame, b: DataFrame, pos: str = "pos", value: str = "s", **how) -> DataFrame:
    """(pos, dist): a and b paired by position from 1, the shorter one repeated. No rows if one of them has none."""
    na, nb = a.count(), b.count()
    if not na or not nb:
        return a.limit(0).select(F.col(pos), F.lit(None).cast("double").alias("dist"))
    long, short = (a, b) if na >= nb else (b, a)
    n = min(na, nb)
    left = long.select(F.col(pos).alias("pos"), F.col(value).alias("long"), F.pmod(F.col(pos) - 1, F.lit(n)).alias("k"))
    right = short.select(F.col(value).alias("short"), F.pmod(F.col(pos) - 1, F.lit(n)).alias("k"))
    met = left.join(_small(right), "k")  # the short side's positions would be hot keys of a shuffle
    x, y = ("long", "short") if na >= nb else ("short", "long")
    return met.select("pos", text_distance(x, y, **how).alias("dist"))
