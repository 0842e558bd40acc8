"""Distances and similarities of two columns as expressions.

Expressions of Spark's own carry Levenshtein at unit weights, Hamming, Jaccard and soundex; Arrow batches of numpy kernels the others.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..options import Options, options
from . import kernels
from .encode import Codes, from_column
from .phonetic import phonetic

INFINITE = float("inf")


def column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def byte_text(text: Column) -> Column:
    """One character per UTF-8 byte, so that every function works on bytes unchanged."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def gram_array(values: Column, q: int, of_text: bool = True) -> Column:
    """All q-grams of a text (strings) or of an array (arrays), in order; empty where it is shorter. The work is in proportion to the size."""
    if of_text:
        return F.regexp_extract_all(values, F.lit(f"(?s)(?=(.{{{q}}}))."), F.lit(1))
    # The outer array binds the values, which the inner function would compute for each place otherwise.
    cut = lambda v: F.transform(F.sequence(F.lit(1), F.greatest(F.size(v) - q + 1, F.lit(1))), lambda i: F.slice(v, i, q))
    return F.when(F.size(values) >= q, F.transform(F.array(values), cut)[0]).otherwise(F.array().cast("array<array<int>>"))


def kernel_column(a: Column, b: Column, o: Options) -> Column:
    """An Arrow-batched kernel; null where a side is null."""

    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        found = kernels.distances(from_column(x), from_column(y), o)
        return pa.array(found, pa.float64(), mask=(x.is_null().to_numpy(zero_copy_only=False) | y.is_null().to_numpy(zero_copy_only=False)), from_pandas=False)

    run.__annotations__ = {"x": pa.Array, "y": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "double")(a, b)


def distance(a: Column, b: Column, o: Options, of_text: bool = True) -> Column:
    """Cost of turning b into a; null where a side is null."""
    missing = a.isNull() | b.isNull()
    if of_text and o.use_bytes:
        a, b = byte_text(a), byte_text(b)
    size = F.char_length if of_text else F.size
    if o.method in ("qgram", "cosine", "jaccard") and o.q == 0:
        found = F.lit(0.0)
    elif o.method == "lv" and of_text and o.unit_weights:
        found = F.levenshtein(a, b).cast("double")
    elif o.method == "hamming":
        parts = (lambda c: F.split(c, "")) if of_text else (lambda c: c)
        differing = F.aggregate(F.zip_with(parts(a), parts(b), lambda p, q: F.when(p.eqNullSafe(q), 0).otherwise(1)), F.lit(0), lambda n, d: n + d)
        found = F.when(size(a) != size(b), INFINITE).when(size(a) == 0, 0.0).otherwise(differing.cast("double"))
    elif o.method == "jaccard":
        x, y = gram_array(a, o.q, of_text), gram_array(b, o.q, of_text)
        either = F.size(F.array_union(x, y))
        found = F.when(either == 0, 0.0).otherwise(1 - F.size(F.array_intersect(x, y)) / F.greatest(either, F.lit(1)))
    elif o.method == "soundex":
        if not of_text:
            raise ValueError("soundex is not defined for sequences")
        found = F.when(phonetic(a) == phonetic(b), 0.0).otherwise(1.0)
    else:
        return kernel_column(a, b, o)
    return F.when(~missing, found)


def similarity(d: Column, a: Column, b: Column, o: Options, of_text: bool = True) -> Column:
    """1 less the distance over the largest that unit weights allow; below 0 becomes 0."""
    if of_text and o.use_bytes:
        a, b = byte_text(a), byte_text(b)
    size = F.char_length if of_text else F.size
    x, y = size(a).cast("double"), size(b).cast("double")
    positive = lambda c: F.when(c == 0, 1.0).otherwise(c)
    if o.method in ("osa", "lv", "dl"):
        most = positive(F.greatest(x, y))
    elif o.method == "hamming":
        most = positive(x)  # sizes are equal wherever the distance is finite
    elif o.method == "lcs":
        most = positive(x + y)
    elif o.method == "qgram":
        most = x + y - 2 * o.q + 2
        most = F.when(most < 0, 1.0).otherwise(most)
    else:
        most = F.lit(1.0)
    share = F.when(most == 0, F.when(d == 0, F.lit(float("nan"))).otherwise(F.lit(INFINITE))).otherwise(d / positive(most))
    found = 1 - share
    return F.when(F.isnan(found), found).when(found < 0, 0.0).otherwise(found)


def text_distance(a: Column | str, b: Column | str, method: str = "osa", weight: Sequence[float] | None = None, q: float = 1, p: float = 0.0, bt: float = 0.0, use_bytes: bool = False, nthread: float | None = None) -> Column:
    """Distance of two string columns."""
    return distance(column(a).cast("string"), column(b).cast("string"), options(method, weight, q, p, bt, use_bytes, nthread))


def text_similarity(a: Column | str, b: Column | str, method: str = "osa", weight: Sequence[float] | None = None, q: float = 1, p: float = 0.0, bt: float = 0.0, use_bytes: bool = False, nthread: float | None = None) -> Column:
    """Similarity from 0 to 1 of two string columns."""
    a, b, o = column(a).cast("string"), column(b).cast("string"), options(method, weight, q, p, bt, use_bytes, nthread)
    return similarity(distance(a, b, o), a, b, o)


def _integers(values: Column | str) -> Column:
    return column(values).cast("array<int>")


def _present(values: Column) -> Column:
    """A sequence whose first element is missing is missing as a whole."""
    return F.when((F.size(values) > 0) & F.get(values, F.lit(0)).isNull(), F.lit(None)).otherwise(values)


def seq_dist(a: Column | str, b: Column | str, method: str = "osa", weight: Sequence[float] | None = None, q: float = 1, p: float = 0.0, bt: float = 0.0, nthread: float | None = None) -> Column:
    """Distance of two columns of integer arrays; numbers are cut to integers."""
    o = options(method, weight, q, p, bt, nthread=nthread)
    return distance(_present(_integers(a)), _present(_integers(b)), o, of_text=False)


def seq_sim(a: Column | str, b: Column | str, method: str = "osa", weight: Sequence[float] | None = None, q: float = 1, p: float = 0.0, bt: float = 0.0, nthread: float | None = None) -> Column:
    """Similarity from 0 to 1 of two columns of integer arrays."""
    o = options(method, weight, q, p, bt, nthread=nthread)
    a, b = _present(_integers(a)), _present(_integers(b))
    return similarity(distance(a, b, o, of_text=False), a, b, o, of_text=False)


def codes_of(values: list) -> Codes:
    """For tests and tools: texts or lists of integers as codes."""
    return from_column(pa.array(values))
