"""Candidate pairs for nearest-match joins: pairs that can't lie within the distance are never formed.

Each plan gives (x, t) value pairs from distinct values of both sides and is sound: no pair within the distance is missing.
Bounds are taken with a little slack, so that rounding drops nothing.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import byte_text, gram_array
from ..functions.phonetic import phonetic
from ..options import Options

SLACK = 1e-9
#: Edits up to which values are met by shared segments; beyond it by size only.
MOST_EDITS = 3


def candidates(x: DataFrame, t: DataFrame, o: Options, most: float, of_text: bool = True) -> DataFrame:
    """x: (x), t: (t), both distinct and not null."""
    size = F.char_length if of_text else F.size
    shown = (lambda c: byte_text(F.col(c))) if of_text and o.use_bytes else F.col
    if o.method == "soundex" and most < 1:
        return _equal(x, t, phonetic(shown("x")), phonetic(shown("t")))
    if o.method == "hamming":
        if most < 0 or not math.isfinite(most) or not of_text or most > MOST_EDITS:
            return _equal(x, t, size(shown("x")), size(shown("t")))
        return _by_segments(x, t, shown, int(most + SLACK) + 1, 0, 0)
    if o.method in ("jaccard", "cosine") and most < 1 and o.q >= 1:
        return _by_grams(x, t, shown, o, of_text, most, F.lit(0))
    if o.method == "qgram" and o.q >= 1 and math.isfinite(most):
        return _by_grams(x, t, shown, o, of_text, most, F.lit(most))
    if o.method in ("lv", "osa", "dl", "lcs") and math.isfinite(most):
        unit = o.unit_weights or o.method == "lcs"
        delete, insert = (1.0, 1.0) if o.method == "lcs" else o.weight[:2]
        if o.method == "dl":
            delete, insert = min(delete, o.weight[3]), min(insert, o.weight[3])
        edits = int(most + SLACK)
        if unit and of_text and edits <= MOST_EDITS:
            # An edit spoils two segments at most (a swap or an insertion at a border), in lcs and lv one.
            return _by_segments(x, t, shown, (1 if o.method in ("lv", "lcs") else 2) * edits + 1, edits, edits)
        return _by_sizes(x, t, size(shown("x")), size(shown("t")), lambda nx, nt: ((nx - nt) * delete <= most + SLACK) & ((nt - nx) * insert <= most + SLACK))
    if o.method == "jw" and most < 1 and o.unit_weights:
        # At most the shorter one's letters are matched, and none without a common one; the prefix takes off up to 4 p of a distance.
        ratio = lambda n, m: F.least(n, m) / F.greatest(n, F.lit(1))
        least = lambda nx, nt: F.when((nx == 0) & (nt == 0), 0.0).otherwise((1 - (ratio(nx, nt) + ratio(nt, nx) + 1) / 3) * (1 - 4 * o.p))
        letters = (lambda c: F.split(shown(c), "")) if of_text else shown
        pairs = _by_sizes(x, t, size(shown("x")), size(shown("t")), lambda nx, nt: least(nx, nt) <= most + SLACK)
        return pairs.filter(F.arrays_overlap(letters("x"), letters("t")) | ((size(shown("x")) == 0) & (size(shown("t")) == 0)))
    return x.crossJoin(t)


def _by_sizes(x: DataFrame, t: DataFrame, size_x: Column, size_t: Column, near: Callable[[Column, Column], Column]) -> DataFrame:
    """Pairs of near sizes. Only the different sizes, which are few, are compared with each other; values meet by equal keys."""
    sizes_x, sizes_t = x.select(size_x.alias("nx")).distinct(), t.select(size_t.alias("nt")).distinct()
    met = sizes_x.join(sizes_t, near(F.col("nx"), F.col("nt")))
    return x.withColumn("nx", size_x).join(met, "nx").join(t.withColumn("nt", size_t), "nt").select("x", "t")


def _equal(x: DataFrame, t: DataFrame, key_x: Column, key_t: Column) -> DataFrame:
    return x.withColumn("k", key_x).join(t.withColumn("k", key_t), "k").select("x", "t")


def _by_grams(x: DataFrame, t: DataFrame, shown, o: Options, of_text: bool, most: float, few: Column) -> DataFrame:
    """Pairs that share one of x's rarest grams, so many of them that a near value can't lack all, and those with so few grams together that none need be shared.

    Without a share of its grams x is too far: jaccard from more than `most` of its distinct ones on, qgram from more than `most` of all, and
    cosine once the others' norm is below (1 - most) of the whole one's. Grams that no table value has come first and meet nothing.
    """
    gx, gt = gram_array(shown("x"), o.q, of_text), gram_array(shown("t"), o.q, of_text)
    of_t = t.select("t", F.explode(F.array_distinct(gt)).alias("g"))
    probe = rarest_grams(x.select("x", F.explode(gx).alias("g")).groupBy("x", "g").agg(F.count("*").alias("n")), of_t, o, most)
    shared = probe.join(of_t, "g").select("x", "t").distinct()
    few_x, few_t = x.withColumn("nx", F.size(gx)).filter(F.col("nx") <= few), t.withColumn("nt", F.size(gt)).filter(F.col("nt") <= few)
    return shared.union(few_x.join(few_t, F.col("nx") + F.col("nt") <= few).select("x", "t")).distinct()


def rarest_grams(of_x: DataFrame, of_t: DataFrame, o: Options, most: float) -> DataFrame:
    """(x, g): of each x the rarest grams, so many of them that a near value can't lack all; of_x: (x, g, n), of_t: (t, g)."""
    often = of_t.groupBy("g").agg(F.count("*").alias("often"))
    of_x = of_x.join(often, "g", "left").withColumn("often", F.coalesce("often", F.lit(0)))
    all_, before = Window.partitionBy("x"), Window.partitionBy("x").orderBy("often", "g").rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda value: F.coalesce(F.sum(value).over(before), F.lit(0))
    if o.method == "jaccard":
        wanted = so_far(F.lit(1)) <= most * F.count("*").over(all_) + SLACK
    elif o.method == "qgram":
        wanted = so_far(F.col("n")) <= most + SLACK
    else:
        square = F.col("n") * F.col("n")
        whole = F.sum(square).over(all_)
        wanted = whole - so_far(square) >= (1 - most) ** 2 * whole - SLACK
    return of_x.withColumn("wanted", wanted).filter("wanted and often > 0").select("x", "g")


def _by_segments(x: DataFrame, t: DataFrame, shown, parts: int, shift: int, sizes: int) -> DataFrame:
    """Pairs of which one of the table value's `parts` equal segments occurs in x, moved by `shift` places at most, sizes differing by `sizes` at most.

    With fewer spoilt segments than parts, one is whole. Values too short to be cut meet all of a near size.
    """
    nt, nx = F.char_length(shown("t")), F.char_length(shown("x"))
    begin = lambda n, k: F.floor(n * k / parts).cast("int")
    cut = t.withColumn("n", nt).filter(F.col("n") >= parts)
    cut = cut.select("t", "n", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("k"))
    cut = cut.select("t", "n", "k", F.substr(shown("t"), begin(F.col("n"), F.col("k")) + 1, begin(F.col("n"), F.col("k") + 1) - begin(F.col("n"), F.col("k"))).alias("g"))
    probe = x.withColumn("nx", nx).select("x", F.explode(F.sequence(F.greatest(F.col("nx") - sizes, F.lit(parts)), F.greatest(F.col("nx") + sizes, F.lit(parts)))).alias("n"))
    probe = probe.select("x", "n", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("k"))
    probe = probe.select("x", "n", "k", F.explode(F.sequence(F.lit(-shift), F.lit(shift))).alias("d"))
    at = begin(F.col("n"), F.col("k")) + F.col("d")
    probe = probe.filter(at >= 0).select("x", "n", "k", F.substr(shown("x"), at + 1, begin(F.col("n"), F.col("k") + 1) - begin(F.col("n"), F.col("k"))).alias("g")).distinct()
    whole = probe.join(cut, ["n", "k", "g"]).select("x", "t")
    short = t.withColumn("n", nt).filter(F.col("n") < parts)
    near = x.withColumn("nx", nx).filter(F.col("nx") < parts + sizes).join(short, F.abs(F.col("nx") - F.col("n")) <= sizes).select("x", "t")
    return whole.union(near).distinct()
