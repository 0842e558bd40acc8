"""Integer sequences as the gram measures see them: which grams they have, and how often.

A sequence is cut into grams once, not once for each pair; what is compared and shuffled after that is its profile, which is as small as its kinds of grams.
Grams are texts of numbers with commas between; a missing number is an empty one.

Sequences and profiles are costly expressions. A filter on them, also one that Spark infers from a join or a generator, would be pushed down and compute them again:
so digests are never null here, and arrays are exploded with their empty ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..options import Options
from .pruning import SLACK, rarest_grams

#: Up to so many kinds of grams sets are bits of as many words of 64; beyond it arrays.
MOST_KINDS = 512


def _grams(values: Column, q: int) -> Column:
    """All grams of an array of integers, in order."""
    # The outer array binds the values, which the inner function would compute for each place otherwise. A slice would copy all of them for each place.
    gram = lambda v, i: F.array_join(F.array(*[F.get(v, i + k) for k in range(q)]), ",", "")
    cut = lambda v: F.transform(F.sequence(F.lit(0), F.greatest(F.size(v) - q, F.lit(0))), lambda i: gram(v, i))
    return F.when(F.size(values) >= q, F.transform(F.array(values.cast("array<string>")), cut)[0]).when(values.isNotNull(), F.array().cast("array<string>"))


def profile(values: Column, q: int) -> Column:
    """array<struct<g, n>>: the different grams in order, and how often each occurs; null for null."""

    def runs(s: Column) -> Column:
        places = F.when(F.size(s) > 0, F.sequence(F.lit(0), F.size(s) - 1)).otherwise(F.array().cast("array<int>"))
        starts = F.filter(places, lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        counted = lambda b: F.transform(b, lambda i, k: F.struct(F.get(s, i).alias("g"), (F.coalesce(F.get(b, k + 1), F.size(s)) - i).cast("long").alias("n")))
        return F.transform(F.array(starts), counted)[0]

    return F.when(values.isNotNull(), F.transform(F.array(F.sort_array(_grams(values, q))), runs)[0])


def profiled(rows: DataFrame, value: str, q: int) -> DataFrame:
    """The rows with a digest of the value's profile in its place (never null), and the profile itself as `value`_profile: equal profiles are equally far from all others."""
    rows = rows.withColumn(f"{value}_profile", profile(F.col(value), q))
    return rows.withColumn(value, F.coalesce(F.unhex(F.sha2(F.col(f"{value}_profile").cast("string"), 256)), F.lit(b"")))


def _each(df: DataFrame, array: str, name: str, *keys: str) -> DataFrame:
    """A row for each element."""
    return df.select(*keys, F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())


def near_profiles(x: DataFrame, t: DataFrame, o: Options, most: float) -> DataFrame:
    """(x, t, d) of digests whose profiles may lie within the distance; x: (x, x_profile), t: (t, t_profile), distinct and not null."""
    listed = lambda side, name: _each(side, f"{name}_profile", "e", name).select(name, "e.g", "e.n")
    of_x, of_t = listed(x, "x"), listed(t, "t").withColumnRenamed("n", "m")
    total = lambda name, of: F.aggregate(f"{name}_profile", F.lit(0).cast("long"), lambda s, e: s + of(e["n"]))
    facts = lambda side, name: side.select(name, F.size(f"{name}_profile").cast("long").alias(f"kinds_{name}"), total(name, lambda n: n).alias(f"all_{name}"), total(name, lambda n: n * n).alias(f"square_{name}"))
    x_facts, t_facts = facts(x, "x"), facts(t, "t")
    if o.method == "qgram" and most < float("inf") or o.method != "qgram" and most < 1:
        few = F.lit(most) if o.method == "qgram" else F.lit(0)
        pairs = rarest_grams(of_x, of_t, o, most).join(of_t, "g").select("x", "t")
        little = x_facts.filter(F.col("all_x") <= few).join(t_facts.filter(F.col("all_t") <= few), F.col("all_x") + F.col("all_t") <= few)
        pairs = pairs.union(little.select("x", "t")).distinct()
    else:
        pairs = x.select("x").crossJoin(t.select("t"))
    sums = [F.count("*").alias("both"), F.sum(F.least("n", "m")).alias("common"), F.sum(F.col("n") * F.col("m")).alias("product")]
    met = pairs.join(of_x, "x").join(of_t, ["t", "g"]).groupBy("x", "t").agg(*sums)
    whole = pairs.join(met, ["x", "t"], "left").na.fill(0, ["both", "common", "product"]).join(x_facts, "x").join(t_facts, "t")
    xx, tt, xt = F.col("square_x").cast("double"), F.col("square_t").cast("double"), F.col("product").cast("double")
    if o.method == "qgram":
        d = (F.col("all_x") + F.col("all_t") - 2 * F.col("common")).cast("double")
    elif o.method == "jaccard":
        d = _jaccard(F.col("both"), F.col("kinds_x") + F.col("kinds_t") - F.col("both"))
    else:
        d = F.when((xt == xx) & (xx == tt), 0.0).when((xx == 0) | (tt == 0), float("nan")).otherwise(F.abs(1 - xt / (F.sqrt(xx) * F.sqrt(tt))))
    return whole.select("x", "t", d.alias("d"))


def _jaccard(both: Column, either: Column) -> Column:
    return F.when(either == 0, 0.0).otherwise(1 - both / F.greatest(either, F.lit(1)))


def gram_sets(sides: list[tuple[DataFrame, str]], q: int) -> tuple[list[DataFrame], Column]:
    """Two tables with sets of grams in place of their columns of sequences, of different names, and the Jaccard distance of these as an expression.

    If the sequences have few kinds of grams together, a set is bits, of which an intersection costs an instruction or two.
    """
    sides = [(df.withColumn(c, F.array_distinct(_grams(F.col(c), q))), c) for df, c in sides]
    a, b = (c for _, c in sides)
    each = [_each(df, c, "g").distinct() for df, c in sides]
    kinds = sorted(r.g for r in each[0].union(each[1]).distinct().limit(MOST_KINDS + 1).collect())
    if len(kinds) > MOST_KINDS:
        both = F.size(F.array_intersect(a, b))
        found = _jaccard(both, F.size(a) + F.size(b) - both)
        return [df for df, _ in sides], F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), found)
    words = range(-(-len(kinds) // 64))

    def bits(c: str) -> Column:
        """A struct of words and the set's size."""
        place = F.transform(F.col(c), lambda g: F.array_position(F.array(*[F.lit(k) for k in kinds]).cast("array<string>"), g) - 1)
        bit = lambda p: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(p, F.lit(64)).cast("int"))
        word = lambda ps, w: F.aggregate(F.filter(ps, lambda p: F.floor(p / 64) == w), F.lit(0).cast("long"), lambda s, p: s.bitwiseOR(bit(p)))
        whole = lambda ps: F.struct(F.size(ps).alias("n"), *[word(ps, w).alias(f"w{w}") for w in words])
        return F.transform(F.array(place), whole)[0]

    shown = [df.withColumn(c, F.when(F.col(c).isNotNull(), bits(c))) for df, c in sides]
    both = sum((F.bit_count(F.col(f"{a}.w{w}").bitwiseAND(F.col(f"{b}.w{w}"))) for w in words), F.lit(0))
    found = _jaccard(both, F.col(f"{a}.n") + F.col(f"{b}.n") - both)
    return shown, F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), found)
