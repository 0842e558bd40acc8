"""Nearest match in a table and fuzzy membership."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import _present, distance
from ..options import Options, options
from ..plans.profiles import near_profiles, profiled
from ..plans.pruning import candidates


def _sides(x: DataFrame, table: DataFrame, id_col: str, x_col: str, pos_col: str, t_col: str, most: float, of_text: bool) -> tuple[DataFrame, DataFrame]:
    if of_text and not most > 0:
        raise ValueError("max_dist must be above 0")
    value = (lambda c: F.col(c).cast("string")) if of_text else (lambda c: _present(F.col(c).cast("array<int>")))
    return x.select(F.col(id_col).alias("id"), value(x_col).alias("x")), table.select(F.col(pos_col).alias("pos"), value(t_col).alias("t"))


def _shown(rows: DataFrame, entries: DataFrame, o: Options, of_text: bool) -> tuple[DataFrame, DataFrame, list[str], list[str]]:
    """The sides as they are compared, which values are missing, and the columns of their values: gram measures take the profiles of sequences, which may be long."""
    rows, entries = rows.withColumn("missing", F.col("x").isNull()), entries.withColumn("missing", F.col("t").isNull())
    if of_text or o.method not in ("qgram", "cosine", "jaccard") or o.q < 1:
        return rows, entries, ["x"], ["t"]
    return profiled(rows, "x", o.q), profiled(entries, "t", o.q), ["x", "x_profile"], ["t", "t_profile"]


def _within(x: DataFrame, t: DataFrame, o: Options, most: float, of_text: bool) -> DataFrame:
    """(x, t, d) of distinct values that lie within the distance."""
    if "x_profile" in x.columns:
        near = near_profiles(x, t, o, most)
    else:
        near = candidates(x, t, o, most, of_text).withColumn("d", distance(F.col("t"), F.col("x"), o, of_text))
    return near.filter((F.col("d") <= most) & ~F.isnan("d") & (F.col("d") < math.inf))


def _matched(x: DataFrame, table: DataFrame, id_col: str, x_col: str, pos_col: str, t_col: str, most: float, of_text: bool, nomatch: int | None, match_na: bool, how: dict) -> DataFrame:
    o = options(**how)
    rows, entries, of_x, of_t = _shown(*_sides(x, table, id_col, x_col, pos_col, t_col, most, of_text), o, of_text)
    # Equal values give equal distances: each is compared once, by the first position it has.
    firsts = entries.filter("not missing").groupBy(*of_t).agg(F.min("pos").alias("pos"))
    asked = rows.filter("not missing").select(*of_x).distinct()
    near = _within(asked, firsts.select(*of_t), o, most, of_text)
    near = near.withColumn("d", F.when(F.abs("d") < 1e-14, 0.0).otherwise(F.col("d")))
    best = near.join(firsts.select("t", "pos"), "t").groupBy("x").agg(F.min(F.struct("d", "pos")).alias("best"))
    found = rows.select("id", "x", "missing").join(best.select("x", F.col("best.pos").alias("match"), F.col("best.d").alias("dist")), "x", "left")
    if match_na:
        missing = entries.filter("missing").agg(F.min("pos").alias("na_pos"))  # one row
        found = found.crossJoin(F.broadcast(missing)).withColumn("match", F.when(F.col("missing"), F.col("na_pos")).otherwise(F.col("match")))
    other: Column = F.lit(nomatch).cast("long")
    return found.select(F.col("id").alias(id_col), F.coalesce(F.col("match").cast("long"), other).alias("match"), "dist")


def amatch(x: DataFrame, table: DataFrame, id_col: str = "id", x_col: str = "x", pos_col: str = "pos", t_col: str = "t", max_dist: float = 0.1, nomatch: int | None = None, match_na: bool = True, **how) -> DataFrame:
    """(id, match long, dist): position of the table entry nearest to x within max_dist, the first on ties; else `nomatch`.

    A null x matches the first null entry if match_na. Infinite and undefined distances never match.
    """
    return _matched(x, table, id_col, x_col, pos_col, t_col, float(max_dist), True, nomatch, match_na, how)


def ain(x: DataFrame, table: DataFrame, id_col: str = "id", x_col: str = "x", pos_col: str = "pos", t_col: str = "t", max_dist: float = 0.1, match_na: bool = True, **how) -> DataFrame:
    """(id, found boolean): whether the table has an entry within max_dist of x."""
    return _member(x, table, id_col, x_col, pos_col, t_col, float(max_dist), True, match_na, how)


def _member(x: DataFrame, table: DataFrame, id_col: str, x_col: str, pos_col: str, t_col: str, most: float, of_text: bool, match_na: bool, how: dict) -> DataFrame:
    """No nearest one is sought: values that the table has need no distance, the others a single near entry."""
    o = options(**how)
    rows, entries, of_x, of_t = _shown(*_sides(x, table, id_col, x_col, pos_col, t_col, most, of_text), o, of_text)
    asked, known = rows.filter("not missing").select(*of_x).distinct(), entries.filter("not missing").select(*of_t).distinct()
    same = asked.join(known, F.col("x") == F.col("t"), "left_semi").select("x")
    if o.method == "jw" and not o.unit_weights:  # there equal values may lie apart
        found = _within(asked, known, o, most, of_text).select("x").distinct()
    else:
        other = asked.join(known, F.col("x") == F.col("t"), "left_anti")
        found = same.union(_within(other, known, o, most, of_text).select("x").distinct())
    flagged = rows.select("id", "x", "missing").join(found.withColumn("found", F.lit(True)), "x", "left").withColumn("found", F.col("found").isNotNull())
    if match_na:
        missing = entries.filter("missing").agg((F.count("*") > 0).alias("na"))  # one row
        flagged = flagged.crossJoin(F.broadcast(missing)).withColumn("found", F.when(F.col("missing"), F.col("na")).otherwise(F.col("found")))
    return flagged.select(F.col("id").alias(id_col), "found")


def seq_amatch(x: DataFrame, table: DataFrame, id_col: str = "id", x_col: str = "x", pos_col: str = "pos", t_col: str = "t", max_dist: float = 0.1, nomatch: int | None = None, match_na: bool = True, **how) -> DataFrame:
    """The same over integer arrays."""
    return _matched(x, table, id_col, x_col, pos_col, t_col, float(max_dist), False, nomatch, match_na, how)


def seq_ain(x: DataFrame, table: DataFrame, id_col: str = "id", x_col: str = "x", pos_col: str = "pos", t_col: str = "t", max_dist: float = 0.1, match_na: bool = True, **how) -> DataFrame:
    return _member(x, table, id_col, x_col, pos_col, t_col, float(max_dist), False, match_na, how)
