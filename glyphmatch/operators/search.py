"""Approximate search: the window of a text that lies nearest to a pattern."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.encode import Codes, from_texts
from ..functions.metrics import byte_text, column
from ..functions.phonetic import phonetic
from ..options import METHODS, RUNNING, Options, options
from .pairs import _small

#: Windows that are compared at a time.
_WINDOWS = 1 << 14


def best_windows(texts: list, patterns: list, sizes: list, o: Options) -> pa.Array:
    """struct(location from 1, distance) for each text: the first of its nearest windows; infinite if none is comparable, null where an input is.

    Windows of texts that follow each other are compared in one go; those of a long text in several.
    """
    plain = (lambda s: s.encode().decode("latin-1")) if o.use_bytes else (lambda s: s)
    known: dict[str, np.ndarray] = {}
    best: list = [None if None in row else [1, float("inf")] for row in zip(texts, patterns, sizes)]
    held: list[tuple[int, int, int, np.ndarray, np.ndarray]] = []  # row, offset, windows, their codes, the pattern's

    def compare() -> None:
        if not held:
            return
        wanted = Codes(np.concatenate([np.tile(p, n) for _, _, n, _, p in held]), np.concatenate([np.full(n, len(p)) for _, _, n, _, p in held]))
        shown = Codes(np.concatenate([w.ravel() for *_, w, _ in held]), np.concatenate([np.full(n, w.shape[1]) for _, _, n, w, _ in held]))
        d = kernels.distances(wanted, shown, o)
        d = np.where(np.isnan(d), np.inf, d)
        at = 0
        for row, offset, n, *_ in held:
            k = int(d[at : at + n].argmin())
            if d[at + k] < best[row][1]:
                best[row] = [offset + k + 1, float(d[at + k])]
            at += n
        held.clear()

    waiting = 0
    for row, (text, pattern, size) in enumerate(zip(texts, patterns, sizes)):
        if best[row] is None:
            continue
        if pattern not in known:
            known[pattern] = from_texts([plain(pattern)]).values
        codes = from_texts([plain(text)]).values
        size = min(size, len(codes))
        count = len(codes) - size + 1
        for at in range(0, count, _WINDOWS):
            n = min(_WINDOWS, count - at)
            views = np.lib.stride_tricks.sliding_window_view(codes[at : at + n + size - 1], size) if size else np.zeros((n, 0), np.int64)
            held.append((row, at, n, views, known[pattern]))
            waiting += n
            if waiting >= _WINDOWS:
                compare()
                waiting = 0
    compare()
    kind = pa.struct([("location", pa.int32()), ("distance", pa.float64())])
    return pa.array([b and {"location": b[0], "distance": b[1]} for b in best], kind)


def best_window(text: Column | str, pattern: Column | str, window: Column | int | None, o: Options) -> Column:
    """struct(location, distance) of the best window; null where a side is null."""
    text, pattern = column(text).cast("string"), column(pattern).cast("string")
    size = F.octet_length(pattern) if o.use_bytes else F.char_length(pattern)
    width = size if window is None else (F.lit(window) if isinstance(window, int) else window)
    if o.method == "soundex":
        return _native(text, pattern, width, o)

    def run(x: pa.Array, y: pa.Array, w: pa.Array) -> pa.Array:
        return best_windows(x.to_pylist(), y.to_pylist(), w.to_pylist(), o)

    run.__annotations__ = {"x": pa.Array, "y": pa.Array, "w": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "location int, distance double")(text, pattern, width.cast("int"))


def _native(text: Column, pattern: Column, width: Column, o: Options) -> Column:
    """Soundex windows by expressions."""
    shown = byte_text(text) if o.use_bytes else text
    size = F.char_length(shown)
    places = F.sequence(F.lit(1), F.greatest(size - width + 1, F.lit(1)))
    code = phonetic(byte_text(pattern) if o.use_bytes else pattern)
    each = F.transform(places, lambda k: F.struct(F.when(phonetic(F.substr(shown, k, F.greatest(width, F.lit(0)))) == code, 0.0).otherwise(1.0).alias("distance"), k.alias("location")))
    whole = F.struct(F.lit(1).alias("location"), F.when(phonetic(shown) == code, 0.0).otherwise(1.0).alias("distance"))
    best = F.array_min(each)
    found = F.when(width >= size, whole).otherwise(F.struct(best["location"].alias("location"), best["distance"].alias("distance")))
    return F.when(text.isNotNull() & pattern.isNotNull(), found)


def _options(how: dict) -> Options:
    return options(choices=(*METHODS, RUNNING), **how)


def _match(text: Column, location: Column, width: Column, o: Options) -> Column:
    shown = byte_text(text) if o.use_bytes else text
    found = F.substr(shown, location, width)
    return F.decode(F.encode(found, "ISO-8859-1"), "UTF-8") if o.use_bytes else found


def afind(texts: DataFrame, patterns: DataFrame, i_col: str = "i", text_col: str = "x", j_col: str = "j", pattern_col: str = "pattern", window: int | str | None = None, value: bool = True, **how) -> DataFrame:
    """(i, j, location int, distance double, match string): the nearest window of every text for every pattern.

    window: its size (a number or a column of patterns), by default the pattern's. Null texts and patterns give nulls.
    """
    o = _options(how)
    if isinstance(window, int) and window < 1:
        raise ValueError("window must be 1 or more")
    left = texts.select(F.col(i_col).alias("i"), F.col(text_col).cast("string").alias("text"))
    right = patterns.select(F.col(j_col).alias("j"), F.col(pattern_col).cast("string").alias("pattern"), *([F.col(window).alias("window")] if isinstance(window, str) else []))
    width = F.col("window") if isinstance(window, str) else window
    met = left.crossJoin(_small(right)).withColumn("best", best_window("text", "pattern", width, o))
    found = ["i", "j", F.col("best.location").alias("location"), F.col("best.distance").alias("distance")]
    size = F.octet_length("pattern") if o.use_bytes else F.char_length("pattern")
    used = size if window is None else (F.lit(width) if isinstance(width, int) else width)
    return met.select(*found, *([_match(F.col("text"), F.col("best.location"), used, o).alias("match")] if value else []))


def _one(texts: DataFrame, pattern: str | None, i_col: str, text_col: str, window: int | None, max_dist: float, how: dict) -> DataFrame:
    o = _options(how)
    if not max_dist >= 0:
        raise ValueError("max_dist must be 0 or more")
    left = texts.select(F.col(i_col).alias("i"), F.col(text_col).cast("string").alias("text"))
    found = left.withColumn("best", best_window("text", F.lit(pattern).cast("string"), window, o))
    size = window if window is not None else len(pattern.encode() if o.use_bytes else pattern) if pattern is not None else 0
    return found.select("i", F.col("best.distance").alias("distance"), _match(F.col("text"), F.col("best.location"), F.lit(size), o).alias("match"))


def grab(texts: DataFrame, pattern: str, max_dist: float = float("inf"), value: bool = False, i_col: str = "i", text_col: str = "x", window: int | None = None, **how) -> DataFrame:
    """(i[, match]): the texts that have a window within max_dist of the pattern."""
    found = _one(texts, pattern, i_col, text_col, window, max_dist, how).filter(F.col("distance") <= max_dist)
    return found.select("i", *(["match"] if value else []))


def grabl(texts: DataFrame, pattern: str | None, max_dist: float = float("inf"), i_col: str = "i", text_col: str = "x", window: int | None = None, **how) -> DataFrame:
    """(i, found boolean): whether a text has such a window; null for null."""
    return _one(texts, pattern, i_col, text_col, window, max_dist, how).select("i", (F.col("distance") <= max_dist).alias("found"))


def extract(texts: DataFrame, pattern: str, max_dist: float = float("inf"), i_col: str = "i", text_col: str = "x", window: int | None = None, **how) -> DataFrame:
    """(i, match string): the nearest window if it lies within max_dist, else null."""
    found = _one(texts, pattern, i_col, text_col, window, max_dist, how)
    return found.select("i", F.when(F.col("distance") <= max_dist, F.col("match")).alias("match"))
