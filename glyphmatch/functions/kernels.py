"""Distances of many pairs of integer sequences at once, in numpy.

Every kernel gives the cost of turning a source into a target: padded matrices `s` and `t` (fillers differ and match nothing) with sizes `x` and `y`.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from ..options import Options
from .encode import MOST_CELLS, Codes, alike_in_size

Kernel = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def edit(s: np.ndarray, t: np.ndarray, x: np.ndarray, y: np.ndarray, weight: tuple[float, ...], swaps: bool) -> np.ndarray:
    """Weighted edit distance, with swaps of neighbours if wanted (each character edited once)."""
    delete, insert, change, swap = weight
    n, width = t.shape
    steps = insert * np.arange(width + 1)
    before: np.ndarray | None = None
    row = np.broadcast_to(steps, (n, width + 1)).copy()
    found = np.where(x == 0, y * insert, 0.0)
    for i in range(s.shape[1]):
        now = np.empty_like(row)
        now[:, 0] = (i + 1) * delete
        differs = t != s[:, i : i + 1]
        now[:, 1:] = np.minimum(row[:, 1:] + delete, row[:, :-1] + change * differs)
        if swaps and i and width > 1:
            crossed = (t[:, :-1] == s[:, i : i + 1]) & (t[:, 1:] == s[:, i - 1 : i])
            cost = np.where(differs[:, 1:], swap, 0.0)  # nothing is swapped where all four agree
            now[:, 2:] = np.where(crossed, np.minimum(now[:, 2:], before[:, :-2] + cost), now[:, 2:])
        # Insertions run along the row: the least of what stands before, plus a step for each place.
        now = np.minimum.accumulate(now - steps, axis=1) + steps
        before, row = row, now
        done = x == i + 1
        if done.any():
            found[done] = row[done, y[done]]
    return found if all(w == 1 for w in weight) else np.round(found, 12)


def common_subsequence(s: np.ndarray, t: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Insertions and deletions: both sizes less twice the longest common subsequence."""
    n, width = t.shape
    row = np.zeros((n, width + 1), np.int64)
    longest = np.zeros(n, np.int64)
    for i in range(s.shape[1]):
        now = row.copy()
        now[:, 1:] = np.where(t == s[:, i : i + 1], row[:, :-1] + 1, row[:, 1:])
        row = np.maximum.accumulate(now, axis=1)
        done = x == i + 1
        if done.any():
            longest[done] = row[done, y[done]]
    return (x + y - 2 * longest).astype(float)


def damerau(s: np.ndarray, t: np.ndarray, x: np.ndarray, y: np.ndarray, weight: tuple[float, ...]) -> np.ndarray:
    """Full Damerau-Levenshtein distance; what lies between two swapped characters costs a swap each.

    A swap needs both partners: without one it counts as infinite.
    """
    delete, insert, change, swap = weight
    n, width = t.shape
    rows, unit = np.arange(n)[:, None], all(w == 1 for w in weight)
    table = np.empty((n, s.shape[1] + 1, width + 1))
    table[:, 0, :] = insert * np.arange(width + 1)
    table[:, :, 0] = delete * np.arange(s.shape[1] + 1)
    last_row = np.zeros((n, width), np.int64)  # the last source place, from 1, that equals each target place
    steps, places = insert * np.arange(width + 1), np.arange(1, width + 1)
    for i in range(1, s.shape[1] + 1):
        equal = t == s[:, i - 1 : i]
        last_column = np.zeros((n, width), np.int64)
        last_column[:, 1:] = np.maximum.accumulate(np.where(equal, places, 0), axis=1)[:, :-1]
        both = (last_row > 0) & (last_column > 0)
        gaps = (i - last_row - 1) + (places - last_column - 1) + 1
        swapped = np.where(both, table[rows, np.maximum(last_row - 1, 0), np.maximum(last_column - 1, 0)] + gaps * swap, np.inf)
        kept = table[:, i - 1, :-1]
        if unit:
            now = np.minimum(swapped, np.where(equal, kept, np.minimum(table[:, i - 1, 1:] + delete, kept + change)))
            whole = np.concatenate((table[:, i, :1], now), axis=1)
            table[:, i, :] = np.minimum.accumulate(whole - steps, axis=1) + steps
        else:
            for j in range(1, width + 1):
                other = np.minimum(np.minimum(table[:, i - 1, j] + delete, table[:, i, j - 1] + insert), kept[:, j - 1] + change)
                table[:, i, j] = np.minimum(swapped[:, j - 1], np.where(equal[:, j - 1], kept[:, j - 1], other))
        last_row = np.where(equal, i, last_row)
    found = table[np.arange(n), x, y]
    return found if unit else np.round(found, 12)


def hamming(s: np.ndarray, t: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Places that differ; infinite where sizes do."""
    width = min(s.shape[1], t.shape[1])
    inside = np.arange(width) < np.minimum(x, y)[:, None]
    return np.where(x == y, ((s[:, :width] != t[:, :width]) & inside).sum(1).astype(float), np.inf)


def jaro(s: np.ndarray, t: np.ndarray, x: np.ndarray, y: np.ndarray, weight: tuple[float, ...], p: float, bt: float) -> np.ndarray:
    """Jaro distance, with Winkler's reduction by the common start if p is above 0. weight: target, source, order."""
    n, width = t.shape
    span = np.maximum(np.maximum(x, y) // 2 - 1, 0)
    free, matched = np.ones((n, width), bool), np.zeros(s.shape, bool)
    places = np.arange(width)
    for i in range(s.shape[1]):
        if not width:
            break
        fits = free & (t == s[:, i : i + 1]) & (np.abs(places - i) <= span[:, None])
        hit, first = fits.any(1), fits.argmax(1)
        matched[:, i] = hit
        free[hit, first[hit]] = False
    m = matched.sum(1)
    most = int(m.max()) if n else 0
    left, right = np.zeros((n, most), np.int64), np.zeros((n, most), np.int64)
    for values, flags, into in ((s, matched, left), (t, ~free, right)):
        at, column = np.nonzero(flags)
        into[at, (np.cumsum(flags, axis=1) - 1)[at, column]] = values[at, column]
    moved = 0.5 * ((left != right) & (np.arange(most) < m[:, None])).sum(1)
    by_target, by_source, by_order = weight[:3]
    safe = np.maximum(m, 1)
    found = 1 - (by_target * m / np.maximum(y, 1) + by_source * m / np.maximum(x, 1) + by_order * (m - moved) / safe) / 3
    found = np.where((x == 0) & (y == 0), 0.0, np.where(m == 0, 1.0, found))
    if p > 0:
        top = min(4, s.shape[1], width)
        same = np.logical_and.accumulate((s[:, :top] == t[:, :top]) & (np.arange(top) < np.minimum(x, y)[:, None]), axis=1).sum(1) if top else np.zeros(n)
        found = np.where(found > bt, found - same * p * found, found)
    return found


def _gram_keys(codes: Codes, q: int, other: Codes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Numbers that stand for the grams of both sides, equal for equal grams, and the rows they are in."""
    keys, rows = [], []
    for side in (codes, other):
        counts = np.maximum(side.sizes - q + 1, 0)
        row = np.repeat(np.arange(len(counts)), counts)
        start = np.repeat(side.begins - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(int(counts.sum())) if len(counts) else np.zeros(0, np.int64)
        rows.append(row)
        keys.append(start)
    cut = len(keys[0])
    number = np.zeros(cut + len(keys[1]), np.int64)
    for k in range(q):
        value = np.concatenate((codes.values[keys[0] + k], other.values[keys[1] + k]))
        _, value = np.unique(value, return_inverse=True)
        _, number = np.unique(number * (int(value.max(initial=0)) + 1) + value, return_inverse=True)
    return number[:cut], rows[0], number[cut:], rows[1]


def grams(s: Codes, t: Codes, method: str, q: int) -> np.ndarray:
    """qgram, cosine and jaccard distances from gram counts."""
    n = len(s.sizes)
    if q == 0:
        return np.zeros(n)
    a, a_row, b, b_row = _gram_keys(s, q, t)
    kinds = int(max(a.max(initial=-1), b.max(initial=-1))) + 1
    cells, inverse = np.unique(np.concatenate((a_row * kinds + a, b_row * kinds + b)), return_inverse=True)
    na = np.bincount(inverse[: len(a)], minlength=len(cells)).astype(float)
    nb = np.bincount(inverse[len(a) :], minlength=len(cells)).astype(float)
    row = cells // max(kinds, 1)
    total = lambda values: np.bincount(row, values, minlength=n)
    if method == "qgram":
        return total(np.abs(na - nb))
    if method == "jaccard":
        both, either = total(((na > 0) & (nb > 0)).astype(float)), total(np.ones(len(cells)))
        return np.where(either == 0, 0.0, 1 - both / np.maximum(either, 1))
    xy, xx, yy = total(na * nb), total(na * na), total(nb * nb)
    with np.errstate(invalid="ignore", divide="ignore"):
        found = np.abs(1 - xy / (np.sqrt(xx) * np.sqrt(yy)))
    return np.where((xy == xx) & (xx == yy), 0.0, found)


def distances(a: Codes, b: Codes, o: Options) -> np.ndarray:
    """Distance of each row's a and b: the cost of turning b into a."""
    if o.method in ("qgram", "cosine", "jaccard", "running_cosine"):
        method = "cosine" if o.method == "running_cosine" else o.method
        # Pairs are independent; so many at a time that their grams stay within the cells.
        share = np.cumsum(a.sizes + b.sizes) // MOST_CELLS
        cuts = [0, *(np.flatnonzero(np.diff(share)) + 1).tolist(), len(share)]
        return np.concatenate([grams(b.part(i, j), a.part(i, j), method, o.q) for i, j in zip(cuts, cuts[1:])]) if len(share) else np.zeros(0)
    found = np.empty(len(a.sizes))
    w = o.weight
    for rows in alike_in_size(b.sizes, a.sizes, 1 << 22, 2 if o.method == "dl" else 1):
        s, t, x, y = b.padded(rows, -2), a.padded(rows, -3), b.sizes[rows], a.sizes[rows]
        if o.method in ("osa", "lv"):
            found[rows] = edit(s, t, x, y, w, o.method == "osa")
        elif o.method == "dl":
            found[rows] = damerau(s, t, x, y, w)
        elif o.method == "lcs":
            found[rows] = common_subsequence(s, t, x, y)
        elif o.method == "hamming":
            found[rows] = hamming(s, t, x, y)
        elif o.method == "jw":
            found[rows] = jaro(s, t, x, y, w, o.p, o.bt)
        else:
            raise ValueError(f"{o.method} has no batch kernel")
    return found
