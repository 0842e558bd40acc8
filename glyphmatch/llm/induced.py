"""Suffix arrays by induced sorting, in whole-bucket numpy steps where buckets are large.

Suffixes are classified as smaller (S) or larger (L) than their right neighbour; leftmost smaller ones (LMS) cut the text into
substrings, which are sorted by words of several letters and named; the string of names, whose letters are many and whose buckets are small, is sorted
recursively by triples (skew), in steps over whole arrays; a round of inducing from the sorted LMS suffixes gives the array. A bucket's entries are scanned at once:
those that they induce into the bucket itself form the next front. Where a text is short for its letters,
plain loops do the same scan. The recursion ends where all names of a level are distinct.

Places and ranks are 32-bit numbers, and what numpy would widen or copy for a whole text (indices, words) is made in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: A whole-bucket step pays from about so many suffixes a bucket on.
_LARGE_BUCKET = 16
#: Places that are looked at together where each needs several wide numbers.
BLOCK = 1 << 18
_ZERO = np.zeros(1, np.int64)


def blocks(n: int) -> Iterator[slice]:
    """Slices that cover n places, one block after the other."""
    for at in range(0, n, BLOCK):
        yield slice(at, min(n, at + BLOCK))


def those(places: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """The places that are flagged, in order."""
    return np.concatenate([part[flags[part]] for part in (places[b] for b in blocks(len(places)))] or [places])


def suffix_array(text: np.ndarray, sigma: int) -> np.ndarray:
    """The suffix array of a text of numbers below sigma that ends with its only 0."""
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int32)
    text = text.astype(np.uint16 if sigma <= 1 << 16 else np.int32, copy=False)
    smaller = _smaller(text)
    lms = (np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1).astype(np.int32)
    induce = _induce_buckets if n >= _LARGE_BUCKET * sigma else _induce_loop
    return induce(text, smaller, lms[_by_triples(_names(text, lms, sigma))], sigma)


def _smaller(text: np.ndarray) -> np.ndarray:
    """True for S suffixes; the last one is S."""
    n = len(text)
    found = np.ones(n, bool)
    for b in reversed(list(blocks(n - 1))):
        here, after = text[b], text[b.start + 1 : b.stop + 1]
        less, size = here < after, len(here)
        following = np.where(here != after, np.arange(size), size)
        following = np.minimum.accumulate(following[::-1])[::-1]
        found[b] = np.append(less, found[b.stop])[following]
    return found


def _names(text: np.ndarray, lms: np.ndarray, sigma: int) -> np.ndarray:
    """Ranks of the LMS substrings; equal ones share a rank. Where one begins another, the longer one has an L suffix where the shorter one ends, so it is the smaller."""
    bits = sigma.bit_length()
    each = 64 // bits  # letters of a word; past a substring's end it is filled with a letter beyond all
    last = len(text) - 1
    sizes = np.append(lms[1:], np.int32(last)) - lms + 1

    def word(which: np.ndarray, at: int) -> np.ndarray:
        found = np.zeros(len(which), np.uint64)
        for b in blocks(len(which)):
            begins, left, part = lms[which[b]], sizes[which[b]] - at, found[b]
            for k in range(each):
                letters = text[np.minimum(begins + (at + k), last)].astype(np.uint64)
                letters[left <= k] = sigma
                part <<= np.uint64(bits)
                part |= letters
        return found

    rank = np.zeros(len(lms), np.int32)  # how many are smaller
    active, at = np.arange(len(lms), dtype=np.int32), 0
    while len(active):
        keys = word(active, at)
        order = keys.argsort(kind="stable")
        if at:
            order = order[rank[active[order]].argsort(kind="stable")]
        active, keys = active[order], keys[order]
        del order
        group = rank[active]
        first = np.append(True, group[1:] != group[:-1])
        new = first | np.append(True, keys[1:] != keys[:-1])
        del keys
        place = np.arange(len(active), dtype=np.int32)
        group -= np.maximum.accumulate(np.where(first, place, np.int32(0)))
        group += np.maximum.accumulate(np.where(new, place, np.int32(0)))
        rank[active] = group
        alone = new & np.append(new[1:], True)
        at += each
        active = active[~alone & (sizes[active] > at)]
    return _dense(rank, len(rank))


def _dense(ranks: np.ndarray, below: int) -> np.ndarray:
    """Numbers below `below` by their place among those that occur."""
    there = np.zeros(below, bool)
    there[ranks] = True
    return (np.cumsum(there, dtype=np.int32) - np.int32(1))[ranks]


def _packed(columns: list[np.ndarray]) -> np.ndarray:
    """One 64-bit key a row, ordered as the columns in turn; where bits don't suffice, what is packed so far is replaced by its ranks."""
    found, used = columns[0].astype(np.uint64), int(columns[0].max()).bit_length()
    for column in columns[1:]:
        bits = int(column.max()).bit_length()
        if used + bits > 64:
            different, found = np.unique(found, return_inverse=True)
            found, used = found.astype(np.uint64), (len(different) - 1).bit_length()
        found <<= np.uint64(bits)
        np.bitwise_or(found, column, out=found, dtype=np.uint64, casting="unsafe")
        used += bits
    return found


def _by_triples(text: np.ndarray) -> np.ndarray:
    """The suffix array of numbers from 0 whose last one occurs once.

    Suffixes at places 1 and 2 of every three are sorted by recursion on the names of their triples; the others by a letter and the next one's rank;
    both are merged by letters and ranks. Places past the end count as 0, all letters as more.
    """
    n = len(text)
    if int(text.max()) + 1 == n:  # all differ
        return np.argsort(text).astype(np.int32)
    letters = np.zeros(n + 3, np.int32)
    letters[:n] = text
    letters[:n] += 1
    del text
    # The triples that reach the last letter differ from all others, so no comparison runs from the first part into the second.
    sorted_ = _by_triples(_triples(letters))
    ones = (n + 1) // 3
    sorted_ = np.where(sorted_ < ones, 3 * sorted_ + 1, 3 * (sorted_ - ones) + 2)
    rank = np.zeros(n + 3, np.int32)
    rank[sorted_] = np.arange(1, len(sorted_) + 1, dtype=np.int32)
    zeros = np.arange(0, n, 3, dtype=np.int32)
    zeros = zeros[_packed([letters[:n:3], rank[1 : n + 1 : 3]]).argsort()]
    second = sorted_ % 3 == 2
    ones, twos = sorted_[~second], sorted_[second]
    place = np.arange(len(zeros))
    for others, depth in ((ones, 1), (twos, 2)):
        if len(others):
            both = np.concatenate((others, zeros))
            keys = _packed([*(letters[both + k] for k in range(depth)), rank[both + depth]])
            place += np.searchsorted(keys[: len(others)], keys[len(others) :])
    array, free = np.empty(n, np.int32), np.ones(n, bool)
    array[place] = zeros
    free[place] = False
    array[free] = sorted_
    return array


def _triples(letters: np.ndarray) -> np.ndarray:
    """Ranks, from 0, of the triples at places 1 and then 2 of every three of a text that three zeros follow; equal ones share a rank."""
    n = len(letters) - 3
    keys = _packed([np.concatenate((letters[1 + k : n + k : 3], letters[2 + k : n + k : 3])) for k in range(3)])
    order = keys.argsort()
    keys = keys[order]
    names = np.empty(len(keys), np.int32)
    names[order] = np.append(np.int32(0), np.cumsum(keys[1:] != keys[:-1], dtype=np.int32))
    return names


def _induce_buckets(text: np.ndarray, smaller: np.ndarray, lms: np.ndarray, sigma: int) -> np.ndarray:
    n = len(text)
    ends = np.cumsum(np.bincount(text, minlength=sigma))
    heads = np.append(0, ends[:-1])
    larger_each = np.bincount(text[~smaller], minlength=sigma)
    before_larger, before_smaller = np.zeros(n, bool), np.zeros(n, bool)
    before_larger[1:], before_smaller[1:] = ~smaller[:-1], smaller[:-1]
    cuts = np.append(0, np.cumsum(np.bincount(text[lms], minlength=sigma)))
    array = np.full(n, -1, np.int32)

    def put(front: np.ndarray, wanted: np.ndarray, step: int) -> None:
        """Put the wanted left neighbours of the front, in order, at the next places of their buckets."""
        found = front[wanted[front]] - 1
        if len(found) <= 2:
            for p in found.tolist():
                c = text[p]
                array[at[c] - (step < 0)] = p
                at[c] += step
            return
        letters = text[found]
        by = letters.argsort(kind="stable")
        letters = letters[by]
        cut = (letters[1:] != letters[:-1]).nonzero()[0] + 1
        starts = np.concatenate((_ZERO, cut))
        own = letters[starts]
        sizes = np.concatenate((cut, [len(by)])) - starts
        place = np.arange(len(by))
        if step > 0:
            array[(at[own] - starts).repeat(sizes) + place] = found[by]
            at[own] += sizes
        else:
            array[(at[own] - 1 + starts).repeat(sizes) - place] = found[by]
            at[own] -= sizes

    at = heads.copy()
    head, cut_at, larger = heads.tolist(), cuts.tolist(), larger_each.tolist()
    for c in range(sigma):
        done = head[c]
        while done < (upto := int(at[c])):
            front = array[done:upto]
            done = upto
            put(front, before_larger, 1)
        if cut_at[c] < cut_at[c + 1]:
            put(lms[cut_at[c] : cut_at[c + 1]], before_larger, 1)
    at = ends.copy()
    array[0] = n - 1
    at[0] = 0
    end = ends.tolist()
    for c in range(sigma - 1, -1, -1):
        done = end[c]
        while done > (upto := int(at[c])):
            front = array[upto:done][::-1]
            done = upto
            put(front, before_smaller, -1)
        if larger[c]:
            put(array[head[c] : head[c] + larger[c]][::-1], before_smaller, -1)
    return array


def _induce_loop(text: np.ndarray, smaller: np.ndarray, lms: np.ndarray, sigma: int) -> np.ndarray:
    n = len(text)
    counts = np.bincount(text, minlength=sigma)
    ends = np.cumsum(counts)
    at = np.append(0, ends[:-1]).tolist()
    letters = text.tolist()
    left_larger = (~np.append(True, smaller[:-1])).tolist()  # the left neighbour is L
    left_smaller = np.append(False, smaller[:-1]).tolist()
    # The scan needs LMS suffixes at the ends of their buckets, in order.
    array_np = np.full(n, -1, np.int64)
    first = ends - np.bincount(text[lms], minlength=sigma)
    groups = text[lms]
    starts = np.append(0, np.cumsum(np.bincount(groups, minlength=sigma))[:-1])
    array_np[first[groups] + np.arange(len(lms)) - starts[groups]] = lms
    array = array_np.tolist()
    for k in range(n):
        j = array[k]
        if j >= 0 and left_larger[j]:
            c = letters[j - 1]
            array[at[c]] = j - 1
            at[c] += 1
    at = ends.tolist()
    at[0] = 0
    array[0] = n - 1
    for k in range(n - 1, -1, -1):
        j = array[k]
        if left_smaller[j]:
            c = letters[j - 1]
            at[c] -= 1
            array[at[c]] = j - 1
    return np.array(array, np.int32)


def common_prefixes(raw: np.ndarray, array: np.ndarray, wanted: np.ndarray, most: int, known: np.ndarray | None = None) -> np.ndarray:
    """Permuted common prefixes: for each wanted position how many letters, up to `most`, it shares with the wanted position before it in the array.

    raw: bytes. Others get 0, and so do those that are known where the one before them is known as well. Wanted positions must have `most` bytes after them.
    """
    found = np.zeros(len(raw), np.int32)
    order = those(array, wanted)
    padded = np.append(raw, np.zeros(8, np.uint8))
    words = np.ndarray((len(raw),), "<u8", padded, 0, (1,))
    for b in blocks(len(order) - 1):
        here, other = order[b.start + 1 : b.stop + 1], order[b]
        if known is not None:
            asked = ~(known[here] & known[other])
            here, other = here[asked], other[asked]
        k = 0
        while len(here) and k + 8 <= most:
            equal = words[here + k] == words[other + k]
            if not equal.all():
                lost, lost_other = here[~equal], other[~equal]
                same, size = np.ones(len(lost), bool), np.full(len(lost), k, np.int32)
                for byte in range(7):
                    same &= padded[lost + k + byte] == padded[lost_other + k + byte]
                    size += same
                found[lost] = size
                here, other = here[equal], other[equal]
            k += 8
        while len(here) and k < most:
            equal = padded[here + k] == padded[other + k]
            found[here[~equal]] = k
            here, other = here[equal], other[equal]
            k += 1
        found[here] = most
    return found
