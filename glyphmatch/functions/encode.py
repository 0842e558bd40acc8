"""Arrow columns of strings or integer lists as padded integer matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Cells of a padded matrix that are worked on at a time.
MOST_CELLS = 1 << 20


class Codes:
    """Sequences of integers one after the other, with their bounds."""

    def __init__(self, values: np.ndarray, sizes: np.ndarray):
        self.values, self.sizes = values, sizes.astype(np.int64)
        self.begins = np.concatenate(([0], np.cumsum(self.sizes)[:-1])) if len(sizes) else self.sizes

    def part(self, first: int, end: int) -> Codes:
        """The sequences from first to end."""
        sizes = self.sizes[first:end]
        begin = int(self.begins[first]) if end > first else 0
        return Codes(self.values[begin : begin + int(sizes.sum())], sizes)

    def padded(self, rows: np.ndarray, filler: int) -> np.ndarray:
        sizes = self.sizes[rows]
        width = int(sizes.max()) if len(rows) else 0
        found = np.full((len(rows), width), filler, np.int64)
        inside = np.arange(width) < sizes[:, None]
        found[inside] = self.values[np.repeat(self.begins[rows] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(int(sizes.sum()))]
        return found


def from_texts(texts: list[str]) -> Codes:
    """Code points."""
    values = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return Codes(values, np.fromiter(map(len, texts), np.int64, len(texts)))


def from_column(column: pa.Array) -> Codes:
    """Strings as code points, lists as they are; null as empty."""
    if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        rows = [x or [] for x in column.to_pylist()]
        flat = [-1 if v is None else v for x in rows for v in x]
        return Codes(np.array(flat, np.int64), np.fromiter(map(len, rows), np.int64, len(rows)))
    return from_texts([x or "" for x in column.to_pylist()])


def alike_in_size(x: np.ndarray, y: np.ndarray, most_cells: int = MOST_CELLS, power: int = 1) -> Iterator[np.ndarray]:
    """Rows in groups of similar sizes, so that padding stays small and a group's matrices (a cube for power 2) within the cells."""
    order = np.lexsort((y, x))
    at = 0
    while at < len(order):
        n = min(len(order) - at, 1 << 14)
        while n > 1:
            rows = order[at : at + n]
            if n * (1 + int(max(x[rows].max(), y[rows].max()))) ** power <= most_cells:
                break
            n = max(1, n // 2)
        yield order[at : at + n]
        at += n
