"""Packing token pieces into sequences of a fixed size by exact complements, then best fit.

Only the histogram of piece lengths matters for the plan. It has at most `size` rows whatever the corpus holds, so it
is planned on the driver: for each length, longest first, a single, a pair or a triple of other lengths that
fills the gap exactly is looked up and used as often as the counts allow; what is left goes by best fit. The plan is
a list of slots (length, ranks from-to, first sequence, offset) with a number of rows that depends on the size alone.
Pieces get a rank within their length in salted groups and find their slot by it.

Null texts count as empty: a document is its ids and the end id, one token at least. Repeated rows are packed
each; an empty table gives no rows; columns besides those named aren't read.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import byte_characters
from .common import field_ddl, sliced, stored

#: Words that a worker remembers before it starts anew; it keeps them only while a task runs.
REMEMBERED = 250_000
LONGEST_REMEMBERED = 256

#: Letters before this one are in composed form and have lower-case letters of one character, or are told by isalpha().
_LATIN_END = "\u0180"
_MARKS = frozenset(".,;:!?")
#: A character beyond those, or the one of them whose lower-case form has two characters.
_OTHER = re.compile(f"[^\0-{chr(ord(_LATIN_END) - 1)}]|\u0130")
_TOKENIZERS: dict = {}


def _bytes(ids: list[int]) -> bytes:
    found = array("I", ids)
    if sys.byteorder == "big":
        found.byteswap()
    return found.tobytes()


class _Words(dict):
    """Word between spaces or line ends -> its ids as little-endian uint32 bytes."""

    def __init__(self, content: bytes):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(content)
        self.model = self.tokenizer.model
        self.mapped = dict(enumerate(byte_characters()))

    def __missing__(self, word: str) -> bytes:
        if word and max(word) < _LATIN_END and len(word) <= LONGEST_REMEMBERED:
            # The tokenizer splits letters from a mark after them, and lower-cases. A word of lower-case
            # Latin letters is one pre-token, so its model can be asked at once.
            low = word.lower()
            if word[-1] in _MARKS and word[-2:-1].lower().isalpha():
                self[word] = ids = self[word[:-1]] + self[word[-1]]
                return ids
            if low.isalpha():
                if low != word:
                    ids = self[low]
                else:
                    letters = low if low.isascii() else low.encode().decode("latin-1").translate(self.mapped)
                    ids = _bytes([t.id for t in self.model.tokenize(letters)])
                self[word] = ids
                return ids
        ids = _bytes(self.tokenizer.encode(word, add_special_tokens=False).ids)
        if len(word) <= LONGEST_REMEMBERED:
            self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if len(self) > REMEMBERED:
            self.clear()
        # A line end is white space as a space is; a word at it would else be remembered with the next line's first.
        text = text.replace("\n", " ")
        if "<|" not in text and not _OTHER.search(text):
            text = text.lower()  # as the tokenizer does; words that begin sentences are remembered once
        return b"".join(map(self.__getitem__, text.split(" ")))


def _words(content: bytes) -> _Words:
    key = (len(content), hash(content))
    if key not in _TOKENIZERS:
        _TOKENIZERS[key] = _Words(content)
    return _TOKENIZERS[key]


def tokenize(docs: DataFrame, tokenizer_path: str, size: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece int, start long, length long, ids binary): documents as ids (little-endian uint32) and the end id, cut at the size.

    The tokenizer must drop white space, so that words between spaces can be encoded one by one. Its file is read on the driver and broadcast.
    """
    with open(tokenizer_path, "rb") as f:
        content = docs.sparkSession.sparkContext.broadcast(f.read())
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(content.value)
        step = 4 * size
        for whole in batches:
            for batch in sliced(whole):
                row, piece, start, ids = [], [], [], []
                for k, text in enumerate(batch.column(1).to_pylist()):
                    tokens = (words.encode(text) if text else b"") + end
                    for n, at in enumerate(range(0, len(tokens), step)):
                        row.append(k)
                        piece.append(n)
                        start.append(at // 4)
                        ids.append(tokens[at : at + step])
                columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "piece", "start", "length", "ids"])
        words.clear()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {field_ddl(docs, id_col)}, piece int, start long, length long, ids binary"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def plan_slots(histogram: dict[int, int], size: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Slots (length, first rank, end rank, sequence of the first rank, offset) and the number of sequences.

    histogram: pieces by length, 1 to size.
    """
    left = np.zeros(size + 1, np.int64)
    for length, n in histogram.items():
        if not 1 <= length <= size:
            raise ValueError(f"length {length} is not in 1..{size}")
        left[length] += n
    bins: list[tuple[list[int], int]] = []  # (lengths, times)

    def fill(gap: int, parts: int) -> list[int] | None:
        """The longest-first combination of at most `parts` available lengths with the sum gap."""
        if left[gap]:
            return [gap]
        if parts >= 2:
            a = np.arange(gap - 1, (gap + 1) // 2 - 1, -1)
            both = (left[a] > 0) & (left[gap - a] > 0) & ((2 * a != gap) | (left[a] > 1))
            if both.any():
                first = int(a[both.argmax()])
                return [first, gap - first]
        if parts >= 3:
            for first in range(gap - 2, (gap + 2) // 3 - 1, -1):
                if left[first]:
                    left[first] -= 1
                    rest = fill(gap - first, 2)
                    left[first] += 1
                    if rest:
                        return [first, *rest]
        return None

    loose: list[tuple[int, int]] = []
    for length in range(size, 0, -1):
        while left[length]:
            if length == size:
                parts: list[int] | None = []
            else:
                left[length] -= 1
                parts = fill(size - length, 3)
                left[length] += 1
            if parts is None:
                loose.append((length, int(left[length])))
                left[length] = 0
                break
            used = [length, *parts]
            times = min(int(left[x]) // used.count(x) for x in used)
            for x in used:
                left[x] -= times
            bins.append((used, times))
    open_bins: dict[int, list[tuple[list[int], int]]] = {}  # by gap
    gaps = np.zeros(size + 1, bool)
    for length, n in loose:
        while n:
            fits = np.flatnonzero(gaps[length:])
            if len(fits):
                gap = length + int(fits[0])
                lengths, times = open_bins[gap].pop()
                used = min(n, times)
                if times > used:
                    open_bins[gap].append((lengths, times - used))
                gaps[gap] = bool(open_bins[gap])
                n -= used
            else:  # new bins, each with as many of this length as fit
                gap, lengths = size, []
                each = min(size // length, n)
                used = n // each
                n -= used * each
                lengths = [length] * (each - 1)
                gap = size - length * (each - 1)
            left_over = gap - length
            open_bins.setdefault(left_over, []).append(([*lengths, length], used))
            gaps[left_over] = left_over > 0
    bins += [x for group in open_bins.values() for x in group]

    slots, taken, sequence = [], np.zeros(size + 1, np.int64), 0
    for lengths, times in bins:
        offset = 0
        for x in lengths:
            at = int(taken[x])
            slots.append((x, at, at + times, sequence, offset))
            taken[x] += times
            offset += x
        sequence += times
    return slots, sequence


def pack(pieces: DataFrame, size: int = 2048, length_col: str = "length", order_cols: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """The pieces with sequence_id and offset. `pieces` is read three times: pass a stored table."""
    spark = pieces.sparkSession
    histogram = {int(r[0]): int(r[1]) for r in pieces.groupBy(F.col(length_col)).count().collect()}  # at most `size` rows
    slots, _ = plan_slots(histogram, size)
    total = sum(histogram.values())
    salts = max(64, min(1 << 16, total // 250_000))
    keyed = pieces.withColumns({"_len": F.col(length_col).cast("int"), "_salt": F.pmod(F.xxhash64(*order_cols), F.lit(salts)).cast("int")})
    counts = keyed.groupBy("_len", "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_len").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_len", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    rest = [F.col(c) for c in pieces.columns if c not in order_cols]
    within = Window.partitionBy("_len", "_salt").orderBy(*order_cols, *rest)
    ranked = keyed.withColumn("_row", F.row_number().over(within)).join(starts, ["_len", "_salt"]).withColumn("_rank", F.col("_first") + F.col("_row") - 1)
    # The plan's rows are bounded by the size: every step of the planner uses up a length or a group of bins.
    plan = spark.createDataFrame([(int(a), int(b), int(c), int(d), int(e)) for a, b, c, d, e in slots], "_slot_len int, _from long, _to long, _seq long, _off long")
    placed = ranked.join(F.broadcast(plan), (F.col("_len") == F.col("_slot_len")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    return placed.select(*pieces.columns, (F.col("_seq") + F.col("_rank") - F.col("_from")).alias("sequence_id"), F.col("_off").alias("offset"))


def packed_documents(docs: DataFrame, tokenizer_path: str, size: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents with their place: id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = tokenize(docs, tokenizer_path, size, id_col=id_col, text_col=text_col)
    slim = stored(pieces.select(id_col, "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "pieces")
    return pack(slim, size, order_cols=(id_col, "piece"))


def crc32(ids: bytes) -> int:
    return zlib.crc32(ids)
