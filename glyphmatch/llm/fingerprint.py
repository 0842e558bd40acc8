"""Quartile bucket digests of whole texts and their likeness.

A 24-byte window slides over the UTF-8 bytes, padded with zeros at the end; six triplets of each window's bytes are hashed into buckets and
counted. Bytes of a triplet lie some way apart: counts of neighbouring bytes would tell the language rather than the text. The
digest says for each bucket in which quartile its count lies (two bits) and holds the length on a logarithmic scale. Two digests differ by the
sum of their quartile steps (a step over all three quartiles counts six) and the length steps; the likeness is one minus
the difference over what unrelated texts' digests differ by, not below 0.

Null texts count as empty; an empty text has the digest of no counts. Equal texts have equal
digests. An empty table gives an empty result; repeated rows and ids are ordered by id, then text; columns besides
the two named aren't read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import field_ddl, sliced

BUCKETS = 256
#: Bytes hashed at a time: bounds memory for very long texts.
CHUNK = 1 << 18
#: Offsets in the window of the triplets that are hashed, and an odd multiplier for each.
_TRIPLETS = ((0, 3, 11), (0, 5, 13), (0, 7, 17), (0, 2, 19), (0, 9, 21), (0, 11, 23))
_FACTORS = (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F, 0x165667B1, 0xD3A2646D)
_WINDOW = 24


def _counts(raw: bytes) -> np.ndarray:
    total = np.zeros(BUCKETS, np.int64)
    padded = raw + bytes(_WINDOW - 1)
    for at in range(0, len(raw), CHUNK):
        b = np.frombuffer(padded, np.uint8, min(CHUNK + _WINDOW - 1, len(padded) - at), at).astype(np.uint32)
        n = len(b) - _WINDOW + 1
        for (i, j, k), factor in zip(_TRIPLETS, _FACTORS):
            key = b[i : i + n] | b[j : j + n] << np.uint32(8) | b[k : k + n] << np.uint32(16)
            key *= np.uint32(factor)
            key ^= key >> np.uint32(15)
            key *= np.uint32(factor ^ 0x5BD1E994)
            total += np.bincount(key >> np.uint32(32 - BUCKETS.bit_length() + 1), minlength=BUCKETS)
    return total


def _length_step(n: int) -> int:
    return min(255, round(math.log(n + 1) / math.log(1.1)))


def digest(raw: bytes) -> str:
    """Hex: one byte of length, then a quarter byte for each bucket."""
    counts = _counts(raw)
    cuts = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    steps = (counts[:, None] > cuts).sum(1).astype(np.uint8)
    packed = steps[0::4] | steps[1::4] << 2 | steps[2::4] << 4 | steps[3::4] << 6
    return f"{_length_step(len(raw)):02x}" + packed.tobytes().hex()


def _steps(d: str) -> np.ndarray:
    packed = np.frombuffer(bytes.fromhex(d[2:]), np.uint8)
    return np.stack([packed >> s & 3 for s in (0, 2, 4, 6)], 1).ravel()


#: Difference of two buckets by their quartiles: the steps between them, six over all three.
_COST = np.array([[0, 1, 2, 6], [1, 0, 1, 2], [2, 1, 0, 1], [6, 2, 1, 0]])


def likeness(a: str, b: str) -> float:
    """0 to 1; 1 for equal digests, 0 where the buckets differ as much as those of unrelated texts with as many of each quartile."""
    if a == b:
        return 1.0
    x, y = _steps(a), _steps(b)
    length = abs(int(a[:2], 16) - int(b[:2], 16))
    difference = int(_COST[x, y].sum()) + max(0, length - 1)
    unrelated = float(np.bincount(x, minlength=4) @ _COST @ np.bincount(y, minlength=4)) / len(x)
    return max(0.0, 1.0 - difference / unrelated) if unrelated else 0.0


def edited(text: str, following: str) -> str:
    """The text with its last floor(n / 2) code points replaced by the first as many of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole):
                found = [digest((x or "").encode()) for x in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["id", "fingerprint"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {field_ddl(docs, id_col)}, fingerprint string").withColumnRenamed("id", id_col)


def _range_of(column: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds aren't above the value (null: none), in about 2 * sqrt(bounds) steps."""
    if not bounds:
        return F.lit(0)
    width = math.isqrt(len(bounds) - 1) + 1
    chunks = [bounds[k : k + width] for k in range(0, len(bounds), width)]

    def not_above(values: Column) -> Column:
        return F.aggregate(values, F.lit(0), lambda n, x: n + F.when(column >= x, 1).otherwise(0))

    heads = F.lit([c[0] for c in chunks]).cast("array<long>")
    group = not_above(heads)
    inner = F.element_at(F.array(*[F.lit(c).cast("array<long>") for c in chunks]), F.greatest(group, F.lit(1)))
    return F.coalesce(F.greatest((group - 1) * width, F.lit(0)) + not_above(inner), F.lit(0))


def compared_with_next(docs: DataFrame, parts: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document with its edited text's digest and its likeness to that and to the next document (the last: the first).

    Ids are cut into ranges at some of them; a range is sorted by id within one task. The document that begins a
    range also goes to the end of the range before, so that every document meets its next one without a global sort.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    shares = [k / parts for k in range(1, parts)] or [0.5]
    cuts, least, nulls = rows.agg(F.percentile_approx("id", shares, 10_000), F.min("id"), F.count(F.when(F.col("id").isNull(), 1))).first()
    bounds = sorted({x for x in cuts or [] if x != least}) if parts > 1 else []
    is_first = F.col("id").isNull() if nulls or least is None else F.coalesce(F.col("id") == F.lit(least), F.lit(False))
    at = _range_of(F.col("id"), bounds)
    ends = F.when(is_first, F.lit(len(bounds)))
    if bounds:
        ends = ends.when(F.coalesce(F.col("id").isin(bounds), F.lit(False)), at - 1)
    places = F.array_compact(F.array(F.struct(at.alias("part"), F.lit(0).alias("next")), F.when(ends.isNotNull(), F.struct(ends.alias("part"), F.lit(1).alias("next")))))
    dealt = rows.select(F.explode(places).alias("to"), "id", "text").select("to.part", "to.next", "id", "text")
    ordered = dealt.repartition(len(bounds) + 1, "part").sortWithinPartitions("part", "next", F.col("id").asc_nulls_first(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the row that waits for its next: part, id, text, digest
        closed: set = set()

        def line(part, key, text, own, following, next_digest):
            other = edited(text, following).encode()
            e = digest(other)
            return key, len(text), hashlib.sha256(other).hexdigest(), own, e, likeness(own, e), likeness(own, next_digest)

        for whole in batches:
            for batch in sliced(whole):
                out = []
                for part, nxt, key, text in zip(*(c.to_pylist() for c in batch.columns)):
                    if nxt and part in closed:
                        continue  # further rows with the id that begins the next range
                    own = digest(text.encode())
                    if held and held[0] == part:
                        out.append(line(*held, text, own))
                    if nxt:
                        closed.add(part)
                        held = None
                    else:
                        held = (part, key, text, own)
                if out:
                    cols = list(zip(*out))
                    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    schema = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return ordered.mapInArrow(run, schema).withColumnRenamed("id", id_col)
