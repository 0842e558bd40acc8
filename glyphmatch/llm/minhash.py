"""Near-duplicate documents by MinHash: universal hash minima, banding, verification, connected components.

A document's set holds its distinct shingles of `width` words (ASCII letters lower-cased; fewer words: the whole
sequence). Documents with equal sets form a class at once. Class representatives get `rows * bands` minima of universal
hashes; those that agree in all rows of a band share a bucket. Pairs are checked in two passes: first everyone in a bucket against its
smallest member, by one-bit signatures; then, between the components found so far, all pairs of a bucket by sketches of `SKETCH` further minima, made only
for the documents that are left. Each pair is confirmed on the full sets, in buckets of over LARGE members within the join that makes the pairs. A link at the threshold is missed by all bands with a probability of
(1 - threshold ** rows) ** bands: 3e-7 at 0.85, 6e-5 at 0.80, less above; a sketch beyond SIGMAS standard deviations drops another 3e-7.

Null and empty texts have no shingles, are linked with nothing and kept. Ids should be unique; rows with a
null id are kept and get no component. Repeated rows are copies of each other. Columns besides the two named
aren't read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, sliced, stored, unstored, without
from .components import by_families, connected_components, crossing_pairs, in_blocks, linked_members, shared_buckets

BANDS, ROWS = 32, 6
#: Minima of the second pass, of each of which four bits are compared.
SKETCH = 1024
#: So many standard deviations may a pair's signature or sketch lie beyond what the threshold lets expect.
SIGMAS = 5.0
#: Members of a bucket from which on full sets are compared where its pairs are made.
LARGE = 64
#: Ids of at most so many documents (16 bytes each) are broadcast; more are joined by a shuffle.
MOST_BROADCAST = 1_000_000
#: Word hashes that a worker remembers before it starts anew; workers keep them only while a task runs.
REMEMBERED = 200_000

_UPPER = bytes(range(65, 91))
_LOWER = bytes.maketrans(_UPPER, _UPPER.lower())
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


_HASHES = _WordHashes()


def forget() -> None:
    """Called by name, so that it is the worker's own memory that is cleared and not a copy shipped with a task."""
    _HASHES.clear()


def _finished(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def shingle_set(text: str, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text; the probability that two of them agree by chance is negligible."""
    words = text.encode().translate(_LOWER).split()  # splits at the six ASCII white-space characters
    if not words:
        return np.zeros(0, np.uint64)
    if len(_HASHES) > REMEMBERED:
        _HASHES.clear()
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    n = min(width, len(words))
    total = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        total *= np.uint64(_MIX[k % len(_MIX)] | 1)
        total += h[k : len(words) - n + 1 + k]
        total ^= total >> np.uint64(31)
    return np.unique(_finished(total))


def _family(n: int, seed: int = 20240229) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 31, n, np.uint32)[:, None] * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, n, np.uint32)[:, None]


def minima(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minimum of (a * x + b) mod 2 ** 32 over the set for each of the hashes."""
    x = (shingles >> np.uint64(32)).astype(np.uint32) ^ shingles.astype(np.uint32)
    found = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 1024):
        values = a * x[at : at + 1024]
        values += b
        np.minimum(found, values.min(1), out=found)
    return found


def band_keys(found: np.ndarray, bands: int) -> np.ndarray:
    keys = np.arange(bands, dtype=np.uint64) * np.uint64(_MIX[0])
    for row in found.reshape(bands, -1).T.astype(np.uint64):
        keys = _finished((keys + row + np.uint64(1)) * np.uint64(_MIX[1]))
    return keys.astype(np.int64)


def _bits(found: np.ndarray, at: int = 13) -> np.ndarray:
    ones = (found >> np.uint32(at) & np.uint32(1)).astype(np.uint8)
    return np.packbits(np.pad(ones, (0, -len(ones) % 64))).view(np.int64)


@contextmanager
def arrow_rows(spark: SparkSession, n: int):
    """At most so many rows in an Arrow batch, for rows that hold whole sets."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if not 0 < int(before) <= n:
        spark.conf.set(name, str(n))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def signatures(docs: DataFrame, width: int, bands: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """(id long, n int, key binary, keys array<long>, bits array<long>): set size, set digest, band keys, one-bit signature."""
    a, b = _family(bands * rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for whole in batches:
            for batch in sliced(whole):
                n, key, keys, bits = [], [], [], []
                for text in batch.column(1).to_pylist():
                    found = shingle_set(text or "", width)
                    n.append(len(found))
                    if len(found):
                        least = minima(found, a, b)
                        key.append(xxhash.xxh3_128_digest(found.tobytes()))
                        keys.append(band_keys(least, bands))
                        bits.append(_bits(least))
                    else:
                        key.append(None)
                        keys.append(None)
                        bits.append(None)
                arrays = [batch.column(0), pa.array(n, pa.int32()), pa.array(key, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, ["id", "n", "key", "keys", "bits"])
        forget()

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, "id long, n int, key binary, keys array<long>, bits array<long>")


def _of_documents(docs: DataFrame, ids: DataFrame, name: str, kind: str, made: Callable[[str], object], id_col: str, text_col: str) -> DataFrame:
    """(id, name): what is made anew from the texts of the documents with these ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = {"binary": pa.binary(), "array<long>": pa.list_(pa.int64())}[kind]
        for whole in batches:
            for batch in sliced(whole):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([made(x or "") for x in batch.column(1).to_pylist()], of)], ["id", name])
        forget()

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    few = ids.count() <= MOST_BROADCAST
    return texts.join(F.broadcast(ids) if few else ids, "id", "left_semi").mapInArrow(run, f"id long, {name} {kind}")


def _sketches(docs: DataFrame, ids: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(id, sketch array<long>): four bits of each of SKETCH minima, one plane of bits after the other."""
    a, b = _family(SKETCH, 20240301)

    def made(text: str) -> np.ndarray:
        least = minima(shingle_set(text, width), a, b)
        return np.concatenate([_bits(least, at) for at in (9, 12, 15, 18)])

    return _of_documents(docs, ids, "sketch", "array<long>", made, id_col, text_col)


def confirmed(pairs: DataFrame, docs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union of their full sets."""
    spark = pairs.sparkSession
    ids = stored(pairs.select(F.col("a").alias("id")).distinct().union(pairs.select(F.col("b").alias("id")).distinct()).distinct(), "ids")
    sets = stored(_of_documents(docs, ids, "set", "binary", lambda text: shingle_set(text, width).tobytes(), id_col, text_col), "sets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                both = int((y[at] == x).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep))], ["a", "b"])

    met = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b")
    with arrow_rows(spark, 500):
        return stored(met.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "links")


def _allowed(bits: int, share: float, sigmas: float = SIGMAS) -> int:
    """So many of the bits may differ where each differs with that probability."""
    return int(bits * share + sigmas * (bits * share * (1 - share)) ** 0.5)


def _apart(x: Callable[[str], Column], y: Callable[[str], Column], words: int, planes: int) -> Column:
    """How many minima differ in any of the planes' bits; the bits are in the columns p{plane}_{word}."""

    def differing(w: int) -> Column:
        found = x(f"p0_{w}").bitwiseXOR(y(f"p0_{w}"))
        for p in range(1, planes):
            found = found.bitwiseOR(x(f"p{p}_{w}").bitwiseXOR(y(f"p{p}_{w}")))
        return F.bit_count(found)

    return sum((differing(w) for w in range(1, words)), differing(0))


def _apart_in(x: Column, y: Column, words: int, planes: int) -> Column:
    """The same for bits in arrays, plane after plane: slower, and short enough for compiled code."""
    bit = lambda w, p: F.get(x, w + p * words).bitwiseXOR(F.get(y, w + p * words))

    def of(w: Column) -> Column:
        found = bit(w, 0)
        for p in range(1, planes):
            found = found.bitwiseOR(bit(w, p))
        return F.bit_count(found)

    return F.aggregate(F.sequence(F.lit(0), F.lit(words - 1)), F.lit(0), lambda n, w: n + of(w))


def _planes(column: str, words: int, planes: int, each: int) -> list[Column]:
    return [F.element_at(column, p * each + w + 1).alias(f"p{p}_{w}") for p in range(planes) for w in range(words)]


def near_duplicates(docs: DataFrame, width: int = 3, percent: int = 85, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles long, component_id, kept) for every row; the component is the smallest id reachable over links."""
    found = stored(signatures(docs, width, bands, rows, id_col, text_col), "signatures")
    # Sets of fewer shingles than this are alike enough only if they are equal.
    least = -(-percent // (100 - percent)) if percent < 100 else 1 << 30
    first = found.filter("key is not null and id is not null").groupBy("key").agg(F.min(F.struct("id", "n", "bits", "keys")).alias("r"))
    classes = stored(first.select("key", "r.*"), "classes")
    shared = shared_buckets(classes.filter(F.col("n") >= least).select(F.posexplode("keys").alias("band", "bucket"), "id"))
    words = -(-bands * rows // 64)
    facts = classes.select("id", "n", *_planes("bits", words, 1, words))
    share = (1 - percent / 100) / 2
    side = lambda of: lambda name: F.col(f"{of}.{name}")

    def sized(x: str, y: str) -> Column:
        return 100 * F.least(side(x)("n"), side(y)("n")) >= percent * F.greatest(side(x)("n"), side(y)("n"))

    def near(x: str, y: str) -> Column:
        return sized(x, y) & (_apart(side(x), side(y), words, 1) <= _allowed(bands * rows, share))

    def nearer(x: str, y: str) -> Column:
        """First by a quarter of the sketch; a pair that shares several buckets is then looked at in the first of them only, by all of the sketch."""
        quarter = _apart(side(x), side(y), SKETCH // 256, 4) <= _allowed(SKETCH // 4, 2 * share * 15 / 16)
        again = F.arrays_overlap(F.slice(side(x)("keys"), F.lit(1), side(x)("band")), side(y)("keys"))
        all_ = _apart_in(side(x)("sketch"), side(y)("sketch"), SKETCH // 64, 4) <= _allowed(SKETCH, 2 * share * 15 / 16)
        return sized(x, y) & quarter & F.when(again, F.lit(False)).otherwise(all_)

    def starred(pairs: DataFrame) -> DataFrame:
        met = pairs.alias("p").join(facts.alias("x"), F.col("p.a") == F.col("x.id")).join(facts.alias("y"), F.col("p.b") == F.col("y.id"))
        return confirmed(stored(met.filter(near("x", "y")).select("p.a", "p.b"), "stars"), docs, width, percent, id_col, text_col)

    def crossing(members: DataFrame) -> DataFrame:
        left = stored(members.select("id").distinct(), "left")
        sketches = stored(_sketches(docs, left, width, id_col, text_col).join(classes.select("id", "n", "keys"), "id"), "sketches")
        sketches = sketches.select("id", "n", "keys", "sketch", *_planes("sketch", SKETCH // 256, 4, SKETCH // 64))
        large = stored(members.groupBy("bucket").agg(F.count("*").alias("n")).filter(F.col("n") > LARGE).select("bucket"), "large-buckets")
        if not large.limit(1).count():
            return confirmed(stored(crossing_pairs(members.join(sketches, "id"), nearer), "crossing"), docs, width, percent, id_col, text_col)
        few = large.count() <= MOST_BROADCAST
        large = F.broadcast(large) if few else large
        pairs = stored(crossing_pairs(members.join(large, "bucket", "left_anti").join(sketches, "id"), nearer), "crossing")
        links = confirmed(pairs, docs, width, percent, id_col, text_col)
        given = stored(members.join(large, "bucket", "left_semi").select("band", "bucket", "id", "component"), "large-members")
        hot = by_families(given)
        ids = stored(hot.select("id").distinct(), "large-ids")
        sets = stored(_of_documents(docs, ids, "set", "array<long>", lambda text: shingle_set(text, width).view(np.int64), id_col, text_col), "large-sets")

        def linked(x: str, y: str) -> Column:
            """Full sets are compared within the join, which so makes links only, however many pairs lie near the threshold."""
            both = F.size(F.array_intersect(side(x)("set"), side(y)("set")))
            alike = (100 + percent) * both >= percent * (side(x)("n") + side(y)("n"))
            return F.when(nearer(x, y), alike).otherwise(F.lit(False))

        size = hot.join(classes.select("id", "n"), "id").agg(F.sum(8 * F.col("n") + 1024)).first()[0]
        sides = in_blocks(hot.join(sketches, "id").join(sets, "id"), size)
        within = stored(crossing_pairs(sides, linked), "large-links")
        unstored(given, hot, ids, sets, sides)
        return links.union(within)

    links = linked_members(shared, starred, crossing)
    joined = classes.select("key", "id").join(connected_components(links).select(F.col("node").alias("id"), "component"), "id", "left")
    by_class = stored(joined.select("key", F.coalesce("component", "id").alias("component")), "by-class")
    return (
        found.select("id", "n", "key")
        .join(by_class, "key", "left")
        .select(
            F.col("id").alias(id_col),
            F.col("n").cast("long").alias("n_shingles"),
            F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"),
            F.coalesce(F.col("id") == F.coalesce("component", "id"), F.lit(True)).alias("kept"),
        )
    )


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of one document of each group of near-duplicates, with all their columns; a row that occurs twice stays once."""
    found = stored(near_duplicates(docs, width, percent, id_col=id_col, text_col=text_col), "near")
    key = fresh("id", docs.columns)
    same = F.col(f"`{id_col}`") == F.col(key)
    dropped = stored(found.filter("not kept").select(F.col(id_col).alias(key)).distinct(), "dropped")
    rest = without(docs, dropped, same)
    twice = found.filter(F.col("kept") & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count("*").alias("n")).filter("n > 1")
    twice = stored(twice.select(F.col(id_col).alias(key)), "twice")
    if not twice.count():
        return rest
    return without(rest, twice, same).unionByName(rest.join(twice, same, "left_semi").dropDuplicates([id_col]))
