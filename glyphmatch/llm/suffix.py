"""Removal of repeated byte strings: suffix arrays by induced sorting over shards that equal strings share.

Every string of `width` bytes in a text (a window) has an anchor, its leftmost smallest 64-gram by hash, so equal windows have
equal anchors. Windows next to each other with one anchor form a region. Regions whose anchor occurs once hold no repeated
window. Of equal regions two are fetched, of others the one there is, and dealt by
anchor into shards of a few MB. Each shard's text gets a suffix array by induced sorting and permuted common prefixes; a
window repeats if it shares `width` bytes with its neighbour in the array. What is found for a region holds for all that equal it.
An anchor with very many distinct regions isn't dealt to one shard: its regions are looked at as texts of their own, with anchors of twice as many
bytes, and at last of whole windows, of which each has one region.

Nulls count as empty. Texts shorter than a window keep all bytes. Rows with equal id and text count as several occurrences each.
Columns besides the two named aren't read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import field_ddl, sliced, stored
from .induced import blocks, common_prefixes, suffix_array, those

WIDTH = 200
#: Bytes of a shard's text from which the next anchor begins another one.
SHARD_BYTES = 6 << 20
#: Distinct regions of one anchor beyond which they get longer anchors.
MOST_REGIONS = 2_000
#: Lists of at most so many numbers (4 bytes each) are broadcast; longer ones are joined by a shuffle.
MOST_BROADCAST = 4_000_000
#: Windows of a very long text that are looked at together.
CHUNK = 1 << 18

_LETTERS = np.random.default_rng(20240311).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def gram_hashes(raw: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every k bytes in a row, from prefix sums of letters times powers."""
    up, down = _powers(len(raw))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_LETTERS[raw] * up, out=sums[1:])
    h = (sums[k:] - sums[:-k]) * down[: len(raw) - k + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(_BASE)
    h ^= h >> np.uint64(32)
    return h


def _raw(text: str | bytes) -> bytes:
    return text if isinstance(text, bytes) else text.encode()


def anchors(raw: bytes, width: int, level: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Regions of a text: first window, number of windows, hash of the anchor, which has 8, 16 or all 25 of 25 parts of a window."""
    k = max(1, width * (8, 16, 25)[level] // 25)
    span = width - k + 1
    starts, sizes, hashes = [], [], []
    for at in range(0, max(0, len(raw) - width + 1), CHUNK):
        part = np.frombuffer(raw, np.uint8, min(CHUNK + width - 1, len(raw) - at), at)
        h = gram_hashes(part, k)
        # The hash's upper bits and the place in one number: the smallest is the leftmost smallest.
        keys = h >> np.uint64(20) << np.uint64(20) | np.arange(len(h), dtype=np.uint64)
        blocks = np.concatenate((keys, np.full(-len(keys) % span, np.uint64((1 << 64) - 1)))).reshape(-1, span)
        to_end = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
        from_start = np.minimum.accumulate(blocks, 1).ravel()
        n = len(h) - span + 1
        place = (np.minimum(to_end[:n], from_start[span - 1 : span - 1 + n]) & np.uint64((1 << 20) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        starts.append(first + at)
        sizes.append(np.diff(np.append(first, n)))
        hashes.append(h[place[first]])
    if not starts:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64)
    return np.concatenate(starts), np.concatenate(sizes), np.concatenate(hashes)


def _digests(raw: bytes, starts: np.ndarray, sizes: np.ndarray, width: int) -> np.ndarray:
    import xxhash

    of = xxhash.xxh64_intdigest
    ends = starts + sizes + (width - 1)
    return np.fromiter((of(raw[i:j]) for i, j in zip(starts.tolist(), ends.tolist())), np.uint64, len(starts))


def _regions(rows: DataFrame, width: int, level: int) -> DataFrame:
    """(id, th, start int, size int, anchor long, region long) for every region of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole):
                row, columns = [], [[], [], [], []]
                for k, text in enumerate(batch.column(2).to_pylist()):
                    raw = _raw(text)
                    if len(raw) < width:
                        continue
                    start, size, anchor = anchors(raw, width, level)
                    row.append(np.full(len(start), k))
                    for c, x in zip(columns, (start.astype(np.int32), size.astype(np.int32), anchor.view(np.int64), _digests(raw, start, size, width).view(np.int64))):
                        c.append(x)
                if row:
                    at = pa.array(np.concatenate(row))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *(pa.array(np.concatenate(c)) for c in columns)], ["id", "th", "start", "size", "anchor", "region"])

    return rows.mapInArrow(run, f"id {field_ddl(rows, 'id')}, th long, start int, size int, anchor long, region long")


def _fetched(rows: DataFrame, wanted: DataFrame, few: bool, width: int, level: int) -> DataFrame:
    """(anchor, region, again, hot, size, raw) of the wanted regions; wanted: (id, th, marks array<long>), a mark being 4 * start + 2 * hot + again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole, 4 << 20):
                out: list[list] = [[], [], [], [], [], []]
                for text, marks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    raw = _raw(text)
                    start, size, anchor = anchors(raw, width, level)
                    marks = np.unique(np.array(marks, np.int64))
                    at = np.searchsorted(start, marks >> 2)
                    start, size, anchor = start[at], size[at], anchor[at]
                    out[0] += anchor.view(np.int64).tolist()
                    out[1] += _digests(raw, start, size, width).view(np.int64).tolist()
                    out[2] += (marks & 1).astype(bool).tolist()
                    out[3] += (marks & 2).astype(bool).tolist()
                    out[4] += size.tolist()
                    out[5] += [raw[i:j] for i, j in zip(start.tolist(), (start + size + (width - 1)).tolist())]
                types = [pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int32(), pa.binary()]
                yield from sliced(pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], ["anchor", "region", "again", "hot", "size", "raw"]))

    met = rows.alias("d").join(F.broadcast(wanted).alias("w") if few else wanted.alias("w"), F.col("d.id").eqNullSafe(F.col("w.id")) & (F.col("d.th") == F.col("w.th")))
    return met.select("d.text", "w.marks").mapInArrow(run, "anchor long, region long, again boolean, hot boolean, size int, raw binary")


def _runs(flags: np.ndarray) -> np.ndarray:
    """From-to pairs of the runs of True."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return edges.astype(np.int32)


def _begun_alike(raw: np.ndarray, order: np.ndarray, begins: np.ndarray, ends: np.ndarray, width: int) -> np.ndarray:
    """Places whose window is known to repeat from a region's first window alone: where it shares more than a window with the one before it in the order,
    so do the windows after both, letter by letter less (the common prefixes' rule)."""
    first = np.zeros(len(raw), bool)
    first[begins] = True
    first[order[:1]] = False  # none is before it
    at = np.concatenate([np.flatnonzero(first[order[b]]) + b.start for b in blocks(len(order))])
    here, other = order[at].astype(np.int64), order[at - 1].astype(np.int64)
    end = lambda at: ends[np.searchsorted(ends, at)]
    upto = np.minimum(end(here) - here, end(other) - other)
    words = np.ndarray((len(raw),), "<u8", np.append(raw, np.zeros(8, np.uint8)), 0, (1,))
    shared, active, k = np.zeros(len(here), np.int64), np.arange(len(here)), 0
    while len(active := active[upto[active] >= k + 8]):
        active = active[words[here[active] + k] == words[other[active] + k]]
        k += 8
        shared[active] = k
    enough = shared >= width
    here, other, n = here[enough], other[enough], shared[enough] - width + 1
    edges = np.zeros(len(raw) + 1, np.int32)
    np.add.at(edges, np.concatenate((here, other)), 1)
    np.add.at(edges, np.concatenate((here + n, other + n)), -1)
    return np.cumsum(edges[:-1], out=edges[:-1]) > 0


def repeated_windows(raws: list[bytes], sizes: list[int], width: int) -> list[np.ndarray]:
    """For each region which of its windows also start elsewhere in these regions, by suffix array and common prefixes."""
    joined = b"".join(x + b"\0" for x in raws)  # a separator after each; no window reaches over one
    raw = np.frombuffer(joined, np.uint8)
    ends = np.cumsum([len(x) + 1 for x in raws])
    begins = ends - [len(x) + 1 for x in raws]
    text = np.zeros(len(raw) + 1, np.uint16)
    text[:-1] = raw
    text[:-1] += 2
    text[ends - 1] = 1
    array = suffix_array(text, 258)[1:]
    del text
    wanted = np.zeros(len(raw), bool)
    for b, n in zip(begins.tolist(), sizes):
        wanted[b : b + n] = True
    order = those(array, wanted)
    hit = _begun_alike(raw, order, begins, ends - 1, width)
    prefix = common_prefixes(raw, array, wanted, width, hit)
    as_before = np.concatenate([prefix[order[b]] >= width for b in blocks(len(order))])
    hit[order[as_before]] = True
    hit[order[:-1][as_before[1:]]] = True
    return [hit[b : b + n] for b, n in zip(begins.tolist(), sizes)]


def _sorted_shards(regions: DataFrame, width: int, parts: int) -> DataFrame:
    """(anchor, region, spans array<int>): runs of repeated windows in each region, of all that have one."""

    def finish(held: list[tuple]) -> pa.RecordBatch:
        hits = repeated_windows([x[4] for x in held], [x[3] for x in held], width)
        spans = [_runs(hit) for hit in hits]
        keep = [k for k, s in enumerate(spans) if len(s) and not held[k][2]]
        return pa.RecordBatch.from_arrays(
            [pa.array([held[k][0] for k in keep], pa.int64()), pa.array([held[k][1] for k in keep], pa.int64()), pa.array([spans[k] for k in keep], pa.list_(pa.int32()))], ["anchor", "region", "spans"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size >= SHARD_BYTES and row[0] != held[-1][0]:
                    yield finish(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield finish(held)

    dealt = regions.select("anchor", "region", "again", "size", "raw").repartition(parts, "anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(run, "anchor long, region long, spans array<int>")


def repeated_spans(rows: DataFrame, width: int, level: int = 0) -> DataFrame:
    """(id, th, cuts array<int>): from-to byte pairs of the maximal runs to remove, for texts (strings or binaries) that have any."""
    spark = rows.sparkSession
    found = stored(_regions(rows, width, level), "regions")
    often = stored(found.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor"), "often")
    few = often.count() <= MOST_BROADCAST // 2
    open_ = stored(found.join(F.broadcast(often) if few else often, "anchor", "left_semi"), "open")
    place = ("id", "th", "start")
    # Each of the two is one row's, since all its columns are taken together; they differ where there are several rows.
    ends = [f(c).alias(f"{name}_{c}") for name, f in (("first", F.first), ("last", F.last)) for c in place]
    distinct = stored(open_.groupBy("anchor", "region").agg(*ends, F.first("size").alias("size"), F.count("*").alias("copies")), "distinct")
    hot = distinct.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > MOST_REGIONS) if level < 2 else distinct.limit(0)
    hot = stored(hot.select("anchor", F.lit(2).alias("hot")), "hot")
    hot_ones = hot.count()
    twice = F.when(F.col("copies") > 1, 2).otherwise(1)
    total, windows = distinct.agg(F.coalesce(F.sum(twice), F.lit(0)), F.coalesce(F.sum(F.col("size") * twice), F.lit(0))).first()
    marked = distinct.join(hot, "anchor", "left")
    mark = lambda c, again: F.col(c).cast("long") * 4 + F.coalesce("hot", F.lit(0)) + again
    wanted = marked.select(F.col("first_id").alias("id"), F.col("first_th").alias("th"), mark("first_start", 0).alias("mark"))
    wanted = wanted.union(marked.filter("copies > 1").select("last_id", "last_th", mark("last_start", 1))).groupBy("id", "th").agg(F.collect_list("mark").alias("marks"))
    regions = _fetched(rows, wanted, total <= MOST_BROADCAST, width, level)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(windows + total * (width - 1)) // SHARD_BYTES))
    if hot_ones:
        regions = stored(regions, "fetched")
        texts = regions.filter("hot").select(F.col("anchor").alias("id"), F.col("region").alias("th"), F.col("raw").alias("text"))
        # Bytes from i to j are covered by repeated windows; all windows in between cover the same bytes.
        inner = repeated_spans(texts, width, level + 1).select(F.col("id").alias("anchor"), F.col("th").alias("region"), F.transform("cuts", lambda x, k: F.when(k % 2 == 1, x - (width - 1)).otherwise(x)).alias("spans"))
        verdicts = _sorted_shards(regions.filter("not hot"), width, parts).union(inner)
    else:
        verdicts = _sorted_shards(regions, width, parts)
    verdicts = stored(verdicts, "verdicts")

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts = []
            for starts, spans in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                starts = np.repeat(starts, [len(s) // 2 for s in spans])
                pairs = np.concatenate([np.array(s, np.int64) for s in spans]).reshape(-1, 2)
                begins, ends = pairs[:, 0] + starts, pairs[:, 1] + starts + (width - 1)
                order = np.argsort(begins, kind="stable")
                begins, ends = begins[order], np.maximum.accumulate(ends[order])
                new = np.append(True, begins[1:] > ends[:-1])
                last = np.append(new[1:], True)
                cuts.append(np.stack((begins[new], ends[last]), 1).ravel().astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cuts, pa.list_(pa.int32()))], ["id", "th", "cuts"])

    hits = open_.join(verdicts, ["anchor", "region"]).groupBy("id", "th").agg(F.collect_list(F.struct("start", "spans")).alias("s"))
    return hits.select("id", "th", "s.start", "s.spans").mapInArrow(merged, f"id {field_ddl(rows, 'id')}, th long, cuts array<int>")


def _aligned(raw: bytes, cut: list[int]) -> list[int]:
    """The cuts without characters at their ends that they cover in part."""
    found: list[int] = []
    for i, j in zip(cut[::2], cut[1::2]):
        while i < j and raw[i] & 0xC0 == 0x80:
            i += 1
        while j > i and j < len(raw) and raw[j] & 0xC0 == 0x80:
            j -= 1
        found += [i, j] if i < j else []
    return found


def without_repeats(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, cuts array<int>, kept binary) per row."""
    return _cut(docs, width, id_col, text_col, (), False).select(F.col("id").alias(id_col), "n_bytes", "n_removed", "n_spans", "cuts", "kept")


def deduplicated(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with what is left as their text, all other columns as they are.

    Characters of which only some bytes would go are left, so that the text is valid UTF-8. Null texts become empty.
    """
    others = tuple(c for c in docs.columns if c not in (id_col, text_col))
    found = {id_col: F.col("id"), text_col: F.col("kept").cast("string")} | {c: F.col(f"keep_{k}") for k, c in enumerate(others)}
    return _cut(docs, width, id_col, text_col, others, True).select(*[found[c].alias(c) for c in docs.columns])


def _cut(docs: DataFrame, width: int, id_col: str, text_col: str, keep: tuple[str, ...], whole_characters: bool) -> DataFrame:
    """(id, cuts, keep_0, .., n_bytes, n_removed, n_spans, kept binary) per row."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *[F.col(f"`{c}`").alias(f"keep_{k}") for k, c in enumerate(keep)])
    rows = rows.withColumn("th", F.xxhash64("text"))
    cuts = stored(repeated_spans(rows.select("id", "th", "text"), width), "cuts")
    few = (cuts.agg(F.coalesce(F.sum(F.size("cuts") + 6), F.lit(0))).first()[0]) <= MOST_BROADCAST
    extra = [c for c in rows.columns if c.startswith("keep_")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole):
                n_bytes, n_removed, n_spans, kept = [], [], [], []
                for text, cut in zip(batch.column("text").to_pylist(), batch.column("cuts").to_pylist()):
                    raw = text.encode()
                    cut = _aligned(raw, cut) if cut and whole_characters else cut
                    ends = [0, *(cut or ()), len(raw)]
                    left = b"".join([raw[i:j] for i, j in zip(ends[::2], ends[1::2])])
                    n_bytes.append(len(raw))
                    n_removed.append(len(raw) - len(left))
                    n_spans.append(len(cut or ()) // 2)
                    kept.append(left)
                same = [batch.column(c) for c in ("id", "cuts", *extra)]
                yield pa.RecordBatch.from_arrays([*same, *(pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans)), pa.array(kept, pa.binary())], ["id", "cuts", *extra, "n_bytes", "n_removed", "n_spans", "kept"])

    met = rows.alias("d").join(F.broadcast(cuts).alias("c") if few else cuts.alias("c"), F.col("d.id").eqNullSafe(F.col("c.id")) & (F.col("d.th") == F.col("c.th")), "left")
    schema = f"id {field_ddl(rows, 'id')}, cuts array<int>, " + "".join(f"{c} {field_ddl(rows, c)}, " for c in extra) + "n_bytes long, n_removed long, n_spans long, kept binary"
    return met.select("d.id", "c.cuts", *[f"d.{c}" for c in extra], "d.text").mapInArrow(run, schema)
