"""Toxicity scores by a convolutional text classifier that is trained here in numpy.

A word's vector is the mean of hashed embeddings of the word and of its first and last bytes. Filters of several widths run over the word vectors
of the whole text; the largest value of each filter, through a rectifier, enters a logistic output. Training is by Adagrad on a bounded
sample of labelled rows (`SAMPLE` rows at most, up to half of them toxic, chosen by a hash of the id, whole texts), each class weighted to its share among all labelled rows when the output is scaled; a fifth of the sample is kept
apart to scale the output and to choose a threshold for each language (at least `LEAST_POSITIVE` toxic rows, else the threshold of all). The score depends on the text alone.

Null and empty texts are scored as a text without words. Repeated rows get equal scores. Labels of rows that aren't in the
table, and null labels, are left out; with one class only, every score is that class's share. An empty table gives an
empty result; columns besides those named aren't read.
"""

from __future__ import annotations

import hashlib
import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import field_ddl, sliced

#: Labelled rows that the classifier is fitted on at most.
SAMPLE = 8_000
#: Bytes of the texts that the classifier is fitted on, at most.
SAMPLE_BYTES = 200_000_000
LEAST_POSITIVE = 20
BUCKETS, SIZE, FILTERS, WIDTHS = 1 << 17, 12, 8, (1, 2, 3)
#: Bytes at a word's start and end that are pieces of it.
FIRST, LAST = (3, 4, 5, 6), (3, 4)
#: Steps of training, each over a batch of texts.
STEPS, BATCH, RATE = 800, 64, 0.08
REMEMBERED = 250_000
#: Words of a very long text that are looked at together.
CHUNK = 16_384

_COLUMNS = sum(WIDTHS) * FILTERS
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_MARKS = b" .,;:!?\"'()[]{}<>|*#$%&-_"


def plain(word: bytes) -> bytes:
    return word.strip(_MARKS) or word[:1]


def pieces(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word's pieces, one word after the other, and the number of pieces of each."""
    found = []
    for w in words:
        found.append(w)
        found += [b"<%d" % n + w[:n] for n in FIRST if n < len(w)]
        found += [b">%d" % n + w[-n:] for n in LAST if n < len(w)]
    sizes = np.array([1 + sum(n < len(w) for n in (*FIRST, *LAST)) for w in words])
    return np.fromiter(map(zlib.crc32, found), np.int64, len(found)) % BUCKETS, sizes


@dataclass
class Model:
    embeddings: np.ndarray  # BUCKETS x SIZE
    filters: np.ndarray  # SIZE x _COLUMNS; the columns of a width's taps follow each other
    bias: np.ndarray  # by filter
    out: np.ndarray  # by filter
    out_bias: float
    scale: tuple[float, float] = (1.0, 0.0)

    def vectors(self, words: list[bytes]) -> np.ndarray:
        at, counts = pieces(words)
        starts = np.append(0, np.cumsum(counts)[:-1])
        return np.add.reduceat(self.embeddings[at], starts) / counts[:, None].astype(np.float32)

    def logit(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled + self.bias, 0) @ self.out + self.out_bias

    def score(self, pooled: np.ndarray) -> np.ndarray:
        z = self.scale[0] * self.logit(pooled) + self.scale[1]
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _responses(taps: np.ndarray) -> list[np.ndarray]:
    """By width: the filters' values at each place; taps: rows of _COLUMNS for the words, with max(WIDTHS) - 1 rows of padding at the end."""
    n, at, found = len(taps) - max(WIDTHS) + 1, 0, []
    for width in WIDTHS:
        total = taps[:n, at : at + FILTERS]
        for k in range(1, width):
            total = total + taps[k : n + k, at + k * FILTERS : at + (k + 1) * FILTERS]
        at += width * FILTERS
        found.append(total)
    return found


class Scorer:
    """Scores texts; a word's filter values are computed once and looked up after that."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.rows: dict[bytes, int] = {}
        self.taps = np.zeros((1024, _COLUMNS), np.float32)  # row 0 is padding
        self.used = 1
        self.plain: dict[bytes, int] = {}

    def learn(self, words: set[bytes]) -> None:
        by_word = {w: plain(w) for w in words}
        new = list(set(by_word.values()) - self.plain.keys())
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            values = self.model.vectors(part) @ self.model.filters
            while self.used + len(part) > len(self.taps):
                self.taps = np.concatenate((self.taps, np.zeros_like(self.taps)))
            self.taps[self.used : self.used + len(part)] = values
            self.plain.update(zip(part, range(self.used, self.used + len(part))))
            self.used += len(part)
        self.rows.update((w, self.plain[p]) for w, p in by_word.items())

    def pooled(self, texts: list[str]) -> np.ndarray:
        if len(self.rows) > REMEMBERED:
            self.clear()
        split = [t.encode().translate(_LOWER).split() for t in texts]
        self.learn({w for words in split for w in words} - self.rows.keys())
        found = np.zeros((len(texts), len(WIDTHS) * FILTERS), np.float32)
        pad = max(WIDTHS) - 1
        for k, words in enumerate(split):
            ids = np.zeros(max(1, len(words)) + pad, np.int64)
            ids[: len(words)] = np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))
            best = None
            for at in range(0, len(ids) - pad, CHUNK):
                top = np.concatenate([r.max(0) for r in _responses(self.taps[ids[at : at + CHUNK + pad]])])
                best = top if best is None else np.maximum(best, top)
            found[k] = best
        return found

    def score(self, texts: list[str]) -> np.ndarray:
        return self.model.score(self.pooled(texts))


def train(texts: list[str], labels: np.ndarray, seed: int = 7) -> Model:
    rng = np.random.default_rng(seed)
    n_filters = len(WIDTHS) * FILTERS
    model = Model(
        rng.normal(0, 0.5, (BUCKETS, SIZE)).astype(np.float32),
        rng.normal(0, 0.3, (SIZE, _COLUMNS)).astype(np.float32),
        np.zeros(n_filters, np.float32),
        rng.normal(0, 0.3, n_filters).astype(np.float32),
        float(np.log((labels.mean() + 1e-3) / (1 - labels.mean() + 1e-3))),
    )
    words: dict[bytes, int] = {}
    docs = []
    for text in texts:
        docs.append(np.array([words.setdefault(plain(w), len(words)) for w in text.encode().translate(_LOWER).split()], np.int64))
    if not words:
        return model
    heavier = min(5.0, max(1.0, float((labels == 0).sum() / max(1, (labels > 0).sum()))))  # the rarer class counts more
    all_pieces, counts = pieces(list(words))
    begins = np.append(0, np.cumsum(counts))
    sums = {name: np.full_like(getattr(model, name), 1e-6) for name in ("embeddings", "filters", "bias", "out")}
    sum_out_bias, pad = 1e-6, max(WIDTHS) - 1
    for _ in range(-(-STEPS * BATCH // len(docs))):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), BATCH):
            chosen = order[at : at + BATCH]
            y = labels[chosen].astype(np.float32)
            vocabulary, where = np.unique(np.concatenate([docs[k] for k in chosen]), return_inverse=True)
            sizes = counts[vocabulary]
            starts = np.append(0, np.cumsum(sizes))
            own = np.repeat(begins[vocabulary] - starts[:-1], sizes) + np.arange(starts[-1])
            buckets = all_pieces[own]
            vectors = np.zeros((len(vocabulary) + 1, SIZE), np.float32)  # the last row is padding
            if len(vocabulary):
                vectors[:-1] = np.add.reduceat(model.embeddings[buckets], starts[:-1]) / sizes[:, None].astype(np.float32)
            taps = vectors @ model.filters
            pooled, places, done = np.zeros((len(chosen), n_filters), np.float32), [], 0
            for k, d in enumerate(chosen):
                n = len(docs[d])
                ids = np.full(max(1, n) + pad, len(vocabulary))
                ids[:n] = where[done : done + n]
                done += n
                responses = _responses(taps[ids])
                best = [r.argmax(0) for r in responses]
                pooled[k] = np.concatenate([r[b, np.arange(FILTERS)] for r, b in zip(responses, best)])
                places.append((ids, best))
            active = pooled + model.bias
            hidden = np.maximum(active, 0)
            p = 1 / (1 + np.exp(-np.clip(hidden @ model.out + model.out_bias, -30, 30)))
            error = np.where(y > 0, heavier, 1.0).astype(np.float32) * (p - y) / len(chosen)
            to_hidden = error[:, None] * model.out * (active > 0)
            to_vectors, to_filters = np.zeros_like(vectors), np.zeros_like(model.filters)
            for k, (ids, best) in enumerate(places):
                column = 0
                for w, width in enumerate(WIDTHS):
                    g = to_hidden[k, w * FILTERS : (w + 1) * FILTERS]
                    for j in range(width):
                        rows = ids[best[w] + j]
                        cols = slice(column + j * FILTERS, column + (j + 1) * FILTERS)
                        to_filters[:, cols] += vectors[rows].T * g
                        np.add.at(to_vectors, rows, (model.filters[:, cols] * g).T)
                    column += width * FILTERS
            touched = np.flatnonzero(to_vectors[:-1].any(1))
            if len(touched):
                spans = np.concatenate([buckets[starts[t] : starts[t + 1]] for t in touched])
                share = np.repeat(to_vectors[touched] / sizes[touched][:, None], sizes[touched], 0)
                rows, inverse = np.unique(spans, return_inverse=True)
                g = np.zeros((len(rows), SIZE), np.float32)
                np.add.at(g, inverse, share)
                sums["embeddings"][rows] += g * g
                model.embeddings[rows] -= RATE * g / np.sqrt(sums["embeddings"][rows])
            for name, g in (("filters", to_filters), ("bias", to_hidden.sum(0)), ("out", hidden.T @ error)):
                sums[name] += g * g
                getattr(model, name)[...] -= RATE * g / np.sqrt(sums[name])
            sum_out_bias += float(error.sum()) ** 2
            model.out_bias -= RATE * float(error.sum()) / sum_out_bias**0.5
    return model


def _scaled(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a weighted logistic fit of labels on outputs: the slope by least loss with a prior towards 1, the offset by bisection."""
    best = (np.inf, 1.0, 0.0)
    wanted = float(weight @ y) + 1e-3
    for slope in (0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0):
        low, high = -60.0, 60.0
        for _ in range(60):
            offset = (low + high) / 2
            p = 1 / (1 + np.exp(-np.clip(slope * z + offset, -30, 30)))
            low, high = (offset, high) if weight @ p < wanted else (low, offset)
        loss = -(weight * (y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))).sum() + np.log(slope) ** 2
        best = min(best, (float(loss), slope, offset))
    return best[1], best[2]


def _best_threshold(score: np.ndarray, y: np.ndarray) -> float:
    """The middle of the widest range of cuts with the best F1."""
    order = np.argsort(-score)
    s, hits = score[order], np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(s) + 1) + y.sum())
    k = int(np.flatnonzero(f1 >= f1.max() - 1e-12)[-1])
    return float((s[k] + s[k + 1]) / 2) if k + 1 < len(s) else float(s[k])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", lang_col: str = "lang") -> tuple[Model, dict[str | None, float]]:
    """The model and the thresholds by language (None: all), from the documents of at most `sample` of the labels.

    The sample's ids are chosen from the labels alone and broadcast (at most `sample` rows), so no text is shuffled. Their texts come to the driver, at most
    SAMPLE_BYTES of them; where they are more, documents that no longer fit are left out whole.
    """
    spark = docs.sparkSession
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    known = known.select(F.col(id_col).alias("id"), (F.col(label_col) > 0).cast("int").alias("y"), F.xxhash64(F.col(id_col).cast("string")).alias("h"))
    total = {bool(r[0]): r[1] for r in known.groupBy("y").count().collect()}
    most = {True: min(total.get(True, 0), max(sample // 2, sample - total.get(False, 0)))}
    most[False] = min(total.get(False, 0), sample - most[True])
    chosen = [(r.id, r.y, r.h) for kind in (True, False) for r in known.filter(F.col("y") == int(kind)).orderBy("h", "id").limit(most[kind]).collect()]
    ids = spark.createDataFrame(chosen, f"id {field_ddl(known, 'id')}, y int, h long")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    met = rows.join(F.broadcast(ids), "id")
    sizes = sorted((r.h, r.id, r.n) for r in met.select("h", "id", F.octet_length("text").alias("n")).collect())
    if sum(n for *_, n in sizes) > SAMPLE_BYTES:
        # By their hashes' order the documents that still fit; whole texts, as many as the bound has room for.
        room, kept = SAMPLE_BYTES, set()
        for h, id_, n in sizes:
            if n <= room:
                room -= n
                kept.add(id_)
        met = rows.join(F.broadcast(spark.createDataFrame([c for c in chosen if c[0] in kept], ids.schema)), "id")
    taken = [(r.h, r.text, r.y, r.lang) for r in met.collect()]
    taken.sort(key=lambda r: (r[0], r[1], r[2]))
    texts, y, langs = [r[1] for r in taken], np.array([int(r[2] > 0) for r in taken], np.int64), [r[3] for r in taken]
    apart = np.arange(len(texts)) % 5 == 4
    model = train([t for t, a in zip(texts, apart) if not a], y[~apart]) if (~apart).any() else train([], np.zeros(1))
    if not 0 < y.sum() < len(y):
        share = float(y.mean()) if len(y) else 0.0
        model.scale = (0.0, float(np.log((share + 1e-6) / (1 - share + 1e-6))))
        return model, {None: 0.5}
    scorer = Scorer(model)
    pooled = scorer.pooled([t for t, a in zip(texts, apart) if a])
    weight = np.where(y[apart] > 0, total.get(True, 0) / max(1, most[True]), total.get(False, 0) / max(1, most[False]))
    model.scale = _scaled(model.logit(pooled).astype(float), y[apart], weight / weight.mean())
    score, held = model.score(pooled), y[apart]
    thresholds: dict[str | None, float] = {None: _best_threshold(score, held) if held.any() else 0.5}
    by_lang = np.array([x or "" for x, a in zip(langs, apart) if a])
    for lang in set(by_lang.tolist()) - {""}:
        if held[by_lang == lang].sum() >= LEAST_POSITIVE:
            thresholds[lang] = _best_threshold(score[by_lang == lang], held[by_lang == lang])
    return model, thresholds


_SCORERS: dict[str, Scorer] = {}


def scored(docs: DataFrame, model: Model, thresholds: dict[str | None, float], id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, score, toxic): toxic by the threshold of the row's language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is set by BUCKETS and SIZE: 6 MB
    mark = hashlib.sha256(pickle.dumps(model)).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if mark not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[mark] = Scorer(shared.value)
        for whole in batches:
            for batch in sliced(whole, 2 << 20):
                score = _SCORERS[mark].score([x or "" for x in batch.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(score.astype(float))], ["id", "lang", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    out = rows.mapInArrow(run, f"id {field_ddl(docs, id_col)}, lang string, score double")
    cut = F.lit(thresholds[None])
    for lang, value in thresholds.items():
        if lang is not None:
            cut = F.when(F.col("lang") == lang, value).otherwise(cut)
    return out.select(F.col("id").alias(id_col), "score", (F.col("score") >= cut).alias("toxic"))


def held_out(id_col: Column) -> Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))
