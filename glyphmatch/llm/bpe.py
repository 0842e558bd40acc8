"""Byte-level BPE encoding and decoding through a sentencepiece model built from a rank file.

The rank file is turned into a serialised sentencepiece BPE model: every token's bytes are mapped to printable
characters, the score of a piece is its negative rank, and normalisation is the identity. sentencepiece then
merges the pair of the highest score first, leftmost on ties, which is the order of the ranks. Decoding is the
inverse mapping from id to bytes.

A text falls apart into independent units at a space that follows a non-space character, since no pre-token
reaches over such a place; units are encoded once per worker and looked up after that.

Null texts count as empty and give no ids. Repeated rows, ties and columns besides the two named are no concern;
other columns aren't read. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import field_ddl, sliced

#: Units that a worker remembers before it starts anew; a bound on memory, not on results.
REMEMBERED = 800_000
#: Longer units are encoded each time they occur.
LONGEST_REMEMBERED = 256


def read_ranks(content: bytes) -> list[bytes]:
    """Tokens by rank from a rank file: a base64 token and its rank on each line."""
    pairs = [line.split() for line in content.splitlines() if line.strip()]
    tokens: list[bytes] = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


def byte_characters() -> list[str]:
    """A printable character for each byte: visible Latin-1 characters stand for themselves, others follow from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    found = {b: chr(b) for b in visible}
    for b in range(256):
        found.setdefault(b, chr(256 + len(found) - len(visible)))
    return [found[b] for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _message(field: int, content: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(content)) + content


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n & (1 << 64) - 1)


def serialise_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece model (protobuf wire format): piece k is token k with score -k; the unknown piece comes last.

    Fixed values of the format: ModelProto pieces 1, trainer_spec 2, normalizer_spec 3; SentencePiece piece 1,
    score 2, type 3 (normal 1, unknown 2); TrainerSpec model_type 3 (BPE 2), vocab_size 4, unk_id 40, bos_id 41,
    eos_id 42, pad_id 43; NormalizerSpec name 1, add_dummy_prefix 3, remove_extra_whitespaces 4, escape_whitespaces 5.
    """
    chars = byte_characters()
    parts = [
        _message(1, _message(1, "".join(chars[b] for b in token).encode()) + _varint(2 << 3 | 5) + struct.pack("<f", -float(rank)) + _number(3, 1))
        for rank, token in enumerate(tokens)
    ]
    parts.append(_message(1, _message(1, b"<unk>") + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _number(3, 2)))
    parts.append(_message(2, _number(3, 2) + _number(4, len(tokens) + 1) + _number(40, len(tokens)) + _number(41, -1) + _number(42, -1) + _number(43, -1)))
    parts.append(_message(3, _message(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)))
    return b"".join(parts)


def _known_pattern() -> str | None:
    """The pattern of which it is known that no match reaches over a space that follows another character; texts are cut there for it alone."""
    try:
        from public_tokenizers import PATTERN
    except ImportError:
        return None
    return PATTERN


class _Units(dict):
    """Unit -> its ids as little-endian int32 bytes, made on first sight."""

    def __init__(self, codec: Codec):
        self.codec = codec

    def __missing__(self, unit: str) -> bytes:
        ids = self.codec.encode_unit(unit)
        if len(unit) <= LONGEST_REMEMBERED:
            self[unit] = ids
        return ids


class Codec:
    """Encoder and decoder for one rank file and pre-token pattern."""

    def __init__(self, tokens: list[bytes], model: bytes, pattern: str):
        import regex
        import sentencepiece

        self.tokens = tokens
        self.piece_ids = {token: rank for rank, token in enumerate(tokens)}
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.chars = byte_characters()
        self.table = {b: self.chars[b] for b in range(256)}
        self.pretoken = regex.compile(pattern)
        self.by_spaces = pattern == _known_pattern()
        self.boundary = regex.compile(r"(?<![\s\x1c-\x1f\x85]) ")
        self.odd = regex.compile(r"[\s\x1c-\x1f\x85] ")
        self.units = _Units(self)
        self.sizes = np.array([len(t) for t in tokens], np.int64)

    def encode_pretoken(self, piece: bytes) -> list[int]:
        whole = self.piece_ids.get(piece)
        if whole is not None:
            return [whole]
        return self.processor.encode(piece.decode("latin-1").translate(self.table), num_threads=1)

    def encode_unit(self, unit: str) -> bytes:
        ids: list[int] = []
        for match in self.pretoken.finditer(unit):
            ids += self.encode_pretoken(match.group().encode())
        return np.array(ids, "<i4").tobytes()

    def split(self, text: str) -> list[str]:
        """Units that concatenate to the text; a unit but the first starts with a space after a non-space character."""
        if not self.odd.search(text) and text[:1] != " ":
            first, *rest = text.split(" ")
            return [first, *[" " + x for x in rest]]
        at = [0, *(m.start() for m in self.boundary.finditer(text) if m.start()), len(text)]
        return [text[i:j] for i, j in zip(at, at[1:])]

    def encode(self, text: str) -> bytes:
        if not self.by_spaces:
            return self.encode_unit(text)
        if len(self.units) > REMEMBERED:
            self.units.clear()
        return b"".join(map(self.units.__getitem__, self.split(text))) if text else b""

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


_CODECS: dict[tuple[int, int, str], Codec] = {}


def _codec(content: bytes, pattern: str) -> Codec:
    key = (len(content), hash(content), pattern)
    if key not in _CODECS:
        tokens = read_ranks(content)
        _CODECS[key] = Codec(tokens, serialise_model(tokens), pattern)
    return _CODECS[key]


def _content(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) for every row: the token ids of the whole text.

    The rank file is read on the driver; its bytes (a fixed size, set by the vocabulary) are broadcast.
    """
    content = docs.sparkSession.sparkContext.broadcast(_content(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(content.value, pattern)
        for whole in batches:
            for batch in sliced(whole):
                encoded = [codec.encode(x) if x else b"" for x in batch.column(1).to_pylist()]
                offsets = np.zeros(len(encoded) + 1, np.int64)
                np.cumsum([len(x) // 4 for x in encoded], out=offsets[1:])
                values = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(encoded))])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)], ["id", "ids"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {field_ddl(docs, id_col)}, ids array<int>").select(F.col("id").alias(id_col), "ids")


def decode(encoded: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, ids, decoded binary): the bytes that the ids stand for. A null array counts as empty."""
    content = encoded.sparkSession.sparkContext.broadcast(_content(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(content.value, pattern)
        for whole in batches:
            for batch in sliced(whole):
                lists = batch.column(1)
                values, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
                decoded = [codec.decode(values[i:j]) for i, j in zip(offsets[:-1], offsets[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(decoded, pa.binary())], ["id", "ids", "decoded"])

    rows = encoded.select(F.col(id_col).alias("id"), F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("ids"))
    schema = f"id {field_ddl(encoded, id_col)}, ids array<int>, decoded binary"
    return rows.mapInArrow(run, schema).select(F.col("id").alias(id_col), "ids", "decoded")
