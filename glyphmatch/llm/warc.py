"""WARC archives as a PySpark data source, with identical-payload revisits.

Writing: one file per task, a gzip member per record, a manifest that lists only the files of successful tasks, so
that failed or repeated attempts leave nothing that is read. Beside each file lies an index of its members' sizes.

Reading: partitions are runs of whole members of about `split_bytes`, planned from the manifest (files without one
are read whole). Filters on record_type, record_id, target_uri, refers_to and payload_digest are pushed into
the reader, which inflates a record's head first; the rest of a record that a filter rejects, or whose payload
isn't in the requested schema, isn't inflated where the index gives the member's size.

Archive rows: record_id, record_type, target_uri, refers_to, payload_digest (bare upper-case base32 SHA-1), payload_bytes long
(length of the full payload, for revisits that of the response referred to), payload binary (null for revisits).
Null payloads are stored as empty, null uris are left out and read back as null; line breaks in header values are percent-encoded.
Repeated rows give a record each; an empty table gives archives without records.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

SCHEMA = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"
_ARROW = {"record_id": pa.string(), "record_type": pa.string(), "target_uri": pa.string(), "refers_to": pa.string(), "payload_digest": pa.string(), "payload_bytes": pa.int64(), "payload": pa.binary()}
_FILTERED = {"record_id", "record_type", "target_uri", "refers_to", "payload_digest"}
#: Fixed values of the format.
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "1970-01-01T00:00:00Z"
_MANIFEST = "_manifest.json"
_BATCH_BYTES = 8 << 20


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value: str) -> str:
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if "\r" in value or "\n" in value or "%" in value else value


def _raw(value: str) -> str:
    return value.replace("%0D", "\r").replace("%0A", "\n").replace("%25", "%") if "%" in value else value


def record_bytes(row: dict) -> bytes:
    """One record, not compressed. A revisit carries the HTTP head of its capture, with the full payload's length, and no payload."""
    revisit = row["record_type"] == "revisit"
    payload = row["payload"] or b""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {row['record_type']}",
        f"WARC-Record-ID: <{_clean(row['record_id'] or '')}>",
        f"WARC-Date: {_DATE}",
        *([f"WARC-Target-URI: {_clean(row['target_uri'])}"] if row["target_uri"] is not None else []),
        *([f"WARC-Refers-To: <{_clean(row['refers_to'] or '')}>", f"WARC-Profile: {_PROFILE}"] if revisit else []),
        f"WARC-Payload-Digest: sha1:{row['payload_digest']}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    found = {}
    for line in lines[1:]:
        name, _, value = line.partition(":")
        found[name.strip().lower()] = value.strip()
    return found


class Store:
    """Files under a path or URI, through pyarrow's file systems: local, HDFS and object stores alike."""

    def __init__(self, path: str):
        from pyarrow import fs

        if "://" in path or path.startswith("file:"):
            if path.startswith("file:"):
                path = "file://" + path.removeprefix("file:").removeprefix("//")
            self.fs, self.root = fs.FileSystem.from_uri(path)
        else:
            self.fs, self.root = fs.LocalFileSystem(), path

    def path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}" if name else self.root

    def make(self) -> None:
        self.fs.create_dir(self.root, recursive=True)

    def write(self, name: str):
        return self.fs.open_output_stream(self.path(name), compression=None)

    def read(self, name: str) -> bytes:
        with self.fs.open_input_stream(self.path(name), compression=None) as f:
            return f.read()

    def open(self, name: str):
        return self.fs.open_input_file(self.path(name))

    def names(self) -> list[str]:
        from pyarrow import fs

        found = self.fs.get_file_info(fs.FileSelector(self.root, recursive=False))
        return sorted(x.base_name for x in found if x.is_file)

    def delete(self, name: str) -> None:
        self.fs.delete_file(self.path(name))

    def rename(self, name: str, to: str) -> None:
        self.fs.move(self.path(name), self.path(to))


@dataclass
class Written(WriterCommitMessage):
    name: str
    splits: list  # (first byte, end byte, first member)
    records: int


@dataclass
class Run(InputPartition):
    name: str
    first: int
    end: int | None  # None: the file has no index
    member: int = 0


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.level, self.split = options["path"], int(options.get("level", 1)), int(options.get("split_bytes", 8 << 20))
        self.overwrite = overwrite
        Store(self.path).make()

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, name = Store(self.path), f"part-{uuid.uuid4().hex}.warc.gz"
        at, opened, splits, sizes = 0, 0, [], []
        with store.write(name) as out:
            for batch in iterator:
                for k in range(batch.num_rows):
                    row = batch.slice(k, 1).to_pylist()[0]
                    packer = zlib.compressobj(self.level, zlib.DEFLATED, 31)
                    member = packer.compress(record_bytes(row)) + packer.flush()
                    out.write(member)
                    sizes.append(len(member))
                    at += len(member)
                    if at - opened >= self.split:
                        splits.append((opened, at, len(sizes)))
                        opened = at
        if at > opened:
            splits.append((opened, at, len(sizes)))
        firsts = [0, *(x[2] for x in splits)]
        with store.write(f"{name}.idx") as out:
            import numpy as np

            out.write(np.array(sizes, "<u8").tobytes())
        return Written(name, [(a, b, firsts[k]) for k, (a, b, _) in enumerate(splits)], len(sizes))

    def commit(self, messages: list) -> None:
        store = Store(self.path)
        before = _manifest(store)
        files = [] if self.overwrite else before[:]
        files += [{"name": m.name, "splits": m.splits, "records": m.records} for m in messages if m is not None]
        # Whole under another name first: a reader finds the old manifest or the new one.
        with store.write(f"{_MANIFEST}.new") as out:
            out.write(json.dumps(files).encode())
        store.rename(f"{_MANIFEST}.new", _MANIFEST)
        for old in before if self.overwrite else ():
            store.delete(old["name"])
            store.delete(f"{old['name']}.idx")

    def abort(self, messages: list) -> None:
        store = Store(self.path)
        for m in messages:
            if m is not None:
                store.delete(m.name)
                store.delete(f"{m.name}.idx")


def _manifest(store: Store) -> list[dict]:
    return json.loads(store.read(_MANIFEST)) if _MANIFEST in store.names() else []


class WarcReader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.path = options["path"]
        self.columns = schema.fieldNames()
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and f.attribute[0] in _FILTERED:
                values = {f.value}
            elif isinstance(f, In) and len(f.attribute) == 1 and f.attribute[0] in _FILTERED:
                values = set(f.value)
            else:
                yield f
                continue
            name = f.attribute[0]
            self.wanted[name] = self.wanted.get(name, values) & values

    def partitions(self) -> list[Run]:
        store = Store(self.path)
        names = store.names()
        if _MANIFEST not in names:
            found = [Run(x, 0, None) for x in names if x.endswith((".warc", ".warc.gz"))]
        else:
            found = [Run(x["name"], a, b, member) for x in _manifest(store) for a, b, member in x["splits"]]
        return found or [Run("", 0, 0)]

    def read(self, partition: Run) -> Iterator[pa.RecordBatch]:
        held, size = {c: [] for c in self.columns}, 0
        schema = pa.schema([(c, _ARROW[c]) for c in self.columns])
        if partition.name:
            for row in self.records(partition):
                for c in self.columns:
                    held[c].append(row[c])
                size += 200 + len(row["payload"] or b"")
                if size >= _BATCH_BYTES:
                    yield pa.RecordBatch.from_pydict(held, schema)
                    held, size = {c: [] for c in self.columns}, 0
        if held[self.columns[0]]:
            yield pa.RecordBatch.from_pydict(held, schema)

    def records(self, run: Run) -> Iterator[dict]:
        store = Store(self.path)
        if run.end is None:
            yield from self.foreign(store, run.name)
            return
        import numpy as np

        sizes = np.frombuffer(store.read(f"{run.name}.idx"), "<u8")[run.member :]
        with store.open(run.name) as f:
            f.seek(run.first)
            at = run.first
            for n in map(int, sizes):
                if at >= run.end:
                    return
                at += n
                packed = f.read(n)
                inflater = zlib.decompressobj(31)
                start, rest = b"", packed
                while b"\r\n\r\n" not in start and rest:
                    start += inflater.decompress(rest, 1024)
                    rest = inflater.unconsumed_tail
                head, _, body = start.partition(b"\r\n\r\n")
                row = self.judged(parse_head(head))
                if row is None:
                    continue
                if self.needs_body(row):
                    body += inflater.decompress(rest)
                    yield self.filled(row, body)
                else:
                    yield row

    def foreign(self, store: Store, name: str) -> Iterator[dict]:
        """Records of a file that this writer didn't write: read on from member to member, in blocks."""
        with store.open(name) as f:
            plain = _Inflated(f) if name.endswith(".gz") else f
            buffer = b""
            while True:
                while b"\r\n\r\n" not in buffer.lstrip(b"\r\n"):
                    block = plain.read(1 << 16)
                    if not block:
                        return
                    buffer += block
                head, _, buffer = buffer.lstrip(b"\r\n").partition(b"\r\n\r\n")
                fields = parse_head(head)
                length = int(fields.get("content-length", 0))
                row = self.judged(fields)
                wants = row is not None and self.needs_body(row)
                parts, missing = [buffer[:length]], length - len(buffer)
                buffer = buffer[length:]
                if missing > 0 and not wants and plain is f:
                    f.seek(f.tell() + missing)
                else:
                    while missing > 0:
                        block = plain.read(min(missing, 1 << 16))
                        if not block:
                            raise ValueError(f"{name} ends within a record")
                        missing -= len(block)
                        if wants:
                            parts.append(block)
                if wants:
                    yield self.filled(row, b"".join(parts))
                elif row is not None:
                    yield row

    def judged(self, fields: dict[str, str]) -> dict | None:
        """The row as far as the head tells, or None if a pushed filter rejects it."""
        row = {
            "record_id": _raw(fields.get("warc-record-id", "").strip("<>")),
            "record_type": fields.get("warc-type"),
            "target_uri": _raw(fields["warc-target-uri"]) if "warc-target-uri" in fields else None,
            "refers_to": _raw(fields["warc-refers-to"].strip("<>")) if "warc-refers-to" in fields else None,
            "payload_digest": fields["warc-payload-digest"].partition(":")[2] if "warc-payload-digest" in fields else None,
            "payload_bytes": None,
            "payload": None,
            "http": fields.get("content-type", "").startswith("application/http"),
        }
        return row if all(row[k] in v for k, v in self.wanted.items()) else None

    def needs_body(self, row: dict) -> bool:
        return "payload" in self.columns or "payload_bytes" in self.columns

    @staticmethod
    def filled(row: dict, body: bytes) -> dict:
        if not row["http"]:
            return row | {"payload": body.removesuffix(b"\r\n\r\n"), "payload_bytes": len(body.removesuffix(b"\r\n\r\n"))}
        head, _, content = body.partition(b"\r\n\r\n")
        sizes = [int(x.partition(b":")[2]) for x in head.split(b"\r\n")[1:] if x.lower().startswith(b"content-length:")]
        if row["record_type"] == "revisit":
            return row | {"payload_bytes": sizes[0] if sizes else None}
        content = content[: sizes[0]] if sizes else content
        return row | {"payload": content, "payload_bytes": len(content)}


class _Inflated:
    """A gzip file of many members as one stream of plain bytes."""

    def __init__(self, f):
        self.f, self.inflater, self.rest = f, zlib.decompressobj(31), b""

    def read(self, n: int) -> bytes:
        while True:
            if not self.rest:
                self.rest = self.f.read(1 << 16)
                if not self.rest:
                    return b""
            out = self.inflater.decompress(self.rest, n)
            if self.inflater.eof:
                self.rest, self.inflater = self.inflater.unused_data, zlib.decompressobj(31)
            else:
                self.rest = self.inflater.unconsumed_tail
            if out:
                return out


class WarcDataSource(DataSource):
    """`spark.read.format("warc").load(folder)`; options: path, level (gzip), split_bytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options), schema)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options), overwrite)


def register(spark) -> None:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def with_revisits(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", least_bytes: int = 0, prefix: str = "urn:page:") -> DataFrame:
    """Archive rows of pages: of the pages with an equal payload of at least so many bytes, those with the largest id are responses, the others revisit it.

    Payloads are compared by SHA-1. Counts per digest are added up before the shuffle; only digests that occur more than once are joined back.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("id"), F.col(uri_col).cast("string").alias("uri"), payload.alias("payload"))
    rows = rows.withColumns({"sha1": F.unhex(F.sha1("payload")), "payload_bytes": F.octet_length("payload").cast("long")})
    shared = (
        pages.select(F.col(id_col).alias("id"), payload.alias("payload"))
        .select("id", F.unhex(F.sha1("payload")).alias("sha1"), F.octet_length("payload").alias("n"))
        .filter(F.col("n") >= least_bytes)
        .groupBy("sha1")
        .agg(F.max("id").alias("last"), F.count("*").alias("copies"))
        .filter("copies > 1")
        .select("sha1", "last")
    )
    revisit = F.col("last").isNotNull() & F.coalesce(F.col("last") != F.col("id"), F.lit(True)) & (F.col("payload_bytes") >= least_bytes)
    named = lambda c: F.concat(F.lit(prefix), F.coalesce(c.cast("string"), F.lit("")))
    return rows.join(shared, "sha1", "left").select(
        named(F.col("id")).alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.col("uri").alias("target_uri"),
        F.when(revisit, named(F.col("last"))).alias("refers_to"),
        base32(F.col("sha1")).alias("payload_digest"),
        "payload_bytes",
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def base32(sha1) -> F.Column:
    """Upper-case base32 of 20 bytes, from four groups of five bytes, as an expression."""
    digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    native = "0123456789ABCDEFGHIJKLMNOPQRSTUV"  # the digits of base 32 as conv() writes them
    groups = [F.lpad(F.conv(F.hex(F.substring(sha1, 5 * k + 1, 5)), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*groups), native, digits)
