"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but the six ASCII white-space characters.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; one is made only where none is set, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if found:
        if not context.getCheckpointDir():
            context.setCheckpointDir(found)
        return found.rstrip("/")
    if not context.getCheckpointDir():
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="glyphmatch-")
        atexit.register(shutil.rmtree, own, True)
        context.setCheckpointDir(own)
    return context.getCheckpointDir().rstrip("/")


#: Rows in an Arrow batch at most: a batch holds whole texts, on both sides of the pipe to Python.
ARROW_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch size to ARROW_ROWS if it is larger."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if not 0 < now <= ARROW_ROWS:
        spark.conf.set(name, str(ARROW_ROWS))


def work_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/glyphmatch-{name}-{uuid.uuid4().hex}"


#: Shuffle files of a query go when it ends, where Spark knows the setting.
_FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Whether compiled aggregations look a group up in a small table of their own before the one that can spill.
_SMALL_TABLE = "spark.sql.codegen.aggregate.map.twolevel.enabled"


@contextmanager
def _set(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def many_groups(spark: SparkSession):
    """Within it aggregations have one hash table each: the small one before it, of 65,536 groups, would soon be full, and rows would be looked up in both."""
    return _set(spark, _SMALL_TABLE, "false")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it back: later steps survive lost executors and share the work.

    The shuffle files of the write go at its end, as nothing else reads them. `unstored` deletes the table.
    """
    spark = df.sparkSession
    path = work_path(spark, name)
    with _set(spark, _FILE_CLEANUP, "true"):
        df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._stored_at = path
    return found


def unstored(*tables: DataFrame) -> None:
    """Delete tables that `stored` returned and that nothing reads any more."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._stored_at)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Keys of at most so many rows to leave out are broadcast (some 30 bytes each); more are joined by a shuffle.
MOST_LEFT_OUT = 1_000_000


def without(rows: DataFrame, keys: DataFrame, same: Column) -> DataFrame:
    """Rows without those that meet one of the keys; `keys` is read twice: pass a stored table."""
    few = keys.count() <= MOST_LEFT_OUT
    return rows.join(F.broadcast(keys) if few else keys, same, "left_anti")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _UPPER.lower())


def sliced(batch: pa.RecordBatch, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about so many bytes each, one row at least."""
    rows = batch.num_rows
    if rows == 0:
        return
    step = max(1, min(rows, rows * most_bytes // max(1, batch.nbytes)))
    for at in range(0, rows, step):
        yield batch.slice(at, step)


def as_bytes(column: pa.Array) -> list[bytes]:
    """The values of a string column as UTF-8 bytes, null as empty."""
    return [x or b"" for x in column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()]


def as_texts(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def field_ddl(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def count_matches(text: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def chained(*parts: Iterable) -> Iterator:
    for part in parts:
        yield from part


def fresh(name: str, columns: Iterable[str]) -> str:
    """The name, or it with underscores that make it differ from all of the columns, whatever their case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def safe_name(name: str) -> str:
    return re.sub(r"\W", "_", name)
