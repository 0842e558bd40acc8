"""Nearest matches of a stream against a table.

Distances, similarities, codes and q-gram arrays are plain expressions and work on streams as they are. A nearest match
aggregates over candidates, so it runs per micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..operators.match import amatch


def match_stream(stream: DataFrame, table: DataFrame, sink: Callable[[DataFrame, int], None], **how) -> DataStreamWriter:
    """A writer that gives the matches of each micro-batch to `sink(matches, batch_id)`; start it with a checkpoint location for exactly-once sinks."""
    return stream.writeStream.foreachBatch(lambda batch, number: sink(amatch(batch, table, **how), number))
