"""Structured Streaming into a store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from tickloom.operators.writer import StoreWriter


def ingest(stream: DataFrame, writer: StoreWriter, *, late: str = "drop") -> DataStreamWriter:
    """A stream writer that appends each micro-batch of key and record columns to the store.

    With ``late="drop"`` rows at or before a key's newest stored stamp are left out, so a batch that
    is run again after a failure adds nothing twice.  With ``late="error"`` such rows stop the
    stream, as an append out of order does.  The caller sets checkpoint, trigger, and starts it.
    """

    def batch(rows: DataFrame, _: int) -> None:
        writer.append_frame(rows, late=late)

    return stream.writeStream.foreachBatch(batch).outputMode("append")
