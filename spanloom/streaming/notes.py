"""Streams of notes: each micro-batch is parsed as a table. Notes are independent, so no state is kept between batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from spanloom.api import Engine, Result


def parse_stream(notes: DataFrame, engine: Engine, sink: Callable[[Result, int], None]) -> DataStreamWriter:
    """A writer that hands each batch's result, with the batch's number, to sink; call start() on it.

    A sink that writes to a place named by the batch's number writes each batch once, whatever is retried.
    """
    return notes.writeStream.foreachBatch(lambda batch, number: sink(engine.parse(batch), number))
