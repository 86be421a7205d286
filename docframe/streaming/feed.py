"""Streams into and out of collections (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def ingest(stream: DataFrame, collection, checkpoint: str, doc_column: str = "doc") -> StreamingQuery:
    """Insert every micro-batch of ``stream`` as one atomic batch of documents, once.

    The manifest keeps the number of the last batch by checkpoint, so one that is replayed after
    its commit adds nothing.
    """
    writer = stream.writeStream.foreachBatch(lambda batch, number: collection.insert_frame(batch, doc_column, (checkpoint, number)) and None)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(changes: DataFrame) -> DataFrame:
    """Running number of puts and deletes per kind, from a change feed."""
    return changes.groupBy("op").count()
