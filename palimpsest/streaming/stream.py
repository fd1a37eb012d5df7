"""Continuous ingest of a stream of records by micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from palimpsest.database import Database


def ingest_stream(records: DataFrame, database: Database, checkpoint: str, modified_field: str | None = None, every: str | None = None) -> StreamingQuery:
    """Merge every micro-batch of (id, data, seq) and commit it; a batch that comes again changes nothing.

    What is there is taken in and the stream ends; with ``every``, such as ``1 minute``, it goes on and looks again so often.
    """

    def merge(batch: DataFrame, number: int) -> None:
        database.ingest(batch, modified_field=modified_field)

    writer = records.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
