"""Periodic upserts of a stream into a store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming import StreamingQuery

from marram.sources.store import Store


def flush_into(stream: DataFrame, store: Store, checkpoint: str, order: list[Column], every: str = "30 seconds", once: bool = False) -> StreamingQuery:
    """Each micro-batch is merged into the store, whose versions keep the last batch, so that one that is run again changes nothing.

    A merge rewrites the buckets that the batch touches, not the table.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        Store(batch.sparkSession, store.folder).merge(batch, order, batch_id)

    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()
