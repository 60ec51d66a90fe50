"""Continuous upserts: each micro-batch of changes is merged into a table by key. An extension beyond full copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming import StreamingQuery

from sparkferry.operators.merge import latest
from sparkferry.sources.stores import ParquetStore


def merge_stream(changes: DataFrame, store: ParquetStore, table: str, key: list[str], order: list[Column], checkpoint: str, once: bool = True, buckets: int = 64) -> StreamingQuery:
    """Starts a query that merges changes into a table of the store; of several changes of a key the last by `order` counts.

    The table lies in buckets of the key's hash, and a batch rewrites those that its keys fall into: many buckets suit batches of
    few keys. A batch that runs again after a failure gives the same table, as merging twice equals merging once.
    """

    def apply(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            store.merge_buckets(table, latest(batch, key, order), key, buckets)

    writer = changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
