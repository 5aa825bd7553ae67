"""Structured Streaming counterparts of interval loads: windowed counts with late data, and continuous merges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparkmodel.plans.buckets import merge_load
from sparkmodel.plans.storage import TableStore

#: Micro-batches after which what was replaced is deleted.
VACUUM = 50


def windowed(stream: DataFrame, time_column: str, window: str, lookback: str, keys: Sequence[str], aggregates: Sequence[Column]) -> DataFrame:
    """Aggregates of fixed windows; rows later than `lookback` behind the newest one are not waited for."""
    late = stream.withWatermark(time_column, lookback)
    counts = late.groupBy(F.window(time_column, window), *keys).agg(*aggregates)
    return counts.select(F.col("window.start").alias("window_start"), "*").drop("window")


def merge_stream(stream: DataFrame, store: TableStore, table: str, keys: Sequence[str], checkpoint: str, order: Sequence[str] = ()) -> StreamingQuery:
    """Merge each micro-batch into a table by key, rewriting the buckets of its keys. A batch that is delivered again changes nothing."""
    newest = [F.col(c).desc() for c in order]

    def merge(batch: DataFrame, number: int) -> None:
        merge_load(store, table, batch, keys, order=newest)
        if number % VACUUM == VACUUM - 1:
            store.vacuum(table)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
