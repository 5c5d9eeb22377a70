"""Streams of raw rows into a store: each micro-batch goes through the engine's own path.

There is no watermark, as late events must reopen history; what is kept grows
with the events themselves, in the store, not in operator state. A batch that is
tried again after a failure adds nothing: event ids that the store knows are
duplicates.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from ..engine import Batch, Engine


def start(stream: DataFrame, engine: Engine, checkpoint: str, on_batch: Callable[[Batch, int], None] | None = None, available_now: bool = True) -> StreamingQuery:
    """stream: a streaming frame with seq, origin and raw columns or ``data``."""

    def one(df: DataFrame, epoch: int) -> None:
        if df.isEmpty():
            return
        batch = engine.ingest(df)
        if on_batch:
            on_batch(batch, epoch)

    writer = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
