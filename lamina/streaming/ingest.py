"""A stream into a store, and windowed counts with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lamina.plans.store import Store


def ingest_stream(stream: DataFrame, store: Store, checkpoint: str, name: str = "ingest", trigger: dict | None = None) -> StreamingQuery:
    """Every micro-batch becomes a batch of the store, once: one that comes again after a failure is
    known by its number. Late rows go to the day of their own time. store.wait() waits for it."""

    def take(batch: DataFrame, number: int) -> None:
        store.ingest(batch, origin=f"{name}:{number}")

    writer = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return store.watch((writer.trigger(**trigger) if trigger else writer).start())


def windowed_counts(stream: DataFrame, time_column: str, key: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows of each key and tumbling window, of a stream or a table; a stream forgets windows that
    are later than `late`."""
    return stream.withWatermark(time_column, late).groupBy(F.window(time_column, width).alias("window"), key).agg(F.count("*").alias("n"))
