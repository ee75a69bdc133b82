"""Incremental ingest as a stream of landed arrivals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from newsloom import schemas
from newsloom.sources.store import ArticleStore


def landed(spark: SparkSession, folder: str, schema: T.StructType = schemas.INCOMING) -> DataFrame:
    """Stream of parquet files as they land; a trigger takes all that has landed."""
    return spark.readStream.schema(schema).parquet(folder)


def ingest(stream: DataFrame, store: ArticleStore, checkpoint: str, now: str | None = None):
    """Merge every micro-batch into the store, then stop when the input is drained.

    The micro-batch number is the store's batch number: a replayed micro-batch
    overwrites its own folders and reads only what was there before it.  Without
    ``now``, each micro-batch is stamped with the time it is merged.
    """
    def merge(batch: DataFrame, batch_id: int) -> None:
        store.apply(batch, batch_id, now)

    return (
        stream.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
