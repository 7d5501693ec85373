"""Incremental ingest: a file stream whose batches are put into a table by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from irloom.sources.kept import compact, keyed_rows, put_rows


def ingest(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, key: str, order: str | None = None, files_per_batch: int = 1000, compact_at: int = 8) -> None:
    """Puts all new files of source into target, a keyed table, and stops.

    The checkpoint remembers which files are done; a batch that runs again replaces itself, and only
    the buckets of its keys are written.  Of rows with one key the greatest in order counts, of
    equal ones (or without an order) the later batch's.  At the end buckets of compact_at or more
    folders are merged.
    """

    def put(batch: DataFrame, number: int) -> None:
        put_rows(batch, target, key, number, order)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    compact(spark, target, T.StructType.fromDDL(schema), key, order, compact_at)


def current_rows(spark: SparkSession, target: str, schema: str, key: str, order: str | None = None) -> DataFrame:
    """The row of each key that counts, over all batches."""
    return keyed_rows(spark, target, T.StructType.fromDDL(schema), key, order)
