"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import re
import tempfile
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of characters other than ASCII white space.
WORD_BREAK = "[\\x20\\x09-\\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table below sf_dir."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_and_text(docs: DataFrame, *more: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id (long) and text (null: empty); of other columns only those named, so clashing names cannot meet."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *more)


def words_of(text: Column) -> Column:
    """The words of a string as an array, without empty ones."""
    return F.filter(F.split(text, WORD_BREAK), lambda w: w != F.lit(""))


def by_bytes(batch: pa.RecordBatch, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in slices whose strings and bytes take at most `most`, or one row; none of an empty batch."""
    size = np.full(batch.num_rows, 16, np.int64)
    for c in batch.columns:
        if pa.types.is_string(c.type) or pa.types.is_binary(c.type):
            size += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
    size = np.cumsum(size)
    at = 0
    while at < batch.num_rows:
        n = max(1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")) - at)
        yield batch.slice(at, n)
        at += n


def arrow_map(df: DataFrame, fn: Callable[..., dict], schema: str, names: list[str]) -> DataFrame:
    """mapInArrow over plain lists: fn gets one list per input column and returns one list per output column.

    Of a batch no more rows are turned into Python objects at once than by_bytes allows.
    """

    def run(batches: Iterator[pa.RecordBatch], fn=fn, names=names) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole):
                out = fn(*(c.to_pylist() for c in batch.columns))
                yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v) for v in (out[n] for n in names)], names=names)

    return df.mapInArrow(run, schema)


def set_checkpoint_dir(spark: SparkSession) -> None:
    """Uses the shared checkpoint folder that the cluster names; a folder of our own only for a local session that names none (tests)."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoints-"))


def release(spark: SparkSession) -> None:
    """Lets go of plans that a checkpoint has replaced, so that Spark removes their shuffle files now rather than when the driver's heap fills.

    What the first collection frees is let go of in the background and still holds the shuffles; the
    second one frees those.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    time.sleep(1)
    spark.sparkContext._jvm.System.gc()
