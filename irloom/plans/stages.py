"""Runs of named stages that can begin again at any of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession


def run_stages(spark: SparkSession, stages: list[tuple[str, Callable[[DataFrame], DataFrame]]], source: DataFrame, folder: str, start_from: str | None = None) -> DataFrame:
    """Applies the stages in order; each one's rows are stored below folder and read again as the next one's input.

    With start_from the stages before it are not run: the stored rows of its predecessor are read.
    """
    names = [n for n, _ in stages]
    first = names.index(start_from) if start_from else 0
    rows = spark.read.parquet(f"{folder}/{names[first - 1]}") if first else source
    for name, stage in stages[first:]:
        stage(rows).write.mode("overwrite").parquet(f"{folder}/{name}")
        rows = spark.read.parquet(f"{folder}/{name}")
    return rows


def rows_as_ready(df: DataFrame) -> Iterator[Row]:
    """Yields rows partition by partition; the driver holds one partition and, meanwhile, the next."""
    return df.toLocalIterator(prefetchPartitions=True)
