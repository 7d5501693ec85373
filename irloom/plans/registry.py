"""The registry of queries: name, function of (spark, folder of the tables), and SQL for DuckDB where there is one."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from irloom.plans.session import ensure_checkpoint_dir

QUERIES: dict = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = (fn, sql)
        return fn

    return add


def docs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder, for queries that write and read again."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"
