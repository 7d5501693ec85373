"""A corpus pipeline of the training-data operators, from documents to packed sequences."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from irloom.llm.common import set_checkpoint_dir
from irloom.llm.decontaminate import decontaminate
from irloom.llm.exact_dedup import exact_dedup
from irloom.llm.language_id import drop_unidentified
from irloom.llm.near_dedup import near_dedup
from irloom.llm.packing import pack


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: no letters, or an ambiguous decision."""
    return drop_unidentified(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of equal texts the one with the least doc_id."""
    return exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of near-duplicate texts the one with the least doc_id."""
    return near_dedup(docs)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a benchmark item."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents that are left; returns the pieces."""
    return pack(docs)


STAGES = [
    ("language_id", identify_languages),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark_passages),
    ("packing", pack_sequences),
]

#: Language ID, near-duplicate links and tokens are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents; each one's result is stored and read again as the next one's input.

    A run stores its stages in a new folder below the shared checkpoint folder, which its result
    still reads; so runs do not disturb each other, and a folder may go with its result.
    """
    set_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        out = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return STAGES[-1][1](spark, docs, sf_dir)
