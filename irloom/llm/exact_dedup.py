"""Operator 4, exact dedup: 128-bit content hash, then bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from irloom.llm.common import documents, id_and_text


def text_classes(docs: DataFrame, keep: str = "min") -> DataFrame:
    """One row per distinct text: content_hash, text_sha256, keep_id, group_size.

    Rows are grouped by the 128-bit hash together with the text itself, so equal hashes of
    different bytes fall apart.  The grouping combines on the map side: a group that holds a third
    of all rows leaves each task as one row.
    """
    pick = F.max if keep == "max" else F.min
    grouped = id_and_text(docs).groupBy(F.md5("text").alias("content_hash"), "text").agg(pick("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return grouped.select("content_hash", F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size")


def exact_groups(docs: DataFrame, keep: str = "min") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty.  Null ids never win against an id; a group of null ids only keeps
    them (keep_id null).  Rows that repeat an id and its text share one decision.  Texts of any length
    are compared whole.  Empty tables give no rows; other columns are not read.
    """
    keys = id_and_text(docs).select("doc_id", F.md5("text").alias("content_hash"), F.sha2("text", 256).alias("text_sha256"))
    return keys.join(text_classes(docs, keep), ["content_hash", "text_sha256"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def exact_dedup(docs: DataFrame, keep: str = "min") -> DataFrame:
    """The documents (all their columns) whose row stays, by the rules of exact_groups; of rows that repeat an id and its text one.

    A row meets its class by its id and the text's hashes together, so a text that a third of all
    rows hold is no hot key, and rows are compared with their repeats where that join has put them.
    Of a class without any id one row stays.
    """
    text, key = F.coalesce(F.col("text"), F.lit("")), ["__id", "__hash", "__sha"]
    named = lambda i: F.coalesce(F.col(i).cast("long").cast("string"), F.lit(""))
    classes = text_classes(docs, keep).select(named("keep_id").alias("__id"), F.col("content_hash").alias("__hash"), F.col("text_sha256").alias("__sha"))
    keyed = docs.withColumns({"__id": named("doc_id"), "__hash": F.md5(text), "__sha": F.sha2(text, 256)})
    return keyed.join(classes, key, "left_semi").dropDuplicates(key).select(*docs.columns)


def op4_exact_dedup(spark, sf_dir):
    return exact_groups(documents(spark, sf_dir), keep="max")


SQL = """
select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
       doc_id is not distinct from max(doc_id) over (partition by t) as kept, sha256(t) as text_sha256
from (select doc_id, coalesce(text, '') as t from documents)
"""
