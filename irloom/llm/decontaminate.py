"""Operator 1, benchmark decontamination, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from irloom.llm.common import WORD_BREAK, documents, id_and_text, set_checkpoint_dir

#: Up to so many rows (sketched hashes, item shingles of about 100 bytes, candidate pairs) a table is broadcast; beyond it it is joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Documents are cut into pieces of so many words, which overlap by a shingle, so that no row holds more shingles.
PIECE = 1000
SPACE = " \t\n\x0b\f\r"


def starts(words: Column, size: Column, most: int = 1 << 30) -> Column:
    """Where the first `most` runs of size words begin, from 1; none where there are fewer words."""
    n = F.least(F.size(words) - size + 1, F.lit(most))
    return F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def shingle_hash(words: Column, at: Column, size: Column) -> Column:
    return F.xxhash64(F.slice(words, at, size))


def shingle_text(words: Column, at: Column, size: Column) -> Column:
    return F.array_join(F.slice(words, at, size), " ")


def with_words(texts: DataFrame) -> DataFrame:
    """Adds w, the words of text in lower case; texts without words go."""
    trimmed = texts.withColumn("text", F.btrim(F.lower("text"), F.lit(SPACE))).where("text <> ''")
    return trimmed.withColumn("w", F.split("text", WORD_BREAK)).drop("text")


def item_shingles(items: DataFrame, width: int = 5) -> DataFrame:
    """item_id, width, h, shingle, distinct: the shingles of each item and their hashes; an item of fewer words is one shingle of all of them."""
    x = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).where(F.col("item_id").isNotNull())
    x = with_words(x).withColumn("width", F.least(F.size("w"), F.lit(width)))
    one = lambda i: F.struct(shingle_hash(F.col("w"), i, F.col("width")).alias("h"), shingle_text(F.col("w"), i, F.col("width")).alias("shingle"))
    x = x.select("item_id", "width", F.explode(F.transform(starts(F.col("w"), F.col("width")), one)).alias("s"))
    return x.select("item_id", "width", "s.h", "s.shingle").distinct()


def item_sketches(parts: DataFrame, threshold_pct: int) -> DataFrame:
    """h, item_id: a MinHash sketch of each item, the least hashes of its shingles, as many as its size partition asks for.

    An item of n shingles of which threshold_pct percent lie in a document misses at most m =
    n - ceil(n * pct / 100) of them, so one of any m + 1 is there.  Items are partitioned by the
    size class of n (powers of two); each keeps the m + 1 least hashes for the largest n of its
    class, which loses no pair, however long the document is.
    """
    sorted_items = parts.groupBy("item_id").agg(F.sort_array(F.collect_list("h")).alias("h"))  # an item's own shingles
    most = F.pow(F.lit(2), F.floor(F.log2(F.size("h"))) + 1) - 1
    keep = (most - F.ceil(most * threshold_pct / F.lit(100)) + 1).cast("int")
    return sorted_items.select("item_id", F.explode(F.slice("h", F.lit(1), keep)).alias("h")).distinct()


def pieces(docs: DataFrame, widths: list[int]) -> DataFrame:
    """doc_id, w: the words of each document in pieces that overlap, so that each shingle begins in the first PIECE words of one."""
    words = with_words(id_and_text(docs).where(F.col("doc_id").isNotNull()))
    cut = F.transform(F.sequence(F.lit(1), F.size("w"), F.lit(PIECE)), lambda i: F.slice("w", i, PIECE + max(widths) - 1))
    return words.select("doc_id", F.explode(cut).alias("w"))


def of_every_width(widths: list[int], fn) -> Column:
    """fn(w, start, width) for all shingles of a piece."""
    one = lambda k: F.transform(starts(F.col("w"), F.lit(k), PIECE), lambda i: fn(F.col("w"), i, F.lit(k)))
    return F.flatten(F.array(*map(one, widths)))


def candidate_pairs(docs: DataFrame, parts: DataFrame, widths: list[int], threshold_pct: int = 75) -> DataFrame:
    """doc_id, item_id: documents that hold a shingle whose hash is in the item's sketch."""
    sketches = item_sketches(parts, threshold_pct).checkpoint()
    near = F.broadcast if sketches.count() <= BROADCAST_ROWS else (lambda df: df)
    hashes = pieces(docs, widths).select("doc_id", F.explode(of_every_width(widths, shingle_hash)).alias("h"))
    return hashes.join(near(sketches), "h").select("doc_id", "item_id").distinct()


def contained_items(docs: DataFrame, items: DataFrame, width: int = 5, threshold_pct: int = 75) -> DataFrame:
    """Pairs doc_id, item_id, n_item (shingles of the item), n_shared (those in the document), containment.

    A pair is returned if at least threshold_pct percent of the item's distinct shingles (width
    words, lower case) lie in the document.  Search: each item's MinHash sketch, of a length that
    its size partition sets, is looked up among the hashes of all shingles of the documents, which
    gives candidate pairs.  Verification: the shingles of candidate documents are compared with
    those of their items as strings.

    Null or empty texts and items match nothing.  Repeated rows of one id count as one document or
    item that holds all their shingles; null ids match nothing.  Long texts are cut into pieces of
    PIECE words that overlap, so no shingle is lost and no row grows with a text.  Empty tables
    give no rows; other columns are not read.
    """
    set_checkpoint_dir(docs.sparkSession)
    parts = item_shingles(items, width).checkpoint()
    widths = sorted(r[0] for r in parts.select("width").distinct().collect()) or [width]  # at most `width` values
    pairs = candidate_pairs(docs, parts, widths, threshold_pct).checkpoint()
    near = F.broadcast if parts.count() <= BROADCAST_ROWS else (lambda df: df)
    few = F.broadcast if pairs.count() <= BROADCAST_ROWS else (lambda df: df)
    chosen = docs.join(few(pairs.select("doc_id").distinct()), "doc_id", "left_semi")
    found = pieces(chosen, widths).select("doc_id", F.explode(of_every_width(widths, shingle_text)).alias("shingle"))
    matched = found.join(near(parts.select("item_id", "shingle")), "shingle").join(few(pairs), ["doc_id", "item_id"], "left_semi").distinct()
    shared = matched.groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("n_shared"))
    sizes = parts.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_item"))
    held = shared.join(near(sizes), "item_id").where(F.col("n_shared") * 100 >= F.col("n_item") * threshold_pct)
    return held.select("doc_id", "item_id", "n_item", "n_shared", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def decontaminate(docs: DataFrame, items: DataFrame, width: int = 5, threshold_pct: int = 75) -> DataFrame:
    """The documents (all their columns) that contain no item; rows without an id stay."""
    bad = contained_items(docs, items, width, threshold_pct).select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(*docs.columns)


def op1_decontaminate(spark, sf_dir):
    return contained_items(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL = r"""
with iw as (
  select item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from benchmark where item_id is not null),
iv as (select item_id, w, least(len(w), 5) as k from iw where len(w) > 0),
i as (select distinct item_id, k, array_to_string(w[p : p + k - 1], ' ') as s from (select *, unnest(range(1, len(w) - k + 2)) as p from iv)),
n as (select item_id, count(*) as n_item from i group by item_id),
dw as (
  select doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents where doc_id is not null),
d as (select distinct doc_id, array_to_string(w[p : p + k - 1], ' ') as s
      from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as p from dw, (select distinct k from i)))
select doc_id, item_id, n_item, count(*) as n_shared, count(*) / n_item as containment
from d join i using (s) join n using (item_id)
group by doc_id, item_id, n_item having count(*) * 100 >= n_item * 75
"""
