"""Operator 11, sharding: records hash into fixed virtual slots, and a stored, versioned map sends slots to shards.

A record never changes its slot.  What changes is the map, of which each edit is a new version:
rebalancing moves few slots from full shards, and growing moves slots only into the new shards.
The map has as many rows as there are slots (SLOTS, some thousands), whatever the input is, so it
may be broadcast and folded over in one row.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from irloom.llm.common import documents, set_checkpoint_dir

#: Virtual slots, and shards of the registered query.
SLOTS, SHARDS = 4096, 16


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """One row per document: doc_id, size (UTF-8 bytes of the text, null: none, plus 1), text_crc32, copy, virtual_slot.

    Rows that agree in doc_id, size and checksum are counted on the map side and numbered as copies;
    id, size, checksum and copy decide the slot, so that neither an id nor a text that a third of
    all rows hold fills one slot.  Null ids are hashed by the rest.  Texts of any length leave the
    scan as two numbers.  Empty tables give no rows; other columns are not read.
    """
    text, key = F.coalesce(F.col("text").cast("string"), F.lit("")), ["doc_id", "size", "text_crc32"]
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    x = x.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).select(*key, F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("copy"))
    return x.withColumn("virtual_slot", F.pmod(F.xxhash64(*key, "copy"), F.lit(slots)).cast("int"))


def slot_loads(rows: DataFrame) -> DataFrame:
    """virtual_slot, bytes, n: what each slot holds; at most one row for each slot."""
    return rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))


def first_map(spark: SparkSession, slots: int = SLOTS, shards: int = SHARDS) -> DataFrame:
    """Version 1 of a map (version, virtual_slot, shard), which knows no loads: slots are dealt round."""
    return spark.range(slots).select(F.lit(1).alias("version"), F.col("id").cast("int").alias("virtual_slot"), (F.col("id") % shards).cast("int").alias("shard"))


def store_map(slot_map: DataFrame, path: str) -> None:
    """Adds a version to the maps stored at path; earlier versions stay as they are."""
    slot_map.coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A stored version of the map, by default the latest."""
    x = spark.read.schema("virtual_slot int, shard int, version int").parquet(path)
    version = version if version is not None else x.agg(F.max("version")).first()[0]
    if version is None or x.where(F.col("version") == version).isEmpty():
        raise AnalysisException(f"no version {version} of the map at {path}")
    return x.where(F.col("version") == version).select("version", "virtual_slot", "shard")


def edited_map(slot_map: DataFrame, loads: DataFrame, shards: int) -> DataFrame:
    """The next version of a map, for `shards` shards of near equal bytes.

    A shard keeps its largest slots as long as their bytes stay within an equal share (slots larger
    than that have a shard each, the others share what is left); the rest go, largest first, to the
    shard that has least so far.  Where the map has fewer shards than asked
    for, only the new ones take slots.  Slots without rows have no bytes and go round with the rest.
    """
    x = slot_map.join(F.broadcast(loads), "virtual_slot", "left").select("version", "virtual_slot", "shard", F.coalesce("bytes", F.lit(0).cast("long")).alias("bytes"))
    by_size, every = W.partitionBy("shard").orderBy(F.desc("bytes"), "virtual_slot"), W.partitionBy()  # over at most all slots
    x = x.withColumns({"upto": F.sum("bytes").over(by_size.rowsBetween(W.unboundedPreceding, 0)), "total": F.sum("bytes").over(every), "old": F.max("shard").over(every) + 1})
    large = F.col("bytes") > F.col("total") / shards
    x = x.withColumn("share", (F.col("total") - F.sum(F.when(large, F.col("bytes")).otherwise(0)).over(every)) / (shards - F.sum(large.cast("int")).over(every)))
    kept = F.col("upto") <= F.col("share")
    row = x.agg(
        F.max("version").alias("version"), F.max("old").alias("old"), F.sort_array(F.collect_list(F.when(~kept, F.struct((-F.col("bytes")).alias("b"), "virtual_slot")))).alias("pool"),
        F.collect_list(F.when(kept, F.struct("virtual_slot", "shard", "bytes"))).alias("kept"),
    )
    held = lambda s: F.aggregate(F.filter("kept", lambda k: k["shard"] == s), F.lit(0).cast("long"), lambda a, k: a + k["bytes"])
    closed = lambda s: (F.col("old") < shards) & (s < F.col("old"))
    begin = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.when(closed(s), F.lit((1 << 63) - 1)).otherwise(held(s)))
    state = F.struct(begin.alias("held"), F.array().cast("array<struct<virtual_slot:int,shard:int>>").alias("moved"))

    def place(s, slot):
        to = F.array_position(s["held"], F.array_min(s["held"])).cast("int") - 1
        held = F.transform(s["held"], lambda v, i: F.when(i == to, v - slot["b"]).otherwise(v))
        return F.struct(held.alias("held"), F.array_append(s["moved"], F.struct(slot["virtual_slot"].alias("virtual_slot"), to.alias("shard"))).alias("moved"))

    kept_slots = F.transform("kept", lambda k: F.struct(k["virtual_slot"].alias("virtual_slot"), k["shard"].alias("shard")))
    both = row.select((F.col("version") + 1).alias("version"), F.explode(F.concat(kept_slots, F.aggregate("pool", state, place, lambda s: s["moved"]))).alias("m"))
    return both.select("version", "m.virtual_slot", "m.shard")


def shard_rows(rows: DataFrame, loads: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Adds map_version, shard and slot, the row's place in its shard, gapless from 0.

    Rows are numbered within their virtual slot; counts of the slots give each slot its first place.
    """
    in_shard = W.partitionBy("shard").orderBy("virtual_slot").rowsBetween(W.unboundedPreceding, -1)  # a row for each slot
    first = slot_map.join(F.broadcast(loads), "virtual_slot").select("virtual_slot", F.col("version").alias("map_version"), "shard", F.coalesce(F.sum("n").over(in_shard), F.lit(0)).alias("first"))
    in_slot = W.partitionBy("virtual_slot").orderBy("doc_id", "size", "text_crc32", "copy")
    x = rows.withColumn("at", F.row_number().over(in_slot) - 1).join(F.broadcast(first), "virtual_slot")
    return x.select("doc_id", "size", "text_crc32", "map_version", "virtual_slot", "shard", (F.col("first") + F.col("at")).alias("slot"))


def shard(docs: DataFrame, path: str, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, map_version, virtual_slot, shard, slot.

    The map at path is made if there is none, edited for what the slots hold now, and stored as a
    new version.  Near equal bytes: shards differ by less than one small slot as long as no slot is
    larger than a shard's share.
    """
    spark = docs.sparkSession
    set_checkpoint_dir(spark)
    rows = records(docs, slots).checkpoint()
    loads = slot_loads(rows)
    try:
        now = load_map(spark, path)
    except AnalysisException:
        store_map(first_map(spark, slots, shards), path)
        now = load_map(spark, path)
    store_map(edited_map(now, loads, shards), path)
    return shard_rows(rows, loads, load_map(spark, path))


def op11_sharding(spark, sf_dir):
    set_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/slot-map-{uuid.uuid4().hex}"
    x = shard(documents(spark, sf_dir), path)
    return x.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")


#: DuckDB has neither this checksum nor this hash; tests hold the operator against a plain version.
SQL = None
