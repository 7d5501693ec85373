"""Tables that are kept and added to: one by key, one in files of equal size.

Both begin again after a stop at any moment: what a run writes counts only once it is whole, and
running it again replaces what it had written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from irloom.operators.training import batch_number, dense_row_index
from irloom.sources import paths

# --- a table by key -----------------------------------------------------------------------------------

#: The folders of a keyed table: hash of the key, number of the batch, and whether the batch stands for those before it too.
FOLDERS = {"kept_bucket": T.IntegerType(), "kept_batch": T.LongType(), "kept_merged": T.IntegerType()}


def last_rows(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Of rows with one key the last in order, ties by a hash of the row; null is a key like others.

    An aggregation, so rows of a frequent key meet after each task has kept one of them.
    """
    others = [c for c in df.columns if c != key]
    if not others:
        return df.distinct()
    pick = F.max_by(F.struct(*others), F.struct(*order, F.xxhash64(*[F.to_json(F.struct(*others))])))
    return df.groupBy(key).agg(pick.alias("__row")).select(*[F.col(key) if c == key else F.col("__row").getField(c).alias(c) for c in df.columns])


def put_rows(batch: DataFrame, folder: str, key: str, number: int, order: str | None = None, n_buckets: int = 64) -> None:
    """Adds a batch's rows to a keyed table: only the batch is written, into a folder for each bucket that it touches.

    number: rises from batch to batch; a batch put again under its number replaces itself.  Of rows
    with one key the greatest in order counts, of equal ones (or without an order) the later
    batch's.  n_buckets stays the same for a table.
    """
    last = last_rows(batch, key, [F.col(order)] if order else [])
    placed = last.withColumns({"kept_bucket": F.pmod(F.xxhash64(key), F.lit(n_buckets)).cast("int"), "kept_batch": F.lit(number).cast("long"), "kept_merged": F.lit(0)})
    write_buckets(placed, folder)


def write_buckets(placed: DataFrame, folder: str) -> None:
    """Replaces the folders that the rows name, and no others; a bucket is one file unless it is large."""
    placed.hint("rebalance", "kept_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*FOLDERS).parquet(f"{folder}/rows")


def stored_rows(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """All stored rows and their folders' numbers; an empty table where nothing was put yet."""
    whole = T.StructType([*schema.fields, *[T.StructField(n, t) for n, t in FOLDERS.items()]])
    return spark.read.schema(whole).parquet(f"{folder}/rows") if paths.exists(spark, f"{folder}/rows") else spark.createDataFrame([], whole)


def winners(stored: DataFrame, key: str, order: str | None) -> DataFrame:
    """The row of each key that counts, with its folders' numbers."""
    return last_rows(stored, key, [F.col(c) for c in [*([order] if order else []), "kept_batch", "kept_merged"]])


def keyed_rows(spark: SparkSession, folder: str, schema: T.StructType, key: str, order: str | None = None) -> DataFrame:
    """The table's rows, one for each key."""
    return winners(stored_rows(spark, folder, schema), key, order).select(*schema.names)


def compact(spark: SparkSession, folder: str, schema: T.StructType, key: str, order: str | None = None, least: int = 8) -> int:
    """Merges the folders of every bucket that has `least` or more, but for its newest batch's; returns how many folders went.

    The merged rows are stored under a number of their own before the old folders go, and win
    against them meanwhile.  The table's newest batch, which a stream may put again, stays as it is.
    Numbers of folders, not rows, come to the driver.  Readers of the old folders should be done.
    """
    stored = stored_rows(spark, folder, schema)
    known = stored.select(*FOLDERS).distinct()  # one row a folder
    newest = known.agg(F.max("kept_batch")).first()[0]
    old = [tuple(r) for r in known.where(F.col("kept_batch") < F.lit(newest)).collect()] if newest is not None else []
    by_bucket: dict[int, list[tuple]] = {}
    for f in old:
        by_bucket.setdefault(f[0], []).append(f)
    merged = {b: fs for b, fs in by_bucket.items() if len(fs) >= max(least, 2)}
    if not merged:
        return 0
    chosen = stored.where(F.col("kept_bucket").isin(list(merged))).where(F.col("kept_batch") < newest)
    # a name that no folder has: the newest of the merged batches, and one more than any merge under it
    level = 1 + max(f[2] for fs in merged.values() for f in fs)
    last = F.create_map(*[F.lit(v) for b, fs in merged.items() for v in (b, max(f[1] for f in fs))])
    rows = winners(chosen, key, order).withColumns({"kept_batch": last[F.col("kept_bucket")].cast("long"), "kept_merged": F.lit(level)})
    write_buckets(rows, folder)
    gone = [f for fs in merged.values() for f in fs]
    for f in gone:
        paths.remove(spark, f"{folder}/rows/" + "/".join(f"{n}={v}" for n, v in zip(FOLDERS, f, strict=True)))
    return len(gone)


# --- a table in files of equal size -------------------------------------------------------------------


def committed(spark: SparkSession, folder: str) -> int | None:
    """How many rows a rolling table holds by its last whole run; None before the first."""
    done = [int(n.split("=")[1]) for n in paths.children(spark, f"{folder}/open") if n.startswith("rows=") and paths.exists(spark, f"{folder}/open/{n}/_SUCCESS")]
    return max(done, default=None)


def rolled_rows(spark: SparkSession, folder: str, schema: T.StructType, size: int = 10_000) -> DataFrame:
    """The rows of a rolling table with row_no (from 0) and bin, the number of the file they are in."""
    whole = T.StructType([*schema.fields, T.StructField("row_no", T.LongType()), T.StructField("bin", T.LongType())])
    total = committed(spark, folder)
    if total is None:
        return spark.createDataFrame([], whole)
    tail = spark.read.schema(T.StructType(whole.fields[:-1])).parquet(f"{folder}/open/rows={total:020d}").withColumn("bin", F.lit(total // size).cast("long"))
    if total < size:
        return tail
    return spark.read.schema(whole).parquet(f"{folder}/full").where(F.col("bin") < total // size).unionByName(tail)


def roll(df: DataFrame, folder: str, key: str, size: int = 10_000) -> None:
    """Adds the rows whose key the table has not: in key order, in files of exactly `size` rows, each in its bin's folder.

    The rows left over lie in an open file; the next run begins with them.  Full files are written
    first and count once the open file behind them is whole, so a stopped run leaves the table as it
    was, and keys count as done exactly with their rows.  Of rows with one key (null too) one is
    kept.  A run without new rows writes nothing.
    """
    spark, total = df.sparkSession, committed(df.sparkSession, folder) or 0
    have = rolled_rows(spark, folder, df.schema, size)
    done = have.select(F.col(key).alias("__done"))
    new = last_rows(df, key, []).join(done, F.col(key).eqNullSafe(F.col("__done")), "left_anti")
    new = dense_row_index(new, key, "row_no")
    first = total // size  # the bin that is open
    n = new.agg(F.count(F.lit(1))).first()[0]
    if not n and committed(spark, folder) is not None:
        return
    now = total + n
    rows = have.where(F.col("bin") == first).drop("bin").unionByName(new.withColumn("row_no", F.col("row_no") + total), allowMissingColumns=False)
    bins = rows.withColumn("bin", batch_number("row_no", size))
    full = bins.where(F.col("bin") < now // size)
    if now // size > first:
        full.repartition("bin").sortWithinPartitions("bin", "row_no").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bin").parquet(f"{folder}/full")
    rest = bins.where(F.col("bin") >= now // size).drop("bin")  # fewer than `size` rows
    rest.repartition(1).sortWithinPartitions("row_no").write.mode("overwrite").parquet(f"{folder}/open/rows={now:020d}")


def with_bin_size(rolled: DataFrame) -> DataFrame:
    """Adds rows_in_bin, how many rows the row's file has."""
    return rolled.withColumn("rows_in_bin", F.count(F.lit(1)).over(W.partitionBy("bin")))
