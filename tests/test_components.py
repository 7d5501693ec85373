"""Components of stars, paths and random graphs; leaks without pairs."""

import random

from irloom.operators import training
from pyspark.sql import functions as F


def plain(n, edges):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in range(n)}


def test_random_graphs(spark):
    rng = random.Random(2)
    n = 300
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(180)] + [(7, i) for i in range(40, 60)] + [(299, 299), (5, 6), (6, 5), (5, 6)]
    rows = spark.createDataFrame(edges, "src long, dst long")
    got = training.connected_components(rows, spark.range(n).select("id")).collect()
    assert {r.id: r.component for r in got} == plain(n, edges) and len(got) == n
    assert training.connected_components(rows.limit(0), spark.range(3).select("id")).where("component = id").count() == 3


def test_a_star(spark):
    star = spark.range(1, 1_000_001).select(F.lit(500_000).cast("long").alias("src"), F.col("id").alias("dst"))
    got = training.connected_components(star, star.select(F.col("dst").alias("id"))).groupBy("component").count().collect()
    assert [tuple(r) for r in got] == [(1, 1_000_000)]


def test_a_path(spark):
    path = spark.range(1_000).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    got = training.connected_components(path, spark.range(1_001).select("id")).groupBy("component").count().collect()
    assert [tuple(r) for r in got] == [(0, 1_001)]


def test_leaks_of_a_large_group(spark):
    """A group of 200,000 rows has 40 billion pairs, which are counted and never made."""
    df = spark.range(200_003).select(F.col("id").alias("i"), F.when(F.col("id") < 200_000, "big").when(F.col("id") < 200_002, "two").alias("k"))
    splits = df.select("i", F.when(F.col("i") % 10 == 0, "validation").otherwise("train").alias("split"))
    n, v = 200_000, 20_000
    assert tuple(training.leaking_pairs(df, ["k"], splits, "i").first()) == (2 * v * (n - v) + 2, n * (n - 1) + 2)
    index = splits.select(F.col("i").alias("old_idx"), "split", F.col("i").alias("new_idx"))
    counts = training.positive_counts(df.withColumnRenamed("i", "old_idx"), ["k"], index)
    assert {tuple(r) for r in counts.where("old_idx in (0, 1, 200000, 200001, 200002)").select("old_idx", "n_positives").collect()} == {(0, v - 1), (1, n - v - 1), (200_000, 0), (200_001, 0), (200_002, 0)}
    assert training.task_table(counts).count() == 200_000
