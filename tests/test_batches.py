"""Whole training batches, rectangles of edges, and merged sketches, each against a plain version."""

import random

from irloom.operators import tables, training
from pyspark.sql import functions as F

EDGES = "file_path string, edge_no int, src_start int, src_end int, dst_start int, dst_end int, prob double"


def cells_of(rows):
    """Each place by the last edge on it."""
    out = {}
    for f, _, a, b, c, d, p in sorted(rows, key=lambda r: r[1]):
        out.update({(f, i, j): p for i in range(a, b + 1) for j in range(c, d + 1)})
    return out


def test_rectangles_are_disjoint_and_cover_the_cells(spark):
    rng = random.Random(3)
    rows = []
    for f in ("a", "b", "c", "d"):
        span = {"a": 6, "b": 12, "c": 30, "d": 30}[f]
        for no in range(25):
            a, c = rng.randrange(span), rng.randrange(span)
            rows.append((f, no, a, a + rng.randrange(5), c, c + rng.randrange(5), rng.choice([0.25, 0.5, 1.0])))
    rows += [rows[0][:1] + (99,) + rows[0][2:6] + (0.75,)]  # the first edge's ranges again, on top
    edges = spark.createDataFrame([*rows, ("a", 100, -1, 2, 0, 1, 1.0), ("a", 101, 3, 2, 0, 1, 1.0), ("a", 102, None, 2, 0, 1, 1.0)], EDGES)
    for stripe in (4096, 7):
        got = {}
        for r in training.edge_rectangles(edges, F.col("prob"), stripe=stripe).collect():
            for i in range(r.i_first, r.i_last + 1):
                for j in range(r.j_first, r.j_last + 1):
                    assert (r.file_path, i, j) not in got
                    got[r.file_path, i, j] = r.weight
        assert got == cells_of(rows)
    assert {(r.file_path, r.i, r.j): r.weight for r in training.rasterize_edges(edges, F.col("prob")).collect()} == cells_of(rows)


def test_a_large_edge_is_one_rectangle(spark):
    edges = spark.createDataFrame([("f", 0, 0, 4096, 0, 4096, 0.5)], EDGES)
    assert [tuple(r) for r in training.edge_rectangles(edges, F.col("prob"), inclusive=False).collect()] == [("f", 0, 4095, 0, 4095, 0.5)]
    more = spark.createDataFrame([("f", 0, 0, 4096, 0, 4096, 0.5), ("f", 1, 10, 20, 10, 20, 1.0)], EDGES)
    rows = training.edge_rectangles(more, F.col("prob"), inclusive=False).collect()
    assert len(rows) == 5 and sum((r.i_last - r.i_first + 1) * (r.j_last - r.j_first + 1) for r in rows) == 4096 * 4096
    assert training.edge_rectangles(edges.limit(0), F.col("prob")).count() == 0


def test_training_batches_against_a_plain_version(spark):
    rng = random.Random(7)
    pool = {}
    for i in range(23):
        ids = [rng.randrange(12) for _ in range(rng.randrange(30))] if i else None
        edge = lambda n: sorted(rng.randrange(40) for _ in range(n))
        pool[i] = (ids, [edge(4) for _ in range(rng.randrange(4))] if i % 5 else None, [[*map(float, edge(4)), 0.5] for _ in range(rng.randrange(3))])
    drawn = [(i, (i + 1) % 23, None if i == 9 else (i + 7) % 23) for i in range(0, 23, 2)] + [(9, 1, None)]
    table = spark.createDataFrame([(i, *r) for i, r in pool.items()], "i long, input_ids array<int>, ddg_graph array<array<int>>, cfg_graph array<array<float>>")
    triples = spark.createDataFrame(drawn, "anchor_idx long, positive_idx long, negative_idx long")
    cut = lambda ids: [*ids[:19], 2] if len(ids) > 20 else ids
    masks = spark.createDataFrame([(i, cut(r[0] or [])) for i, r in pool.items()], "i long, ids array<int>")
    masks = {r.i: r.m for r in masks.select("i", training.mlm_mask(F.col("ids"), F.col("i"), 12).alias("m")).collect()}
    got = {r.batch_id: r for r in training.training_batches(triples, table, "i", 12, 4, 20).collect()}
    kept = sorted(t for t in drawn if t[2] is not None)
    batches = [kept[k : k + 4] for k in range(0, len(kept), 4)]
    assert sorted(got) == list(range(len(batches)))
    for no, batch in enumerate(batches):
        r, order = got[no], [t[k] for k in range(3) for t in batch]
        ids = [cut(pool[i][0] or []) for i in order]
        length = -(-max(map(len, ids)) // 8) * 8
        pad = lambda x, p: list(x) + [p] * (length - len(x))  # noqa: B023, E731
        anchors = order[: len(batch)]
        graphs = [[[e for e in pool[i][k] or [] if max(e[:4]) < 20] for i in order] for k in (1, 2)]
        assert r.anchor_idx == anchors and r.length == length and length % 8 == 0
        assert r.contract_input_ids == [pad(x, 1) for x in ids] and r.contract_attention_mask == [pad([1] * len(x), 0) for x in ids]
        assert r.input_ids == [pad(masks[i].input_ids, 1) for i in anchors] and r.labels == [pad(masks[i].labels, -100) for i in anchors]
        assert r.attention_mask == r.contract_attention_mask[: len(batch)]
        for have, want, n in ((r.ddg_graph, graphs[0], 4), (r.cfg_graph, graphs[1], 5)):
            most = max(map(len, want))
            assert have == [g + [[-1] * n] * (most - len(g)) for g in want]
    assert training.training_batches(triples.limit(0), table, "i", 12).count() == 0


def test_merged_sketches_keep_ranks(spark):
    x = spark.range(60_000).select((F.col("id") % 7).alias("g"), (F.pow(F.xxhash64("id") % 1000, F.lit(2)) / 50).cast("int").alias("c"))
    x = x.union(spark.createDataFrame([(0, 0), (1, -5), (2, None)], "g long, c int"))  # counts that are not positive are left out
    stored = [tables.count_sketches(part, "c", ["g"]) for part in (x.where("g < 3"), x.where("g >= 3"), x.limit(0))]
    q = tables.merged_quantiles(stored[0].union(stored[1]).union(stored[2]))
    positive = x.where("c > 0")
    rows = tables.rank_errors(x, "c", q).collect()
    assert sorted(r.share for r in rows) == [0.5, 0.9, 0.95, 0.98, 0.99] and all(r.n == positive.count() and r.rank_error <= 0.01 for r in rows)
    by = {r.g: r.n for r in tables.merged_quantiles(stored[0].union(stored[1]), (0.5,), ["g"]).collect()}
    assert by == {r.g: r["count"] for r in positive.groupBy("g").count().collect()}
    assert tables.merged_quantiles(stored[2]).count() == 0
