"""Tables that are kept: by key, with batches put again and folders merged, and in files of equal size."""

import random

import pytest
from irloom.sources import kept, paths
from irloom.streaming.ingest import current_rows, ingest
from pyspark.sql import types as T

SCHEMA = "k long, at long, v string"
FIELDS = T.StructType([T.StructField("k", T.LongType()), T.StructField("at", T.LongType()), T.StructField("v", T.StringType())])


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("order", ["at", None])
def test_batches_put_again_and_merged(spark, tmp_path, order):
    rng, folder, want = random.Random(5), str(tmp_path / "t"), {}
    batches = [[(rng.choice([None, *range(12)]), rng.randrange(6) if order else n, f"{n}.{i}") for i in range(9)] for n in range(7)]
    batches = [list({r[0]: r for r in b}.values()) for b in batches]
    put = lambda n: kept.put_rows(spark.createDataFrame(batches[n], SCHEMA), folder, "k", n, order, 4)
    assert kept.keyed_rows(spark, folder, FIELDS, "k", order).count() == 0 and kept.compact(spark, folder, FIELDS, "k", order) == 0
    for n, batch in enumerate(batches):
        put(n)
        for r in batch:
            if r[0] not in want or order is None or r[1] >= want[r[0]][1]:
                want[r[0]] = r
        if n in (3, 6):
            before = kept.stored_rows(spark, folder, FIELDS).select(*kept.FOLDERS).distinct().count()
            gone = kept.compact(spark, folder, FIELDS, "k", order, 2)
            after = kept.stored_rows(spark, folder, FIELDS).select(*kept.FOLDERS).distinct().count()
            assert gone and after < before
        put(n)  # the newest batch comes again, before or after a merge
        assert rows_of(kept.keyed_rows(spark, folder, FIELDS, "k", order)) == sorted(want.values(), key=str)


def test_only_touched_buckets_are_written(spark, tmp_path):
    folder = str(tmp_path / "t")
    kept.put_rows(spark.createDataFrame([(i, 0, "a") for i in range(50)], SCHEMA), folder, "k", 0, "at", 8)
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("*.parquet")}
    kept.put_rows(spark.createDataFrame([(3, 1, "b"), (3, 1, "b")], SCHEMA), folder, "k", 1, "at", 8)
    now = {p: p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("*.parquet")}
    assert files.items() <= now.items() and len(now) == len(files) + 1


def test_merge_that_stopped_before_its_folders_went(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "t")
    for n in range(4):
        kept.put_rows(spark.createDataFrame([(i, n, f"{n}") for i in range(n, 9)], SCHEMA), folder, "k", n, "at", 2)
    want = rows_of(kept.keyed_rows(spark, folder, FIELDS, "k", "at"))
    with monkeypatch.context() as m:
        m.setattr(kept.paths, "remove", lambda *a: None)
        kept.compact(spark, folder, FIELDS, "k", "at", 2)
    assert rows_of(kept.keyed_rows(spark, folder, FIELDS, "k", "at")) == want
    kept.compact(spark, folder, FIELDS, "k", "at", 2)
    assert rows_of(kept.keyed_rows(spark, folder, FIELDS, "k", "at")) == want
    assert kept.stored_rows(spark, folder, FIELDS).select("kept_bucket", "kept_batch").distinct().count() == 4  # two buckets, merged and newest


def test_stream_of_batches_with_repeated_keys(spark, tmp_path):
    source, args = str(tmp_path / "in"), (str(tmp_path / "t"), str(tmp_path / "state"), "k", "at")
    want = {}
    for run in range(2):
        for f in range(3):
            rows = [(i % 5, 10 * run + i, f"{run}{f}{i}") for i in range(f, f + 7)]
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
            for r in rows:
                want[r[0]] = max(want.get(r[0], (0, -1, "")), r, key=lambda x: (x[1], x[2][:2]))
        ingest(spark, source, SCHEMA, *args, files_per_batch=1, compact_at=2)
        got = current_rows(spark, args[0], SCHEMA, "k", "at")
        assert {r.k: r.at for r in got.collect()} == {k: r[1] for k, r in want.items()}


def test_rolling_table(spark, tmp_path):
    folder, schema = str(tmp_path / "r"), "k long, v string"
    fields = T.StructType.fromDDL(schema)
    table = lambda keys: spark.createDataFrame([(k, f"v{k}") for k in keys], schema)
    sizes = lambda: {r.bin: r.n for r in kept.rolled_rows(spark, folder, fields, 10).groupBy("bin").agg({"*": "count"}).toDF("bin", "n").collect()}
    assert kept.rolled_rows(spark, folder, fields, 10).count() == 0
    kept.roll(table([]), folder, "k", 10)
    assert kept.committed(spark, folder) == 0 and sizes() == {}
    kept.roll(table([*range(0, 46, 2), None, 4, 4]), folder, "k", 10)  # 23 keys, null and a key three times
    assert sizes() == {0: 10, 1: 10, 2: 4}
    kept.roll(table([*range(46), None]), folder, "k", 10)
    assert sizes() == {0: 10, 1: 10, 2: 10, 3: 10, 4: 7}
    rows = kept.rolled_rows(spark, folder, fields, 10).orderBy("row_no").collect()
    assert [r.row_no for r in rows] == list(range(47)) and [r.bin for r in rows] == [i // 10 for i in range(47)]
    assert [r.k for r in rows] == [None, *range(0, 46, 2), *range(1, 46, 2)]
    names = paths.children(spark, f"{folder}/open")
    kept.roll(table(range(46)), folder, "k", 10)  # nothing new
    assert paths.children(spark, f"{folder}/open") == names
    kept.roll(table(range(46, 49)), folder, "k", 10)
    assert sizes() == {0: 10, 1: 10, 2: 10, 3: 10, 4: 10} and all(len(list(p.glob("*.parquet"))) == 1 for p in (tmp_path / "r" / "full").glob("bin=*"))


def test_rolling_run_that_stopped(spark, tmp_path):
    folder, fields = str(tmp_path / "r"), T.StructType.fromDDL("k long")
    kept.roll(spark.range(15).toDF("k"), folder, "k", 10)
    kept.roll(spark.range(37).toDF("k"), folder, "k", 10)
    paths.remove(spark, f"{folder}/open/rows={37:020d}/_SUCCESS")  # the full files are there, the commit is not
    assert sorted(r.k for r in kept.rolled_rows(spark, folder, fields, 10).collect()) == list(range(15))
    kept.roll(spark.range(12, 31).toDF("k"), folder, "k", 10)
    got = kept.rolled_rows(spark, folder, fields, 10).orderBy("row_no").collect()
    assert [(r.k, r.row_no, r.bin) for r in got] == [(i, i, i // 10) for i in range(31)]
