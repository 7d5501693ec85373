"""The corpus of function folders: the data source in batch and as a stream, and the three forms of the corpus."""

import json

from irloom.functions import text as X
from irloom.sources import corpus, files, folders
from pyspark.sql import functions as F

BODY = 'define i32 @f_main(i32 %x) {{\n  %y = add i32 %x, {}\n  %s = call ptr @g(ptr @"q r")\n  ret i32 %y\n}}\n'


def folder(root, name, texts, mapped=None):
    at = root / name
    at.mkdir(parents=True, exist_ok=True)
    for n, t in texts.items():
        (at / n).write_bytes(t if isinstance(t, bytes) else t.encode())
    lines = "".join(f"{f},{n}\n" for n, f in (mapped or {n: n[:-3] for n in texts}).items())
    (at / "function_map.csv").write_text("OriginalFunctionName,HashedFileName\n" + lines)


def tree(root):
    folder(root, "p-O1-h_functions", {"a.ll": BODY.format(5), "b.ll": BODY.format(700), "c.txt": "no", "d.ll": " \n"})
    folder(root, "q-Os-h_functions", {"a.ll": BODY.format(73), "no.ll": "unnamed"}, {"a.ll": "main", "gone.ll": "x", "e.ll": ""})
    (root / "without_map").mkdir()
    (root / "without_map" / "z.ll").write_text("z")


def test_folders_as_the_scan_reads_them(spark, tmp_path):
    tree(tmp_path)
    names = ["file_path", "file_name", "function_name", "opt", "text"]
    x = folders.read_folders(spark, str(tmp_path))
    assert x.rdd.getNumPartitions() == 2 and x.where("error is not null").count() == 0
    got, want = (sorted(map(tuple, df.select(names).collect())) for df in (x, files.scan_corpus_dirs(spark, str(tmp_path))))
    assert got == want and len(got) == 4
    folder(tmp_path, "r-O3-h_functions", {"bad.ll": b"\xff\xfe define", "good.ll": "x"})
    rows = {r.function_name: r for r in folders.read_folders(spark, str(tmp_path)).where("file_name like 'r-%'").collect()}
    assert rows["good"].text == "x" and rows["good"].error is None and rows["bad"].text is None and rows["bad"].error.startswith("UnicodeDecodeError")
    (tmp_path / "empty").mkdir()
    assert folders.read_folders(spark, str(tmp_path / "empty")).count() == 0


def test_a_stream_of_folders_goes_on_where_it_was(spark, tmp_path):
    root, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    tree(root)
    seen = []
    for n in range(3):
        folder(root, f"s{n}-O2-h_functions", {"a.ll": f"{n}"})
        query = folders.read_folders(spark, str(root), stream=True).writeStream.format("parquet").option("checkpointLocation", state).start(out)
        query.processAllAvailable()
        query.stop()
        seen.append(spark.read.parquet(out).count())
    assert seen == [5, 6, 7]
    assert sorted((r.file_path, r.text) for r in spark.read.parquet(out).collect()) == sorted((r.file_path, r.text) for r in folders.read_folders(spark, str(root)).collect())


def test_the_corpus_in_three_forms(spark, tmp_path):
    root, out = tmp_path / "in", tmp_path / "out"
    tree(root)
    for mode in ("regex", "advanced"):
        rows = corpus.build_corpus(spark, str(root), str(out / mode), mode).collect()
        normal = {v: spark.range(1).select(X.normalize_ir(F.lit(BODY.format(v).strip()), mode=mode).alias("v")).first().v for v in (5, 700, 73)}
        assert sorted(r.text for r in rows) == sorted(normal.values())
        by = {(r.metadata.file_name, r.metadata.function_name): r for r in rows}
        one = by["q-Os-h_functions", "main"]
        assert one.metadata.opt == "Os" and one.metadata.file_path.endswith("/a.ll")
        assert one.metadata.original_length == len(BODY.format(73).strip()) and one.metadata.normalized_length == len(normal[73]) and one.text == normal[73]
        assert ("i32 %var0, 73" in one.text) == (mode == "advanced")
        lines = [json.loads(x) for p in (out / mode / "jsonl").glob("*.json") for x in p.read_text().splitlines()]
        assert sorted((x["text"], x["metadata"]["normalized_length"]) for x in lines) == sorted((r.text, r.metadata.normalized_length) for r in rows)
        assert {r.text for r in files.read_text_corpus(spark, str(out / mode / "text_only")).collect()} >= {t.strip() for t in normal.values()}
        counters = spark.read.json(str(out / mode / "counters")).first().asDict()
        assert counters == {"total_files": 4, "processed_files": 3, "failed_files": 0, "total_functions": 3, "total_lines": sum(t.count("\n") + 1 for t in normal.values())}
    failed = folders.read_folders(spark, str(root)).withColumn("text", F.when(F.col("function_name") != "a", F.col("text")))
    assert corpus.corpus_counters(failed, corpus.corpus_rows(failed)).first().failed_files == 1
    assert corpus.corpus_rows(failed.limit(0)).count() == 0
