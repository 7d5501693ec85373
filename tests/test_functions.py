"""Worked cases of the text rules, graphs, splits, files and ingest."""

import pytest
from irloom.functions import text as X
from irloom.operators import bpe, graphs, tables, training
from irloom.sources import files
from irloom.streaming.ingest import current_rows, ingest
from pyspark.sql import functions as F

MODULE = """source_filename = "x"
; note
define i32 @main(i32 %a) {
entry:
  %p = alloca i32, align 4
  store i32 %a, ptr %p, align 4
  %b = load i32, ptr %p, align 4
  %c = icmp eq i32 %b, 1000
  br i1 %c, label %then, label %exit
then:
  br label %exit
exit:
  ret i32 %b ; done
}
!0 = !{i32 0}"""


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("add i32 %0, 16", "add i32 %0, 16"), ("x 17", "x <MED_INT>"), ("x 100", "x <LARGE_INT>"), ("x 1000", "x <HUGE_INT>"), ("x 73", "x <MED_INT>"), ("x 128", "x 128"), ("[99 x i8]", "[99 x i8]"),
        ("and 0x1F", "and <HEX_CONST>"), ("f 3.5", "f <FLOAT_CONST>"), ("f 3.55", "f 3.<MED_INT>"), ("%a = add i32 %b, %a", "%var0 = add i32 %var1, %var0"), ("%7, %.160", "%7, %.160"),
        ("br label %then", "br label %var0"), ("then:", "then:"), ("call @llvm.memcpy @.str @2.i2", "call @llvm.memcpy @.str @2.i2"), ("  ret i32 0 ; done", "ret i32 0"), ("call @foo @bar @foo", "call @func0 @bar @func0"), ('call @"a b" @z', "call @func0 @func1"), ("x !17", "x !17"),
    ],
)
def test_normalise(spark, line, want):
    got = value(spark, X.normalize_ir(F.lit(line)))
    assert got == (want.replace("@bar", "@func1"))


def test_small_rules(spark):
    assert value(spark, X.opt_level(F.lit("prog-O2-O0-x"))) == "O0"
    info = value(spark, X.binary_info(F.lit("r/a-b-O1-ff_functions/k.ll")))
    assert (info.ll_name, info.opt, info.binary, info.hash) == ("k.ll", "O1", "a-b", "ff")
    assert value(spark, X.keeps_function(F.lit("define i32 @f() {\n a\n b\n}"))) is False
    assert value(spark, X.keeps_function(F.lit("no function"))) is True
    assert value(spark, X.counted_lines(F.lit(MODULE))) == [11]
    assert value(spark, X.edge_probability(F.lit("62.5%"))) == 0.625
    assert value(spark, X.node_instruction_id(F.lit("x\\n(ID: 7)"))) == 7
    assert value(spark, X.block_label(F.lit("a\\n:b"))) == "a:"
    assert value(spark, X.strip_metadata(F.lit("ret i32 0, !dbg !12"))) == "ret i32 0"
    assert [value(spark, training.edge_bucket(F.lit(p))) for p in (0.0, 0.5, 1.0)] == [0, 9, 16]
    assert value(spark, X.mark_function(F.lit("a:\nb"))) == "<func>\na: <bb>\nb\n</func>"


def test_graphs(spark):
    df = spark.createDataFrame([("f.ll", MODULE)], "file_path string, text string")
    assert sorted((r.src, r.dst, r.prob) for r in graphs.cfg_edges(df).collect()) == [("entry", "exit", 0.5), ("entry", "then", 0.5), ("then", "exit", 1.0)]
    assert [(r.src_id, r.dst_id) for r in graphs.raw_dependence(df).collect()] == [(1, 2)]
    assert (2, 3) in {(r.src_id, r.dst_id) for r in graphs.ddg_edges(df).collect()}
    dot = spark.createDataFrame([('    Node0x1 [label="entry:"];',), ('    Node0x1 -> Node0x2 [label="62.5%"];',), ('  "0x1" -> "0x2" [color=blue];',)], "value string")
    assert [(r.id, r.label) for r in graphs.dot_nodes(dot).collect()] == [("Node0x1", "entry:")]
    assert [(r.src, r.dst, r.label) for r in graphs.dot_edges(dot).collect()] == [("Node0x1", "Node0x2", "62.5%"), ("0x1", "0x2", None)]
    edges = spark.createDataFrame([("f", 0, 0, 1, 2, 2, 0.5), ("f", 1, 1, 1, 2, 3, 0.7)], "file_path string, edge_no int, src_start int, src_end int, dst_start int, dst_end int, prob double")
    cells = {(r.i, r.j): r.weight for r in training.rasterize_edges(edges, F.col("prob")).collect()}
    assert cells == {(0, 2): 0.5, (1, 2): 0.7, (1, 3): 0.7}


def test_positive_groups_and_components(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, None)], "idx long, k string")
    assert {r.anchor_idx: r.positives for r in training.positive_map(df, ["k"], "idx").collect()} == {1: [2, 3], 2: [1, 3], 3: [1, 2]}
    edges = spark.createDataFrame([(i, i + 1) for i in range(20, 40)] + [(1, 2)], "src long, dst long")
    got = {r.id: r.component for r in training.connected_components(edges, spark.range(1, 45)).collect()}
    assert got[40] == 20 and got[2] == 1 and got[3] == 3
    loss = training.triplet_margin(spark.createDataFrame([([1.0, 0.0], [2.0, 0.0], [0.0, 3.0])], "a array<double>, p array<double>, n array<double>"), "a", "p", "n").first()
    assert loss.loss == 0.0
    split = training.group_split(spark.range(10).select(F.col("id").alias("idx"), F.col("id").alias("component")), "idx")
    assert {r["split"]: r["count"] for r in split.groupBy("split").count().collect()} == {"train": 9, "validation": 1}


def test_percentile_and_bpe(spark):
    assert tables.token_statistics(spark.range(1, 11), "id").first().p95 == 10
    docs = spark.createDataFrame([(1, "low lower lowest"), (2, "new newer low"), (3, "")], "doc_id long, text string")
    merges = bpe.train_merges(docs, 4)
    assert merges[:2] == [("l", "o"), ("lo", "w")]
    vocab = bpe.vocabulary(docs, merges)
    enc = bpe.encode(docs, merges, vocab)
    assert {r.doc_id: r.decoded for r in bpe.decode(enc, vocab).collect()} == {1: "lowlowerlowest", 2: "newnewerlow", 3: ""}


def test_files_and_ingest(spark, tmp_path):
    folder = tmp_path / "ir" / "p-O1-h_functions"
    folder.mkdir(parents=True)
    (folder / "k.ll").write_text(MODULE)
    (folder / "k.txt").write_text("no")
    (folder / "function_map.csv").write_text("OriginalFunctionName,HashedFileName\nold,k.ll\nmain,k.ll\n")
    assert files.scan_ir_files(spark, str(tmp_path / "ir"), functions_only=True).count() == 1
    assert [(r.function_name, r.ll_name) for r in files.read_function_map(spark, str(folder / "function_map.csv")).collect()] == [("main", "k.ll")]
    files.write_text_corpus(spark.createDataFrame([("one",), ("two",)], "text string"), str(tmp_path / "corpus"))
    assert {"one", "two"} <= {r.text for r in files.read_text_corpus(spark, str(tmp_path / "corpus")).collect()}
    source, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for n, rows in enumerate(([(1, "a"), (2, "a")], [(2, "b"), (3, "b")])):
        spark.createDataFrame(rows, "k long, v string").coalesce(1).write.mode("append").parquet(source)
        ingest(spark, source, "k long, v string", target, state, "k", "v")
        assert spark.read.parquet(f"{target}/rows").select("kept_batch").distinct().count() == n + 1
    assert {r.k: r.v for r in current_rows(spark, target, "k long, v string", "k", "v").collect()} == {1: "a", 2: "b", 3: "b"}


def test_offsets_of_long_texts(spark):
    """One pass: 400,000 tokens of one text, and special tokens that stand close to others."""
    import time

    text = "ab <func>,c<bb>  é %<bb> " * 50_000
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "id long, text string")
    began = time.time()
    rows = {r.id: r.o for r in df.select("id", X.token_offsets(F.col("text"), ("<func>", "<bb>")).alias("o")).collect()}
    assert time.time() - began < 30 and rows[2] is None and [tuple(o) for o in rows[3]] == [(0, 0), (0, 0)]
    got = [text[a:z] for a, z in rows[1][1:-1]]
    assert got[:8] == ["ab", "<func>", ",", "c", "<bb>", "é", "%", "<bb>"] and len(got) == 400_000 and got[-8:] == got[:8]


def test_no_anchor_is_dropped(spark):
    """In a group of 95 % of the rows every anchor gets a row outside it."""
    from collections import Counter

    from irloom.operators import training

    df = spark.range(2000).select(F.col("id").alias("i"), F.when(F.col("id") % 20 > 0, "big").when(F.col("id") % 40 == 0, "small").otherwise("other").alias("k"))
    group = {r.i: r.k for r in df.collect()}
    ranges = training.group_ranges(df, ["k"], "i")
    for rows in (training.drawn_triplets(ranges, "i", 2000).collect(), training.triplets(training.positive_map(df, ["k"], "i"), 2000).collect()):
        assert len(rows) == 2000 and all(group[r.negative_idx] != group[r.anchor_idx] == group[r.positive_idx] and r.positive_idx != r.anchor_idx for r in rows)
        drawn = Counter(r.negative_idx for r in rows if group[r.anchor_idx] == "big")
        assert len(drawn) == 100 and max(drawn.values()) < 60  # 1900 draws of 100 rows
    one = spark.createDataFrame([(0, "a"), (1, "a"), (2, None)], "i long, k string")
    assert {r.negative_idx for r in training.drawn_triplets(training.group_ranges(one, ["k"], "i"), "i", 2).collect()} == {None}
    assert {r.negative_idx for r in training.triplets(training.positive_map(one, ["k"], "i"), 3).collect()} == {2}


def test_exact_merges(spark, monkeypatch):
    """The index of pairs gives the merges of counting all pairs anew for each, and so do the rounds over partitions."""
    import random
    from collections import Counter

    rng = random.Random(6)
    words = {"".join(rng.choices("abcdé_", weights=[9, 5, 3, 2, 2, 1], k=rng.randint(1, 12))): rng.randint(1, 50) for _ in range(400)}

    def plain(n):
        now, out = {w: list(w) for w in words}, []
        while len(out) < n:
            total = Counter()
            for w, s in now.items():
                for p in zip(s, s[1:]):
                    total[p] += words[w]
            best = min(((-c, *p) for p, c in total.items() if c >= 2), default=None)
            if best is None:
                return out
            out.append(best[1:])
            now = {w: bpe.apply_merges(s, {best[1:]: 0}) for w, s in now.items()}
        return out

    want = plain(10_000)
    assert len(want) > 500 and bpe.learn_merges([list(w) for w in words], list(words.values()), 10_000, 2) == want
    docs = spark.createDataFrame([(" ".join([w] * n),) for w, n in words.items()], "text string")
    assert bpe.train_merges(docs, 10_000) == want
    monkeypatch.setattr(bpe, "INDEXED", 0)
    assert bpe.train_merges(docs, 12) == want[:12]
