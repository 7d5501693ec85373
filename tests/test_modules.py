"""Row indices on larger tables, graphs of real forms of IR, the normaliser's modes, vocabularies, readers and stages."""

import random

import pytest
from irloom.functions import text as X
from irloom.operators import bpe, graphs, tables, training
from irloom.plans.stages import rows_as_ready, run_stages
from irloom.sources import files
from pyspark.sql import functions as F

MODULE = """define i32 @func_main(i32 %a-0) {
  %"x y" = alloca i32
  store i32 %a-0, ptr %"x y"
  %v-2 = load i32, ptr %"x y" ; not %q
  switch i32 %v-2, label %other [
    i32 1, label %one-1
    i32 22, label %"two b"
  ]
one-1:    ; preds = %0
  %r = invoke i32 @f(i32 %v-2)
          to label %other unwind label %"two b"
"two b":
  %l = landingpad { ptr, i32 }
          cleanup
  resume { ptr, i32 } %l
other:
  ret i32 0
}
define void @second() {
  ret void
}"""


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_row_index_of_a_larger_table(spark):
    df = spark.range(600_000).select(F.md5(F.col("id").cast("string")).alias("key"), F.sha2(F.col("id").cast("string"), 256).alias("a"), F.sha2(F.hex("id"), 512).alias("b"))
    x = training.dense_row_index(df, "key", "i")
    got = x.agg(F.count_distinct("i").alias("n"), F.min("i").alias("least"), F.max("i").alias("most")).first()
    assert tuple(got) == (600_000, 0, 599_999)
    head = [r.key for r in x.where("i < 1000").orderBy("i").collect()]
    assert head == sorted(head) and head == [r.key for r in df.select("key").orderBy("key").limit(1000).collect()]
    assert training.dense_row_index(df.limit(0), "key", "i").count() == 0


def test_instructions_over_several_lines(spark):
    df = spark.createDataFrame([("f.ll", MODULE)], "file_path string, text string")
    rows = sorted((r.function_name, r.inst_id, r.block, r.line.split(" ")[0]) for r in graphs.ir_instructions(df).collect())
    assert [x[1:3] for x in rows if x[0] == "func_main"] == [(0, "entry"), (1, "entry"), (2, "entry"), (3, "entry"), (4, "one-1"), (5, "two b"), (6, "two b"), (7, "other")]
    assert ("second", 0, "entry", "ret") in rows
    edges = sorted((r.src, r.succ_no, r.dst, round(r.prob, 3)) for r in graphs.cfg_edges(df).collect())
    assert edges == [("entry", 0, "other", 0.333), ("entry", 1, "one-1", 0.333), ("entry", 2, "two b", 0.333), ("one-1", 0, "other", 0.5), ("one-1", 1, "two b", 0.5)]
    assert sorted((r.src_id, r.dst_id) for r in graphs.ddg_edges(df).collect()) == [(0, 1), (0, 2), (2, 3), (2, 4), (5, 6)]
    assert [(r.ptr, r.src_id, r.dst_id) for r in graphs.raw_dependence(df).collect()] == [("%x y", 1, 2)]
    assert [(r.n_edges, r.n_dropped) for r in graphs.cfg_edge_losses(df, encoder()).collect()] == [(5, 3)]  # the entry block has no label line
    rows = {r.function_name: r for r in graphs.build_dataset_rows(df, encoder()).collect()}
    assert rows["func_main"].success and len(rows["func_main"].ddg_graph) == 5 and len(rows["func_main"].cfg_graph) == 2
    assert rows["second"].success and rows["second"].error_message == "missing: ddg_graph, cfg_graph"
    weights = graphs.cfg_edges(df).where("src = 'one-1'").select(*graphs.KEY, "src", "succ_no", (F.col("succ_no") * 2 + 1.0).alias("weight"))
    assert sorted((r.dst, r.prob, r.label) for r in graphs.weigh_edges(graphs.cfg_edges(df), weights).where("src = 'one-1'").collect()) == [("other", 0.25, "25.0%"), ("two b", 0.75, "75.0%")]


def test_empty_modules(spark):
    df = spark.createDataFrame([("a", None), ("b", ""), ("c", "declare void @f()"), ("d", "define void @f() {\n}")], "file_path string, text string")
    for rows in (graphs.ir_instructions(df), graphs.cfg_edges(df), graphs.ddg_edge_align(df, encoder()), graphs.cfg_edge_align(df, encoder()), graphs.raw_dependence(df)):
        assert rows.count() == 0


def test_ranges_by_first_occurrence():
    """Ranges of tokens that overlap a place or lie in it; `1:` stands inside `11:` first, on a line of its own second."""
    enc = encoder([("1", "1"), ("x", "11")])
    text = "x11\n1 y"
    _, starts, ends = enc.encode(text)
    assert starts.tolist() == [0, 0, 4, 6, 0] and ends.tolist() == [0, 3, 5, 7, 0]
    of = lambda parts, contained=False, whole=False: graphs.token_ranges(graphs.first_places(text, parts, whole), parts, starts[1:-1], ends[1:-1], contained)
    at = lambda a, z: {"first": a, "last": z}
    assert of(["1", "x11", "1\n1", "z", "\n"]) == [at(1, 1), at(1, 1), at(1, 2), None, None]
    assert of(["1", "x11", "1\n1", "z"], True) == [None, at(1, 1), at(2, 2), None] and of(["1", "x", "1 y"], True, True) == [at(2, 2), None, at(2, 3)]
    assert graphs.first_places("11:\n1: x", ["1:", "11:"]) == [1, 0] and graphs.first_places("11:\n1: x", ["1:", "11:"], True) == [4, 0]


def test_many_texts_are_found_by_one_automaton(monkeypatch):
    rng = random.Random(4)
    text = "\n".join("".join(rng.choices("ab", k=rng.randint(0, 6))) for _ in range(300))
    parts = [*text.split("\n")[:200], "aabbaabbaabb", "zz", "b\na"]
    parts = [p for p in parts if p]
    want = [graphs.first_places(text, parts, w) for w in (False, True)]
    monkeypatch.setattr(graphs, "COMPARED", 0)
    assert [graphs.first_places(text, parts, w) for w in (False, True)] == want


def encoder(merges=(), atomic=bpe.ATOMIC):
    return bpe.Encoder(list(merges), bpe.plain_vocabulary("".join(map(chr, range(33, 127))), list(merges)), atomic)


def test_ranges_index_the_ids(spark):
    """Reading the ids of every range as text gives the normalised instruction or label."""
    df = spark.createDataFrame([("f.ll", MODULE)], "file_path string, text string")
    functions = graphs.ir_functions_of(df).select("file_path", X.normalize_ir(F.col("text")).alias("text"))
    merges = bpe.train_merges(functions, 40)
    enc = encoder(merges)
    token = {i: t for t, i in enc.ids.items()}
    normal = {"func_main": value(spark, X.normalize_ir(F.lit(MODULE.split("\ndefine void")[0])))}
    read = lambda ids, a, z: "".join(token[i] for i in ids[a : z + 1])
    squeezed = lambda t: "".join(t.split())
    rows = {r.function_name: r for r in graphs.build_dataset_rows(df, enc).collect()}
    ids = rows["func_main"].input_ids
    assert read(ids, 1, len(ids) - 2) == squeezed(normal["func_main"]) and (ids[0], ids[-1]) == (0, 2) and len(ids) < len(squeezed(normal["func_main"]))
    lines = {r.inst_id: r.needle for r in graphs.ir_functions_of(df).where("function_name = 'func_main'").select(F.posexplode(graphs.instructions_of(X.normalize_ir(F.col("text")))).alias("inst_id", "i")).select("inst_id", "i.needle").collect()}
    assert lines[3].startswith("switch") and lines[3].endswith("]") and "\nto label" in lines[4]
    edges = graphs.ddg_edge_align(df, enc).collect()
    assert sorted((e.src_id, e.dst_id) for e in edges) == [(0, 1), (0, 2), (2, 3), (2, 4), (5, 6)]
    for e in edges:
        assert read(ids, e.src_start, e.src_end) == squeezed(lines[e.src_id]) and read(ids, e.dst_start, e.dst_end) == squeezed(lines[e.dst_id])
    assert sorted(map(tuple, rows["func_main"].ddg_graph)) == sorted((e.src_start, e.src_end, e.dst_start, e.dst_end) for e in edges)
    labels = graphs.cfg_edge_align(df, enc, whole_lines=True).collect()
    assert labels and all(read(ids, e.dst_start, e.dst_end) == squeezed((f'"{e.dst}"' if " " in e.dst else e.dst) + ":") for e in labels)
    got = bpe.encode_with_offsets(functions.select("file_path", "text"), enc).collect()
    assert sorted(r.input_ids for r in got) == sorted(r.input_ids for r in rows.values())
    assert all([token[i] for i in r.input_ids[1:-1]] == [r.text[a:z] for a, z in zip(r.token_starts[1:-1], r.token_ends[1:-1], strict=True)] for r in got)


def test_functions_on_a_line_and_odd_names(spark):
    text = 'define void @f() {\n  ret void\n}\ndefine void @"a(b"() { ret void }\ndefine { ptr, i32 } @h({ i32 } %x) { ; {}\n  %y = insertvalue { i32 } %x, i32 1, 0\n  ret { ptr, i32 } zeroinitializer\n}\n@g = global i32 0\n'
    df = spark.createDataFrame([("m", text), ("e", ""), ("n", None)], "file_path string, text string")
    assert [(r.function_name, r.text.count("\n")) for r in tables.split_functions(df).collect()] == [("f", 2), ("a(b", 0), ("h", 3)]
    assert sorted((r.function_name, r.line) for r in graphs.ir_instructions(df).collect()) == [("a(b", "ret void"), ("f", "ret void"), ("h", "%y = insertvalue { i32 } %x, i32 1, 0"), ("h", "ret { ptr, i32 } zeroinitializer")]


def test_long_functions_take_a_join(spark, monkeypatch):
    body = "\n".join(f"  %v{i} = add i32 %v{max(0, i - 7)}, %v{i // 2}" for i in range(1, 60))
    df = spark.createDataFrame([("f.ll", "define i32 @f(i32 %v0) {\n" + body + "\n  ret i32 %v59\n}\n" + MODULE)], "file_path string, text string")
    enc = encoder()
    rows = lambda: (sorted(graphs.ddg_edges(df).collect()), sorted(graphs.ddg_edge_align(df, enc).collect()), sorted(graphs.build_dataset_rows(df, enc).collect(), key=lambda r: r.function_name))
    short = rows()
    assert len(short[0]) > 100 and len(short[0]) == len(short[1]) == sum(len(r.ddg_graph or []) for r in short[2])
    monkeypatch.setattr(graphs, "LONG", 10)
    assert rows() == short


def test_a_function_of_50000_instructions(spark):
    body = "\n".join(f"  %v{i} = add i32 %v{max(0, i - 1)}, {i}" for i in range(1, 50_001))
    df = spark.createDataFrame([("f.ll", "define i32 @f(i32 %v0) {\n" + body + "\n}")], "file_path string, text string")
    assert graphs.ddg_edges(df).count() == 49_999


@pytest.mark.parametrize(
    ("mode", "text", "want"),
    [
        ("regex", "define i32 @func_main(i32 %a) {\n100:\n  br label %100\n}", "define i32 @func0(i32 %var0) {\n100:\nbr label %<LARGE_INT>\n}"), ("regex", "declare i32 @bbox(i32)\ncall @bbox @foo", "declare i32 @func0(i32)\ncall @bbox @func1"),
        ("regex", 'call @"a b"() @c @"a b"', "call @func0() @func1 @func0"), ("advanced", 'declare i32 @x(i32) 99\n@x = c"hi 99!", align 73\n; 99\n100:\n  call @var1 99', 'declare i32 @x(i32) 99\n@func0 = c<STRING_CONST>, align 73\n; 99\n100:\n  call @func1 <MED_INT>'),
    ],
)
def test_normaliser_modes(spark, mode, text, want):
    assert value(spark, X.normalize_ir(F.lit(text), mode=mode)) == want


def test_vocabulary(spark, tmp_path):
    docs = spark.createDataFrame([(1, "low lower <func> lowest"), (2, "new newer low")], "doc_id long, text string")
    merges = bpe.train_merges(docs, 6)
    assert bpe.train_merges(docs, 6, together=1) == merges and 4 <= len(bpe.train_merges(docs, 6, together=8)) <= 6
    assert bpe.apply_merges(list("lower"), {("l", "o"): 0, ("lo", "w"): 1, ("w", "e"): 2}) == ["low", "e", "r"] and bpe.apply_merges(list("aaaaa"), {("a", "a"): 0}) == ["aa", "aa", "a"]
    vocab = bpe.vocabulary(docs, merges)
    bpe.save_vocab(vocab, merges, str(tmp_path / "v"))
    back, same = bpe.load_vocab(spark, str(tmp_path / "v"))
    assert same == merges and sorted(back.collect()) == sorted(vocab.collect())
    ids = {r.doc_id: r.input_ids for r in bpe.encode(docs, merges, vocab, atomic=bpe.ATOMIC).collect()}
    assert 5 in ids[1] and ids[1][0] == 0 and ids[1][-1] == 2
    assert "<bos>" in {r.token for r in bpe.missing_special_tokens(vocab).collect()} and bpe.vocab_stats(vocab).first().n_special == 9


def test_readers_and_stages(spark, tmp_path):
    folder = tmp_path / "ir" / "p-O1-h_functions"
    folder.mkdir(parents=True)
    (folder / "k.ll").write_text("one")
    (folder / "other.ll").write_text("")
    (folder / "function_map.csv").write_text("OriginalFunctionName,HashedFileName\nmain,k.ll\n")
    assert [(r.file_name, r.function_name, r.opt, r.text) for r in files.scan_corpus_dirs(spark, str(tmp_path / "ir")).collect()] == [("p-O1-h_functions", "main", "O1", "one")]
    names = spark.createDataFrame([("k.ll",), ("other.ll",), ("new.ll",)], "name string")
    assert {r.name for r in files.unprocessed_on_disk(spark, names, "name", str(tmp_path / "ir")).collect()} == {"other.ll", "new.ll"}
    with pytest.raises(FileNotFoundError):
        files.read_first_corpus(spark, [(str(tmp_path / "no"), "text")])
    ran = []
    stages = [(n, lambda x, n=n: ran.append(n) or x.withColumn(n, F.lit(1))) for n in ("a", "b", "c")]
    run_stages(spark, stages, spark.range(3), str(tmp_path / "s"))
    assert run_stages(spark, stages, spark.range(0), str(tmp_path / "s"), "c").columns == ["id", "a", "b", "c"] and ran == ["a", "b", "c", "c"]
    assert len(list(rows_as_ready(spark.range(5)))) == 5 and len(tables.to_pandas_head(spark.range(50), 7)) == 7
