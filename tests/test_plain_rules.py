"""The rules over Python strings: odd texts, many texts, and plans that send no table through the driver."""

import time

import pytest
from irloom.functions import ir
from irloom.operators import bpe, graphs
from irloom.plans import graph_queries, training_queries
from irloom.plans.graph_queries import encoder

TEXT = "define i32 @f(i32 %a) {{\nentry:\n  %p = alloca i32, align 4\n  store i32 {0}, ptr %p, align 4\n  %v = load i32, ptr %p, align 4\n  %c = icmp sgt i32 %v, {1}\n  br i1 %c, label %then, label %exit\nthen:\n  br label %exit\nexit:\n  ret i32 %v\n}}"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("define i32\n@func_x(i32 %a) {\r\n  ret i32 99\r\n}", "define i32\n@func0(i32 %var0) {\r\nret i32 <MED_INT>\r\n}"),
        ("source_filename = \"x\"\r\n@g = 17\u2028b: ", "\r\n@func0 = 17\u2028b:"), ("\u00e917 17\u00b2 17", "\u00e917 <MED_INT>\u00b2 <MED_INT>"), ('@"open %a', '@"open %var0'),
    ],
)
def test_odd_texts(text, want):
    """As Spark's own functions had it: ends of lines and borders of words are Java's."""
    assert ir.Normalizer()(text) == want


def test_lines_of_odd_functions():
    assert ir.body_of("define void @f() {\n ; c\n\n  switch i32 %a, label %b [\n  i32 1, label %c\n  ]\n  \n} \n") == "  switch i32 %a, label %b [\x01  i32 1, label %c\x01  ]\n"
    assert ir.blocks_of('define void @f() {\n"a b": ; x\n ret void\n100:\n}') == [("a b", '"a b"', ["ret void"]), ("100", "100", [])]
    assert ir.Lines().names('%"x y" = add i32 %a, %a ; %b') == ("x y", ["a"]) and ir.Lines().successors("%r = invoke @f() to label %a unwind label %b") == ["a", "b"]


def test_many_functions_take_little_time():
    """A millisecond each was too much; texts that differ only in what is masked are encoded once."""
    locate = graphs.Locator(encoder())
    began = time.process_time()
    rows = [locate(TEXT.format(1000 + i, 2000 + i)) for i in range(5000)]
    assert time.process_time() - began < 2.5 and len(locate.known) == 1
    blocks, ids, ranges, at = rows[-1]
    assert len(ranges) == 7 and set(at) == {"entry", "then", "exit"} and len(locate.control_edges(blocks, at)) == 3 and len(ids) > 50


def test_known_texts_give_the_same(monkeypatch):
    text = [TEXT.format(i, 5 * i) for i in range(40)] * 2
    locate = graphs.Locator(encoder())
    monkeypatch.setattr(graphs, "LONG", 0)  # nothing is remembered
    again = graphs.Locator(encoder())
    for t in text:
        a, b = locate(t), again(t)
        assert a[0] == b[0] and a[1].tolist() == b[1].tolist() and a[2:] == b[2:]


@pytest.mark.parametrize(("module", "name"), [(graph_queries, "cfg_edge_weights"), (training_queries, "pair_template"), (training_queries, "training_batches")])
def test_no_broadcast_of_tables_that_grow(spark, module, name):
    """A small file becomes much text, so its size says nothing about what a broadcast would take."""
    plan = getattr(module, name)(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    kept = [x for x in plan.split("\n") if "BroadcastHashJoin" in x and "__part" not in x]  # counts of parts, one row each
    assert kept == []


def test_texts_that_come_again_are_encoded_once():
    enc = bpe.Encoder([("a", "b")], bpe.plain_vocabulary("abc", [("a", "b")]))
    assert enc.encode_again("ab cab") is enc.encode_again("ab cab") and enc.encode_again("ab cab")[0].tolist() == enc.encode("ab cab")[0].tolist()
