"""Rows without graphs: null and empty ones, which real functions do not have side by side."""

from irloom.operators import tables

ROWS = [(0, "x" * 300, None, None), (1, "b", [], [[1.0]]), (2, "c", [[1]], None), (3, "d", [[1]], [[1.0]]), (4, None, [], [])]


def test_missing_graphs(spark):
    x = spark.createDataFrame(ROWS, "i int, text string, ddg_graph array<array<int>>, cfg_graph array<array<float>>")
    assert sorted(r.i for r in tables.filter_missing_graphs(x).collect()) == [1, 3, 4]  # an empty graph passes
    shown = {kind: [(r.i, r.text) for r in tables.show_missing(x, kind, "i", 5, "text").collect()] for kind in ("ddg", "cfg", "both")}
    assert shown["both"] == [(0, "x" * 200), (4, None)] and [i for i, _ in shown["ddg"]] == [0, 1, 4] and [i for i, _ in shown["cfg"]] == [0, 2, 4]
    r = tables.missing_graph_stats(x).first()
    assert (r.total, r.missing_ddg_only, r.missing_cfg_only, r.missing_both, r.has_both, float(r.missing_percent)) == (5, 1, 1, 2, 1, 80.0)
    assert tables.missing_graph_stats(x.where("false")).first().total == 0
