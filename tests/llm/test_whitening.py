"""Whitening against a dense eigensolver, and each of its numerical parts."""

import math
import random

import numpy as np
import pytest
from irloom.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x string, component string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "clash", "clash") for i, v in rows], SCHEMA)


def plain(rows, components=16):
    """vec_id, deviation and whitened (up to the sign), shares; eigenvalues by numpy."""
    f32 = lambda v: [float(np.float32(c)) for c in v]
    good = [(i, tuple(math.floor(64 * c) + 1000000 for c in f32(v))) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({x for _, x in good}), dtype=object)
    n, s = len(fit), fit.sum(0)
    y = np.array([[int(n * a - b) for a, b in zip(x, s, strict=True)] for _, x in good], dtype=object)
    f = np.array([[n * a - b for a, b in zip(x, s, strict=True)] for x in fit], dtype=float) / n
    value, vector = np.linalg.eigh(f.T @ f / n)
    value, vector = value[::-1][:components], vector[:, ::-1][:, :components]
    return [i for i, _ in good], n, [sum(int(v) ** 2 for v in r) for r in y], (y.astype(float) / n) @ vector / np.sqrt(value), value / np.trace(f.T @ f / n)


def compare(got, want):
    ids, n, deviation, white, share = want
    k = white.shape[1]
    got = sorted(got, key=lambda r: (r.component, str(r.vec_id), r.deviation, abs(r.whitened)))
    assert len(got) == len(ids) * k and {r.n for r in got} == {n} and max(r.identity_error for r in got) < 1e-9 and len({r.identity_error for r in got}) == 1
    order = [sorted(range(len(ids)), key=lambda i: (str(ids[i]), deviation[i], abs(white[i, c]))) for c in range(k)]
    for c in range(k):
        part = got[c * len(ids) : (c + 1) * len(ids)]
        assert [(r.vec_id, r.deviation) for r in part] == [(ids[i], deviation[i]) for i in order[c]]
        assert all(r.explained == pytest.approx(share[c], rel=1e-9) for r in part)
        a, b = np.array([r.whitened for r in part]), np.array([white[i, c] for i in order[c]])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-6


def test_all_embeddings(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    compare(whitening.op12_whitening(spark, "/root/testdata/sf0.01").collect(), plain(rows))


def test_odd_rows(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 3), rng.gauss(1, 0.5), rng.gauss(0, 1)]) for i in range(300)]
    rows += [(7, rows[7][1])] * 200 + [(None, rows[3][1]), (900, [0.5, 0.5, 1e5]), (901, [-0.0, 1 / 64, -1 / 64])]
    odd = [(500, None), (501, [1.0, None, 2.0]), (502, [1.0, float("nan"), 2.0]), (503, [float("inf"), 1.0, 2.0]), (504, []), (505, [1.0, 2.0]), (506, [1e30, 0.0, 0.0])]
    compare(whitening.whiten(table(spark, rows + odd).repartition(7)).collect(), plain(rows))
    assert whitening.whiten(table(spark, odd[:5])).count() == 0 and whitening.whiten(table(spark, [])).count() == 0
    assert whitening.whiten(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0  # no variance
    assert sorted((r.vec_id, r.component, round(abs(r.whitened), 9), r.deviation) for r in whitening.whiten(table(spark, [(1, [1.0, 2.0]), (2, [2.0, 2.0])])).collect()) == [(1, 1, 1.0, 4096), (2, 1, 1.0, 4096)]


@pytest.mark.parametrize("kind", ["plain", "graded", "equal", "dependent", "few", "one"])
def test_directions(kind):
    rng = np.random.default_rng(3)
    a = rng.normal(size=(3 if kind == "few" else 200, 1 if kind == "one" else 12))
    if kind == "graded":
        a = a * 10.0 ** -np.arange(12)
    if kind == "equal":
        a = np.linalg.qr(a)[0]
    if kind == "dependent":
        a[:, 3], a[:, 5] = a[:, 4], 0
    r = np.linalg.qr(a, mode="r")
    r = np.vstack([r, np.zeros((a.shape[1] - len(r), a.shape[1]))])
    value, vector, share = whitening.whitening(r, len(a))
    v = a.T @ a / len(a)
    singular = np.linalg.svd(a, compute_uv=False)[: len(value)] ** 2 / len(a)
    assert np.allclose(value, singular, rtol=1e-9) and len(value) == np.sum(np.linalg.svd(a, compute_uv=False) > 1e-12 * np.linalg.norm(a))
    assert np.abs(vector @ vector.T - np.eye(len(value))).max() < 1e-11 and np.abs(vector @ v - value[:, None] * vector).max() < 1e-13 * value[0] * 10
    assert share.sum() == pytest.approx(1)


def test_steps():
    rng = np.random.default_rng(8)
    r = np.triu(rng.normal(size=(9, 9)))
    a, b, w = whitening.bidiagonal(r)
    m = np.diag(a) + np.diag(b, 1)
    assert np.allclose(w @ m.T @ m @ w.T, r.T @ r) and np.allclose(w.T @ w, np.eye(9))
    tiny = 10.0 ** -np.arange(0, 45, 5)  # a bidiagonal matrix fixes even its least singular values to high relative accuracy
    got = whitening.dqds(tiny, np.zeros(8))
    assert np.allclose(got, tiny**2, rtol=1e-13)
    assert whitening.dqds(np.array([0.0, 2.0, 0.0]), np.array([1.0, 3.0]))[-1] == 0
    assert whitening.qd_step([1.0, 1.0], [0.5], 5.0) is None
    big = np.array([[1 << 52, 5]]), 1 << 20, np.array([7 << 50, 9])
    assert whitening.times_n_minus_sum(*big).tolist() == [[(1 << 72) - (7 << 50), (5 << 20) - 9]]
    assert whitening.deviation(np.array([[1 << 40, 1]], dtype=object)) == [None] and whitening.deviation(np.array([[1 << 31, 3]], dtype=object)) == [(1 << 62) + 9]
