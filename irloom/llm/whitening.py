"""Operator 12, embedding whitening: blockwise QR, Householder bidiagonalisation, dqds and twisted factorisations.

Rows become whole numbers, each distinct vector is fitted once.  Tasks reduce their centred rows to
triangles, triangles are stacked and reduced in groups of FAN, and one triangle of dimension x
dimension reaches the driver, which finds the directions.  Only they go back to the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from irloom.llm.common import set_checkpoint_dir

#: Components of the result, triangles that meet in one task, rows of a block, and the first size of an entry that does not count as finite.
COMPONENTS, FAN, BLOCK, LIMIT = 16, 64, 4096, float(1 << 46)
EPS = np.finfo(float).eps


def lattice_rows(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and x, the entries as whole numbers floor(64 * c) + 1000000.

    Vectors that are null or empty or hold null, non-finite or enormous entries (2^46 and more) go,
    and so do those whose length is not the most frequent one (of equally frequent the longest).
    """
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= LIMIT))
    x = table.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"), F.size(v).alias("length")).where((F.col("length") > 0) & ~bad)
    usual = x.groupBy("length").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("length")).first()
    x = x.where(F.col("length") == (usual["length"] if usual else 0))
    return x.select("vec_id", F.transform("v", lambda c: F.floor(c * 64.0).cast("long") + F.lit(1000000).cast("long")).alias("x"))


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def times_n_minus_sum(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - S exactly: 64-bit numbers where they suffice, else Python's."""
    middle = sums // n
    near, rest = x - middle, sums - n * middle
    if near.size and n * (int(np.abs(near).max()) + 1) >= 1 << 62:
        near, rest = near.astype(object), rest.astype(object)
    return n * near - rest


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    return times_n_minus_sum(x, n, sums).astype(float) / n


def deviation(y: np.ndarray) -> list[int | None]:
    """Sums of squares of whole numbers, exactly; null beyond 2^63 - 1."""
    if y.size and y.dtype != object and int(np.abs(y).max()) ** 2 * y.shape[1] < 1 << 63:
        return (y * y).sum(1).tolist()
    exact = [sum(v * v for v in map(int, row)) for row in y]
    return [v if v < 1 << 63 else None for v in exact]


def tree(df: DataFrame, combine: Callable[[list[np.ndarray]], np.ndarray], levels: int = 3) -> np.ndarray | None:
    """Combines the arrays of at(int), part(binary) in groups of FAN until one is left; FAN^levels tasks are enough for any cluster."""

    def of_group(table: pa.Table) -> pa.Table:
        out = combine([np.frombuffer(p, float) for p in table.column("part").to_pylist()])
        return pa.table({"at": pa.array([table.column("at")[0].as_py() // FAN], pa.int32()), "part": pa.array([out.tobytes()], pa.binary())})

    for _ in range(levels):
        df = df.groupBy((F.col("at") / FAN).cast("int").alias("group")).applyInArrow(of_group, "at int, part binary")
    row = df.first()
    return np.frombuffer(row["part"], float) if row else None


def reduced(df: DataFrame, step: Callable[[np.ndarray | None, np.ndarray], np.ndarray], d: int) -> DataFrame:
    """at, part: each task's blocks of rows of x folded into one array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            for k in range(0, batch.num_rows, BLOCK):
                state = step(state, matrix(batch.column("x").slice(k, BLOCK), d))
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([state.tobytes()], pa.binary())], names=["at", "part"])

    return df.select("x").mapInArrow(run, "at int, part binary")


def triangle(fit: DataFrame, n: int, sums: np.ndarray) -> np.ndarray:
    """R of the QR factorisation of all centred rows, d x d."""
    d = len(sums)

    def stack(parts: list[np.ndarray]) -> np.ndarray:
        r = np.linalg.qr(np.vstack([p.reshape(-1, d) for p in parts]), mode="r")
        return np.vstack([r, np.zeros((d - len(r), d))])

    def step(state: np.ndarray | None, x: np.ndarray) -> np.ndarray:
        return stack(([] if state is None else [state]) + [centred(x, n, sums)])

    return tree(reduced(fit, step, d), stack).reshape(d, d)


def reflector(x: np.ndarray) -> np.ndarray | None:
    """The unit vector whose reflection sends x to a multiple of the first axis."""
    v = x.astype(float).copy()
    size = np.linalg.norm(v)
    if size == 0 or len(v) < 2 or not np.any(v[1:]):
        return None
    v[0] += np.copysign(size, v[0])
    return v / np.linalg.norm(v)


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """a, b, w of r = u B w^T: the diagonal and the superdiagonal of B, and the right reflections."""
    m, d = r.astype(float).copy(), r.shape[1]
    w = np.eye(d)
    for k in range(d):
        if (v := reflector(m[k:, k])) is not None:
            m[k:, k:] -= 2 * np.outer(v, v @ m[k:, k:])
        if k + 2 < d and (v := reflector(m[k, k + 1 :])) is not None:
            m[k:, k + 1 :] -= 2 * np.outer(m[k:, k + 1 :] @ v, v)
            w[:, k + 1 :] -= 2 * np.outer(w[:, k + 1 :] @ v, v)
    return np.diag(m).copy(), np.diag(m, 1).copy(), w


def qd_step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float]] | None:
    """One differential quotient-difference transform; none if the shift is beyond the least eigenvalue."""
    qq, ee, d = [], [], q[0] - shift
    for i in range(len(e)):
        if d < 0:
            return None
        qq.append(d + e[i])
        if qq[i] == 0:
            ee.append(0.0)
            d = q[i + 1] - shift
        else:
            t = q[i + 1] / qq[i]
            ee.append(e[i] * t)
            d = d * t - shift
    return None if d < 0 else ([*qq, d], ee)


def least_shift(q: list[float], e: list[float]) -> float:
    """1 / trace of the inverse, which no eigenvalue is below; only sums and quotients of positive numbers."""
    if min(q) <= 0:
        return 0.0
    column = 1 / q[0]
    trace = column
    for i in range(len(e)):
        column = (1 + e[i] * column) / q[i + 1]
        trace += column
    return (1 - 16 * EPS) / trace if np.isfinite(trace) else 0.0


def dqds(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The squared singular values of a bidiagonal matrix, falling, each to high relative accuracy."""
    found, todo, tiny = [], [([float(x) ** 2 for x in a], [float(x) ** 2 for x in b], 0.0)], (100 * EPS) ** 2
    while todo:
        q, e, sigma = todo.pop()
        while q:
            if len(q) == 1 or e[-1] <= tiny * (sigma + q[-1]):
                found.append(sigma + q.pop())
                e = e[: len(q) - 1] if q else []
                continue
            cut = next((i for i in range(len(e)) if e[i] <= tiny * (sigma + min(q))), None)
            if cut is not None:
                todo.append((q[: cut + 1], e[:cut], sigma))
                q, e = q[cut + 1 :], e[cut + 1 :]
                continue
            if q[0] < q[-1]:
                q, e = q[::-1], e[::-1]
            shift = least_shift(q, e)
            while (new := qd_step(q, e, shift)) is None:
                shift = shift / 4 if shift > EPS * max(q) else 0.0
            (q, e), sigma = new, sigma + shift
    return np.array(sorted(found, reverse=True))


def twisted(a: np.ndarray, b: np.ndarray, value: float) -> Iterator[np.ndarray]:
    """Unit vectors that solve the twisted factorisations of B^T B - value, the best place of the twist first."""
    n, small = len(a), EPS * EPS * max(float(np.abs(a).max()), float(np.abs(b).max(initial=0)))
    a = np.where(np.abs(a) < small, small, a)
    safe = lambda x: x if abs(x) > small * small else small * small
    lower, upper, s, p = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    s[0], p[-1] = -value, a[-1] ** 2 - value
    for i in range(n - 1):
        lower[i] = a[i] * b[i] / safe(s[i] + a[i] ** 2)
        s[i + 1] = lower[i] * b[i] / a[i] * s[i] - value
    for i in range(n - 2, -1, -1):
        t = a[i] ** 2 / safe(b[i] ** 2 + p[i + 1])
        upper[i] = b[i] / a[i] * t
        p[i] = p[i + 1] * t - value
    for k in np.argsort(np.abs(s + p + value), kind="stable"):
        z = np.zeros(n)
        z[k] = 1.0
        for i in range(k - 1, -1, -1):
            z[i] = -lower[i] * z[i + 1]
        for i in range(k, n - 1):
            z[i + 1] = -upper[i] * z[i]
        size = np.linalg.norm(z)
        if np.isfinite(size):
            yield z / size


def whitening(r: np.ndarray, n: int, components: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalues (falling), unit eigenvectors (rows) and shares of the trace, of the covariance r^T r / n.

    At most `components`, fewer where the rest are zero to rounding.  Eigenvectors of nearly equal
    eigenvalues are made orthogonal to those before; one that is not new takes another twist.
    """
    a, b, w = bidiagonal(r / np.sqrt(n))
    b[np.abs(b) <= 8 * EPS * np.minimum(np.abs(a[:-1]), np.abs(a[1:]))] = 0.0  # falls apart into blocks, whose vectors do not mix
    values = dqds(a, b)
    total = float(values.sum())
    kept = [v for v in values[:components] if v > len(a) * EPS * EPS * 1e4 * values[0]]
    done: list[np.ndarray] = []
    for k, value in enumerate(kept):
        near = [done[j] for j in range(k) if kept[j] - value < 1e-3 * value]
        best = np.zeros(len(a))
        for z in twisted(a, b, value):
            for _ in range(2):
                for u in near:
                    z = z - (u @ z) * u
            if np.linalg.norm(z) > np.linalg.norm(best):
                best = z
            if np.linalg.norm(best) > 0.5:
                break
        if np.linalg.norm(best) < 1e-6:
            raise ArithmeticError("no twisted factorisation gives another eigenvector")
        done.append(best / np.linalg.norm(best))
    rows = np.array([w @ z for z in done]).reshape(len(done), len(a))
    return np.array(kept), rows / np.linalg.norm(rows, axis=1, keepdims=True), np.array(kept) / (total or 1.0)


def identity_error(fit: DataFrame, n: int, sums: np.ndarray, to: np.ndarray) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity; to: d x k."""
    k = to.shape[1]

    def step(state: np.ndarray | None, x: np.ndarray) -> np.ndarray:
        z = centred(x, n, sums) @ to
        z = np.hstack([z, np.ones((len(z), 1))])
        return z.T @ z + (0 if state is None else state)

    moments = tree(reduced(fit, step, len(sums)), sum).reshape(k + 1, k + 1) / n
    return float(np.abs(moments[:k, :k] - np.outer(moments[k, :k], moments[k, :k]) - np.eye(k)).max())


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(table: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row for each remaining row and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Repeated vectors are fitted once and all returned; repeated and null ids stay as they are.  A
    table without rows, or whose vectors are all equal, gives no rows.  The fit list is stored once,
    as it is read three times.  Other columns are not read.
    """
    set_checkpoint_dir(table.sparkSession)
    rows = lattice_rows(table, id_col, vector_col)
    fit = rows.select("x").dropDuplicates().checkpoint()
    totals = fit.select(F.posexplode("x").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("s"), F.count(F.lit(1)).alias("n")).orderBy("at").collect()  # one row for each dimension
    if not totals:
        return table.sparkSession.createDataFrame([], SCHEMA)
    n, sums = totals[0]["n"], np.array([t["s"] for t in totals], np.int64)
    d = len(sums)
    values, directions, shares = whitening(triangle(fit, n, sums), n, components)
    k = len(values)
    if not k:
        return table.sparkSession.createDataFrame([], SCHEMA)
    to = directions.T / np.sqrt(values)
    error = identity_error(fit, n, sums, to)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                y = times_n_minus_sum(matrix(batch.column("x"), d), n, sums)
                m = len(y)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("vec_id").take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, np.int64)),
                        pa.array(deviation(y), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))), pa.array(((y.astype(float) / n) @ to).ravel()), pa.array(np.tile(shares, m)), pa.array(np.full(m * k, error)),
                    ], names=[c.split()[0] for c in SCHEMA.split(", ")],
                )

    return rows.mapInArrow(run, SCHEMA)


def op12_whitening(spark, sf_dir):
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: Eigenvectors are beyond SQL; tests hold the operator against a dense eigensolver.
SQL = None
