"""Whitening of embeddings: leading principal components of distinct vectors, scaled to variance one.

Entries become whole numbers first.  Tasks add up exact sums and then products of centred entries; only
those D and D x D numbers reach the driver.  There the covariance is reduced to a tridiagonal matrix by
Householder reflections, its leading eigenvalues are found by bisection on Sturm counts, and their
vectors by inverse iteration, made orthogonal to each other within clusters of close eigenvalues.  The
components are sent to every task, which projects its rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import pick, stage

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
#: Whole numbers beyond this are held at it, so that a task's sums stay exact.
FAR = 1 << 45
#: Rows that are worked on at a time.
AT_ONCE = 2_000
EPS = np.finfo(float).eps


# ---------------------------------------------------------------- eigenvectors of a symmetric matrix


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, off-diagonal and the orthogonal Q with a = Q T Q', by Householder reflections."""
    a = np.array(a, float)
    n = len(a)
    q = np.eye(n)
    for k in range(n - 2):
        x = a[k + 1:, k].copy()
        high = np.abs(x[1:]).max(initial=0.0)
        if not high:
            continue
        norm = np.linalg.norm(x / max(high, abs(x[0]))) * max(high, abs(x[0]))
        x[0] += norm if x[0] >= 0 else -norm
        v = x / np.linalg.norm(x)
        rest = a[k + 1:, k + 1:]
        p = rest @ v
        w = p - (v @ p) * v
        rest -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1:, k] -= 2 * v * (v @ a[k + 1:, k])
        a[k, k + 1:] = a[k + 1:, k]
        q[:, k + 1:] -= 2 * np.outer(q[:, k + 1:] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), q


def below(d: np.ndarray, e: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Sturm counts: how many eigenvalues of the tridiagonal matrix are less than each x."""
    tiny = max(np.finfo(float).tiny * 4, EPS ** 2 * np.abs(d).max(initial=0.0), np.finfo(float).tiny * float((e ** 2).max(initial=1.0)))
    count = np.zeros(len(x), int)
    q = np.ones(len(x))
    for i in range(len(d)):
        q = d[i] - x - (e[i - 1] ** 2 / q if i else 0.0)
        q = np.where(np.abs(q) < tiny, -tiny, q)
        count += q < 0
    return count


def leading(d: np.ndarray, e: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, each halved in until its interval cannot shrink."""
    n = len(d)
    reach = np.r_[0.0, np.abs(e)] + np.r_[np.abs(e), 0.0]
    pad = 2 * EPS * np.abs(np.r_[d - reach, d + reach]).max() + np.finfo(float).tiny
    low, high = np.full(k, (d - reach).min() - pad), np.full(k, (d + reach).max() + pad)
    wanted = n - 1 - np.arange(k)  # of this many eigenvalues the wanted one is the next
    for _ in range(2_100):  # halving doubles ends long before
        mid = 0.5 * (low + high)
        open_ = (mid > low) & (mid < high) & (high - low > 0.5 * EPS * np.maximum(np.abs(low), np.abs(high)))
        if not open_.any():
            break
        up = below(d, e, mid) <= wanted
        low, high = np.where(open_ & up, mid, low), np.where(open_ & ~up, mid, high)
    return 0.5 * (low + high)


def _factored(d: np.ndarray, e: np.ndarray, x: float, least: float) -> list[tuple]:
    """Rows of the elimination of T - x with partial pivoting: (pivot, next, next but one, factor, swapped); no pivot is smaller than ``least``."""
    n = len(d)
    rows = []
    a, b, c = d[0] - x, e[0] if n > 1 else 0.0, 0.0
    for i in range(n - 1):
        sub, dia, sup = e[i], d[i + 1] - x, e[i + 1] if i + 2 < n else 0.0
        if abs(a) >= abs(sub):
            a = a if abs(a) > least else np.copysign(least, a)
            f = sub / a
            rows.append((a, b, c, f, False))
            a, b, c = dia - f * b, sup - f * c, 0.0
        else:
            f = a / sub
            rows.append((sub, dia, sup, f, True))
            a, b, c = b - f * dia, c - f * sup, 0.0
    rows.append((a if abs(a) > least else np.copysign(least, a), 0.0, 0.0, 0.0, False))
    return rows


def _solved(rows: list, y: np.ndarray) -> np.ndarray:
    y = list(y)
    n = len(rows)
    for i in range(n - 1):
        if rows[i][4]:
            y[i], y[i + 1] = y[i + 1], y[i]
        y[i + 1] -= rows[i][3] * y[i]
    for i in range(n - 1, -1, -1):
        a, b, c, _, _ = rows[i]
        y[i] = (y[i] - (b * y[i + 1] if i + 1 < n else 0.0) - (c * y[i + 2] if i + 2 < n else 0.0)) / a
    return np.array(y)


def vectors(d: np.ndarray, e: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors of the tridiagonal matrix, one a row, by inverse iteration; orthogonal within clusters."""
    n = len(d)
    norm = max(np.abs(d).max(), np.abs(e).max(initial=0.0), np.finfo(float).tiny / EPS ** 2)
    rng = np.random.default_rng(5)
    out = np.zeros((len(values), n))
    first = 0
    for j, value in enumerate(values):
        if j and values[j - 1] - value > 1e-3 * norm:
            first = j
        # equal eigenvalues are told apart a little, so that their solves differ
        rows = _factored(d, e, value - (j - first) * 4 * EPS * norm, EPS * norm)
        y = rng.standard_normal(n)
        for _ in range(5):
            y = _solved(rows, y / np.abs(y).max())
            y /= np.abs(y).max()
            for _ in range(2):
                y -= out[first:j].T @ (out[first:j] @ y)
            y /= np.linalg.norm(y)
        out[j] = y
    return out


def eigen(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix, falling, and their unit vectors as rows."""
    d, e, q = tridiagonal(a)
    values = leading(d, e, min(k, len(d)))
    found = vectors(d, e, values) @ q.T
    return values, found / np.linalg.norm(found, axis=1, keepdims=True)


# ---------------------------------------------------------------- distributed part


def _coded(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Ids and whole-number vectors (as bytes) of the rows whose vector is whole and finite."""
    lists = batch.column(1)
    flat = lists.flatten()  # leaves out what null rows hold
    lengths = np.where(lists.is_null().to_numpy(zero_copy_only=False), 0, np.nan_to_num(np.asarray(lists.value_lengths().fill_null(0)))).astype(np.int64)
    ends = np.cumsum(lengths)
    c = flat.to_numpy(zero_copy_only=False).astype(float)  # nulls turn into nan
    bad = ~np.isfinite(c)
    x = np.floor(np.clip(np.where(bad, 0.0, c) * SCALE, -FAR, FAR)).astype("<i8") + SHIFT
    lost = np.r_[0, np.cumsum(bad)]
    keep = lists.is_valid().to_numpy(zero_copy_only=False) & (lost[ends] == lost[ends - lengths])
    packed = pa.Array.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(np.r_[0, ends].astype("<i8") * 8), pa.py_buffer(x)])
    out = [batch.column(0), pa.array(lengths.astype(np.int32)), packed.cast(pa.binary())]
    return pa.RecordBatch.from_arrays([o.filter(pa.array(keep)) for o in out], ["id", "dims", "x"])


def coded(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, dims, x): x holds floor(64 * c) + 1000000 of every entry; rows with a null or non-finite entry are left out."""
    d = pick(rows, id_col, vector_col).toDF("id", "vector").withColumn("vector", F.col("vector").cast("array<double>"))
    schema = T.StructType([T.StructField("id", d.schema["id"].dataType), T.StructField("dims", T.IntegerType()), T.StructField("x", T.BinaryType())])
    return d.mapInArrow(lambda batches: (_coded(b.slice(at, AT_ONCE)) for b in batches for at in range(0, b.num_rows, AT_ONCE)), schema)


def _numbers(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of whole numbers, one vector a row."""
    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    return np.frombuffer(column.buffers()[2], "<i8", (ends[-1] - ends[0]) // 8, ends[0]).reshape(-1, dims) if len(column) else np.zeros((0, dims), np.int64)


def _parts(batches: Iterator[pa.RecordBatch], name: str, dims: int) -> Iterator[np.ndarray]:
    for b in batches:
        for at in range(0, b.num_rows, AT_ONCE):
            yield _numbers(b.slice(at, AT_ONCE).column(name), dims)


def _summed(fit: DataFrame, dims: int, add: Callable[[Iterator[np.ndarray]], np.ndarray]) -> dict[int, float]:
    """Sums over all tasks of what each adds up, one number a place; as many tasks as cores, so that the parts do not grow with the rows."""
    def run(batches):
        got = add(_parts(batches, "x", dims))
        for at in range(0, len(got), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(range(at, min(at + 50_000, len(got))), pa.int64()), pa.array(got[at:at + 50_000], pa.float64())], ["place", "v"])

    many = fit.select("x").coalesce(2 * fit.sparkSession.sparkContext.defaultParallelism)
    return {r.place: r.v for r in many.mapInArrow(run, "place long, v double").groupBy("place").agg(F.sum("v").alias("v")).collect()}


def _centred(x: np.ndarray, base: np.ndarray, part: np.ndarray) -> np.ndarray:
    """x - S / n without loss: whole numbers first, then the fraction of the mean."""
    return (x - base) - part


@dataclass
class Whitening:
    """n distinct vectors, S as whole numbers, components as rows, their eigenvalues, trace and the identity's error."""

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float
    error: float = 0.0

    def __post_init__(self):
        self.base = np.array([s // self.n for s in self.sums], np.int64)
        self.left = [s - int(b) * self.n for s, b in zip(self.sums, self.base)]
        self.part = np.array([r / self.n for r in self.left])

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return _centred(x, self.base, self.part) @ self.components.T / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2, exact; null where it does not fit a long."""
        gap = x - self.base
        most = (int(np.abs(gap).max(initial=0)) + 1) * self.n
        if most * most * max(1, len(self.sums)) < 1 << 63:
            y = gap * self.n - np.array(self.left, np.int64)
            return (y * y).sum(1).tolist()
        whole = [sum((int(g) * self.n - r) ** 2 for g, r in zip(row, self.left)) for row in gap]
        return [w if w < 1 << 63 else None for w in whole]


def fit(known: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Fit on a table (x) of distinct coded vectors of one length; None without a row or without any variance."""
    size = known.agg(F.count("x").alias("n"), F.first(F.octet_length("x")).alias("b")).first()
    if not size.n or not size.b:
        return None
    n, dims = size.n, size.b // 8

    def total(batches):
        sums = [0] * dims
        for x in _parts(batches, "x", dims):
            sums = [a + int(b) for a, b in zip(sums, x.sum(0))]
        yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array([str(s) for s in sums])], ["dim", "s"])

    many = known.select("x").coalesce(2 * known.sparkSession.sparkContext.defaultParallelism)
    got = many.mapInArrow(total, "dim int, s string").groupBy("dim").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    by_dim = {r.dim: int(r.s) for r in got}
    sums = [by_dim[i] for i in range(dims)]
    empty = Whitening(n, sums, np.zeros(0), np.zeros((0, dims)), 0.0)
    base, part = empty.base, empty.part
    upper = np.triu_indices(dims)

    def products(parts):
        g = np.zeros((dims, dims))
        for x in parts:
            c = _centred(x, base, part)
            g += c.T @ c
        return g[upper]

    flat = _summed(known, dims, products)
    v = np.zeros((dims, dims))
    v[upper] = [flat[i] / n for i in range(len(upper[0]))]
    v = np.triu(v) + np.triu(v, 1).T
    trace = float(np.trace(v))
    values, found = eigen(v, components)
    real = values > dims * EPS * trace
    if not real.any():
        return None
    model = Whitening(n, sums, values[real], found[real], trace)
    k = int(real.sum())

    def white(parts):
        g, s = np.zeros((k, k)), np.zeros(k)
        for x in parts:
            w = model.whiten(x)
            g += w.T @ w
            s += w.sum(0)
        return np.r_[g.ravel(), s]

    flat = _summed(known, dims, white)
    g, s = np.array([flat[i] for i in range(k * k)]).reshape(k, k) / n, np.array([flat[k * k + i] for i in range(k)]) / n
    model.error = float(np.abs(g - np.outer(s, s) - np.eye(k)).max())
    return model


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per remaining vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Vectors that are null or hold a null or non-finite entry are left out.  Of vectors of several lengths the most
    frequent length remains (the shorter one at equal counts); vectors of no entry are left out.  Repeated rows, ids and
    null ids stay rows of their own, but a vector counts once in the fit.  Components without variance are not returned,
    so equal vectors, a single one and an empty table give no row.  Entries beyond 2^45 are held there; a deviation that
    fits no long is null.  Other columns are not looked at.  The driver and every task hold D x D numbers.
    """
    table = stage(coded(rows, id_col, vector_col), "whitening-coded")
    schema = T.StructType([T.StructField(id_col, table.schema["id"].dataType)] + T.StructType.fromDDL(
        "component int, n long, deviation long, whitened double, explained double, identity_error double").fields)
    common = table.filter("dims > 0").groupBy("dims").count().orderBy(F.desc("count"), "dims").first()
    dims = common.dims if common else 0
    table = table.filter(F.col("dims") == dims) if dims else table.limit(0)
    model = fit(stage(table.select("x").distinct(), "whitening-fit"), components) if dims else None
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)
    held = rows.sparkSession.sparkContext.broadcast(model)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        k = len(m.values)
        share = m.values / m.trace
        for b in (b.slice(at, AT_ONCE) for b in batches for at in range(0, b.num_rows, AT_ONCE)):
            x = _numbers(b.column("x"), dims)
            each = np.repeat(np.arange(len(x)), k)
            yield pa.RecordBatch.from_arrays([
                b.column("id").take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(each), m.n)),
                pa.array(m.deviations(x), pa.int64()).take(pa.array(each)), pa.array(m.whiten(x).ravel()), pa.array(np.tile(share, len(x))), pa.array(np.full(len(each), m.error)),
            ], schema.names)

    return table.select("id", "x").mapInArrow(project, schema)
