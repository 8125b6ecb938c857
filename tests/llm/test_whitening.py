import math

import numpy as np
import pytest

from tabwise.llm import whitening as W


def brute(vectors):
    x = np.unique(np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors], np.int64), axis=0)
    s = x.sum(0)
    c = (len(x) * x - s) / len(x)
    v = c.T @ c / len(x)
    e, q = np.linalg.eigh(v)
    return x, s, e[::-1], q.T[::-1], np.trace(v)


@pytest.mark.parametrize("kind", ["plain", "ties", "blocks", "one", "rank"])
def test_eigenvectors(kind):
    rng = np.random.default_rng(3)
    n = {"one": 1, "plain": 40}.get(kind, 24)
    q, _ = np.linalg.qr(rng.standard_normal((n, n)))
    values = np.sort(rng.random(n))[::-1] * 100
    if kind == "ties":
        values[:6] = 90.0
        values[6] = 90.0 - 1e-13
    if kind == "rank":
        values[3:] = 0
    a = np.kron(np.eye(4), np.array([[2.0, 1, 0], [1, 2, 1], [0, 1, 2]])) if kind == "blocks" else (q * values) @ q.T
    a = (a + a.T) / 2
    want = np.linalg.eigvalsh(a)[::-1]
    e, v = W.eigen(a, 16)
    k = len(e)
    assert np.allclose(e, want[:k], rtol=0, atol=2e-13 * want[0])
    assert np.abs(v @ v.T - np.eye(k)).max() < 1e-12
    assert np.abs(a @ v.T - v.T * e).max() < 1e-12 * want[0]


def test_sturm_counts():
    rng = np.random.default_rng(1)
    d, e = rng.standard_normal(30), rng.standard_normal(29)
    e[4] = 0
    t = np.diag(d) + np.diag(e, 1) + np.diag(e, -1)
    known = np.linalg.eigvalsh(t)
    x = rng.standard_normal(50) * 2
    assert (W.below(d, e, x) == (known[None] < x[:, None]).sum(1)).all()


def test_rows_against_brute_force(spark):
    rng = np.random.default_rng(8)
    good = (rng.standard_normal((300, 20)) * np.linspace(3, 0.1, 20)).astype(np.float32)
    good[100:150] = good[7]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(good)] + [(5, good[5].tolist(), None), (None, good[9].tolist(), 2)]
    bad = [(900, None, 1), (901, [None] + [1.0] * 19, 1), (902, [float("nan")] * 20, 1), (903, [float("inf")] + [0.0] * 19, 1), (904, [], 1), (905, [1.0, 2.0], 1)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, Component int").repartition(5)
    x, s, e, q, trace = brute(good)
    n = len(x)
    out = W.whiten(df).collect()
    assert len(out) == 16 * len(rows) and {r.vec_id for r in out} == set(range(300)) | {None}
    assert {r.n for r in out} == {n} and {r.identity_error < 1e-9 for r in out} == {True}
    sign, seen = {}, {}
    for r in out:
        own = good[9 if r.vec_id is None else r.vec_id]
        own = np.array([math.floor(64 * float(c)) + 1_000_000 for c in own], np.int64)
        assert r.deviation == sum((n * int(a) - int(b)) ** 2 for a, b in zip(own, s))
        j = r.component - 1
        want = ((n * own - s) / n) @ q[j] / math.sqrt(e[j])
        sign.setdefault(j, 1 if r.whitened * want > 0 else -1)
        assert abs(r.whitened * sign[j] - want) < 1e-9
        assert abs(r.explained - e[j] / trace) < 1e-9
        seen[j] = seen.get(j, 0) + 1
    assert seen == {j: len(rows) for j in range(16)}


def test_edges(spark):
    schema = "vec_id string, embedding array<double>"
    assert W.whiten(spark.createDataFrame([], schema)).count() == 0
    assert W.whiten(spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0, 2.0]), ("c", None)], schema)).count() == 0
    out = W.whiten(spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0, 3.0]), (None, [1e300, -1e300]), ("d", [7.0])], schema)).collect()
    assert {r.vec_id for r in out} == {"a", "b", None} and all(math.isfinite(r.whitened) for r in out)
    assert all(r.deviation is None or r.deviation >= 0 for r in out)
    single = W.whiten(spark.createDataFrame([("a", [1.0]), ("b", [2.0])], schema)).collect()
    assert sorted((r.vec_id, r.component, r.n, r.deviation, abs(r.whitened), r.explained) for r in single) == [("a", 1, 2, 4096, 1.0, 1.0), ("b", 1, 2, 4096, 1.0, 1.0)]


def test_exact_deviations_of_large_numbers():
    m = W.Whitening(10**9, [10**15 + 3, 5], np.ones(1), np.eye(1, 2), 1.0)
    x = np.array([[1_000_000, 0], [1_000_001, 3]], np.int64)
    want = [sum((10**9 * int(a) - b) ** 2 for a, b in zip(row, m.sums)) for row in x]
    assert m.deviations(x) == [w if w < 1 << 63 else None for w in want]
