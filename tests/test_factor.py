import numpy as np
import pytest

from spotloom.operators import factor


def _dense(graph, n):
    w = np.zeros((n, n))
    for a, b, x in graph:
        w[a, b] = w[b, a] = x
    d = w.sum(1)
    with np.errstate(divide="ignore"):
        r = np.where(d > 0, 1 / np.sqrt(d), 0.0)
    return np.diag((d > 0).astype(float)) - r[:, None] * w * r[None]


@pytest.mark.parametrize(("strength", "most"), [(0.2, 1000), (5.0, 1000), (1.0, 0)])
def test_smoothing_equals_the_dense_inverse(spark, strength, most):
    rng = np.random.default_rng(1)
    graph = [(i, j, float(rng.uniform(0.1, 1))) for i in range(11) for j in range(i + 1, 11) if rng.random() < 0.4]
    x = rng.normal(size=(12, 2))  # spot 11 has no neighbour
    steps = factor.spatial.laplacian(spark.createDataFrame(graph, "a long, b long, w double"), normalized=True).where("i <> j")
    rows = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id long, f0 double, f1 double")
    got = {r.id: (r.f0, r.f1) for r in factor.smooth(rows, steps, strength, 2, 1e-8, most).collect()}
    want = np.linalg.solve(np.eye(12) + strength * _dense(graph, 12), x)
    assert np.allclose([got[i] for i in range(12)], want, atol=1e-6)


def _plain(y, lap, k, strength, ridge, max_iter, tol):
    seen = np.isfinite(y)
    mean = np.nanmean(y, axis=1, keepdims=True)
    filled = np.where(seen, y, mean)
    z = np.linalg.svd(filled - filled.mean(1, keepdims=True), full_matrices=False)[2][:k].T
    last = np.inf
    for _ in range(max_iter):
        g = np.stack([np.linalg.solve(z[m].T @ z[m] + ridge * np.eye(k), z[m].T @ r[m]) for r, m in zip(y, seen)])
        z = np.stack([np.linalg.solve(g[m].T @ g[m] + ridge * np.eye(k), g[m].T @ r[m]) for r, m in zip(y.T, seen.T)])
        z = np.linalg.solve(np.eye(len(z)) + strength * lap, z)
        e = np.sqrt(((g @ z.T - y)[seen] ** 2).mean())
        if np.isfinite(last) and abs(last - e) / max(last, 1e-8) < tol:
            break
        last = e
    return np.where(seen, y, g @ z.T)


def test_factors_equal_a_dense_version(spark):
    """Same start (up to rotation, which ridge steps don't see), rounds and stop."""
    rng = np.random.default_rng(3)
    y = rng.normal(size=(20, 2)) @ (rng.normal(size=(2, 25)) * [[4], [1]])
    y[rng.random(y.shape) < 0.05] = np.nan
    graph = [(i, i + 1, 1.0) for i in range(24)]
    usage = spark.createDataFrame([(g, s, None if np.isnan(y[g, s]) else float(y[g, s])) for g in range(20) for s in range(25)], "gene long, spot long, value double")
    got = {(r.gene, r.spot): r.imputed for r in factor.factorize(usage, spark.createDataFrame(graph, "a long, b long, w double"), rank=2, strength=0.1, max_iter=4).collect()}
    want = _plain(y, _dense(graph, 25), 2, 0.1, 1e-2, 4, 1e-4)
    assert max(abs(got[g, s] - want[g, s]) for g in range(20) for s in range(25)) < 1e-2


def test_factors_of_nothing_observed(spark):
    usage = spark.createDataFrame([(1, 1, None), (1, 2, None)], "gene long, spot long, value double")
    assert [r.imputed for r in factor.factorize(usage, rank=2, max_iter=2).collect()] == [0.0, 0.0]


def test_entries_reach_the_driver_once(spark, monkeypatch):
    """Every round collected the graph anew."""
    calls, real = [], factor._entries
    monkeypatch.setattr(factor, "_entries", lambda steps: calls.append(1) or real(steps))
    rng = np.random.default_rng(6)
    usage = spark.createDataFrame([(g, s, float(rng.normal())) for g in range(6) for s in range(8)], "gene long, spot long, value double")
    graph = spark.createDataFrame([(i, i + 1, 1.0) for i in range(7)], "a long, b long, w double")
    first = {(r.gene, r.spot): r.imputed for r in factor.factorize(usage.where("gene < 5 or spot < 5"), graph, rank=2, max_iter=3, tol=0.0).collect()}
    assert len(calls) == 1 and len(first) == 45
    monkeypatch.setattr(factor, "DRIVER_ENTRIES", 0)  # by joins: the same, and nothing is collected
    again = {(r.gene, r.spot): r.imputed for r in factor.factorize(usage.where("gene < 5 or spot < 5"), graph, rank=2, max_iter=3, tol=0.0).collect()}
    assert len(calls) == 1 and all(abs(first[k] - again[k]) < 1e-6 for k in first)
