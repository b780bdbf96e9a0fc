"""Whitening against exact rational arithmetic and numpy's eigenvectors."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import types as T

from faultlines.llm import whitening as W

VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType()))])


def table(spark, vectors):
    return spark.createDataFrame([(k, None if v is None else [None if x is None else float(x) for x in v]) for k, v in enumerate(vectors)], VECTORS).repartition(3)


def run(frame, most=32):
    model = W.fit(frame, most=most)
    error = model and W.identity_error(frame, model)
    return sorted(W.whiten(frame, model, error).collect(), key=lambda r: (r.vec_id, r.component))


def check(found, vectors, most=32):
    kept = {k: v for k, v in enumerate(vectors) if v is not None and None not in v and np.isfinite(v).all()}
    x = {k: [math.floor(64 * c) + 1000000 for c in v] for k, v in kept.items()}
    n, dims = len(x), len(next(iter(x.values())))
    sums = [sum(v[j] for v in x.values()) for j in range(dims)]
    y = np.array([[float(a - Fraction(s, n)) for a, s in zip(v, sums)] for v in x.values()])
    cov = y.T @ y / n
    e, axes = np.linalg.eigh(cov)
    e, axes = e[::-1], axes[:, ::-1]
    count = min(most, dims)
    assert [(r.vec_id, r.component) for r in found] == [(k, c) for k in x for c in range(1, count + 1)]
    rows = {(r.vec_id, r.component): r for r in found}
    white = []
    for i, k in enumerate(x):
        deviation = sum((n * a - s) ** 2 for a, s in zip(x[k], sums))
        for c in range(1, count + 1):
            r = rows[k, c]
            assert r.n == n and r.deviation == (deviation if deviation < 1 << 63 else None)
            assert r.deviation_wide == (deviation if deviation < 10**38 else None)
            assert r.explained == pytest.approx(max(0, e[c - 1]) / np.trace(cov), rel=1e-9, abs=1e-12)
        white.append([rows[k, c].whitened for c in range(1, count + 1)])
    positive = [c for c in range(count) if e[c] > 1e-9 * e[0]]
    assert all((v is None) == (c not in positive) for row in white for c, v in enumerate(row))
    white = np.array(white, dtype=float)[:, positive]
    assert np.abs(white.T @ white / n - np.eye(len(positive))).max() < 1e-9
    assert found[0].identity_error < 1e-9
    # every component lies in the space of the eigenvalues equal to its own
    for c in positive:
        space = axes[:, np.abs(e - e[c]) < 1e-7 * e[0]]
        back = np.linalg.lstsq(y, white[:, c] * math.sqrt(e[c]), rcond=None)[0]
        assert np.linalg.norm(space.T @ back) == pytest.approx(1, abs=1e-6)


def test_random_vectors_with_hard_rows(spark):
    rng = np.random.default_rng(1)
    vectors = [list(v) for v in rng.standard_normal((300, 12)) * rng.uniform(0.1, 3, 12)]
    vectors += [None, [], [1.0, 2.0], [float("nan")] * 12, [float("inf")] + [0.0] * 11, [None] + [0.5] * 11, vectors[0], vectors[0]]
    good = [v if v is not None and len(v) == 12 else None for v in vectors]
    check(run(table(spark, vectors)), good)


def test_fewer_components_than_dimensions(spark):
    rng = np.random.default_rng(2)
    check(run(table(spark, rng.standard_normal((80, 9)).tolist()), most=4), np.random.default_rng(2).standard_normal((80, 9)).tolist(), most=4)


def test_repeated_eigenvalues(spark):
    vectors = [[s * (1.0 if j == k else 0.0) for j in range(5)] for k in range(5) for s in (1, -1)]
    vectors += [[0, 0, 0, 0, s * 2.0] for s in (1, -1)]
    check(run(table(spark, vectors)), vectors)


def test_missing_rank_and_large_values(spark):
    rng = np.random.default_rng(3)
    check(run(table(spark, (rng.standard_normal((4, 6)) * 3).tolist())), (np.random.default_rng(3).standard_normal((4, 6)) * 3).tolist())
    far = (rng.integers(-50, 50, (30, 4)) * 2.0**46).tolist()
    check(run(table(spark, far)), far)


def test_nothing_varies_and_empty_table(spark):
    found = run(table(spark, [[0.5, 0.25]] * 3))
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in found] == [(c, 3, 0, None, None, None) for _ in range(3) for c in (1, 2)]
    assert run(table(spark, [])) == [] and run(table(spark, [None, [float("nan")]])) == []


def test_polynomial_and_roots(spark):
    rng = np.random.default_rng(5)
    a = rng.integers(-9, 9, (7, 7)).astype(object)
    square = a @ a.T
    exact = W.polynomial(spark, square)
    # Faddeev-LeVerrier in integers
    m, c = np.zeros((7, 7), dtype=object), [1]
    for k in range(1, 8):
        m = square @ m + c[-1] * np.eye(7, dtype=object).astype(int).astype(object)
        c.append(-int(np.trace(square @ m)) // k)
    assert exact == c[::-1]
    roots = np.linalg.eigvalsh(square.astype(float))
    for at in (0, 1, 50, 200, 600):
        assert W.roots_above(exact, at) == (roots > at).sum()


def test_clashing_columns_and_repeated_ids(spark):
    vectors = np.random.default_rng(6).standard_normal((20, 3)).tolist()
    frame = table(spark, vectors).selectExpr("vec_id % 2 as vec_id", "embedding", "1 as n", "'x' as component", "2 as whitened", "3 as i")
    assert len(run(frame)) == 60
