"""Sparse covariances against all pairs of observations, and trajectories on dense curves."""

import numpy as np
import pytest

from curvelake.functions.numeric import simpson_weights
from curvelake.operators import sparse

GRID = np.linspace(0, 1, 7)


def points(seed, n=25, scale=1.0):
    r, rows = np.random.default_rng(seed), []
    for i in range(n):
        a = np.random.default_rng(100 + i).normal(size=2)
        for t in r.random(r.integers(1, 6)):
            rows.append((i, float(t), float(scale * (a[0] * np.sin(np.pi * t) + a[1] * t) + r.normal(0, 0.1))))
    return rows


def table(spark, rows):
    return spark.createDataFrame(rows, "id long, t double, v double").repartition(3)


def by_pairs(a, b, h):
    """Kernel means of products over all pairs of two variables' observations of one id."""
    def residuals(rows):
        k = lambda g: np.array([np.exp(-((t - g) ** 2) / (2 * h * h)) for _, t, _ in rows])
        mean = np.array([(k(g) @ [v for *_, v in rows]) / k(g).sum() for g in GRID])
        return [(i, t, v - mean[np.abs(GRID - t).argmin()]) for i, t, v in rows]

    a, b = residuals(a), residuals(b)
    top, bottom = np.zeros((7, 7)), np.zeros((7, 7))
    for i, s, x in a:
        for j, t, y in b:
            if i == j:
                w = np.outer(np.exp(-((s - GRID) ** 2) / (2 * h * h)), np.exp(-((t - GRID) ** 2) / (2 * h * h)))
                top, bottom = top + w * x * y, bottom + w
    return top / bottom


def test_one_variable_equals_all_pairs(spark):
    rows, h = points(1), 0.2
    m = sparse.covariance([table(spark, rows)], [GRID], h)
    k = np.exp(-((GRID[:, None] - GRID) ** 2) / (2 * h * h))
    k /= k.sum(1, keepdims=True)
    want = k @ by_pairs(rows, rows, h) @ k.T
    root = np.sqrt(simpson_weights(GRID))
    val, vec = np.linalg.eigh(want * np.outer(root, root))
    want = (vec / root[:, None] * np.maximum(val, 0)) @ (vec / root[:, None]).T
    assert np.allclose(m.cov, want)
    assert np.linalg.eigvalsh(m.cov).min() > -1e-9
    with pytest.raises(ValueError):
        sparse.covariance([table(spark, rows)], [GRID], 0)


def test_blocks_of_two_variables(spark):
    one, two, h = points(2), points(3, 25, -0.5), 0.25
    m = sparse.covariance([table(spark, one), table(spark, [r for r in two if r[0] > 2])], [GRID, GRID], h)
    two = [r for r in two if r[0] > 2]  # ids 0 to 2 have the first variable only
    raw = np.block([[by_pairs(a, b, h) for b in (one, two)] for a in (one, two)])
    want = sparse.projected(sparse.smoothed(raw, [GRID, GRID], h), np.tile(simpson_weights(GRID), 2))
    assert np.allclose(m.cov, want)
    assert np.allclose(m.block(0, 1), m.block(1, 0).T)
    assert np.trace(m.block(0, 1)) < 0 < np.trace(m.block(1, 1))


def test_trajectories_follow_dense_curves(spark):
    rows = [(i, float(t), float(np.random.default_rng(i).normal() * np.sin(np.pi * t))) for i in range(30) for t in np.linspace(0, 1, 21)]
    grid = np.linspace(0, 1, 21)
    m = sparse.covariance([table(spark, rows)], [grid], 0.04)
    for r in sparse.trajectories(table(spark, rows), m, 2, 1e-4).collect():
        truth = np.random.default_rng(r["id"]).normal() * np.sin(np.pi * grid)
        off = np.abs(np.array(r["fitted"]) - truth)
        assert off[2:-2].max() < 0.02 and off.max() < 0.3  # kernel means are biased at the ends
        assert min(r["half"]) >= 0
    assert sparse.trajectories(table(spark, rows).limit(0), m).count() == 0
