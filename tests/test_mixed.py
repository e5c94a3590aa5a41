"""Functional mixed models against dense matrices on small tables."""

import numpy as np
import pytest

from curvelake.functions.numeric import unit_grid
from curvelake.operators import mixed
from curvelake.sources.curves import Curves

POINTS = 9


def table(spark, seed=1, subjects=7, p=2):
    """Unbalanced: subject s has 1 to 5 curves."""
    r = np.random.default_rng(seed)
    rows, grid = [], unit_grid(POINTS)
    for s in range(subjects):
        u = r.normal(0, 1.5)
        for _ in range(r.integers(1, 6)):
            x = [1.0, r.normal()][:p]
            v = u * np.sin(np.pi * grid) + sum(b * f for b, f in zip(x, (grid, 2 * grid**2), strict=False)) + r.normal(0, 0.3, POINTS)
            rows.append((len(rows), f"s{s}", [float(b) for b in x], [float(a) for a in v]))
    return Curves(spark.createDataFrame(rows, "id long, who string, x array<double>, values array<double>").repartition(3), grid), rows


def dense(y, x, who, max_iter, tol):
    """The same iterations with the whole covariance matrix."""
    n, p = x.shape
    names = sorted(set(who))
    z = np.array([[a == b for b in names] for a in who], float)
    size = z.sum(0)
    gamma = np.linalg.solve(x.T @ x + 1e-8 * np.eye(p), x.T @ y) if p else np.zeros(0)
    r = y - x @ gamma
    means = z.T @ r / size
    e = ((r - z @ means) ** 2).sum() / (n - len(names))
    u = max(((size * (means - r.mean()) ** 2).sum() / (len(names) - 1) - e) / (n / len(names)), 0)
    u = 0.1 * e if u < 1e-15 else u
    for _ in range(max_iter):
        v = u * z @ z.T + e * np.eye(n)
        if p:
            inv = np.linalg.inv(v)
            gamma = np.linalg.solve(x.T @ inv @ x + 1e-10 * np.eye(p), x.T @ inv @ y)
        r = y - x @ gamma
        mean = u * z.T @ np.linalg.solve(v, r)  # of the effects, given the residuals
        left = np.diag(u * np.eye(len(names)) - u * z.T @ np.linalg.solve(v, u * z))
        new_u = ((mean**2 + left).sum()) / len(names)
        new_e = (((r - z @ mean) ** 2).sum() + (size * left).sum()) / max(n - p, 1)
        stop = abs(new_u - u) + abs(new_e - e) < tol * (u + e)
        u, e = new_u, new_e
        if stop:
            break
    r = y - x @ gamma
    v = u * z @ z.T + e * np.eye(n)
    return gamma, u, e, dict(zip(names, u * z.T @ np.linalg.solve(v, r), strict=True))


@pytest.mark.parametrize("p", [0, 1, 2])
def test_components_equal_dense_matrices(spark, p):
    c, rows = table(spark, p=p)
    m = mixed.functional(c, "who", "x" if p else None, 3, 40, 1e-12)
    who = [r[1] for r in rows]
    x = np.array([r[2] for r in rows]).reshape(len(rows), p)
    scores = m.components.project(np.array([r[3] for r in rows]))
    got = {r["subject"]: r["u"] for r in m.subjects.collect()}
    for k in range(3):
        gamma, u, e, effects = dense(scores[:, k], x, who, 40, 1e-12)
        assert np.allclose(m.fit.gamma[:, k], gamma, atol=1e-7)
        assert np.allclose([m.fit.sigma2_u[k], m.fit.sigma2_e[k]], [u, e], rtol=1e-6)
        assert np.allclose([got[s][k] for s in sorted(got)], [effects[s] for s in sorted(got)], atol=1e-6)
    assert m.n_subjects == len(set(who))
    curves = {r["subject"]: np.array(r["effect"]) for r in m.random_effects().collect()}
    assert np.allclose(m.random_variance(), np.var(list(curves.values()), axis=0))
    for r in m.fitted(c).collect():
        want = m.components.mean + np.array(r["x"]) @ m.beta + curves[r["who"]]
        assert np.allclose(r["fitted"], want)
        values = next(v for i, _, _, v in rows if i == r["id"])
        assert np.allclose(np.array(r["fitted"]) + r["residual"], values)


def test_unknown_subjects_have_fixed_effects_only(spark):
    c, _ = table(spark)
    m = mixed.functional(c, "who", "x", 2)
    new = spark.createDataFrame([("new", [1.0, 2.0], [0.0] * POINTS)], "who string, x array<double>, values array<double>")
    want = m.components.mean + np.array([1.0, 2.0]) @ m.beta
    assert np.allclose(m.fitted(c.with_df(new)).first()["fitted"], want)
    assert np.allclose(m.predict(new.select("who", "x")).first()["values"], want)


def test_pointwise_equals_dense_matrices(spark):
    c, rows = table(spark, 2)
    got = mixed.pointwise(c, "who", "x", 1, 30, 1e-8)
    x, y = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    for k in range(POINTS):
        gamma, u, e, _ = dense(y[:, k], x, [r[1] for r in rows], 30, 1e-8)
        assert np.allclose(got.beta[:, k], gamma, atol=1e-7)
        assert np.allclose([got.sigma2_u[k], got.sigma2_e[k]], [u, e], rtol=1e-5, atol=1e-9)
    smooth = mixed.pointwise(c, "who", "x", 2, 30, 1e-8)
    assert np.allclose(smooth.beta[:, 1], got.beta[:, :3].mean(1))
    assert ((smooth.p >= 0) & (smooth.p <= 1)).all()
    with pytest.raises(ValueError):
        mixed.pointwise(c, "who", "x", 0)


def test_fixed_effects_are_found_by_permutation(spark):
    c, _ = table(spark, 3, 12)
    statistic, p = mixed.permutation_test(c, "who", "x", 2, 39)
    assert p[1] == 1 / 40
    assert (statistic > 0).all()
    r = np.random.default_rng(4)
    noise = spark.createDataFrame([(i, f"s{i % 6}", [r.normal()], [float(a) for a in r.normal(size=POINTS)]) for i in range(60)], "id long, who string, x array<double>, values array<double>")
    assert mixed.permutation_test(c.with_df(noise), "who", "x", 2, 39)[1][0] > 0.05
