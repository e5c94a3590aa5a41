"""Group penalties and history regression against whole matrices."""

import math

import numpy as np
import pytest

from curvelake.functions.numeric import unit_grid
from curvelake.operators import selection
from curvelake.sources.curves import Curves

POINTS = 12


def tables(spark, n=60, p=4, seed=1):
    """p predictors, of which the first and third matter."""
    r, grid = np.random.default_rng(seed), unit_grid(POINTS)
    x = r.normal(size=(p, n, POINTS)).cumsum(2) / 3
    z = r.normal(size=n)
    y = x[0] @ grid + 2 * x[2][:, 4] + 0.5 * z + r.normal(0, 0.1, n)
    make = lambda k: Curves(spark.createDataFrame([(i, float(y[i]), [float(z[i])], [float(v) for v in x[k][i]]) for i in range(n)], "id long, y double, z array<double>, values array<double>").repartition(3), grid)
    return [make(k) for k in range(p)], x, y, z


def objective(x, y, groups, b, lam):
    return 0.5 * ((y - x @ b) ** 2).sum() + lam * sum(math.sqrt(len(g)) * np.linalg.norm(b[g]) for g in groups)


def plain_descent(x, y, groups, lam, how):
    """The same updates on residuals of whole columns."""
    b = np.zeros(x.shape[1])
    for _ in range(200):
        old = b.copy()
        for g in groups:
            r = y - x @ b + x[:, g] @ b[g]
            best = np.linalg.lstsq(x[:, g], r, rcond=None)[0]
            norm, cut = np.linalg.norm(best), lam * math.sqrt(len(g))
            if how == "lasso":
                f = max(0, 1 - cut / norm)
            elif how == "mcp":
                f = max(0, 1 - cut / norm) / (1 - 1 / 3) if norm <= 3 * cut else 1
            else:
                f = max(0, 1 - cut / norm) if norm <= 2 * cut else max(0, norm - 3.7 * cut / 2.7) / norm / (1 - 1 / 2.7) if norm <= 3.7 * cut else 1
            b[g] = best * f
        if np.abs(b - old).max() < 1e-6:
            break
    return b


@pytest.mark.parametrize("how", ["lasso", "scad", "mcp"])
def test_coefficients_equal_descent_on_columns(spark, how):
    predictors, x, y, _ = tables(spark)
    for lam in (0.05, 0.3):
        m = selection.select(predictors, "y", 3, lam, how)
        s = np.hstack([c.project(v) for c, v in zip(m.components, x, strict=True)])
        want = plain_descent(s, y - y.mean(), m.groups, lam, how)
        assert np.allclose(np.concatenate(m.coef), want, atol=1e-4)
        fit = {r["id"]: r["fit"] for r in m.fitted().collect()}
        assert np.allclose([fit[i] for i in range(len(y))], y.mean() + s @ np.concatenate(m.coef))
        assert np.isclose(m.r2, 1 - ((y - y.mean() - s @ np.concatenate(m.coef)) ** 2).sum() / ((y - y.mean()) ** 2).sum())


def test_cross_validation_equals_folds_by_hand(spark):
    predictors, x, y, z = tables(spark)
    m = selection.select(predictors, "y", 2, covariates="z", n_grid=4)
    s = np.hstack([*[c.project(v) for c, v in zip(m.components, x, strict=True)], z[:, None]])
    fold = np.arange(len(y)) % 5
    for lam, error in m.path:
        wrong = 0.0
        for f in range(5):
            a, b = s[fold != f], y[fold != f]
            centre = (a - a.mean(0) * 0, b - b.mean())
            coef = selection.group_descent(centre[0].T @ centre[0], centre[0].T @ centre[1], m.groups, lam, free=np.array([8]))[0]
            wrong += ((y[fold == f] - b.mean() - s[fold == f] @ coef) ** 2).sum()
        assert np.isclose(error, wrong / len(y))
    assert m.lam == min(m.path, key=lambda p: p[1])[0]
    assert len(m.coef) == 5 and len(m.coef[-1]) == 1


def test_what_matters_is_chosen(spark):
    predictors, *_ = tables(spark, 200)
    m = selection.select(predictors, "y", 3, 0.5, "mcp", "z")
    assert m.active == [True, False, True, False] and m.converged
    whole = selection.select(predictors, "y", 3, how="ls", covariates="z")
    best = selection.select(predictors, "y", 3, how="mcp", covariates="z")
    assert best.active[0] and best.active[2] and best.r2 > 0.9
    assert all(whole.active) and whole.r2 >= m.r2
    with pytest.raises(ValueError):
        selection.select(predictors, "y", 3, how="other")


def test_history_equals_whole_matrices(spark):
    (c, *_), x, y, _ = tables(spark)
    m = selection.history(c, "y", 0.6, 6, 0.1)
    lags = x[0][:, m.places]
    slopes = np.array([np.polyfit(lags[:, k], y, 1)[0] for k in range(6)])
    k = np.exp(-0.5 * ((m.lags[:, None] - m.lags) / 0.1) ** 2)
    raw = k @ slopes / k.sum(1)
    gamma = raw / np.sqrt((raw**2).sum() * 0.1)
    assert np.allclose(m.gamma, gamma)
    score = lags @ gamma * 0.1
    b, a = np.polyfit(score, y, 1)
    assert np.allclose([m.slope, m.intercept], [b, a])
    got = {r["id"]: (r["history"], r["fit"]) for r in m.predict(c).collect()}
    assert np.allclose([got[i] for i in range(len(y))], np.stack([score, a + b * score], 1))
    assert m.places[0] == POINTS - 2  # the point before the end, as lags look back
    assert selection.history(c, "y", 0.6, 6).bandwidth >= 0.1 - 1e-9  # one lag at least
    with pytest.raises(ValueError):
        selection.history(c, "y", 2.0)


def test_surfaces_equal_whole_kronecker_matrices(spark):
    from curvelake.operators import surfaces

    r = np.random.default_rng(3)
    m1, m2, n = 4, 3, 25
    x, values = r.normal(size=(n, 2)), r.normal(size=(n, m1 * m2))
    c = Curves(spark.createDataFrame([(i, float(x[i, 0]), float(x[i, 1]), [float(v) for v in values[i]]) for i in range(n)], "id long, a double, b double, values array<double>"), np.arange(float(m1 * m2)))
    m = surfaces.regression(c, ["a", "b"], m1, m2, 0.5, 2.0)
    design = np.hstack([np.ones((n, 1)), x])
    raw = np.linalg.lstsq(design, values, rcond=None)[0]
    penalty = 0.5 * np.kron(surfaces.difference_penalty(m1), np.eye(m2)) + 2.0 * np.kron(np.eye(m1), surfaces.difference_penalty(m2))
    want = np.linalg.solve(np.eye(m1 * m2) + penalty, raw.T).T
    assert np.allclose(m.beta, want)
    left = values - design @ want
    assert np.allclose(m.r2, 1 - (left**2).sum(0) / ((values - values.mean(0)) ** 2).sum(0))
    assert np.allclose(m.se, np.sqrt(np.outer(np.diag(np.linalg.inv(design.T @ design))[1:], (left**2).sum(0) / (n - 3))))
    got = {row["id"]: row["values"] for row in m.predict(c.df.select("id", "a", "b")).collect()}
    assert np.allclose([got[i] for i in range(n)], design @ want)
    free = surfaces.regression(c, ["a", "b"], m1, m2)
    assert free.gcv <= surfaces.regression(c, ["a", "b"], m1, m2, 1.0, 1.0).gcv
    with pytest.raises(ValueError):
        surfaces.regression(c, ["a"], 5, 5)
