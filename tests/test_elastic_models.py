"""Elastic regression, classes and shapes: what holds of fits on small warped bumps."""

import numpy as np
import pytest

from curvelake.functions.numeric import simpson_weights, unit_grid
from curvelake.operators import elastic
from curvelake.operators import elastic_models as em
from curvelake.sources.curves import Curves

T = unit_grid(31)


def bumps(spark, n=18, classes=3, seed=0):
    """Bumps of three sizes at three places, warped at random."""
    r, rows = np.random.default_rng(seed), []
    for i in range(n):
        k = i % classes
        g = T ** np.exp(r.normal(0, 0.1))
        v = (1 + 0.5 * k) * np.exp(-(((g - (k + 1) / (classes + 1)) / 0.12) ** 2))
        rows.append((i, 1 + 0.5 * k, k, [float(a) for a in v]))
    return Curves(spark.createDataFrame(rows, "id long, y double, k int, values array<double>").repartition(2), T)


def one_cell_at_a_time(q1, q2, t, lam=0.0):
    """The cheapest path over coprime steps, cell by cell."""
    q1, q2 = q1 / np.linalg.norm(q1), q2 / np.linalg.norm(q2)
    m = len(t)
    best, came = np.full((m, m), np.inf), {}
    best[0, 0] = 0
    at = lambda q, x: q[int(x)] + (x - int(x)) * (q[min(int(x) + 1, m - 1)] - q[int(x)])
    for i in range(1, m):
        for j in range(1, m):
            for a, b in elastic.STEPS:
                if a <= i and b <= j and np.isfinite(best[i - a, j - b]):
                    dt, slope, parts = t[i] - t[i - a], (t[j] - t[j - b]) / (t[i] - t[i - a]), max(a, b)
                    cost = best[i - a, j - b] + lam * (slope - 1) ** 2 * dt
                    for k in range(parts):
                        u = (k + 0.5) / parts
                        cost += (at(q1, i - a + u * a) - np.sqrt(slope) * at(q2, j - b + u * b)) ** 2 * dt / parts
                    if cost < best[i, j] - 1e-13:
                        best[i, j], came[i, j] = cost, (a, b)
    i = j = m - 1
    x, y = [t[i]], [t[j]]
    while (i, j) in came:
        a, b = came[i, j]
        i, j = i - a, j - b
        x.append(t[i])
        y.append(t[j])
    return np.interp(t, x[::-1], y[::-1])


@pytest.mark.parametrize("lam", [0.0, 0.2])
def test_many_paths_equal_one_cell_at_a_time(lam, monkeypatch):
    r = np.random.default_rng(1)
    t = np.sort(r.random(14))
    q1, q2 = r.normal(size=(5, 14)), r.normal(size=(5, 14))
    for held in (elastic.COST_BYTES, 1):  # all pairs at once, and one by one
        monkeypatch.setattr(elastic, "COST_BYTES", held)
        got = elastic.warp_dp_many(q1, q2, t, lam)
        for k in range(5):
            assert np.allclose(got[k], elastic.normalize_warp(one_cell_at_a_time(q1[k], q2[k], t, lam), t))
    assert np.allclose(elastic.warp_dp_many(q1, q1, t), t)
    assert elastic.warp_dp_many(q1[:0], q2[:0], t).shape == (0, 14)


def test_first_step_of_regression_is_least_squares(spark):
    c = bumps(spark)
    m = em.regression(c, "y", 8, 1e-3, 1)
    rows = c.df.orderBy("id").collect()
    from curvelake.functions.numeric import bspline_basis
    from curvelake.operators.smooth import bspline_penalty

    q, y = elastic.srsf(np.array([r["values"] for r in rows]), T), np.array([r["y"] for r in rows])
    basis = bspline_basis(T, 4, 4)
    phi = q @ (basis * simpson_weights(T)[:, None])
    coef = np.linalg.solve(phi.T @ phi + 1e-3 * bspline_penalty(T, 4, 4, 2), phi.T @ (y - y.mean()))
    assert np.allclose(m.beta, basis @ coef, atol=1e-8)
    assert np.isclose(m.alpha, (y - phi @ coef).mean())
    fit = {r["id"]: r["fit"] for r in m.predict(c).collect()}
    assert np.allclose([fit[r["id"]] for r in rows], phi @ coef + m.alpha)


def test_regression_warps_meet_the_response(spark):
    c = bumps(spark)
    m = em.regression(c, "y", 8, 1e-3, 6)
    assert m.r2 > 0.9
    w = m.beta * simpson_weights(T)
    curves = {r["id"]: r["values"] for r in c.df.collect()}
    for r in m.fitted.collect():
        g = np.array(r["warp"])
        assert g[0] == T[0] and g[-1] == T[-1] and (np.diff(g) >= -1e-12).all()
        q = elastic.srsf(np.array([curves[r["id"]]]), T)
        assert np.isclose(r["fit"], em.warped(q, g[None], T)[0] @ w + m.alpha)


def test_classes_are_told_apart_and_equal_fits_of_their_own(spark):
    c = bumps(spark)
    m = em.logistic(c, "k", [0, 1, 2], 0.01, 5, 1e-3)
    rows = em.predicted_class(m.fitted, m.classes).collect()
    assert np.mean([r["y"] == r["predicted"] for r in rows]) > 0.8
    assert np.allclose([sum(r["probabilities"]) for r in rows], 1)
    one = em.logistic(c, "k", [1], 0.01, 5, 1e-3)
    assert np.allclose(one.beta[0], m.beta[1]) and np.isclose(one.alpha[0], m.alpha[1])
    new = em.predicted_class(m.predict(c), m.classes).collect()
    assert np.mean([r["k"] == r["predicted"] for r in new]) > 0.8


def test_losses_fall(spark):
    c = bumps(spark)
    losses = [em.logistic(c, "k", [0], 0.01, n, 0.0).loss[0] for n in (1, 2, 4)]
    assert losses[0] > losses[1] > losses[2]
    assert np.isclose(losses[0], np.log(2))


def test_scalar_on_shape_fits_polynomials(spark):
    c = bumps(spark)
    m = em.scalar_on_shape(c, "y", 7, 1e-3, 2, 2, 3, 4)
    assert m.r2 > 0.8
    assert np.isclose((m.beta**2) @ simpson_weights(T), 1)
    r = m.predict(c).first()
    f0 = np.array(c.df.where(f"id = {r['id']}").first()["values"]) @ simpson_weights(T)
    assert np.isclose(r["fit"], m.h @ r["score"] ** np.arange(3) + m.g @ f0 ** np.arange(1, 3))
    plain = em.scalar_on_shape(c, "y", 7, 1e-3, 0, 0, 1, 2)
    assert plain.g.size == 0 and plain.h.tolist() == [0.0, 1.0]


def test_component_model_predicts_new_curves(spark):
    c = bumps(spark, 24)
    m = em.component_model(c.with_df(c.df.where("id < 18")), "y", 2)
    new = m.predict(c.with_df(c.df.where("id >= 18"))).collect()
    assert np.abs([r["fit"] - r["y"] for r in new]).max() < 0.3
