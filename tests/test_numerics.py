"""Kernels against closed forms and invariants."""

import math

import numpy as np
import pytest

from curvelake.functions import numeric as nm
from curvelake.functions import special
from curvelake.operators import elastic, metrics, season, smooth


def test_simpson_weights():
    t = np.linspace(0, 2, 11)
    assert np.allclose(nm.simpson_weights(t) @ t**3, 4)
    assert np.isclose(nm.simpson_weights(np.linspace(0, 1, 64)).sum(), 1)
    u = np.array([0, 0.1, 0.3, 0.4, 0.8])
    assert np.isclose(nm.simpson_weights(u) @ u**2, 0.8**3 / 3)
    with pytest.raises(ValueError):
        nm.simpson_weights([0, 0, 1])


def test_distribution_functions():
    assert np.isclose(special.chi2_quantile(0.95, 3), 7.814727903, atol=1e-6)
    assert np.isclose(special.f_quantile(0.95, 3, 20), 3.098391, atol=1e-5)
    assert np.isclose(special.normal_quantile(0.975), 1.959963985, atol=1e-7)
    assert abs(special.normal_quantile_rational(0.975) - 1.959964) < 5e-4
    assert np.isclose(special.t_cdf(2.0, 10), 0.963306, atol=1e-5)


def test_bases_and_differences():
    t = np.linspace(0, 1, 41)
    b = nm.bspline_basis(t, 6)
    assert b.shape == (41, 10) and np.allclose(b.sum(1), 1)
    assert np.allclose(nm.gradient(t**3, t), 3 * t**2, atol=1e-10)
    assert np.allclose(nm.derivative(t[None] ** 2, t)[0][1:-1], 2 * t[1:-1])
    for family in ("fourier", "legendre", "wiener"):
        phi = nm.eigenfunctions(np.linspace(0, 1, 401), 3, family)
        w = nm.simpson_weights(np.linspace(0, 1, 401))
        assert np.allclose(phi.T @ (phi * w[:, None]), np.eye(3), atol=1e-4)
    p = smooth.bspline_penalty(t, 6)
    c = np.linalg.lstsq(b, 1 + 2 * t, rcond=None)[0]
    assert abs(c @ p @ c) < 1e-8


def test_dtw_and_soft_dtw():
    a, b = np.array([[0.0, 1, 2, 1]]), np.array([[0.0, 0, 1, 2]])
    assert metrics.dtw(1)(a, a)[0, 0] == 0
    brute = np.full((5, 5), np.inf)
    brute[0, 0] = 0
    for i in range(4):
        for j in range(4):
            brute[i + 1, j + 1] = abs(a[0, i] - b[0, j]) + min(brute[i, j], brute[i, j + 1], brute[i + 1, j])
    assert metrics.dtw(1)(a, b)[0, 0] == brute[4, 4]
    assert np.isinf(metrics.dtw(1, 0)(a, b)[0, 0])
    assert abs(metrics.soft_dtw(1e-3)(a, b)[0, 0] - metrics.dtw(2)(a, b)[0, 0]) < 1e-2
    value, grad = metrics.soft_dtw_gradient(a[0], b[0], 0.5)
    step = 1e-6
    for k in range(4):
        moved = a[0].copy()
        moved[k] += step
        assert abs((metrics.soft_dtw_gradient(moved, b[0], 0.5)[0] - value) / step - grad[k]) < 1e-4


def test_elastic_alignment():
    t = np.linspace(0, 1, 40)
    f = np.sin(2 * np.pi * t)
    g, w, d = elastic.align(f, f, t)
    assert np.allclose(g, t) and d == 0
    moved = np.sin(2 * np.pi * t**1.3)
    _, w, _ = elastic.align(f, moved, t)
    assert np.abs(w - f).max() < np.abs(moved - f).max() / 3
    h = elastic.normalize_warp(t**2, t)
    assert elastic.inverse_error(h, t) < 0.05
    assert elastic.phase_distance(t, t) < 1e-6
    assert np.allclose(elastic.srsf_inverse(elastic.srsf(f, t), t, f[0]), f, atol=0.05)


def test_periods_and_decompositions():
    t = np.arange(120.0)
    v = 3 + 0.01 * t + np.sin(2 * np.pi * t / 12)
    assert abs(season.period_fft(v - v.mean(), t)[0] - 12) < 0.1
    assert season.period_acf(v - season.linear_trend(v, t), t)[0] == 12
    assert abs(season.sazed(v, t)[0] - 12) < 1
    s, tr, r = season.stl(v, 12)
    assert np.abs(r[12:-12]).max() < 0.1
    assert season.strength_variance(v, t, 12) > 0.95
    p, best, alarm = season.lomb_scargle(t, v - v.mean(), np.arange(1, 40) / 120)
    assert abs(best - 1 / 12) < 1e-9 and alarm < 1e-3
    assert np.isclose(np.real(season.hilbert(np.cos(t))).sum(), np.cos(t).sum())
    assert len(season.peaks(np.sin(2 * np.pi * t / 12), t)[0]) == 10


def test_smoothers_keep_lines():
    t = np.linspace(0, 1, 30)
    y = np.stack([1 + 2 * t, 3 - t])
    assert np.allclose(smooth.local_polynomial(t, y, t, 0.1, 1), y)
    assert np.allclose(smooth.nadaraya_watson(t, np.ones((1, 30)), t, 0.1), 1)
    assert math.isclose(smooth.nw_matrix(t, 0.1).sum(), 30)


def test_charts_by_chunks_equal_one_pass(spark):
    from curvelake.operators import monitor

    r = np.random.default_rng(8)
    rows = [(int(i), [float(a) for a in r.normal(0.2, 1, 3)]) for i in r.permutation(103)]
    stats, eig = spark.createDataFrame(rows, "id long, scores array<double>").repartition(3), [1.0, 0.5, 0.2]
    for how, options in (("ewma", {}), ("mewma", {"exact": True}), ("cusum", {"k": 0.3})):
        want = {x["id"]: (x["statistic"], x["alarm"]) for x in monitor.sequential(stats, eig, how, 3.0, **options).collect()}
        for chunk in (1, 7, 50, 1000):
            got = {x["id"]: (x["statistic"], x["alarm"]) for x in monitor.charted(stats, eig, how, 3.0, chunk=chunk, **options).collect()}
            assert got.keys() == want.keys()
            assert np.allclose([got[i][0] for i in want], [want[i][0] for i in want])
            assert [got[i][1] for i in want] == [want[i][1] for i in want]
