"""Resampling of whole tables: no bound on rows, laws of the draws, sums against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from curvelake.functions import numeric as nm
from curvelake.operators import apply, infer
from curvelake.sources.curves import Curves

N, M = 400, 9


@pytest.fixture(scope="module")
def sample(spark):
    x = np.random.default_rng(8).normal(size=(N, M)).cumsum(1)
    g = np.arange(N) % 3
    x[g == 0] += 0.1
    df = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, g))], "id long, values array<double>, label int").repartition(5)
    return Curves(df.cache(), nm.unit_grid(M)), x, g


@pytest.fixture(autouse=True)
def few(monkeypatch):
    monkeypatch.setattr(infer, "MOST_ROWS", 20)


def halves(c):
    return c.with_df(c.df.where("label = 0")), c.with_df(c.df.where("label > 0"))


def test_f1_f21_equivalence(sample):
    c, x, g = sample
    same, p = infer.equivalence(*halves(c), 5.0, n_boot=40)
    assert same and np.isclose(p, np.abs(x[g == 0].mean(0) - x[g > 0].mean(0)).max())
    zero = c.with_df(c.df.select("id", F.lit([0.0] * M).alias("values")))
    assert np.isclose(infer.equivalence(c, zero, 5.0, n_boot=40)[1], np.abs(x.mean(0)).max())


def test_f2_f4_tolerance_band(sample):
    c, x, _ = sample
    centre, half = infer.tolerance_band(c, 3, n_boot=60)
    model = infer.fpca(c, 3)
    s = model.project(x)
    sd = np.mean([(s[np.random.default_rng(b).integers(0, N, N)] @ model.loadings.T).std(0, ddof=1) for b in range(60)], 0)
    assert np.allclose(centre, x.mean(0)) and np.allclose(half, 1.959964 * sd, rtol=0.02)
    wide = infer.tolerance_band(c, 3, n_boot=60, simultaneous=True)[1]
    inside = (np.abs(s @ model.loadings.T) <= wide + 1e-9).all(1).sum()
    assert inside == int(np.ceil(N * 0.95))


def test_f3_f12_permutations(sample):
    c, x, g = sample
    w = c.weights
    mean = np.array([x[g == k].mean(0) for k in range(3)])
    size = np.bincount(g)
    between = (size[:, None] * (mean - x.mean(0)) ** 2).sum(0) / 2
    within = ((x - mean[g]) ** 2).sum(0) / (N - 3)
    stat, p = infer.f_permutation(c, "label", 30)
    assert np.isclose(stat, between / within @ w) and 0 < p <= 1
    two = c.with_df(c.df.withColumn("g", (F.col("label") == 0).cast("int")))
    stat, p = infer.t_permutation(two, "g", 30)
    assert np.isclose(stat, (x[g == 0].mean(0) - x[g > 0].mean(0)) ** 2 @ w) and 0 < p <= 1


@pytest.mark.parametrize("rows", [60, 16_384])
def test_permuted_sums_keep_sizes_and_law(sample, monkeypatch, rows):
    c, x, g = sample
    whole = apply.block_sums
    monkeypatch.setattr(infer, "block_sums", lambda *a: whole(*a, size=rows))
    one = c.df.select("id", "label", F.array(F.lit(1.0), F.col("values")[0]).alias("values"))
    n, own, _, drawn = infer.permuted_sums(one, "label", [0, 1, 2], 300, 3, 0.0)
    assert (n == np.bincount(g)).all() and (drawn[:, :, 0] == n).all()  # every label is dealt once
    assert np.allclose(drawn[:, :, 1].sum(1), x[:, 0].sum())
    first = drawn[:, 0, 1] / n[0]
    sd = np.sqrt(x[:, 0].var(ddof=1) / n[0] * (1 - n[0] / N))
    assert abs(first.mean() - x[:, 0].mean()) < 4 * sd / np.sqrt(300) and abs(first.std() / sd - 1) < 0.2
    again = infer.permuted_sums(one.repartition(2), "label", [0, 1, 2], 300, 3, 0.0)[3]
    assert np.allclose(drawn, again)


@pytest.mark.parametrize("rows", [60, 16_384])
def test_resamples_have_whole_size(sample, monkeypatch, rows):
    c, x, _ = sample
    whole = apply.block_sums
    monkeypatch.setattr(infer, "block_sums", lambda *a: whole(*a, size=rows))
    one = c.df.select("id", F.array(F.lit(1.0), F.col("values")[0]).alias("values"))
    total, products = infer.resampled_moments(one, 300, 3)
    assert (total[:, 0] == N).all() and np.allclose(products[:, 0, 1], total[:, 1])
    sd = x[:, 0].std() / np.sqrt(N)
    assert abs((total[:, 1] / N).mean() - x[:, 0].mean()) < 4 * sd / np.sqrt(300) and abs((total[:, 1] / N).std() / sd - 1) < 0.2


def test_f9_f10_f11_mean_band(sample):
    from curvelake.operators.smooth import local_polynomial_hat

    c, x, g = sample
    s = x @ local_polynomial_hat(c.grid, c.grid, 0.2, 1).T
    mean, low, high, crit = infer.mean_band(c, 0.2, n_boot=200)
    assert np.allclose(mean, s.mean(0)) and np.allclose(high - mean, crit * s.std(0, ddof=1) / np.sqrt(N))
    r = (s - s.mean(0)) / s.std(0, ddof=1)
    want = np.sort([np.abs(np.random.default_rng(b).standard_normal(N) @ r / np.sqrt(N)).max() for b in range(200)])[189]
    assert abs(crit / want - 1) < 0.2
    a, b = halves(c)
    pairs = min(a.df.count(), b.df.count())
    got = infer.two_sample_band(a, b, 0.2, n_boot=20)[1][0]
    assert np.allclose(got, (s[g == 0][:pairs] - s[g > 0][:pairs]).mean(0))


def test_row_draws():
    z = infer.row_normals(np.arange(20_000), 3, 5)
    assert np.allclose(z.mean(0), 0, atol=0.03) and np.allclose(np.cov(z.T), np.eye(3), atol=0.04)
    assert np.allclose(z[7:9], infer.row_normals(np.array([7, 8]), 3, 5)) and not np.allclose(z, infer.row_normals(np.arange(20_000), 3, 6))
    assert abs(infer.row_signs(np.arange(20_000), 2, 1).mean()) < 0.02


def test_f6_f7_interval_tests_on_whole_tables(spark):
    from curvelake.plans import registry

    for name in ("itp_one_pop", "itp_two_pop", "flm_gof_test"):
        got = registry.queries()[name](spark, "/root/testdata/sf0.001").collect()
        assert len(got) >= 1 and all(0 <= r["p"] <= 1 for r in got)


def test_goodness_of_fit_from_sums(spark):
    r = np.random.default_rng(4)
    fit = r.normal(size=200)
    y = fit + 0.3 * fit**2 + r.normal(size=200)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, fit)], "y double, fit double").repartition(3)
    assert np.allclose(infer.goodness_of_fit_of(df, "y", "fit"), infer.goodness_of_fit(y - fit, fit))


@pytest.mark.parametrize("points", [1, 4, M])
def test_f42_threshold_by_points_equals_whole_replicates(sample, spark, monkeypatch, points):
    from curvelake.operators import depth

    c, x, _ = sample

    def refused(*a):
        raise AssertionError("a table's values went through the driver")

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", refused)
    monkeypatch.setattr(type(c.df), "toArrow", refused)
    monkeypatch.setattr(depth, "DRAWN_BYTES", 8 * N * points)
    monkeypatch.setattr(depth, "DRAWN_ROWS", 7)
    monkeypatch.setattr(depth, "SENT_ROWS", 150)
    largest = []
    for b in range(5):
        r = np.random.default_rng(1 + b)
        y = x[r.integers(0, N, N)]
        y = y + 0.05 * x.std(0, ddof=1) * r.standard_normal(y.shape)
        rank = y.argsort(0).argsort(0) + 1
        kept = y[np.argsort(np.minimum(rank, N - rank).sum(1), kind="stable")[N // 10 :]]
        largest.append(np.sqrt(((y - kept.mean(0)) ** 2 / kept.var(0, ddof=1)).mean(1)).max())
    assert np.isclose(depth.lrt_threshold(c, 5), max(largest), rtol=1e-12)
    assert np.isclose(depth.lrt_threshold(c.with_df(c.df.repartition(2)), 5, 0.5), np.sort(largest)[2], rtol=1e-12)
