"""Pair kernels and tiles: against direct computation, with copies, ties and several blocks."""

import numpy as np
import pytest

from curvelake.functions import numeric as nm
from curvelake.operators import apply, depth, infer, metrics, models, reduce
from curvelake.sources.curves import Curves

N, M = 150, 16
T = nm.unit_grid(M)


@pytest.fixture(scope="module")
def sample(spark):
    x = np.round(np.random.default_rng(9).normal(size=(N, M)), 1) + np.arange(N)[:, None] % 5
    x[7], x[9] = x[3], x[3]
    x[11] = x[3] + 1e-7
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, values array<double>").repartition(4)
    return Curves(df.cache(), T), x


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    monkeypatch.setattr(apply, "FEW_BLOCKS", 3)


def direct_hausdorff(p, q):
    d = np.sqrt(((p[:, None] - q[None]) ** 2).sum(2))
    return max(d.min(1).max(), d.min(0).max())


@pytest.mark.parametrize("size", [20, 60, 512])
def test_f22_f23_pairs_in_parts_of_blocks(sample, size):
    c, x = sample
    got = apply.self_pairs(c.df, metrics.euclidean(), size=size, places=6).toPandas().sort_values(["i", "j"])
    i, j = np.triu_indices(N, 1)
    assert got["i"].tolist() == i.tolist() and got["j"].tolist() == j.tolist()
    assert np.allclose(got["d"], np.sqrt(((x[i] - x[j]) ** 2).sum(1)), atol=1e-6)
    few = c.df.where("id % 10 = 0")
    cross = apply.cross_pairs(few, c.df, metrics.euclidean(), size=size).toPandas().sort_values(["i", "j"])
    assert len(cross) == 15 * N and np.allclose(cross["d"].to_numpy().reshape(15, N), np.sqrt(((x[::10, None] - x[None]) ** 2).sum(2)), atol=1e-9)


def test_f23_a_block_is_sent_once_for_a_wide_block():
    assert apply._block_count(102_564, apply.BLOCK) == 26 and apply._block_count(100, apply.BLOCK) == 1


def test_f18_f27_copies_are_at_zero(sample):
    x = sample[1] + 1e6
    d = metrics.squares(x, x)
    assert d[3, 7] == 0 and d[3, 9] == 0 and np.isclose(d[3, 11], ((x[3] - x[11]) ** 2).sum(), rtol=1e-9)
    assert np.allclose(d, ((x[:, None] - x[None]) ** 2).sum(2), rtol=1e-9, atol=1e-9)


def test_f5_f35_hshift(sample):
    x, w = sample[1], nm.simpson_weights(T)
    want = np.full((10, N), np.inf)
    for s in range(-4, 5):
        lo, hi = max(0, -s), min(M, M - s)
        want = np.minimum(want, ((x[:10, None, lo:hi] - x[None, :, lo + s : hi + s]) ** 2) @ w[lo:hi])
    assert np.allclose(metrics.hshift(T)(x[:10], x), np.sqrt(want), atol=1e-9)


@pytest.mark.parametrize("scale", [0.05, 1.0, 30.0])
def test_f14_f17_f19_f29_hausdorff(sample, scale):
    x = scale * sample[1]
    t = np.sort(np.random.default_rng(1).random(M))
    got = metrics.hausdorff(t)(x[:6], x[:40])
    assert np.allclose(got, [[direct_hausdorff(np.column_stack([t, p]), np.column_stack([t, q])) for q in x[:40]] for p in x[:6]])
    s, u = np.array([0, 0.2, 0.9, 1.0]), np.array([0, 0.5, 0.6, 1.0])
    st = np.stack([np.tile(s, 4), np.repeat(u, 4)], 1)
    got = metrics.hausdorff_surfaces(s, u)(x[:6], x[:40])
    assert np.allclose(got, [[direct_hausdorff(np.column_stack([st, p]), np.column_stack([st, q])) for q in x[:40]] for p in x[:6]])


def test_f26_f28_f30_f34_f36_f37_pairwise_depths(sample):
    c, x = sample
    below = (x[:, None] <= x[None]).all(2).sum(1) / N
    above = (x[:, None] >= x[None]).all(2).sum(1) / N
    sup = 1 / (1 + np.abs(x[:, None] - x[None]).max(2).mean(1))
    modal = np.exp(-((x[:, None] - x[None]) ** 2).mean(2) / (2 * 0.15**2)).mean(1)
    d = x[:, None] - x[None]
    norm = np.sqrt(d**2 @ c.weights)
    spatial = 1 - np.sqrt((d / np.where(norm > 1e-12, norm, np.inf)[..., None]).mean(1) ** 2 @ c.weights)
    for fn, want in ((depth.epigraph, below), (depth.hypograph, above), (depth.half_region, np.minimum(below, above)), (depth.sup_depth, sup), (depth.modal, modal), (depth.spatial, spatial)):
        got = fn(c).toPandas().sort_values("id")["depth"].to_numpy()
        assert np.allclose(got, want, atol=1e-7), fn.__name__


def test_dominating_many_rows():
    r = np.random.default_rng(2)
    a, b = np.round(r.normal(size=(300, 3)), 1), np.round(r.normal(size=(130, 3)), 1)
    assert (depth.dominating(a, b, True) == (a[:, None] <= b[None]).all(2).sum(1)).all()
    assert (depth.dominating(a, b, False) == (a[:, None] >= b[None]).all(2).sum(1)).all()


def labelled(c, x):
    df = c.df.sparkSession.createDataFrame([(i, v.tolist(), i % 4) for i, v in enumerate(x)], "id long, values array<double>, label int").repartition(3)
    return Curves(df, T)


@pytest.mark.parametrize("few", [1, 40, 50_000])
def test_f20_quantiles_of_pairs(sample, few):
    c, x = sample
    i, j = np.triu_indices(N, 1)
    d = np.sqrt(metrics.squares(x * np.sqrt(c.weights), x * np.sqrt(c.weights))[i, j])
    d = d[d > 0]
    shares = [0.0, 1 / 6, 0.5, 1.0]
    assert len(d) == len(i) - 3 and np.allclose(metrics.distance_quantiles(c, shares, cells=16 if few == 1 else 4096, most=few), np.quantile(d, shares), rtol=1e-9)


def test_f24_f31_f32_sums_instead_of_rows_of_pairs(sample, monkeypatch):
    from curvelake.operators import cluster, regress
    from curvelake.plans import modelled

    c = labelled(*sample)
    y = c.df.select("id", c.df["label"].cast("double").alias("y"))
    pairs = metrics.self_distances(c).cache()
    old = regress.nonparametric(metrics.mirrored(pairs), y, 0.3).toPandas().sort_values("id")["fit"]
    want = cluster.calinski_harabasz_from_distances(pairs, c.df.select("id", c.df["label"].alias("cluster"))).first()[0]
    bad = apply.self_pairs(c.df, metrics.lp(c.weights), keep=modelled._bad_distances).toPandas()
    assert sorted(zip(bad["i"], bad["j"])) == [(i, j) for i in (0, 100) for j in range(i + 1, N)]
    # no rows of pairs from here on
    monkeypatch.setattr(metrics, "self_distances", None)
    assert np.allclose(regress.nonparametric_of(c, y, 0.3).toPandas().sort_values("id")["fit"], old)
    assert np.isclose(cluster.calinski_harabasz_of_pairs(c, "label"), want)


def test_f8_jackknife_takes_every_row(spark, monkeypatch):
    monkeypatch.setattr(infer, "MOST_ROWS", 20)
    monkeypatch.setattr(apply, "FEW_OF_A_ROW", 8)
    r = np.random.default_rng(3)
    x = np.cumsum(r.normal(size=(400, M)), 1)
    y = np.round(x @ np.arange(M) / M + r.normal(size=400) ** 3, 1)
    y[5] += 1e4  # most parts of a bracket are empty
    c = Curves(spark.createDataFrame([(i, v.tolist(), float(t)) for i, (v, t) in enumerate(zip(x, y))], "id long, values array<double>, y double").repartition(5).cache(), T)
    new = c.with_df(c.df.where("id % 20 = 0"))
    basis = reduce.fpca(c, 2)
    for alpha in (0.1, 0.001):
        got = {q["id"]: (q["low"], q["high"]) for q in models.jackknife_plus(c, "y", new, 2, alpha).collect()}
        d = np.hstack([np.ones((400, 1)), basis.project(x)])
        lo, hi = int(np.floor(alpha * 401)) - 1, int(np.ceil((1 - alpha) * 401)) - 1
        fits, e = np.zeros((400, 400)), np.zeros(400)
        for i in range(400):
            b = np.linalg.lstsq(np.delete(d, i, 0), np.delete(y, i), rcond=None)[0]
            fits[i], e[i] = d @ b, abs(y[i] - d[i] @ b)
        low, high = np.sort(fits - e[:, None], 0), np.sort(fits + e[:, None], 0)
        assert sorted(got) == list(range(0, 400, 20))
        for i in got:
            assert np.isclose(got[i][0], low[lo, i] if lo >= 0 else -np.inf) and np.isclose(got[i][1], high[hi, i] if hi < 400 else np.inf)


def test_f8_statistics_over_several_blocks_and_ties(spark, monkeypatch):
    monkeypatch.setattr(apply, "FEW_OF_A_ROW", 4)
    r = np.random.default_rng(5)
    v = np.round(r.normal(size=(300, 2)), 1)
    ref = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, values array<double>")
    few = ref.where("id < 100")
    got = apply.row_statistics(few, ref, lambda a, b: (a[:, :1] + b[:, 0], a[:, 1:] * b[:, 1]), [17, 299], wide=70).toPandas().sort_values("id")
    assert np.array_equal(got["v0"], np.sort(v[:100, :1] + v[:, 0], 1)[:, 17]) and np.array_equal(got["v1"], np.sort(v[:100, 1:] * v[:, 1], 1)[:, 299])


def in_blocks(monkeypatch, size):
    whole = apply.against_pairs
    monkeypatch.setattr(depth, "against_pairs", lambda df, fn, schema, rows, reference: whole(df, fn, schema, 7, size))


@pytest.mark.parametrize("size", [40, 4096])
def test_f13_bands_of_all_pairs(sample, monkeypatch, size):
    monkeypatch.setattr(infer, "MOST_ROWS", 20)
    in_blocks(monkeypatch, size)
    c, x = sample  # rounded: most curves touch most others
    for points in (1, 3, M):
        y = np.tile(x[:, :points], 5)[:, :70] if points == M else x[:, :points]
        few = Curves(c.df.sparkSession.createDataFrame([(i, v.tolist()) for i, v in enumerate(y)], "id long, values array<double>"), nm.unit_grid(max(y.shape[1], 2)) if y.shape[1] > 1 else np.zeros(1))
        i, j = np.triu_indices(N, 1)
        low, high = np.minimum(y[i], y[j]), np.maximum(y[i], y[j])
        want = [((low <= v) & (v <= high)).all(1).mean() for v in y]
        got = {r["id"]: r["depth"] for r in depth.band_all(few).collect()}
        assert np.allclose([got[k] for k in range(N)], want, rtol=1e-12)


@pytest.mark.parametrize("size", [40, 4096])
def test_f15_f16_kernel_depth_of_all_curves(sample, monkeypatch, size):
    c, x = sample
    monkeypatch.setattr(infer, "MOST_ROWS", 20)
    in_blocks(monkeypatch, size)
    got = {r["id"]: r["depth"] for r in depth.kernel_spatial_all(c, 1.0).collect()}
    e = np.expm1(-((x[:, None] - x[None]) ** 2 @ c.weights))
    den = np.sqrt(-2 * e)
    inv = np.where(den > 1e-7, 1 / np.maximum(den, 1e-7), 0.0)
    want = [1 - np.sqrt(max(inv[i] @ (e - e[i][:, None] - e[i]) @ inv[i], 0)) / N for i in range(N)]
    assert np.allclose([got[i] for i in range(N)], want, atol=1e-8)
