"""Table operators against numpy on the same curves."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from curvelake.functions import numeric as nm
from curvelake.operators import cluster, depth, infer, metrics, monitor, pointwise, reduce, regress
from curvelake.sources.curves import Curves, karhunen_loeve, validate

M = 21


@pytest.fixture(scope="module")
def data(spark):
    r = np.random.default_rng(5)
    t = np.linspace(0, 1, M)
    x = r.standard_normal((60, 3)) @ np.stack([np.sin(np.pi * t), np.cos(2 * np.pi * t), t]) + 0.05 * r.standard_normal((60, M))
    y = x @ nm.simpson_weights(t) + 0.1 * r.standard_normal(60)
    rows = [(i, x[i].tolist(), float(y[i]), i % 3) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, values array<double>, y double, label int").repartition(3)
    return Curves(df.cache(), t), x, y


def by_id(df, column):
    return np.array([r[column] for r in df.orderBy("id").collect()])


def test_pointwise(data):
    c, x, _ = data
    assert np.allclose(pointwise.covariance(c), np.cov(x.T))
    assert np.allclose(by_id(pointwise.center(c).df, "values"), x - x.mean(0))
    w = nm.simpson_weights(c.grid)
    assert np.allclose(by_id(pointwise.norm_lp(c, 3), "norm"), (np.abs(x) ** 3 @ w) ** (1 / 3))
    validate(c)
    with pytest.raises(ValueError):
        validate(Curves(c.df, np.linspace(0, 1, 5)))


def test_rank_depths(data):
    c, x, _ = data
    f = (x[:, None] >= x[None]).mean(1)
    for buckets in (1, 4):
        assert np.allclose(by_id(depth.fraiman_muniz(c, buckets=buckets), "depth"), np.minimum(f, 1 - f).mean(1))
    n = len(x)
    below, above = (x[None] < x[:, None]).sum(1), (x[None] > x[:, None]).sum(1)
    mbd = 1 - (below * (below - 1) + above * (above - 1)) / (n * (n - 1))
    assert np.allclose(by_id(depth.modified_band(c, 3), "depth"), mbd.mean(1))
    got = by_id(depth.band(c), "depth")
    i = 7
    inside = sum(((np.minimum(x[j], x[k]) <= x[i]) & (x[i] <= np.maximum(x[j], x[k]))).all() for j in range(n) for k in range(j))
    assert np.isclose(got[i], inside / (n * (n - 1) / 2))


def test_distances(data):
    c, x, _ = data
    w = c.weights
    d = {(r["i"], r["j"]): r["d"] for r in metrics.self_distances(c).collect()}
    assert len(d) == 60 * 59 // 2
    assert np.isclose(d[3, 9], np.sqrt((x[3] - x[9]) ** 2 @ w))
    cross = metrics.cross_distances(c, c, "euclidean")
    assert cross.count() == 3600


def test_components_and_regression(data):
    c, x, y = data
    m = reduce.fpca(c, 3)
    w = c.weights
    u, s, vt = np.linalg.svd((x - x.mean(0)) * np.sqrt(w), full_matrices=False)
    assert np.allclose(m.singular, s[:3])
    scores = by_id(reduce.scores(c, m), "scores")
    assert np.allclose(np.abs(scores), np.abs(u[:, :3] * s[:3]), atol=1e-8)
    model = regress.linear(c, "y", 3)
    design = np.column_stack([np.ones(60), scores])
    fit = design @ np.linalg.lstsq(design, y, rcond=None)[0]
    assert np.allclose(by_id(model.predict(c), "fit"), fit)
    z = regress.glm(c, "y", "gaussian", 3)
    assert np.allclose(z.coef, model.coef, atol=1e-6)
    k = reduce.pls(c, "y", 2)
    assert np.corrcoef(by_id(c.df.select("id", "y"), "y"), (x - x.mean(0)) @ k.rotation[:, 0])[0, 1] > 0.5


def test_clusters(data, spark):
    c, x, _ = data
    mid, table = cluster.kmeans(c, 2, seed=3)
    own = by_id(table, "cluster")
    for k in range(2):
        assert np.allclose(mid[k], x[own == k].mean(0))
    d = metrics.self_distances(c)
    labels = cluster.dbscan(d, c.df.select("id"), 1e9, 2)
    assert labels.select("cluster").distinct().count() == 1
    assert cluster.dbscan(d, c.df.select("id"), 1e-9, 2).where("cluster IS NOT NULL").count() == 0
    decide, _, _ = cluster.discriminant(c, "label", 2)
    assert cluster.classify(c, decide).count() == 60


def test_monitoring(data):
    c, x, _ = data
    m = reduce.fpca(c, 2)
    stats = monitor.statistics(c, m)
    s = by_id(stats, "scores")
    assert np.allclose(by_id(stats, "t2"), (s**2 / m.eigenvalues).sum(1))
    got = by_id(monitor.sequential(stats.select("id", "scores"), m.eigenvalues, "ewma", 5.0, lam=0.3), "statistic")
    z = np.zeros(2)
    for k in range(60):
        z = 0.3 * s[k] + 0.7 * z
        assert np.isclose(got[k], (z**2 / (m.eigenvalues * 0.3 / 1.7)).sum())


def test_run_rules(spark):
    v = [0, 0, 4, 0, 2.5, 2.5, 0, 0] + [0.5] * 9
    df = spark.createDataFrame([(k, float(x)) for k, x in enumerate(v)], "t long, v double")
    got = {(r["rule"], r["start"]) for r in monitor.run_rules(df, 0, 1).collect()}
    assert ("WE1", 2) in got and ("WE2", 4) in got and ("WE4", 8) in got and ("WE4", 9) in got and ("WE4", 1) not in got


def test_inference(data, spark):
    c, x, _ = data
    stat, p = infer.t_permutation(c.with_df(c.df.withColumn("g", (F.col("id") < 30).cast("int"))), "g", 20)
    assert np.isclose(stat, (x[:30].mean(0) - x[30:].mean(0)) ** 2 @ c.weights) and 0 < p <= 1
    cal = spark.createDataFrame([(float(k),) for k in range(1, 10)], "r double")
    assert infer.conformal_quantile(cal, "r", 0.2) == 8.0
    assert infer.conformal_quantile(cal, "r", 0.01) == float("inf")
    assert karhunen_loeve(spark, 10, np.linspace(0, 1, 5), 3).df.count() == 10


def test_streaming_depth_equals_batch(data, spark, tmp_path):
    from curvelake.streaming.depth import depth_against, sorted_reference

    c, _, _ = data
    ref = sorted_reference(c)
    batch = by_id(depth_against(c.df, ref), "depth")
    assert np.allclose(batch, by_id(depth.fraiman_muniz(c), "depth"))
    c.df.select("id", "values").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, values array<double>").parquet(str(tmp_path / "in"))
    q = depth_against(stream, ref, "mbd").writeStream.format("memory").queryName("depths").start()
    q.processAllAvailable()
    q.stop()
    assert np.allclose(by_id(spark.table("depths"), "depth"), by_id(depth.modified_band(c), "depth"))


def test_lrt_threshold_draws_from_all_curves(spark):
    r = np.random.default_rng(3)
    x = np.concatenate([r.standard_normal((5000, 3)), 8 * r.standard_normal((200, 3))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, values array<double>")
    c = Curves(df, np.linspace(0, 1, 3))
    assert depth.lrt_threshold(c, 4) > 2 * depth.lrt_threshold(c.with_df(df.where("id < 5000")), 4)


def test_dd_classes_are_whole(spark):
    r = np.random.default_rng(4)
    x, g = np.round(r.standard_normal((7000, 3)), 2), (np.arange(7000) >= 6000).astype(int)
    x[g == 1] += 1
    df = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, g))], "id long, values array<double>, label int").repartition(5)
    depths = np.empty((7000, 2), np.int64)
    for k in (0, 1):
        s = np.sort(x[g == k], 0)
        le = np.stack([np.searchsorted(s[:, p], x[:, p], "right") for p in range(3)], 1)
        depths[:, k] = np.minimum(le, len(s) - le).sum(1)
    d = depths / (3 * np.array([6000, 1000]))
    got = cluster.dd_classify(Curves(df, np.linspace(0, 1, 3)), "label").cache()
    assert (by_id(got, "label") == g).all() and (by_id(got, "predicted") == d.argmax(1)).all()
    assert np.allclose(by_id(got, "depth"), d.max(1), atol=1e-12)


def test_registered_on_whole_curves(spark):
    from curvelake.plans import registry

    d, seen = "/root/testdata/sf0.001", {}
    x = by_id(registry.EMB(spark, d).df, "values")
    t = np.linspace(-np.pi, np.pi, 21)
    basis = [np.full(21, np.sqrt(0.5)), *((np.sin if k % 2 else np.cos)((k + 1) // 2 * t) for k in range(1, 64))]
    assert np.allclose(by_id(registry.queries()["andrews_transform"](spark, d), "curve"), x @ np.array(basis), atol=1e-5)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(registry.elastic, "karcher_mean", lambda c, **options: seen.update(options, points=len(c.grid)) or np.zeros(len(c.grid)))
        assert registry.queries()["karcher_mean"](spark, d).count() == 80 and seen == {"points": 80}


def test_forecast_goes_on_from_the_last_curve(spark, monkeypatch):
    monkeypatch.setattr(infer, "MOST_ROWS", 120)
    r = np.random.default_rng(6)
    a = np.zeros((200, 3))
    for k in range(1, 200):
        a[k] = [0.9, -0.7, 0.5] * a[k - 1] + [3, 2, 1] * r.standard_normal(3)
    t = np.linspace(0, 1, M)
    x = 5 + a @ np.stack([np.sin(np.pi * t), np.cos(2 * np.pi * t), t])
    for parts in (1, 60):
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, values array<double>").repartition(parts)
        c = Curves(df.cache(), t)
        model = reduce.fpca(c, 3)
        s = by_id(reduce.scores(c, model), "scores")
        n, mean, cov, last = infer.autocovariances(reduce.scores(c, model), "scores", 23)
        assert n == 200 and np.allclose(mean, s.mean(0)) and np.allclose(last, s[-23:])
        z = s - s.mean(0)
        assert np.allclose(cov, [(z[h:] * z[: 200 - h]).sum(0) / 200 for h in range(24)])
        want = np.zeros((2, 3))
        for j in range(3):
            phi, mu = infer.ar_fit(s[:, j])
            past = list(s[:, j] - mu)
            for h in range(2):
                past.append(sum(p * past[-1 - i] for i, p in enumerate(phi)))
                want[h, j] = past[-1] + mu
        assert np.allclose(infer.forecast(c, 3, 2), model.rebuild(want))
