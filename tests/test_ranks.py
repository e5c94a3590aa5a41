"""Exact order statistics, numbering and the rank-based outliers against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from curvelake.functions import numeric as nm
from curvelake.operators import apply, depth, infer, pointwise
from curvelake.sources.curves import Curves


def table(spark, values):
    df = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(values)], "id long, values array<double>")
    return Curves(df.repartition(3), nm.unit_grid(len(values[0])))


@pytest.mark.parametrize("ties", [False, True])
def test_order_statistics_without_sorting(spark, monkeypatch, ties):
    monkeypatch.setattr(apply, "FEW_VALUES", 50)
    x = np.random.default_rng(1).normal(size=3000)
    x = np.round(x, 1) if ties else x
    df = spark.createDataFrame([(float(v),) for v in x], "v double").repartition(5)
    places = [0, 1, 749, 1500, 2998, 2999]
    assert apply.order_statistics(df, "v", places) == np.sort(x)[places].tolist()
    assert np.allclose(apply.quantiles(df, "v", [0.1, 0.25, 0.9]), np.quantile(x, [0.1, 0.25, 0.9]), atol=1e-12)


def test_numbered_in_buckets(spark, monkeypatch):
    monkeypatch.setattr(apply, "ROWS_A_TASK", 100)
    x = np.round(np.random.default_rng(2).normal(size=700), 2)
    df = spark.createDataFrame([(k, float(v), k % 3) for k, v in enumerate(x)], "id long, v double, g int").repartition(4)
    got = {r["id"]: r["rank"] for r in apply.numbered(df, "v", "id").collect()}
    order = sorted(range(700), key=lambda k: (x[k], k))
    assert got == {k: n + 1 for n, k in enumerate(order)}
    own = {r["id"]: r["rank"] for r in apply.numbered(df, "v", "id", by=("g",)).collect()}
    for g in range(3):
        assert [own[k] for k in order if k % 3 == g] == list(range(1, sum(k % 3 == g for k in range(700)) + 1))


def test_bucketed_ranks_are_the_same(spark, monkeypatch):
    v = np.round(np.random.default_rng(3).normal(size=(300, 4)), 1)
    c = table(spark, v)
    plain = {(r["id"], r["pos"]): (r["n"], r["le"], r["lt"]) for r in depth.ranks(c, 1).collect()}
    monkeypatch.setattr(depth, "ROWS_A_TASK", 40)
    assert {(r["id"], r["pos"]): (r["n"], r["le"], r["lt"]) for r in depth.ranks(c).collect()} == plain


def mean_ranks(col):
    return np.array([(np.sum(col < x) + 1 + np.sum(col <= x)) / 2 for x in col])


def test_extremal_depth_with_ties(spark):
    v = np.round(np.random.default_rng(4).normal(size=(40, 6)), 0)
    n = len(v)
    d = np.stack([1 - np.abs(2 * mean_ranks(v[:, t]) - n - 1) / n for t in range(v.shape[1])], 1)
    level = d.min(1)
    mass = (np.abs(d - level[:, None]) < 1e-9).mean(1)
    order = sorted(range(n), key=lambda i: (round(level[i], 12), -mass[i], i))
    got = {r["id"]: r["depth"] for r in depth.extremal(table(spark, v)).collect()}
    assert got == {i: (k + 1) / n for k, i in enumerate(order)}


def planted():
    r = np.random.default_rng(5)
    t = np.linspace(0, 1, 30)
    v = np.sin(2 * np.pi * t) + 0.1 * r.normal(size=(40, 1)) + 0.02 * r.normal(size=(40, 30))
    v[3] += 4
    v[7] *= 3
    v[11] = np.sin(8 * np.pi * t)
    return v


def test_planted_outliers(spark):
    v = planted()
    c = table(spark, v)
    got = {r["id"]: r for r in depth.muod(c).collect()}
    mu = v.mean(0)
    for i, x in enumerate(v):
        slope, icept = np.polyfit(mu, x, 1)
        assert abs(got[i]["amplitude"] - abs(slope - 1)) < 1e-9 and abs(got[i]["magnitude"] - abs(icept)) < 1e-9
        assert abs(got[i]["shape"] - abs(np.corrcoef(mu, x)[0, 1] - 1)) < 1e-9
    assert got[3]["magnitude_outlier"] and got[7]["amplitude_outlier"] and got[11]["shape_outlier"]
    found = {r["id"]: r for r in depth.tvd_mss(c).collect()}
    assert found[11]["shape_outlier"] and found[3]["magnitude_outlier"]
    n, d = len(v), np.diff(v, axis=1)
    q = np.stack([mean_ranks(d[:, k]) / n for k in range(d.shape[1])], 1)
    assert np.allclose([found[i]["mss"] for i in range(n)], (q * (1 - q) * np.abs(d)).sum(1) / np.abs(d).sum(1))
    steps = {r["id"]: r["steps"] for r in depth.sequential_outliers(c).collect()}
    assert "T0" in steps[3] and 11 in steps
    gram = {r["id"]: r for r in depth.depthgram(c).collect()}
    assert gram[11]["shape_outlier"] and len(gram) == n
    far = {r["id"]: r["distance"] for r in depth.lrt_outliers(c, 3.0).collect()}
    assert max(far, key=far.get) in (3, 7, 11)


def test_reference_sets_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(infer, "MOST_ROWS", 20)
    c = table(spark, planted())
    for how in (depth.band, lambda x: depth.kernel_spatial(x, 1.0)):
        with pytest.raises(ValueError, match="20 curves"):
            how(c)


def test_sums_agree_between_runs(spark):
    c = table(spark, np.random.default_rng(6).normal(size=(500, 8)) * 1e6)
    one = [apply.sums(c.df.repartition(7, "id"), lambda v: [v.sum(0)], ["values"])[0].tobytes() for _ in range(3)]
    assert len(set(one)) == 1


def test_folds_are_even(spark):
    df = spark.range(103).withColumn("label", F.col("id") % 2)
    sizes = sorted(r["count"] for r in pointwise.folds(df, 5).groupBy("fold").count().collect())
    assert sizes == [20, 20, 21, 21, 21]
    by = pointwise.folds(df, 5, by="label").groupBy("label", "fold").count().collect()
    assert {r["count"] for r in by} == {10, 11}
