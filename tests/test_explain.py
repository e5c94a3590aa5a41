"""Explanations against closed forms and numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from curvelake.operators import explain


@pytest.fixture(scope="module")
def scores(spark):
    r = np.random.default_rng(7)
    s = r.normal(size=(400, 3)) @ np.array([[1, 0.4, 0], [0, 1, 0], [0, 0, 1.0]])
    y = 0.5 + s @ [2.0, -1.0, 0.0] + 0.1 * r.normal(size=400)
    df = spark.createDataFrame([(k, [float(x) for x in a], float(b)) for k, (a, b) in enumerate(zip(s, y))], "id long, scores array<double>, y double").repartition(3).cache()
    return df, s, y


def linear(df):
    return explain.linear(df, 0.5, [2.0, -1.0, 0.0], np.eye(3))


def test_attributions_of_a_linear_model(scores):
    df, s, _ = scores
    x = linear(df)
    want = (s - s.mean(0)) * [2.0, -1.0, 0.0]
    for got in (explain.linear_attributions(x), explain.attributions(x)):
        assert np.allclose([r["values"] for r in got.orderBy("id").collect()], want, atol=1e-6)


def test_effects(scores):
    df, s, _ = scores
    x = linear(df)
    grid, ice, mean = explain.dependence(x, 0, 5)
    assert np.allclose(np.diff(mean), 2 * np.diff(grid)) and ice.count() == 400
    assert explain.interaction(x, 0, 1) < 1e-20
    product = explain.Scored(df, lambda v: v[:, 0] * v[:, 1], 3)
    assert explain.interaction(product, 0, 1) > 0.3 and explain.interaction(product, 0, 2) < 1e-12
    ale = explain.accumulated(x, 0, 10)
    assert sum(r[3] for r in ale) == 400
    for a, b in zip(ale[:-1], ale[1:]):
        assert abs(b[2] - a[2] - 2 * (b[1] - b[0])) < 1e-9


def test_importance(scores):
    df, s, y = scores
    x = linear(df)
    found = {j: v for j, v, _ in explain.permutation_importance(x, 5)}
    assert found[0] > found[1] > 0.05 and abs(found[2]) < 1e-9
    within = {j: v for j, v, _ in explain.permutation_importance(x, 5, n_bins=4)}
    assert within[0] > within[1] > 0
    share = dict(explain.variance_shares(x))
    assert abs(share[0] - 4 * (s[:, 0] ** 2).sum() / 399 / y.var(ddof=1)) < 1e-9
    first = {j: a for j, a, _ in explain.sobol(x)}
    assert first[0] > first[2] and abs(first[2]) < 1e-9


def test_permutations_keep_values(scores):
    df, s, _ = scores
    got = explain._shuffled(df.select("id", F.col("scores")[0].alias("v")), 400, [], 3, "v").collect()
    assert sorted(r["new_v"] for r in got) == sorted(s[:, 0].tolist()) and sum(r["v"] == r["new_v"] for r in got) < 10


def test_diagnostics(scores):
    df, s, y = scores
    d = np.hstack([np.ones((400, 1)), s])
    b = np.linalg.lstsq(d, y, rcond=None)[0]
    x = explain.linear(df, float(b[0]), b[1:])
    loo = [y[i] - d[i] @ np.linalg.lstsq(np.delete(d, i, 0), np.delete(y, i), rcond=None)[0] for i in range(0, 400, 40)]
    h = np.einsum("np,pq,nq->n", d, np.linalg.inv(d.T @ d), d)
    assert np.allclose(((y - d @ b) / (1 - h))[::40], loo)
    assert abs(explain.left_out(x)[0] - (((y - d @ b) / (1 - h)) ** 2).sum()) < 1e-8
    row = explain.deletion_effects(x).where("id = 40").first()
    without = np.linalg.lstsq(np.delete(d, 40, 0), np.delete(y, 40), rcond=None)[0]
    e = np.delete(y, 40) - np.delete(d, 40, 0) @ without
    own = np.sqrt((e @ e) / (399 - 4))
    assert np.allclose(row["dfbetas"], (b - without) / own / np.sqrt(np.diag(np.linalg.inv(d.T @ d))))
    vif = [v for _, v in explain.variance_inflation(x)]
    assert np.allclose(vif, np.diag(np.linalg.inv(np.corrcoef(s.T))))
    # fixed values of Student's t
    assert abs(explain.t_quantile(0.975, 10) - 2.228139) < 1e-4 and abs(explain.t_quantile(0.95, 5) - 2.015048) < 1e-4
    got = explain.prediction_intervals(x, df).collect()
    assert 0.9 < np.mean([r["low"] <= y[r["id"]] <= r["high"] for r in got]) < 0.99


def test_intervals():
    assert explain.significant_regions([1, 1, -1, -2, -3], [2, 2, 1, -1, -1]) == [(0, 1, 1), (3, 4, -1)]
    assert explain.important_intervals([0, 3, 3, 0, 0, 1], 2, 0.5) == [(0, 3, 9 + 18 + 9)] or explain.important_intervals([0, 3, 3, 0, 0, 1], 2, 0.5)[0][:2] == (1, 2)


def test_logistic(scores):
    df, s, _ = scores
    y = (s @ [2.0, -1.0, 0.0] > 0).astype(float)
    x = explain.linear(df.withColumn("y", (2 * F.col("scores")[0] - F.col("scores")[1] > 0).cast("double")), 0.0, [2.0, -1.0, 0.0], np.eye(3), True)
    p = 1 / (1 + np.exp(-(s @ [2.0, -1.0, 0.0])))
    found, groups = explain.calibration(x)
    assert abs(found["brier"] - ((p - y) ** 2).mean()) < 1e-9 and sum(g[0] for g in groups) == 400
    assert 0 < explain.calibration_error(x)["ece"] < 0.5
    assert all(r["flipped"] for r in explain.flip(x, 2000, 0.05).collect())
    rule, precision, coverage = explain.anchor(x, 5)
    assert precision > 0.6 and 0 < coverage <= 1 and rule
    moved = explain.counterfactual(linear(df), 3.0).first()
    assert abs(linear(df).predict((s[moved["id"]] + moved["delta"])[None])[0] - 3.0) < 1e-9


def test_resampling_and_prototypes(scores):
    df, s, y = scores
    x = linear(df)
    coef, r2 = explain.bootstrap(x, 40)
    assert np.abs(coef.mean(0) - [0.5, 2.0, -1.0, 0.0]).max() < 0.05 and r2.min() > 0.9
    assert (explain.bootstrap(x, 40)[0] == coef).all()
    stable = explain.stability(x, 30)
    assert stable["rank_stability"] > 0.9 and stable["beta_std"].max() < 0.05
    found = explain.prototypes(x, 3, 2, 1.0)
    kernel = np.exp(-((s[:, None] - s[None]) ** 2).sum(2) / 2)
    mu, chosen = kernel.mean(1), []
    for _ in range(3):
        gain = 2 * mu - (kernel[:, chosen].mean(1) if chosen else 0)
        gain[chosen] = -np.inf
        chosen.append(int(gain.argmax()))
    assert [i for kind, _, i, _ in found if kind == "prototype"] == chosen
