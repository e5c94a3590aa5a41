"""Clusters in subspaces and up to warps, against direct computation and known groups."""

import math

import numpy as np
import pytest

from curvelake.functions.numeric import unit_grid
from curvelake.operators import subspaces as sub
from curvelake.sources.curves import Curves

POINTS = 15
T = unit_grid(POINTS)


def table(spark, values):
    return Curves(spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(values)], "id long, values array<double>").repartition(2), T)


def groups(n=30, seed=1, apart=1.5):
    """Two groups that differ in one direction and vary in their own."""
    r = np.random.default_rng(seed)
    a = r.normal(size=(n, 1)) * np.sin(2 * np.pi * T) + r.normal(0, 0.1, (n, POINTS))
    b = apart * T**2 + r.normal(size=(n, 1)) * np.cos(2 * np.pi * T) + r.normal(0, 0.1, (n, POINTS))
    return np.vstack([a, b]), np.repeat([0, 1], n)


def agreement(found, truth):
    return max(np.mean(found == truth), np.mean(found != truth))


def labels(df):
    return np.array([r["cluster"] for r in df.orderBy("id").collect()])


def test_discriminative_directions_tell_groups_apart(spark):
    values, truth = groups()
    m = sub.discriminative(table(spark, values), 2, 4)
    assert agreement(labels(m.predict(table(spark, values))), truth) > 0.95
    assert m.directions.shape == (4, 1) and np.isclose(np.linalg.norm(m.directions), 1)
    # the likelihood is that of the mixture on the projected scores
    z = m.basis.project(values) @ m.directions
    dens = sum(w * np.exp(-0.5 * ((z - mu) ** 2 / v).sum(1)) / np.sqrt(np.prod(2 * np.pi * v)) for w, mu, v in zip(m.weights, m.means, m.variances, strict=True))
    assert np.isclose(m.log_likelihood, np.log(dens).sum(), atol=1e-6)
    with pytest.raises(ValueError):
        sub.discriminative(table(spark, values), 0)


def test_subspace_likelihood_is_that_of_full_normal_distributions(spark):
    values, truth = groups(40, 2)
    m = sub.subspaces(table(spark, values), 2, 2, n_init=2)
    assert agreement(labels(m.predict(table(spark, values))), truth) > 0.95
    total = np.zeros(len(values))
    for j in range(2):
        u, a, b = m.directions[j], m.variances[j], m.noise[j]
        cov = u @ np.diag(a) @ u.T + b * (np.eye(POINTS) - u @ u.T)
        d = values - m.means[j]
        total += m.weights[j] * np.exp(-0.5 * (np.einsum("np,pq,nq->n", d, np.linalg.inv(cov), d) + np.linalg.slogdet(cov)[1] + POINTS * math.log(2 * math.pi)))
    assert np.isclose(m.log_likelihood, np.log(total).sum(), rtol=1e-8)
    free = 1 + 2 * (POINTS + 1) + 2 * (2 * (POINTS - 1.5) + 2)
    assert np.isclose(m.bic, -2 * m.log_likelihood + free * math.log(len(values)))
    assert m.icl >= m.bic
    assert [len(a) for a in sub.subspaces(table(spark, values), 2, None, 0.5, n_init=1).variances] == [1, 1]


def test_one_step_of_one_cluster_is_principal_components(spark):
    values, _ = groups(25, 3)
    m = sub.subspaces(table(spark, values), 1, 3, n_init=1)
    val = np.linalg.eigvalsh(np.cov(values.T, bias=True))[::-1]
    assert np.allclose(m.variances[0], val[:3])
    assert np.isclose(m.noise[0], val[3:].mean())


def test_clusters_up_to_warps(spark):
    r = np.random.default_rng(4)
    values, truth = [], []
    for i in range(16):
        g = T ** np.exp(r.normal(0, 0.25))
        values.append(np.sin(2 * np.pi * g) if i % 2 else np.exp(-(((g - 0.5) / 0.15) ** 2)))
        truth.append(i % 2)
    templates, found, rounds, rest = sub.align_clusters(table(spark, values), 2, seed=3)
    assert rest and rounds > 1 and templates.shape == (2, POINTS)
    assert agreement(labels(found), np.array(truth)) == 1
    assert all(r["distances"][r["cluster"]] == min(r["distances"]) for r in found.collect())
    with pytest.raises(ValueError):
        sub.align_clusters(table(spark, values[:1]), 2)
