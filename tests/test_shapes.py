"""Elastic statistics: round trips, invariances and small tables."""

import numpy as np
import pytest

from curvelake.functions import numeric as nm
from curvelake.operators import elastic, shapes
from curvelake.sources.curves import Curves

T = nm.unit_grid(41)


@pytest.fixture(scope="module")
def bumps(spark):
    r = np.random.default_rng(8)
    v = [np.exp(-((T - 0.5 - 0.1 * r.uniform(-1, 1)) ** 2) / 0.02) * (1 + 0.1 * r.normal()) for _ in range(12)]
    return Curves(spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "id long, values array<double>").repartition(2).cache(), T), np.array(v)


def test_tangent_vectors_round_trip(bumps):
    c, v = bumps
    target = v.mean(0)
    back = {r["id"]: np.array(r["values"]) for r in shapes.from_tangent(shapes.tangent_vectors(c, target), c, target).df.collect()}
    for k, x in enumerate(v):
        aligned = elastic.align(target, x, T)[1]
        assert np.abs(back[k] - aligned).max() < 0.08


def test_alignment_lowers_scores(bumps):
    c, v = bumps
    aligned = elastic.align_to(c.with_df(c.df.selectExpr("id", "values", "values AS own")), v[0]).withColumnRenamed("own", "values").cache()
    assert shapes.least_squares_score(c, aligned) < 0.6 and shapes.correlation_score(c, aligned) > 1
    q = shapes.quality(c, aligned)
    assert q["amplitude"] < q["total"] and abs(q["phase"] + q["amplitude"] - q["total"]) < 1e-9
    assert shapes.joint_fpca(aligned, T)[2][0] > 0
    box, marked = shapes.phase_boxplot(aligned, T)
    assert len(box) == len(T) and marked.count() == 12
    drawn = shapes.sample_model(aligned, T, 5).collect()
    assert len(drawn) == 5 and all(np.all(np.diff(r["warp"]) >= -1e-9) for r in drawn)


def test_landmarks_are_met():
    f, g = np.exp(-((T - 0.4) ** 2) / 0.02), np.exp(-((T - 0.6) ** 2) / 0.02)
    warp, moved, _ = shapes.align_through(f, g, T, [0.6], [0.4])
    assert abs(np.interp(0.4, T, warp) - 0.6) < 0.02 and abs(T[moved.argmax()] - 0.4) < 0.03
    fine = elastic.align(f, g, T)[2]
    assert shapes.align_coarse_to_fine(f, g, T)[2] < 2 * fine + 0.5
    a, b, _ = shapes.partial_match(g[16:33], g, T, 3)
    assert abs(a - 0.4) < 0.15 and b - a < 0.8
    path = shapes.geodesic(f, g, T, 3)
    assert np.abs(path[0] - f).max() < 0.05


def test_curves_in_the_plane():
    a = 2 * np.pi * T
    f = np.stack([np.cos(a), np.sin(a)], 1)
    assert np.abs(shapes.srsf_inverse_nd(shapes.srsf_nd(f, T), T, f[0]) - f).max() < 0.05
    g, w, d = shapes.align_nd(f[None], f[None], T)
    assert d[0] < 1e-9 and np.abs(g[0] - T).max() < 1e-9
    flat = shapes._flat(f[None])
    assert np.array_equal(shapes._unflat(flat, 2)[0], f)
    bent = np.stack([np.cos(a), 0.4 * np.sin(a)], 1)
    turned = np.concatenate([np.roll(bent[:-1], -10, 0), np.roll(bent[:-1], -10, 0)[:1]])
    assert shapes.align_closed(turned, bent, T, 4)[3] < 0.2 < shapes.align_nd(turned[None], bent[None], T)[2][0]


def test_one_dimension_of_space_is_a_curve():
    r = np.random.default_rng(9)
    q1, q2 = r.normal(size=(3, 20)), r.normal(size=(3, 20))
    t = nm.unit_grid(20)
    assert np.allclose(elastic.warp_dp_many(q1, q2, t), elastic.warp_dp_many(q1[..., None], q2[..., None], t))


def test_change_of_scores(spark):
    rows = [(k, [float((k >= 60) * 3 + 0.1 * np.sin(k)), float(0.1 * np.cos(3 * k))]) for k in range(100)]
    at, stat, p = shapes.score_changepoint(spark.createDataFrame(rows, "id long, scores array<double>").repartition(3))
    assert at == 60 and p < 0.01 and stat > 2
