"""Queries of elastic statistics: the nations' smoothed curves, and embeddings as plane curves."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from curvelake.functions import numeric as nm
from curvelake.operators import elastic, season, shapes
from curvelake.operators.apply import per_curve, sums
from curvelake.plans.basics import cells, named
from curvelake.plans.others import _listed, _mean
from curvelake.plans.registry import EMB, _smoothed, curve_rows, rounded, rows
from curvelake.sources import curves as src

T = np.arange(float(src.MONTHS))
BAND = 0.2


def _aligned(spark, d):
    """id, values, aligned, warp, distance of every nation. The smoothed curves, a row a nation, are
    dealt out by id and held for their mean and the warps: smoothing and warping are steps apart,
    and no task runs the workers of both."""
    c = _smoothed(spark, d)
    c = c.with_df(c.df.repartition(spark.sparkContext.defaultParallelism, "id").persist())
    n, s = sums(c.df, lambda v: [np.array([len(v)]), v.sum(0)], ["values"])
    return elastic.align_to(c.with_df(c.df.withColumn("own", F.col("values"))), s / n[0], band=BAND).withColumnRenamed("own", "values").persist()


# ---- pairs ----

for _name, _options in {"elastic_cross_distance_matrix": {"band": BAND}, "elastic_cross_distance_matrix_banded": {"band": 0.1}, "elastic_cross_distance_matrix_with_band": {"band": 0.05}}.items():
    named(_name, None, lambda spark, d, o=_options: (lambda c: rounded(shapes.cross_distances(c.with_df(c.df.where("id < 5")), c, **o)))(_smoothed(spark, d)))
named("elastic_decomposition", None, lambda spark, d: rounded(shapes.decomposition(_smoothed(spark, d), _mean(spark, d), band=BAND)))


def _against_mean(name: str, fn, schema: str) -> None:
    """fn(mean, curve) for every nation's curve."""
    def run(spark, d):
        mean = _mean(spark, d)
        return rounded(season.per_series(_smoothed(spark, d), lambda v, t: fn(mean, v), schema))

    named(name, None, run)


_against_mean("curve_geodesic", lambda m, v: (shapes.geodesic(m, v, T, 3)[1],), "values array<double>")
_top = lambda v: float(min(max(T[int(np.argmax(v))], 1.0), T[-1] - 1))
_against_mean("elastic_align_pair_constrained", lambda m, v: shapes.align_through(m, v, T, [_top(v)], [_top(m)])[1:], "aligned array<double>, distance double")
_against_mean("elastic_align_pair_with_landmarks", lambda m, v: shapes.align_through(m, v, T, [20.0, 60.0], [20.0, 60.0])[1:], "aligned array<double>, distance double")
_against_mean("elastic_align_pair_multires", lambda m, v: shapes.align_coarse_to_fine(m, v, T)[1:], "aligned array<double>, distance double")
_against_mean("elastic_partial_match", lambda m, v: shapes.partial_match(m[:40:2], v[::2], T[::2], 2), "first double, last double, distance double")
_against_mean("bayesian_align_pair", lambda m, v: shapes.warp_posterior(m, v, T, 50)[:1], "warp array<double>")
_against_mean("diagnose_pairwise", lambda m, v: (lambda g, w, x: (x, float(np.max(np.gradient(g))), elastic.warp_complexity(g, T), elastic.inverse_error(g, T)))(*elastic.align(m, v, T, 0.0, BAND)), "distance double, steepest double, complexity double, inverse_error double")


# ---- tangent vectors ----

for _name, _method in {"tsrvf_transform": "log", "tsrvf_from_alignment": "log", "tsrvf_transform_with_method": "difference", "tsrvf_from_alignment_with_method": "difference"}.items():
    named(_name, None, lambda spark, d, m=_method: _listed(shapes.tangent_vectors(_smoothed(spark, d), _mean(spark, d), band=BAND, method=m), "vector"))
named("tsrvf_inverse", None, lambda spark, d: (lambda c, m: _listed(shapes.from_tangent(shapes.tangent_vectors(c, m, band=BAND), c, m).df))(_smoothed(spark, d), _mean(spark, d)))

# ---- quality ----

for _name in ("alignment_quality", "diagnose_alignment"):
    named(_name, None, lambda spark, d: (lambda q: rows(spark, "measure string, value double", sorted((k, float(v)) for k, v in q.items())))(shapes.quality(_smoothed(spark, d), _aligned(spark, d))))
named("least_squares_score", None, lambda spark, d: rows(spark, "score double", [(shapes.least_squares_score(_smoothed(spark, d), _aligned(spark, d)),)]))
named("sobolev_least_squares_score", None, lambda spark, d: rows(spark, "score double", [(shapes.least_squares_score(_smoothed(spark, d), _aligned(spark, d), 1),)]))
named("pairwise_correlation_score", None, lambda spark, d: rows(spark, "score double", [(shapes.correlation_score(_smoothed(spark, d), _aligned(spark, d)),)]))
named("pairwise_consistency", None, lambda spark, d: rows(spark, "error double", [(shapes.consistency(np.array([x["values"] for x in _smoothed(spark, d).df.orderBy("id").limit(4).collect()]), T),)]))
named("lambda_cv", None, lambda spark, d: rows(spark, "lambda double, loss double", shapes.choose_penalty(_smoothed(spark, d), (0.0, 0.1), 2, band=BAND)))
named("peak_persistence", None, lambda spark, d: rows(spark, "lambda double, peaks int", shapes.peak_counts(_smoothed(spark, d), (0.0, 1.0), band=BAND)))
named("elastic_outlier_detection", None, lambda spark, d: rounded(shapes.outliers(_smoothed(spark, d), _mean(spark, d), band=BAND)[0]))
named("phase_boxplot", None, lambda spark, d: rows(spark, "median double, lower double, upper double, low double, high double", shapes.phase_boxplot(_aligned(spark, d), T)[0]))
named("transfer_alignment", None, lambda spark, d: (lambda c: rounded(shapes.transfer(c.with_df(c.df.where("id < 12")), c.with_df(c.df.where("id >= 12")), band=BAND)[1].select("id", "distance")))(_smoothed(spark, d)))

# ---- curves in the plane: each embedding's halves as two coordinates ----

P = nm.unit_grid(32)


def _all_plane(spark, d):
    return EMB(spark, d).df.select("id", "values")


named("srsf_transform_nd", None, lambda spark, d: _listed(per_curve(_all_plane(spark, d), lambda v: shapes._flat(shapes.srsf_nd(shapes._unflat(v, 2), P)), "values array<double>")))
named("srsf_inverse_nd", None, lambda spark, d: _listed(per_curve(_all_plane(spark, d), lambda v: shapes._flat(shapes.srsf_inverse_nd(shapes.srsf_nd(shapes._unflat(v, 2), P), P)), "values array<double>")))


def _nation_plane(spark, d):
    """A nation's revenue and its derivative as a plane curve."""
    c = _smoothed(spark, d)
    return per_curve(c.df.select("id", "values"), lambda v: np.hstack([v, nm.central_differences(v, c.grid)]), "values array<double>")


def _nd_mean(spark, d):
    n, s = sums(_nation_plane(spark, d), lambda v: [np.array([len(v)]), v.sum(0)], ["values"])
    return shapes._unflat((s / n[0])[None], 2)


def _nd(fn, schema):
    def run(spark, d):
        mean = _nd_mean(spark, d)
        return rounded(per_curve(_nation_plane(spark, d), lambda v: fn(*shapes.align_nd(np.repeat(mean, len(v), 0), shapes._unflat(v, 2), T, 0.0, BAND)), schema))

    return run


named("elastic_align_pair_nd", None, _nd(lambda g, w, x: (g, x), "warp array<double>, distance double"))
named("elastic_distance_nd", None, _nd(lambda g, w, x: x, "distance double"))
named("karcher_mean_nd", None, lambda spark, d: cells(spark, shapes.karcher_mean_nd(_nation_plane(spark, d), T, 2, 2, band=BAND)))
named("karcher_covariance_nd", None, lambda spark, d: cells(spark, shapes.covariance_nd(_nation_plane(spark, d), T, 2, _nd_mean(spark, d)[0], band=BAND)[0]))
named("pca_nd", None, lambda spark, d: rows(spark, "k int, eigenvalue double", [(k, float(x)) for k, x in enumerate(shapes.covariance_nd(_nation_plane(spark, d), T, 2, _nd_mean(spark, d)[0], band=BAND)[2])]))
named("curve_geodesic_nd", None, _nd(lambda g, w, x: (shapes._flat(w), x), "aligned array<double>, distance double"))

# ---- closed curves and shapes ----


def _closed(v):
    """A curve's first 32 values around a circle."""
    a = 2 * np.pi * np.arange(33) / 32
    radius = 1 + 0.2 * np.append(v[:32], v[0])
    return np.stack([radius * np.cos(a), radius * np.sin(a)], 1)


def _closed_query(pick, schema):
    def run(spark, d):
        mean = _closed(_mean(spark, d))
        u = nm.unit_grid(33)
        return rounded(season.per_series(_smoothed(spark, d), lambda v, t: pick(*shapes.align_closed(mean, _closed(v), u, 4)), schema))

    return run


named("elastic_align_pair_closed", None, _closed_query(lambda k, g, w, x: (int(k), g, x), "shift int, warp array<double>, distance double"))
named("elastic_distance_closed", None, _closed_query(lambda k, g, w, x: (x,), "distance double"))


def _closed_mean(spark, d):
    mean, u = _closed(_mean(spark, d)), nm.unit_grid(33)
    n, s = sums(_smoothed(spark, d).df, lambda v: [np.array([len(v)]), np.sum([shapes.align_closed(mean, _closed(x), u, 4)[2] for x in v], 0)], ["values"])
    return cells(spark, s / n[0])


named("karcher_mean_closed", None, _closed_mean)
named("orbit_representative", None, lambda spark, d: _listed(shapes.shapes(_smoothed(spark, d)).df))
for _name in ("shape_distance", "shape_self_distance_matrix"):
    named(_name, None, lambda spark, d: rounded(shapes.shape_distances(_smoothed(spark, d), band=0.1)))
named("shape_mean", None, lambda spark, d: curve_rows(spark, shapes.shape_mean(_smoothed(spark, d), max_iter=3, band=BAND)))
named("shape_confidence_interval", None, lambda spark, d: curve_rows(spark, *shapes.mean_band(_smoothed(spark, d), 20, band=BAND), names=("mean", "low", "high")))

# ---- models ----

for _name in ("joint_fpca", "joint_fpca_from_alignment"):
    named(_name, None, lambda spark, d: rows(spark, "k int, eigenvalue double", [(k, float(x)) for k, x in enumerate(shapes.joint_fpca(_aligned(spark, d), T)[2])]))
named("horiz_fpns", None, lambda spark, d: _listed(shapes.phase_scores(_aligned(spark, d), T), "scores"))
for _name, _joint in {"gauss_model": False, "joint_gauss_model": True}.items():
    named(_name, None, lambda spark, d, j=_joint: rounded(shapes.sample_model(_aligned(spark, d), T, 10, joint=j)))


def _bands(spark, d, k):
    low, high = shapes.tolerance_bands(_aligned(spark, d), T, n_boot=20)[k]
    return curve_rows(spark, low, high, names=("low", "high"))


for _name, _k in {"elastic_tolerance_band": 0, "elastic_tolerance_band_with_config": 0, "phase_tolerance_band": 1}.items():
    named(_name, None, lambda spark, d, k=_k: _bands(spark, d, k))

# ---- regression: the mean revenue of a nation on its scaled curve ----


def _with_response(spark, d):
    from curvelake.plans.registry import REV

    y = REV(spark, d).df.select("id", (F.aggregate("values", F.lit(0.0), lambda a, x: a + x) / F.lit(src.MONTHS * 1e6)).alias("y"))
    return _aligned(spark, d).join(y, "id")


for _name, _part in {"elastic_pcr": "joint", "elastic_pcr_with_config": "amplitude"}.items():
    named(_name, None, lambda spark, d, p=_part: rounded(shapes.component_regression(_with_response(spark, d), T, "y", 2, p)[1].select("id", "y", "fit")))
named("elastic_pcr_attribution", None, lambda spark, d: rounded(shapes.attribution(_with_response(spark, d), T, "y", 2)))

# ---- change ----

for _name, _fn in {"elastic_ph_changepoint": shapes.phase_scores, "elastic_fpca_changepoint": shapes.amplitude_scores}.items():
    named(_name, None, lambda spark, d, f=_fn: rows(spark, "position int, statistic double, p double", [shapes.score_changepoint(f(_aligned(spark, d), T))]))
