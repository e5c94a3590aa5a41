"""Queries of models over several predictors, conformal regions, charts and small numerics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from curvelake.functions import numeric as nm
from curvelake.operators import cluster, depth, elastic, infer, metrics, models, monitor, pointwise, reduce, regress, smooth
from curvelake.operators.apply import cross_pairs, nearest, per_curve, self_pairs, sums
from curvelake.plans.basics import named
from curvelake.plans.others import GRID, _binary_of, _density, _listed
from curvelake.plans.registry import _BOTH, _C, _D2, _H, _LABEL, _WEIGHTS, EMB, REV, _z, curve_rows, rounded, rows
from curvelake.sources import curves as src
from curvelake.sources.curves import Curves

M = src.EMBEDDING_POINTS


def _y(c: Curves):
    return c.df.select("id", F.col("label").cast("double").alias("y"))


def _pair(spark, d):
    c = EMB(spark, d)
    return [c, pointwise.derivative(c)]


# ---- regression ----

for _name in ("fregre_lm_multi", "predict_fregre_lm_multi"):
    named(_name, None, lambda spark, d: rounded(models.linear_multi(_pair(spark, d), "label", [3, 2])[3].select("id", "label", "fit")))
named("fregre_lm_multi_cv", None, lambda spark, d: rows(spark, "counts string, mse double", models.linear_multi_cv(_pair(spark, d), "label", [[2, 1], [3, 2]])))
_MIXED = f"{_D2}, {_BOTH}, {_LABEL}, z AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS z FROM embeddings), s AS (SELECT i, sum(exp(-d * d / 2) * exp(-pow((a.z - b.z) / 0.2, 2) / 2)) AS w, sum(exp(-d * d / 2) * exp(-pow((a.z - b.z) / 0.2, 2) / 2) * label) AS wy FROM m JOIN l ON l.id = j JOIN z a ON a.id = i JOIN z b ON b.id = j GROUP BY i) SELECT l.id, label::DOUBLE AS y, {_z('wy / w')} AS fit FROM l JOIN s ON s.i = l.id"
named("fregre_np_mixed", _MIXED, lambda spark, d: (lambda c: rounded(models.mixed_kernel(c, c.df.select("id", F.col("label").cast("double").alias("y"), F.col("values")[0].alias("z")), 1.0, 0.2)))(EMB(spark, d)))
_LOO = f"{_D2}, {_BOTH}, {_LABEL}, h AS (SELECT unnest([0.1, 0.3, 1.0])::DOUBLE AS h), s AS (SELECT h, i, sum(exp(-d * d / (2 * h * h))) AS w, sum(exp(-d * d / (2 * h * h)) * label) AS wy FROM m JOIN l ON l.id = j, h GROUP BY h, i) SELECT h, {_z('avg(pow(label - wy / w, 2))')} AS mse FROM s JOIN l ON l.id = s.i GROUP BY h"
named("fregre_np_cv", _LOO, lambda spark, d: (lambda c: rows(spark, "h double, mse double", models.kernel_cv(c, _y(c), (0.1, 0.3, 1.0))))(EMB(spark, d)))
named("predict_fregre_np", f"WITH {_C}, {_WEIGHTS}, d AS (SELECT a.id AS i, b.id AS j, any_value(b.label) AS y, sum(w * (a.v - b.v) * (a.v - b.v)) AS d2 FROM c a JOIN c b USING (pos) JOIN w USING (pos) WHERE a.id % 100 = 0 AND b.id % 100 <> 0 GROUP BY a.id, b.id) SELECT i AS id, {_z('sum(exp(-d2 / 0.18) * y) / sum(exp(-d2 / 0.18))')} AS fit FROM d GROUP BY i", lambda spark, d: (lambda c: rounded(regress.predict_nonparametric(metrics.cross_distances(c.with_df(c.df.where("id % 100 = 0")), c.with_df(c.df.where("id % 100 != 0"))), _y(c), 0.3)))(EMB(spark, d)))
named("fregre_basis_cv", None, lambda spark, d: rows(spark, "lambda double, mse double", models.ridge_cv(EMB(spark, d), "label", nm.bspline_basis(GRID, 8), (0.001, 0.1, 10.0))))
named("fam", None, lambda spark, d: rounded(models.additive(EMB(spark, d), "label", 3)[2].select("id", "label", "fit")))


def _on_components(spark, d):
    """Coefficient curves of the response rebuilt from its components."""
    c = EMB(spark, d)
    b = reduce.fpca(c, 4)
    rebuilt = per_curve(c.df.select("id", "label", "values"), lambda v: b.rebuild(b.project(v)), "values array<double>")
    return curve_rows(spark, *regress.function_on_scalar(c.with_df(rebuilt), ["label"])[0], names=("intercept", "slope"))


named("fosr_fpc", None, _on_components)
named("fof_cv", None, lambda spark, d: (lambda c, y: rows(spark, "kx int, ky int, mse double", [(k, j, float(_fof_loss(c, y, k, j))) for k in (2, 4) for j in (2, 4)]))(*_pair(spark, d)))


def _fof_loss(x: Curves, y: Curves, kx: int, ky: int) -> float:
    """Mean integrated error on every third curve of a fit to the others."""
    part = lambda c, odd: c.with_df(c.df.where(f"id % 3 {'=' if odd else '!='} 0"))
    fit = regress.predict_function_on_function(part(x, True), regress.function_on_function(part(x, False), part(y, False), kx, ky))
    both = fit.select("id", F.col("values").alias("fit")).join(y.df.select("id", "values"), "id")
    n, e = sums(both, lambda a, b: [np.array([len(a)]), np.array([((a - b) ** 2 @ y.weights).sum()])], ["fit", "values"])
    return e[0] / n[0]


# ---- classification ----

named("fclassif_knn", None, lambda spark, d: (lambda c: cluster.knn_classify(models.score_nearest(c, 5, 5), c.df.select("id", F.col("label").alias("label")), 5).select("id", "label", "predicted"))(EMB(spark, d)))
named("fclassif_knn_fit", None, lambda spark, d: (lambda c: (lambda near: rows(spark, "k int, accuracy double", [(k, float(cluster.knn_classify(near, c.df.select("id", "label"), k).agg(F.avg((F.col("label") == F.col("predicted")).cast("double"))).first()[0])) for k in (3, 7)]))(models.score_nearest(c, 5, 7).persist()))(EMB(spark, d)))
_VOTE = f"{_D2}, {_BOTH}, {_LABEL}, h AS (SELECT unnest([0.05, 0.1, 0.2])::DOUBLE AS h), v AS (SELECT h, i, label, sum(exp(-d * d / (2 * h * h))) AS n FROM m JOIN l ON l.id = j, h GROUP BY ALL), b AS (SELECT h, i, label FROM v QUALIFY row_number() OVER (PARTITION BY h, i ORDER BY n DESC, label) = 1) SELECT h, {_z('avg((b.label = l.label)::INT)')} AS accuracy FROM b JOIN l ON l.id = b.i GROUP BY h"
named("fclassif_kernel", _VOTE, lambda spark, d: (lambda c: rows(spark, "h double, accuracy double", models.best_kernel(c, c.df.select("id", "label"), (0.05, 0.1, 0.2))))(EMB(spark, d)))
for _name, _quadratic in {"fclassif_cv": False, "fclassif_cv_with_config": True}.items():
    named(_name, None, lambda spark, d, q=_quadratic: rows(spark, "fold int, error double", models.classify_cv(EMB(spark, d), "label", 3, q)))
named("knn_loocv", f"{_D2}, {_BOTH}, {_LABEL}, q AS (SELECT i, avg(label) AS f FROM (SELECT i, j FROM m QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, j) <= 5) JOIN l ON l.id = j GROUP BY i) SELECT {_z('avg(pow(label - f, 2))')} AS mse FROM q JOIN l ON l.id = q.i", lambda spark, d: (lambda c: rounded(cluster.knn_regress(nearest(c.df, metrics.lp(c.weights), 5), _y(c), 5).join(_y(c), "id").agg(F.avg(F.pow(F.col("y") - F.col("fit"), F.lit(2.0))).alias("mse"))))(EMB(spark, d)))
named("predict_gmm", None, lambda spark, d: (lambda c: cluster.gmm(c, 3, max_iter=15)[3].where("id % 100 = 0").select("id", "cluster"))(EMB(spark, d)))
named("gmm_cluster_with_config", None, lambda spark, d: cluster.gmm(EMB(spark, d), 3, max_iter=15, diagonal=True)[3].select("id", "cluster"))

# ---- conformal regions ----

for _name in ("conformal_generic_regression", "conformal_fregre_np"):
    # a fitted predictor (kernel means); residuals of every second row calibrate
    named(_name, None, lambda spark, d: (lambda fit: rounded(models.conformal_of(fit.where("id % 2 = 0"), fit.where("id % 2 = 1"), 0.1)[0]))((lambda c: regress.nonparametric_of(c, _y(c), 0.3).persist())(EMB(spark, d))))
named("cv_conformal_regression", None, lambda spark, d: (lambda c: rounded(models.cross_conformal(c, "label", c, 3, 3)[0]))(EMB(spark, d)))
named("jackknife_plus_regression", None, lambda spark, d: (lambda c: rounded(models.jackknife_plus(c, "label", c.with_df(c.df.where("id % 100 = 0")), 3)))(EMB(spark, d)))


def _probabilities(spark, d):
    c = _binary_of(spark, d)
    p = regress.glm(c, "y", "binomial", 3).predict(c)
    return p.select("id", F.array(1 - F.col("fit"), F.col("fit")).alias("probabilities"), F.col("y").cast("int").alias("label"))


for _name, _how in {"conformal_logistic": "lac", "conformal_generic_classification": "aps", "cv_conformal_classification": "lac"}.items():
    named(_name, None, lambda spark, d, h=_how: (lambda p: infer.conformal_classes(p.where("id % 2 = 1").select("id", "probabilities"), p.where("id % 2 = 0"), 0.1, h).select("id", F.array_join("set", ",").alias("classes")))(_probabilities(spark, d)))

# ---- tests and bands ----

named("equivalence_test_one_sample", None, lambda spark, d: (lambda c: rows(spark, "equivalent boolean, p double", [tuple(infer.equivalence(c, c.with_df(c.df.select("id", F.lit([0.0] * M).alias("values"))), 0.5, n_boot=50))]))(EMB(spark, d)))
named("scb_mean_degras", None, lambda spark, d: curve_rows(spark, *infer.mean_band(EMB(spark, d), 0.05, n_boot=50)[:3], names=("mean", "low", "high")))


def _exponential_band(spark, d):
    """A band of logits of curves made into shares, carried back."""
    c = EMB(spark, d)
    logits = c.with_df(per_curve(c.df.select("id", "values"), lambda v: np.log((v + 2) / (3 - v)), "values array<double>"))
    center, half = infer.tolerance_band(logits, n_boot=20)
    back = lambda x: (3 * np.exp(x) - 2) / (1 + np.exp(x))
    return curve_rows(spark, back(center), back(center - half), back(center + half), names=("center", "low", "high"))


named("exponential_family_tolerance_band", None, _exponential_band)
named("outliers_threshold_lrt_with_dist", None, lambda spark, d: rows(spark, "threshold double", [(depth.lrt_threshold(EMB(spark, d), n_boot=20),)]))
named("frechet_anova", None, lambda spark, d: (lambda c: rows(spark, "statistic double, p double", [models.quantile_anova(Curves(per_curve(c.df.select("id", "label", "values"), _density, "values array<double>"), GRID), "label")]))(EMB(spark, d)))
named("lqd_fpca", None, lambda spark, d: (lambda c: rows(spark, "k int, eigenvalue double", [(k, float(x)) for k, x in enumerate(reduce.fpca(c.with_df(per_curve(c.df.select("id", "values"), lambda v: np.array([infer.lqd(f, GRID) for f in _density(v)]), "values array<double>")), 3).eigenvalues)]))(EMB(spark, d)))

# ---- charts ----

for _name, _pick in {"mf_spm_phase1": 1, "mf_spm_monitor": 0}.items():
    named(_name, None, lambda spark, d, k=_pick: (lambda got: rounded(got[0]) if k == 0 else rows(spark, "t2 double, spe double", [tuple(float(x) for x in got[1])]))(models.multivariate_chart(_pair(spark, d), 3)))
named("hotelling_t2_regularized", "WITH x AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b FROM embeddings) SELECT id, round(a * a / 0.5 + b * b / 0.1, 6) + 0.0 AS t2 FROM x", lambda spark, d: rounded(models.regularized_t2(EMB(spark, d).df.select("id", F.slice("values", 1, 2).alias("scores")), [0.5, 1e-9], 0.1)))
named("frcc_phase1", f"WITH {_C}, b AS (SELECT pos, regr_slope(v, label) AS s, regr_intercept(v, label) AS i FROM c GROUP BY pos) SELECT id, pos, {_z('v - i - s * label')} AS v FROM c JOIN b USING (pos)", lambda spark, d: rounded(models.adjusted_residuals(EMB(spark, d), ["label"]).long()))
named("frcc_monitor", None, lambda spark, d: (lambda c: rounded(monitor.monitor(c, monitor.phase1(c, 3)[0]).select("id", "t2", "spe", "t2_alarm", "spe_alarm")))(models.adjusted_residuals(EMB(spark, d), ["label"])))
named("profile_phase1", f"WITH {_C}, k AS (SELECT id, pos, v, label, dense_rank() OVER (ORDER BY id) - 1 AS k FROM c), w AS (SELECT range * 25 AS lo, range AS w FROM range((SELECT (count(*) - 50) // 25 + 1 FROM embeddings))) SELECT w AS id, pos, {_z('regr_slope(v, label)')} AS v FROM k JOIN w ON k >= lo AND k < lo + 50 GROUP BY w, pos", lambda spark, d: rounded(models.window_profiles(EMB(spark, d), "label", 50, 25).long()))
named("profile_monitor", None, lambda spark, d: (lambda w: rounded(monitor.statistics(w, reduce.fpca(w, 2)).select("id", "t2", "spe")))(models.window_profiles(EMB(spark, d), "label", 50, 25)))
named("t2_contributions", None, lambda spark, d: (lambda c, m: _listed(monitor.t2_by_component(monitor.statistics(c, m), m), "contributions"))(EMB(spark, d), reduce.fpca(EMB(spark, d), 4)))

# ---- series of curves ----

named("fplsr", None, lambda spark, d: (lambda c: curve_rows(spark, models.next_curve(pointwise.normalize(c, "curve_standardize"), 2)))(REV(spark, d)))
named("ftsm_update", None, lambda spark, d: (lambda c: rounded(reduce.scores(c, reduce.fpca(c.with_df(c.df.where("id < 20")), 3)).select("id", "scores")))(pointwise.normalize(REV(spark, d), "curve_standardize")))
named("principal_differential_analysis", f"WITH {_C}, y AS (SELECT id, pos, v, CASE WHEN lag(v) OVER o IS NULL THEN (lead(v) OVER o - v) / {_H} WHEN lead(v) OVER o IS NULL THEN (v - lag(v) OVER o) / {_H} ELSE (lead(v) OVER o - lag(v) OVER o) / (2 * {_H}) END AS y FROM c WINDOW o AS (PARTITION BY id ORDER BY pos)) SELECT pos, round(-sum(v * y) / sum(v * v), 2) + 0.0 AS value FROM y GROUP BY pos", lambda spark, d: rounded(curve_rows(spark, models.differential_operator(EMB(spark, d))[0]), 2))

# ---- surfaces ----

_W2 = nm.simpson_weights_2d(nm.unit_grid(8), nm.unit_grid(8))
_WSQL = "w AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, {float(x)!r}::DOUBLE)" for k, x in enumerate(_W2)) + ") t(pos, w))"
for _name, _self in {"lp_self_2d": True, "lp_cross_2d": False}.items():
    named(_name, f"WITH {_C}, {_WSQL} SELECT a.id AS i, b.id AS j, {_z('sqrt(sum(w * (a.v - b.v) * (a.v - b.v)))')} AS d FROM c a JOIN c b USING (pos) JOIN w USING (pos) WHERE {'a.id < b.id' if _self else 'a.id % 100 = 0'} GROUP BY ALL", lambda spark, d, own=_self: (lambda c: self_pairs(c.df, metrics.lp(_W2), places=6) if own else cross_pairs(c.df.where("id % 100 = 0"), c.df, metrics.lp(_W2), places=6))(EMB(spark, d)))
named("geometric_median_2d", None, lambda spark, d: curve_rows(spark, pointwise.geometric_median(EMB(spark, d), _W2)))
for _name, _fn in {"fraiman_muniz_2d": depth.fraiman_muniz, "random_projection_2d": depth.random_projection, "random_tukey_2d": lambda c: depth.random_projection(c, how="min"), "modal_2d": depth.modal, "functional_spatial_2d": depth.spatial}.items():
    _rank = "(SELECT id, pos, v, count(*) OVER (PARTITION BY pos) AS n, count(*) OVER (PARTITION BY pos ORDER BY v RANGE UNBOUNDED PRECEDING) AS le FROM c)"
    named(_name, f"WITH {_C} SELECT id, round(avg(least(le / n, 1 - le / n)), 12) + 0.0 AS depth FROM {_rank} GROUP BY id" if _name == "fraiman_muniz_2d" else None, lambda spark, d, f=_fn: rounded(f(EMB(spark, d)), 12 if f is depth.fraiman_muniz else 6))
named("kernel_functional_spatial_2d", None, lambda spark, d: rounded(depth.kernel_spatial_all(EMB(spark, d), 1.0, _W2)))

# ---- small numerics ----

_TRAPZ = "(v * v + lag(v * v) OVER (PARTITION BY id ORDER BY pos)) / 2"
named("inner_product_l2", f"WITH {_C}, s AS (SELECT id, {_TRAPZ} * {_H} AS a FROM c) SELECT id, {_z('sum(a)')} AS value FROM s GROUP BY id", lambda spark, d: rounded(per_curve(EMB(spark, d).df.select("id", "values"), lambda v: nm.trapz(v * v, GRID), "value double")))
named("l2_norm_l2", f"WITH {_C}, s AS (SELECT id, {_TRAPZ} * {_H} AS a FROM c) SELECT id, {_z('sqrt(sum(a))')} AS value FROM s GROUP BY id", lambda spark, d: rounded(per_curve(EMB(spark, d).df.select("id", "values"), lambda v: np.sqrt(nm.trapz(v * v, GRID)), "value double")))
named("bandwidth_candidates_from_dists", f"{_D2}, q AS (SELECT unnest(range(1, 6)) AS k, unnest(quantile_cont(d, [1 / 6.0, 2 / 6.0, 3 / 6.0, 4 / 6.0, 5 / 6.0])) AS h FROM d WHERE d > 0) SELECT k::INT AS k, {_z('h')} AS h FROM q", lambda spark, d: rows(spark, "k int, h double", [(k + 1, x) for k, x in enumerate(metrics.distance_quantiles(EMB(spark, d), [j / 6 for j in range(1, 6)]))]))


named("andrews_loadings", None, lambda spark, d: (lambda m: rounded(reduce.andrews(spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(m.loadings.T)], "id long, features array<double>"), np.linspace(-np.pi, np.pi, 21)).select("id", F.posexplode("curve").alias("pos", "v"))))(reduce.fpca(EMB(spark, d), 3)))
named("gam_to_psi_smooth", None, lambda spark, d: _listed(per_curve(EMB(spark, d).df.select("id", "values"), lambda v: np.array([smooth.nadaraya_watson(GRID, elastic.psi(g, GRID), GRID, 2 * float(GRID[1])) for g in elastic.normalize_warp_rows(v, GRID)]), "values array<double>")))
named("solve_gaussian_pub", f"WITH {_C}, s AS (SELECT sum(label) AS sx, sum(label * label) AS sxx, count(*) AS n, sum(v) AS sy, sum(label * v) AS sxy FROM c WHERE pos = 0) SELECT {_z('(sxx * sy - sx * sxy) / (n * sxx - sx * sx)')} AS a, {_z('(n * sxy - sx * sy) / (n * sxx - sx * sx)')} AS b FROM s", lambda spark, d: rows(spark, "a double, b double", [tuple(float(x) for x in regress.function_on_scalar(EMB(spark, d), ["label"])[0][:, 0])]))


# ---- validation: what is found where every hundredth row has been damaged ----


def _damaged(spark, d, column: str, bad) -> Curves:
    c = EMB(spark, d)
    return c.with_df(c.df.withColumn(column, F.when(F.col("id") % 100 == 0, bad(F.col(column))).otherwise(F.col(column))))


_PLANTED = "SELECT vec_id AS id FROM embeddings WHERE vec_id % 100 = 0"
named("validate_fdata", _PLANTED, lambda spark, d: src.invalid(_damaged(spark, d, "values", lambda v: F.transform(v, lambda x, k: F.when(k == 5, F.lit(float("nan"))).otherwise(x)))).select("id"))
named("validate_response", _PLANTED, lambda spark, d: _damaged(spark, d, "label", lambda v: F.lit(None)).df.where("label IS NULL OR isnan(label)").select("id"))
named("validate_labels", _PLANTED, lambda spark, d: _damaged(spark, d, "label", lambda v: -1 - v).df.where("label IS NULL OR label < 0").select("id"))


def _bad_distances(i, j, d):
    """Rows of a distance table that can't be one, after those of every hundredth i have been damaged."""
    d = np.where(i % 100 == 0, -d - 1, d)
    return (d < 0) | np.isnan(d) | (i >= j)


named("validate_dist_mat", "SELECT a.vec_id AS i, b.vec_id AS j FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE a.vec_id % 100 = 0", lambda spark, d: (lambda c: self_pairs(c.df, metrics.lp(c.weights), keep=_bad_distances).select("i", "j"))(EMB(spark, d)))
named("validate_ncomp", _PLANTED, lambda spark, d: _damaged(spark, d, "values", lambda v: F.slice(v, 1, 2)).df.where(F.size("values") < 3).select("id"))
named("fold_indices", "SELECT k::INT AS fold, (SELECT count(*) FROM embeddings) - (count(*) + 4 - k) // 5 AS n_train, (count(*) + 4 - k) // 5 AS n_test FROM embeddings, range(5) x(k) GROUP BY k", lambda spark, d: (lambda f: f.crossJoin(F.broadcast(f.agg(F.sum("n_test").alias("n")))).select("fold", (F.col("n") - F.col("n_test")).alias("n_train"), "n_test"))(pointwise.folds(EMB(spark, d).df, 5).groupBy("fold").agg(F.count("*").alias("n_test"))))
