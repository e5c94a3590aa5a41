"""Queries of operators over warps, fits, densities, tests and simulations; few have SQL.

Warps come from the nations' smoothed curves aligned to their mean curve.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvelake.functions import numeric as nm
from curvelake.operators import cluster, elastic, infer, metrics, monitor, pointwise, reduce, regress, season, smooth
from curvelake.operators.apply import per_curve, sums
from curvelake.plans.basics import cells, named
from curvelake.plans.registry import _C, _WEIGHTS, EMB, EV, REV, _smoothed, _z, curve_rows, r, rounded, rows
from curvelake.sources import curves as src
from curvelake.sources.curves import Curves

GRID = nm.unit_grid(src.EMBEDDING_POINTS)


def _listed(df, column="values", key="id"):
    return df.select(key, F.posexplode(column).alias("pos", "x")).select(key, "pos", r("x").alias("v"))


def each_nation(name: str, fn, schema: str) -> None:
    """A kernel fn(series, grid) over the nations' smoothed curves."""
    named(name, None, lambda spark, d: rounded(season.per_series(_smoothed(spark, d), fn, schema)))


def each_embedding(name: str, fn, schema: str = "values array<double>", sql: str | None = None) -> None:
    named(name, sql, lambda spark, d: (lambda df: _listed(df) if schema == "values array<double>" else rounded(df))(per_curve(EMB(spark, d).df.select("id", "values"), fn, schema)))


# ---- elastic registration ----


def _mean(spark, d) -> np.ndarray:
    c = _smoothed(spark, d)
    n, s = sums(c.df, lambda v: [np.array([len(v)]), v.sum(0)], ["values"])
    return s / n[0]


def _aligned(spark, d, **options):
    c = _smoothed(spark, d)
    return elastic.align_to(c, _mean(spark, d), **options)


for _name, _options in {"elastic_align_pair_banded": {"band": 0.1}, "elastic_align_pair_penalized": {"lam": 0.1}}.items():
    named(_name, None, lambda spark, d, o=_options: rounded(_aligned(spark, d, **o)))
for _name, _options in {"elastic_distance_banded": {"band": 0.1}, "amplitude_distance": {}}.items():
    named(_name, None, lambda spark, d, o=_options: rounded(_aligned(spark, d, **o).select("id", "distance")))
for _name, _options in {"elastic_self_distance_matrix_banded": {"band": 0.1}, "elastic_self_distance_matrix_with_band": {"band": 0.2}, "amplitude_self_distance_matrix": {"lam": 0.1}}.items():
    named(_name, None, lambda spark, d, o=_options: rounded(elastic.distances(_smoothed(spark, d), **o)))
for _name, _options in {"karcher_mean_banded": {"band": 0.1}, "karcher_mean_with_band": {"band": 0.2}}.items():
    named(_name, None, lambda spark, d, o=_options: curve_rows(spark, elastic.karcher_mean(_smoothed(spark, d), **o)))
named("karcher_median", None, lambda spark, d: curve_rows(spark, elastic.karcher_median(_smoothed(spark, d), max_iter=10)))
named("robust_karcher_mean", None, lambda spark, d: curve_rows(spark, elastic.karcher_mean(_smoothed(spark, d), max_iter=10, weights=lambda x: 1 / (1 + x * x))))
named("elastic_depth", None, lambda spark, d: rounded(elastic.depth(elastic.distances(_smoothed(spark, d), band=0.2))))
each_embedding("srsf_inverse", lambda v: elastic.srsf_inverse(elastic.srsf(v, GRID), GRID, 0.0))


def _warps(spark, d, kernel, schema):
    a = _aligned(spark, d, band=0.2).select("id", "warp")
    return per_curve(a, kernel, schema, values="warp")


_MONTHS = np.arange(float(src.MONTHS))
_U = _MONTHS / _MONTHS[-1]
for _name, _fn in {
    "warp_complexity": lambda w: [elastic.warp_complexity(g, _MONTHS) for g in w],
    "warp_smoothness": lambda w: [elastic.warp_smoothness(g, _MONTHS) for g in w],
    "warp_inverse_error": lambda w: [elastic.inverse_error(g, _MONTHS) for g in w],
}.items():
    named(_name, None, lambda spark, d, f=_fn: rounded(_warps(spark, d, f, "value double")))
_ID = lambda g: g / _MONTHS[-1]
for _name, _fn in {
    "invert_warp": lambda g: elastic.invert(g, _MONTHS),
    "invert_gamma": lambda g: elastic.invert(_ID(g), _U),
    "compose_warps": lambda g: elastic.compose(g, elastic.invert(g, _MONTHS), _MONTHS),
    "normalize_warp": lambda g: elastic.normalize_warp(g * 2 + 1, _MONTHS),
    "reparameterize_curve": lambda g: elastic.apply_warp(np.sin(_U * 6), g, _MONTHS),
    "gam_to_psi": lambda g: elastic.psi(_ID(g), _U),
    "psi_to_gam": lambda g: elastic.psi_to_warp(elastic.psi(_ID(g), _U), _U),
    "inv_exp_map_sphere": lambda g: elastic.sphere_log(np.ones(len(g)), elastic.psi(_ID(g), _U), _U),
    "exp_map_sphere": lambda g: elastic.sphere_exp(np.ones(len(g)), elastic.sphere_log(np.ones(len(g)), elastic.psi(_ID(g), _U), _U), _U),
}.items():
    named(_name, None, lambda spark, d, f=_fn: _listed(_warps(spark, d, lambda w: np.array([f(g) for g in w]), "values array<double>")))
named("warp_statistics", None, lambda spark, d: curve_rows(spark, *elastic.warp_statistics(_aligned(spark, d, band=0.2), _MONTHS), names=("karcher", "mean", "std")))
for _name, _fn in {"vert_fpca": elastic.vertical_fpca, "vert_fpca_from_alignment": elastic.vertical_fpca, "horiz_fpca": elastic.horizontal_fpca, "horiz_fpca_from_alignment": elastic.horizontal_fpca}.items():
    named(_name, None, lambda spark, d, f=_fn: rows(spark, "k int, eigenvalue double", [(k, float(x)) for k, x in enumerate(f(_aligned(spark, d, band=0.2), _MONTHS)[2])]))
named("elastic_amp_changepoint", None, lambda spark, d: rows(spark, "position int, statistic double", [elastic.amplitude_changepoint(_aligned(spark, d, band=0.2), _MONTHS)]))
each_nation("detect_landmarks", lambda v, t: (elastic.landmarks(v, t, "peak", 0.3),), "times array<double>")


def _registered(v, t):
    """The curve with its highest point moved to the middle of the domain."""
    top = min(max(float(t[int(np.argmax(v))]), 1.0), float(t[-1]) - 1)
    return (elastic.apply_warp(v, elastic.landmark_warp([top], [float(t[len(t) // 2])], t), t),)


each_nation("landmark_register", _registered, "values array<double>")

# ---- clustering by distances ----


def _nation_distances(spark, d):
    c = _smoothed(spark, d)
    ids = sorted(x["id"] for x in c.df.select("id").collect())  # 25 nations
    at = {i: k for k, i in enumerate(ids)}
    m = np.zeros((len(ids),) * 2)
    for x in metrics.self_distances(c).collect():
        m[at[x["i"]], at[x["j"]]] = m[at[x["j"]], at[x["i"]]] = x["d"]
    return ids, m


named("hierarchical_from_distances", None, lambda spark, d: rows(spark, "step int, kept int, gone int, height double", [(k, *x) for k, x in enumerate(cluster.hierarchical(_nation_distances(spark, d)[1]))]))
named("cut_dendrogram", None, lambda spark, d: (lambda ids, m: spark.createDataFrame([(int(i), int(c)) for i, c in zip(ids, cluster.cut_dendrogram(cluster.hierarchical(m), len(ids), 4), strict=True)], "id long, cluster int"))(*_nation_distances(spark, d)))
named("knn_predict", None, lambda spark, d: (lambda c: rounded(cluster.knn_regress(metrics.cross_distances(c.with_df(c.df.where("id % 100 = 0")), c).where("i != j"), c.df.select("id", F.col("label").cast("double").alias("y")), 5)))(EMB(spark, d)))
named("predict_fregre_np_from_distances", "WITH c AS (SELECT vec_id AS id, label, generate_subscripts(embedding, 1)::INT - 1 AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings), " + "w AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, {float(x)!r}::DOUBLE)" for k, x in enumerate(nm.simpson_weights(GRID))) + f") t(pos, w)), d AS (SELECT a.id AS i, b.id AS j, any_value(b.label) AS y, sum(w * (a.v - b.v) * (a.v - b.v)) AS d2 FROM c a JOIN c b USING (pos) JOIN w USING (pos) WHERE a.id % 100 = 0 AND b.id % 100 <> 0 GROUP BY a.id, b.id) SELECT i AS id, {_z('sum(exp(-d2 / 2) * y) / sum(exp(-d2 / 2))')} AS fit FROM d GROUP BY i", lambda spark, d: (lambda c: rounded(regress.predict_nonparametric(metrics.cross_distances(c.with_df(c.df.where("id % 100 = 0")), c.with_df(c.df.where("id % 100 != 0"))), c.df.select("id", F.col("label").cast("double").alias("y")), 1.0)))(EMB(spark, d)))

# ---- fits ----

named("basis_to_fdata", None, lambda spark, d: _listed(smooth.evaluate(smooth.project(EMB(spark, d), nm.bspline_basis(GRID, 8)).drop("label"), nm.bspline_basis(GRID, 8), GRID).df))
named("basis_to_fdata_1d", None, lambda spark, d: _listed(smooth.evaluate(smooth.project(EMB(spark, d), nm.fourier_basis(GRID, 7)).drop("label"), nm.fourier_basis(GRID, 7), GRID).df))
_ROUGH = "sum(pow(c, 2) * pow(2 * pi() * ((k + 1) // 2), 4))"
named("fourier_penalty_matrix", f"WITH {_C}, {_WEIGHTS}, f AS (SELECT pos, k, CASE WHEN k = 0 THEN 1.0 WHEN k % 2 = 1 THEN sin(2 * pi() * ((k + 1) // 2) * pos / 63.0::DOUBLE) ELSE cos(2 * pi() * ((k + 1) // 2) * pos / 63.0::DOUBLE) END AS f FROM range(64) a(pos), range(7) b(k)), p AS (SELECT id, k, sum(w * v * f) AS c FROM c JOIN w USING (pos) JOIN f USING (pos) GROUP BY id, k) SELECT id, {_z(_ROUGH)} AS roughness FROM p GROUP BY id", lambda spark, d: (lambda c, phi, p: rounded(per_curve(c.df.select("id", "values"), lambda v: np.einsum("nk,kl,nl->n", v @ phi, p, v @ phi), "roughness double")))(EMB(spark, d), nm.simpson_weights(GRID)[:, None] * nm.fourier_basis(GRID, 7), smooth.fourier_penalty(7, 1.0)))
for _name, _criterion in {"smooth_basis_gcv": "gcv", "smooth_basis_aic": "aic", "smooth_basis_gcv_with_config": "bic"}.items():
    named(_name, None, lambda spark, d, k=_criterion: rows(spark, "lambda double, edf double", [(lambda lam, got: (float(lam), got[1]))(*smooth.smooth_basis_best(EMB(spark, d), nm.bspline_basis(GRID, 8), smooth.bspline_penalty(GRID, 8), k, np.linspace(-6, 2, 9)))]))
named("pspline_fit_gcv", None, lambda spark, d: rows(spark, "lambda double, edf double", [(lambda lam, got: (float(lam), got[2]))(*smooth.pspline_best(EMB(spark, d), 12))]))
named("pspline_evaluate", None, lambda spark, d: (lambda got: _listed(smooth.evaluate(got[0].drop("label"), got[1], GRID).df))(smooth.pspline(EMB(spark, d), 12, 1.0)))
named("select_fourier_nbasis_gcv", None, lambda spark, d: rows(spark, "nbasis int, gcv double", [(n, smooth.fourier_fit(EMB(spark, d), n)[3]) for n in (3, 5, 7, 9)]))
for _name, _criterion in {"basis_nbasis_cv": "gcv", "basis_nbasis_cv_with_config": "bic"}.items():
    named(_name, None, lambda spark, d, k=_criterion: rows(spark, "nbasis int, score double", sorted(smooth.choose_nbasis(EMB(spark, d), range(6, 12), k)[1].items())))
named("fpca_der", None, lambda spark, d: rows(spark, "k int, eigenvalue double", [(k, float(x)) for k, x in enumerate(reduce.fpca_of_derivatives(EMB(spark, d), 3).eigenvalues)]))
named("fsvd", None, lambda spark, d: (lambda c: rows(spark, "k int, value double", [(k, float(x)) for k, x in enumerate(reduce.singular_functions(c, pointwise.derivative(c))[1])]))(EMB(spark, d)))
named("ssvd", None, lambda spark, d: rows(spark, "k int, eigenvalue double", [(k, float(x)) for k, x in enumerate(reduce.smooth_covariance_fpca(EMB(spark, d), 0.05).eigenvalues)]))
named("mfpca", None, lambda spark, d: (lambda c: rows(spark, "k int, eigenvalue double", [(k, float(x)) for k, x in enumerate(reduce.mfpca([c, pointwise.derivative(c)])[3])]))(EMB(spark, d)))
named("model_selection_ncomp", None, lambda spark, d: rows(spark, "k int, gcv double", [(k + 1, float(x)) for k, x in enumerate(regress.choose_components(EMB(spark, d), "label", 5)[1])]))
for _name in ("fregre_cv", "cv_fdata"):
    named(_name, None, lambda spark, d: rows(spark, "k int, mse double", list(regress.cross_validate(EMB(spark, d), "label", range(1, 4), 3).items())))
named("predict_fosr", f"WITH {_C}, b AS (SELECT pos, regr_slope(v, label) AS s, regr_intercept(v, label) AS i FROM c GROUP BY pos) SELECT id, pos, {_z('i + s * label')} AS v FROM c JOIN b USING (pos)", lambda spark, d: _listed(regress.predict_function_on_scalar(EMB(spark, d).df.select("id", "label"), ["label"], regress.function_on_scalar(EMB(spark, d), ["label"])[0])))
named("create_folds", "SELECT k::INT AS fold, (count(*) + 4 - k) // 5 AS n FROM embeddings, range(5) x(k) GROUP BY k", lambda spark, d: pointwise.folds(EMB(spark, d).df, 5).groupBy("fold").agg(F.count("*").alias("n")))
named("create_stratified_folds", "SELECT label, k::INT AS fold, (count(*) + 4 - k) // 5 AS n FROM embeddings, range(5) x(k) GROUP BY label, k", lambda spark, d: pointwise.folds(EMB(spark, d).df, 5, by="label").groupBy(F.col("label"), "fold").agg(F.count("*").alias("n")))
named("subset_rows", f"WITH {_C} SELECT id, pos, {_z('v')} AS v FROM c WHERE id IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)", lambda spark, d: (lambda c: rounded(c.with_df(c.df.join(spark.read.parquet(f"{d}/customer.parquet").where("c_nationkey = 3").select(F.col("c_custkey").cast("long").alias("id")), "id", "left_semi")).long()))(EMB(spark, d)))

# ---- series ----

named("decompose_multiplicative", None, lambda spark, d: rounded(season.decompose(REV(spark, d), 12.0, multiplicative=True)))
named("stl_decompose_with_config", None, lambda spark, d: rounded(season.stl_curves(_smoothed(spark, d), 12, s_window=11, robust=True, outer=2)))
named("stl_fdata", None, lambda spark, d: rounded(season.stl_curves(_smoothed(spark, d), 12)))


def on_mean(name: str, fn, columns: str) -> None:
    """A kernel on the nations' mean curve."""
    named(name, None, lambda spark, d: rows(spark, columns, [tuple(float(x) for x in np.atleast_1d(season.on_mean(_smoothed(spark, d), fn)))]))


on_mean("autoperiod_fdata", season.autoperiod, "period double, acf double")
on_mean("cfd_autoperiod_fdata", season.cfd_autoperiod, "period double, acf double")
on_mean("sazed_fdata", season.sazed, "period double, confidence double")
on_mean("lomb_scargle_fdata", lambda v, t: season.lomb_scargle(t, v, np.arange(1, 40) / 80)[1:], "frequency double, false_alarm double")
on_mean("matrix_profile_fdata", lambda v, t: (season.matrix_profile(v, 12)[2],), "period double")
on_mean("matrix_profile_seasonality", lambda v, t: (lambda p: (float(p[2]), float(1 - np.mean(p[0]) / np.sqrt(24))))(season.matrix_profile(v, 12)), "period double, strength double")
on_mean("ssa_fdata", lambda v, t: season.ssa(v, 24)[1][:3], "s1 double, s2 double, s3 double")
on_mean("ssa_seasonality", lambda v, t: (lambda s: (float((s[1:3] ** 2).sum() / (s**2).sum()),))(season.ssa(v - v.mean(), 24)[1]), "strength double")
each_nation("detect_multiple_periods", lambda v, t: ([p for p, _, _ in season.multiple_periods(v, t)],), "periods array<double>")
each_nation("instantaneous_period", lambda v, t: (np.minimum(season.instantaneous_period(v, t), 1e6),), "values array<double>")
each_nation("seasonal_strength_windowed", lambda v, t: (season.strength_windowed(v, t, 12.0, 24.0),), "values array<double>")
each_nation("detect_seasonality_changes", lambda v, t: ([x for x, _ in season.changes(season.strength_windowed(v, t, 12.0, 24.0), t, 0.5, 3.0)],), "times array<double>")
each_nation("detect_seasonality_changes_auto", lambda v, t: (lambda s: ([x for x, _ in season.changes(s, t, season.otsu(s), 3.0)],))(season.strength_windowed(v, t, 12.0, 24.0)), "times array<double>")
each_nation("analyze_peak_timing", lambda v, t: tuple(np.nan_to_num(season.peak_timing(v, t, 12.0))), "mean double, spread double, slope double, score double")
each_nation("detect_amplitude_modulation_wavelet", lambda v, t: season.amplitude_modulation(v, t, 12.0, "wavelet")[:2], "score double, trend double")

# ---- densities ----


def _density(v):
    """Curves made into densities on the unit grid."""
    return infer.normalize_density(v - v.min(1, keepdims=True) + 0.1, GRID)


_SUM = f"WITH {_C}, z AS (SELECT id, pos, v - min(v) OVER (PARTITION BY id) + 0.1 AS v FROM c), s AS (SELECT id, sum(a) AS s FROM (SELECT id, (v + lag(v) OVER (PARTITION BY id ORDER BY pos)) / 2 / {src.EMBEDDING_POINTS - 1}.0 AS a FROM z) GROUP BY id)"
each_embedding("normalize_density", _density, sql=f"{_SUM} SELECT id, pos, {_z('v / s')} AS v FROM z JOIN s USING (id)")
each_embedding("lqd_transform", lambda v: np.array([infer.lqd(f, GRID) for f in _density(v)]))
each_embedding("inverse_lqd", lambda v: np.array([infer.inverse_lqd(infer.lqd(f, GRID), 0.0, 1.0)[1] for f in _density(v)]))
each_embedding("wasserstein2_distance", lambda v: [infer.wasserstein2(f, np.ones(len(GRID)), GRID) for f in _density(v)], "distance double")


def _bary(spark, d, weights=None):
    """The mean density: quantile functions add up over the table."""
    def parts(v, y):
        w = np.ones(len(v)) if weights is None else weights(y)
        return [np.array([w.sum()]), w @ np.array([infer.quantile_function(f, GRID, len(GRID)) for f in _density(v)])]

    n, q = sums(EMB(spark, d).df, parts, ["values", "label"])
    q = q / n[0]
    return q, 1 / np.maximum(nm.central_differences(q, np.linspace(0, 1, len(q))), 1e-12)


for _name in ("wasserstein_barycenter", "frechet_mean"):
    named(_name, None, lambda spark, d: curve_rows(spark, *_bary(spark, d), names=("point", "density")))
named("frechet_variance", None, lambda spark, d: (lambda q: rows(spark, "variance double", [(float(sums(EMB(spark, d).df, lambda v: [np.array([sum(nm.trapz((infer.quantile_function(f, GRID, len(GRID)) - q) ** 2, np.linspace(0, 1, len(q))) for f in _density(v))])], ["values"])[0][0]) / EMB(spark, d).df.count(),)]))(_bary(spark, d)[0]))


def _label_moments(spark, d):
    n, s, ss = sums(EMB(spark, d).df, lambda y: [np.array([len(y)]), np.array([y.sum()]), np.array([(y**2).sum()])], ["label"])
    mean = s[0] / n[0]
    return mean, ss[0] / n[0] - mean**2 + 1e-6


named("frechet_global_reg", None, lambda spark, d: (lambda m, v: curve_rows(spark, *_bary(spark, d, lambda y: 1 + (y - m) * (2.0 - m) / v), names=("point", "density")))(*_label_moments(spark, d)))


def _local(spark, d, x0=2.0, h=1.5):
    k = lambda y: np.exp(-((y - x0) ** 2) / (2 * h * h))
    n, m1, m2 = sums(EMB(spark, d).df, lambda y: [np.array([v]) for v in (k(y).sum(), (k(y) * (y - x0)).sum(), (k(y) * (y - x0) ** 2).sum())], ["label"])
    return curve_rows(spark, *_bary(spark, d, lambda y: k(y) * (m2[0] - m1[0] * (y - x0)) / (n[0] * m2[0] - m1[0] ** 2)), names=("point", "density"))


named("frechet_local_reg", None, _local)

# ---- tests and regions ----


def _halves(spark, d):
    c = EMB(spark, d)
    return c.with_df(c.df.where("label < 5")), c.with_df(c.df.where("label >= 5"))


named("f_perm_test", None, lambda spark, d: rows(spark, "statistic double, p double", [infer.f_permutation(EMB(spark, d), "label", 50)]))
named("scb_two_sample_test", None, lambda spark, d: (lambda got: curve_rows(spark, *got[1][:3], names=("mean", "low", "high")))(infer.two_sample_band(*_halves(spark, d), 0.05, n_boot=50)))
named("equivalence_test", None, lambda spark, d: rows(spark, "equivalent boolean, p double", [tuple(infer.equivalence(*_halves(spark, d), 0.5, n_boot=50))]))
named("stationarity_test", None, lambda spark, d: rows(spark, "statistic double, p double", [infer.stationarity(pointwise.normalize(REV(spark, d), "curve_standardize"), 50)]))
named("flm_f_test", None, lambda spark, d: rows(spark, "f double, p double", [(lambda m: regress.f_test(m.r2, EMB(spark, d).df.count(), 3))(regress.linear(EMB(spark, d), "label", 3))]))


def _gof(spark, d):
    c = EMB(spark, d)
    return rows(spark, "f double, p double", [infer.goodness_of_fit_of(regress.linear(c, "label", 3).predict(c), "label", "fit")])


named("flm_gof_test", None, _gof)


def _itp(spark, d, paired=False):
    """Interval-wise p-values of B-spline coefficients by sign flips, or by permuting two groups."""
    c = EMB(spark, d)
    b = smooth.project(c, nm.bspline_basis(GRID, 6)).select("id", F.col("coefs").alias("values"), (F.col("label") < 5).cast("int").alias("g"))
    if paired:
        n, own, drawn = sums(b, lambda i, v: [np.array([len(i)]), v.sum(0), infer.row_signs(i, 199, 1).T @ v], ["id", "values"])
        stats = np.vstack([own, drawn]) / n[0]
    else:
        n, own, _, drawn = infer.permuted_sums(b, "g", [0, 1], 199, 1, 0.0)
        stats = (lambda s: s[:, 1] / n[1] - s[:, 0] / n[0])(np.concatenate([own[None], drawn]))
    return rows(spark, "component int, p double", [(k, float(p)) for k, p in enumerate(infer.interval_p_values(stats**2))])


named("itp_one_pop", None, lambda spark, d: _itp(spark, d, True))
named("itp_two_pop", None, _itp)
_PROB = "array(0.5 + 0.05 * (label % 3), 0.3 - 0.05 * (label % 3), 0.2)"
named("conformal_classif", None, lambda spark, d: (lambda p: infer.conformal_classes(p.select("id", "probabilities"), p, 0.2).select("id", F.array_join("set", ",").alias("classes")))(EMB(spark, d).df.select("id", F.expr(_PROB).alias("probabilities"), (F.col("label") % 3).alias("label"))))

def _binary_of(spark, d):
    c = EMB(spark, d)
    return c.with_df(c.df.withColumn("y", (F.col("label") < 5).cast("double")))


# ---- monitoring ----


def _stats(spark, d):
    c = EMB(spark, d)
    model = reduce.fpca(c, 4)
    return monitor.statistics(c, model), model


named("t2_limit_robust", None, lambda spark, d: rows(spark, "limit double", [(monitor.robust_limit(_stats(spark, d)[0], "t2"),)]))
named("spe_limit_robust", None, lambda spark, d: rows(spark, "limit double", [(monitor.robust_limit(_stats(spark, d)[0], "spe"),)]))
named("spe_moment_match_diagnostic", None, lambda spark, d: rounded(monitor.spe_fit(_stats(spark, d)[0])))
named("t2_pc_contributions", None, lambda spark, d: (lambda s, m: _listed(monitor.t2_by_component(s, m), "contributions"))(*_stats(spark, d)))
named("t2_pc_significance", None, lambda spark, d: (lambda s, m: monitor.significant_components(s, m).select("id", F.size(F.filter("significant", lambda x: x)).alias("n")))(*_stats(spark, d)))
named("select_ncomp", None, lambda spark, d: rows(spark, "rule string, k int", [(h, monitor.choose_components(reduce.fpca(EMB(spark, d), 10).eigenvalues, h)) for h in ("variance", "kaiser", "elbow")]))
named("spm_phase1_iterative", None, lambda spark, d: monitor.phase1_iterative(EMB(spark, d), 4)[1])
for _name, _how in {"spm_monitor_partial": "blup", "spm_monitor_partial_batch": "projection"}.items():
    named(_name, None, lambda spark, d, h=_how: (lambda c, m: _listed(per_curve(c.df.select("id", "values"), lambda v: np.array([monitor.partial(x, 32, m, h) for x in v]), "values array<double>")))(EMB(spark, d), reduce.fpca(EMB(spark, d), 4)))
for _name, _options in {"arl0_t2": {}, "arl1_t2": {"shift": [1.0, 0.0, 0.0]}, "arl0_ewma_t2": {"lam": 0.2}}.items():
    # run lengths under the eigenvalues of the embeddings' components
    named(_name, None, lambda spark, d, o=_options: rows(spark, "arl double", [(monitor.run_length(spark, monitor.t2_limit(0.05, 3), reduce.fpca(EMB(spark, d), 3).eigenvalues, **({k: v if k == "lam" else np.sqrt(reduce.fpca(EMB(spark, d), 3).eigenvalues) * v for k, v in o.items()})),)]))



def _spe_parts(spark, d):
    c = EMB(spark, d)
    dc = pointwise.derivative(c)
    parts = [(x, reduce.reconstruct(reduce.scores(x, m), m)) for x in (c, dc) for m in (reduce.fpca(x, 3),)]
    return rounded(monitor.spe_by_variable([p for p, _ in parts], [q for _, q in parts]))


for _name in ("spe_contributions", "spe_multivariate"):
    named(_name, None, _spe_parts)

# ---- distances of surfaces and irregular curves ----


def _hausdorff_2d(spark, d):
    c = EMB(spark, d)
    few = c.with_df(c.df.where("id % 100 = 0"))
    fn = metrics.hausdorff_surfaces(nm.unit_grid(8), nm.unit_grid(8))
    from curvelake.operators.apply import cross_pairs

    return cross_pairs(few.df, c.df, fn, places=6, wide=1024)


_SURF = "s AS (SELECT vec_id AS id, (generate_subscripts(embedding, 1) - 1) % 8 / 7.0 AS s, (generate_subscripts(embedding, 1) - 1) // 8 / 7.0 AS t, unnest(embedding)::DOUBLE AS v FROM embeddings)"
_SQ = "pow(a.s - b.s, 2) + pow(a.t - b.t, 2) + pow(a.v - b.v, 2)"
_HSQL = f"WITH {_SURF}, x AS (SELECT a.id AS i, b.id AS j, a.s, a.t, min({_SQ}) AS d FROM s a JOIN s b ON a.id % 100 = 0 GROUP BY ALL), y AS (SELECT a.id AS i, b.id AS j, b.s, b.t, min({_SQ}) AS d FROM s a JOIN s b ON a.id % 100 = 0 GROUP BY ALL) SELECT i, j, {_z('sqrt(max(d))')} AS d FROM (SELECT i, j, d FROM x UNION ALL SELECT i, j, d FROM y) GROUP BY i, j"
for _name in ("hausdorff_3d", "hausdorff_cross_2d"):
    named(_name, _HSQL, _hausdorff_2d)


def _irregular(spark, d):
    """Pairs of every user with all users of a later id."""
    p = metrics.sorted_points(EV(spark, d))
    return rounded(metrics.cross_irregular(p, p))


named("metric_lp_irreg", None, _irregular)
named("soft_dtw_barycenter", None, lambda spark, d: curve_rows(spark, metrics.soft_dtw_barycenter(pointwise.normalize(REV(spark, d), "curve_standardize"), 1.0, 5)))

# ---- simulation: rows drawn from their own seeds ----


def _spread(c: Curves):
    n, s, q = sums(c.df, lambda v: [np.array([len(v)]), v.sum(0), (v**2).sum(0)], ["values"])
    return curve_rows(c.df.sparkSession, s / n[0], q / n[0], names=("mean", "square"))


def _simulated(spark, d, how: str) -> DataFrame:
    """A curve for each embedding, drawn by its id: from the table's own components, from a
    family's eigenfunctions with the table's eigenvalues, or of a Gaussian process about its mean."""
    c = EMB(spark, d)
    m = reduce.fpca(c, 5)
    if how == "process":
        root = np.linalg.cholesky(nm.covariance_kernel(GRID, GRID, "gaussian", 0.2, float(m.eigenvalues.sum())) + 1e-8 * float(m.eigenvalues.sum()) * np.eye(len(GRID)))
    else:
        root = (m.loadings if how == "own" else nm.eigenfunctions(GRID, 5, "wiener")) * np.sqrt(m.eigenvalues)
    mean = m.mean

    def draw(batches):
        import pandas as pd

        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "values": [mean + root @ np.random.default_rng(7 + int(i)).standard_normal(root.shape[1]) for i in pdf["id"]]})

    return _spread(c.with_df(c.df.select("id").mapInPandas(draw, "id long, values array<double>")))


for _name, _how in {"sim_kl": "own", "sim_fundata": "wiener", "generate_gaussian_process": "process"}.items():
    named(_name, None, lambda spark, d, h=_how: _simulated(spark, d, h))
named("add_error_pointwise", None, lambda spark, d: _spread(src.add_noise(EMB(spark, d), 0.1)))
named("add_error_curve", None, lambda spark, d: _spread(src.add_noise(EMB(spark, d), 0.1, True)))
