"""SQL of operators on curves that had none, and queries of operators that were not registered.

Queries of arrays are listed by position here, so that DuckDB's rows compare with them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from curvelake.functions import numeric as nm
from curvelake.operators import cluster, depth, infer, metrics, pointwise, reduce, season, smooth
from curvelake.operators.apply import per_curve
from curvelake.plans.basics import cells, named
from curvelake.plans.registry import _C, _D2, _E, _GRID, _H, _S, _WEIGHTS, EMB, EV, REV, _z, curve_rows, r, rounded, rows
from curvelake.sources import curves as src
from curvelake.sources.curves import Curves

M = src.EMBEDDING_POINTS

# ---- outliers and rank orders ----

_RANKS = "(SELECT id, pos, v, count(*) OVER (PARTITION BY pos) AS n, rank() OVER (PARTITION BY pos ORDER BY v) - 1 AS lt, count(*) OVER (PARTITION BY pos ORDER BY v RANGE UNBOUNDED PRECEDING) AS le FROM {0})"
_MBD = "avg(1 - (lt * (lt - 1) / 2 + (n - le) * (n - le - 1) / 2) / (n * (n - 1) / 2))"


def _box(x: str) -> str:
    """CTEs that flag the boxplot's outliers of a table x (id, pos, v): x_o (id, outlier)."""
    return f"""{x}_d AS (SELECT id, {_MBD} AS d, max(n) AS n FROM {_RANKS.format(x)} GROUP BY id), {x}_k AS (SELECT id, row_number() OVER (ORDER BY d DESC, id) AS k, n FROM {x}_d),
{x}_b AS (SELECT pos, min(v) AS lo, max(v) AS hi FROM {x} JOIN {x}_k USING (id) WHERE k <= ceil(n / 2) GROUP BY pos),
{x}_o AS (SELECT id, bool_or(v < lo - 1.5 * (hi - lo) OR v > hi + 1.5 * (hi - lo)) AS outlier FROM {x} JOIN {x}_b USING (pos) GROUP BY id)"""


def _fence(x: str, column: str) -> str:
    return f"(SELECT quantile_cont({column}, 0.75) + 1.5 * (quantile_cont({column}, 0.75) - quantile_cont({column}, 0.25)) FROM {x})"


named("extremal_depth", f"WITH {_C}, l AS (SELECT id, n, round(1 - abs(lt + le - n) / n, 12) AS l, count(*) AS m FROM {_RANKS.format('c')} GROUP BY ALL), w AS (SELECT id, n, l, m FROM l QUALIFY row_number() OVER (PARTITION BY id ORDER BY l) = 1) SELECT id, {_z('row_number() OVER (ORDER BY l, m DESC, id) / n')} AS depth FROM w", lambda spark, d: rounded(depth.extremal(EMB(spark, d))))
named("muod", f"WITH {_C}, m AS (SELECT pos, avg(v) AS f FROM c GROUP BY pos), x AS (SELECT id, abs(corr(v, f) - 1) AS shape, abs(regr_intercept(v, f)) AS magnitude, abs(regr_slope(v, f) - 1) AS amplitude FROM c JOIN m USING (pos) GROUP BY id) SELECT id, " + ", ".join(f"{_z(k)} AS {k}, {k} > {_fence('x', k)} AS {k}_outlier" for k in ("shape", "magnitude", "amplitude")) + " FROM x", lambda spark, d: rounded(depth.muod(EMB(spark, d))))
_SHARE = "(le + lt + 1) / (2 * n)"
named("tvd_depth", f"WITH {_C} SELECT id, round(avg({_SHARE} * (1 - {_SHARE})), 12) + 0.0 AS depth FROM {_RANKS.format('c')} GROUP BY id", lambda spark, d: rounded(depth.total_variation(EMB(spark, d)), 12))
named("tvdmss", f"WITH {_C}, f AS (SELECT id, pos, lead(v) OVER (PARTITION BY id ORDER BY pos) - v AS v FROM c QUALIFY pos < {M - 1}), t AS (SELECT id, avg({_SHARE} * (1 - {_SHARE})) AS tvd FROM {_RANKS.format('c')} GROUP BY id), s AS (SELECT id, sum({_SHARE} * (1 - {_SHARE}) * abs(v)) / sum(abs(v)) AS mss FROM {_RANKS.format('f')} GROUP BY id), q AS (SELECT least(quantile_cont(mss, 0.25) - 1.5 * (quantile_cont(mss, 0.75) - quantile_cont(mss, 0.25)), avg(mss)) AS low FROM s), k AS (SELECT c.* FROM c JOIN s USING (id), q WHERE mss >= low), {_box('k')} SELECT id, round(tvd, 12) + 0.0 AS tvd, {_z('mss')} AS mss, mss < low AS shape_outlier, coalesce(outlier, false) AS magnitude_outlier FROM t JOIN s USING (id) CROSS JOIN q LEFT JOIN k_o USING (id)", lambda spark, d: depth.tvd_mss(EMB(spark, d)).withColumn("tvd", r("tvd", 12)).withColumn("mss", r("mss")))
_ONE = "(SELECT id, {0} AS v, count(*) OVER () AS n, rank() OVER (ORDER BY {0}) - 1 AS lt, count(*) OVER (ORDER BY {0} RANGE UNBOUNDED PRECEDING) AS le FROM b)"
named("depthgram", f"WITH {_C}, b AS (SELECT id, round({_MBD}, 12) AS mbd, round(avg((n - lt) / n), 12) AS mei, max(n) AS n FROM {_RANKS.format('c')} GROUP BY id), p AS (SELECT id, -2.0 / (n * (n - 1)) + 2.0 * (n + 1) / (n - 1) * mei - 2.0 * n / (n - 1) * mei * mei - mbd AS above FROM b), x AS (SELECT id, 0 AS pos, mbd AS v FROM b), {_box('x')}, e AS (SELECT id, 1 - (lt * (lt - 1) / 2 + (n - le) * (n - le - 1) / 2) / (n * (n - 1) / 2) AS e FROM {_ONE.format('mei')}), g AS (SELECT id, (n - lt) / n AS g FROM {_ONE.format('mbd')}) SELECT id, round(mbd, 8) + 0.0 AS mbd, round(mei, 8) + 0.0 AS mei, round(e, 8) + 0.0 AS mbd_of_mei, round(g, 8) + 0.0 AS mei_of_mbd, above > {_fence('p', 'above')} AS shape_outlier, outlier AS magnitude_outlier FROM b JOIN p USING (id) JOIN e USING (id) JOIN g USING (id) JOIN x_o USING (id)", lambda spark, d: rounded(depth.depthgram(EMB(spark, d)), 8))
named("magnitude_shape", f"WITH {_C}, m AS (SELECT pos, avg(v) AS f FROM c GROUP BY pos), s AS (SELECT id, sqrt(sum((v - f) * (v - f))) AS s FROM c JOIN m USING (pos) GROUP BY id), u AS (SELECT id, pos, (v - f) / s AS u FROM c JOIN m USING (pos) JOIN s USING (id)), a AS (SELECT pos, avg(u) AS a FROM u GROUP BY pos), h AS (SELECT id, sqrt(sum((u - a) * (u - a))) AS shape FROM u JOIN a USING (pos) GROUP BY id), b AS (SELECT id, {_MBD} AS mbd FROM {_RANKS.format('c')} GROUP BY id) SELECT id, {_z('1 - mbd')} AS magnitude, {_z('shape')} AS shape FROM b JOIN h USING (id)", lambda spark, d: rounded(depth.magnitude_shape(EMB(spark, d))))


def _planted(spark, d):
    """Embeddings with shifted and ragged curves among them."""
    c = EMB(spark, d)
    moved = F.transform("values", lambda x, k: F.when(F.col("id") % 97 == 3, x + 3).when(F.col("id") % 89 == 5, x + F.when(k % 2 == 0, 1.5).otherwise(-1.5)).otherwise(x))
    return c.with_df(c.df.select("id", moved.alias("values")))


named("sequential_transform_outliers", f"WITH {_C}, t0 AS (SELECT id, pos, CASE WHEN id % 97 = 3 THEN v + 3 WHEN id % 89 = 5 THEN v + CASE WHEN pos % 2 = 0 THEN 1.5 ELSE -1.5 END ELSE v END AS v FROM c), t1 AS (SELECT id, pos, v - avg(v) OVER (PARTITION BY id) AS v FROM t0), t2 AS (SELECT id, pos, v / sqrt(sum(v * v) OVER (PARTITION BY id)) AS v FROM t1), d1 AS (SELECT id, pos, lead(v) OVER (PARTITION BY id ORDER BY pos) - v AS v FROM t2 QUALIFY pos < {M - 1}), {', '.join(_box(x) for x in ('t0', 't1', 't2', 'd1'))}, a AS (" + " UNION ALL ".join(f"SELECT id, '{x.upper()}' AS step FROM {x}_o WHERE outlier" for x in ("t0", "t1", "t2", "d1")) + ") SELECT id, string_agg(step, ',' ORDER BY step) AS steps FROM a GROUP BY id", lambda spark, d: depth.sequential_outliers(_planted(spark, d)).select("id", F.array_join("steps", ",").alias("steps")))
named("detect_outliers_lrt_distance", f"WITH {_C}, f AS (SELECT id, avg(least(le / n, 1 - le / n)) AS d, max(n) AS n FROM {_RANKS.format('c')} GROUP BY id), k AS (SELECT id, row_number() OVER (ORDER BY d, id) AS k, n FROM f), m AS (SELECT pos, avg(v) AS f, greatest(var_samp(v), 1e-10) AS s FROM c JOIN k USING (id) WHERE k > floor(0.1 * n) GROUP BY pos) SELECT id, {_z('sqrt(avg((v - f) * (v - f) / s))')} AS distance FROM c JOIN m USING (pos) GROUP BY id", lambda spark, d: rounded(depth.lrt_outliers(EMB(spark, d), 1.0).select("id", "distance")))

# ---- smoothing ----

_KG = f"k AS (SELECT a.k AS pos, b.k AS at, (b.k - a.k) * {_H} AS d, exp(-pow((b.k - a.k) * {_H} / 0.05, 2) / 2) AS k FROM range({M}) a(k), range({M}) b(k))"
_SMOOTHED = f"WITH {_C}, {_KG}, s AS (SELECT id, k.pos, sum(k) AS s0, sum(k * d) AS s1, sum(k * d * d) AS s2, sum(k * pow(d, 3)) AS s3, sum(k * pow(d, 4)) AS s4, sum(k * v) AS b0, sum(k * d * v) AS b1, sum(k * d * d * v) AS b2 FROM c JOIN k ON c.pos = k.at GROUP BY ALL) SELECT id, pos::INT AS pos, "


def _long(c: Curves, places: int = 6):
    return c.df.select("id", F.posexplode("values").alias("pos", "x")).select("id", "pos", r("x", places).alias("v"))


named("nadaraya_watson", f"{_SMOOTHED}{_z('b0 / s0')} AS v FROM s", lambda spark, d: _long(smooth.smooth(EMB(spark, d), 0.05)))
named("local_linear", f"{_SMOOTHED}{_z('(s2 * b0 - s1 * b1) / (s0 * s2 - s1 * s1)')} AS v FROM s", lambda spark, d: _long(smooth.smooth(EMB(spark, d), 0.05, "local")))
named("local_polynomial", f"{_SMOOTHED}{_z('(b0 * (s2 * s4 - s3 * s3) - s1 * (b1 * s4 - s3 * b2) + s2 * (b1 * s3 - s2 * b2)) / (s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 * s2))')} AS v FROM s", lambda spark, d: _long(smooth.smooth(EMB(spark, d), 0.05, "local", degree=2)))
named("knn_smoother", f"WITH {_C}, n AS (SELECT a.k AS pos, b.k AS at FROM range({M}) a(k), range({M}) b(k) QUALIFY row_number() OVER (PARTITION BY a.k ORDER BY abs(a.k - b.k), b.k) <= 5) SELECT id, n.pos::INT AS pos, {_z('avg(v)')} AS v FROM c JOIN n ON c.pos = n.at GROUP BY id, n.pos", lambda spark, d: _long(smooth.smooth(EMB(spark, d), 0.05, "knn", k=5)))
named("smoothing_matrix_nw", f"WITH {_C}, {_KG}, s AS (SELECT k.pos AS goal, k.at AS come, k.k / sum(k.k) OVER (PARTITION BY k.pos) AS s FROM k) SELECT id, s.goal::INT AS k, {_z('sum(s * v)')} AS value FROM c JOIN s ON c.pos = s.come GROUP BY id, s.goal", lambda spark, d: (lambda hat: rounded(per_curve(EMB(spark, d).df.select("id", "values"), lambda v: v @ hat.T, "values array<double>").select("id", F.posexplode("values").alias("k", "value"))))(smooth.nw_matrix(_GRID, 0.05)))
_FITTED = f"{_C}, {_KG}, f AS (SELECT id, k.pos, sum(k * v) / sum(k) AS f, sum(CASE WHEN k.at <> k.pos THEN k * v END) / sum(CASE WHEN k.at <> k.pos THEN k END) AS loo FROM c JOIN k ON c.pos = k.at GROUP BY ALL), e AS (SELECT avg(pow(v - f, 2)) AS mse, avg(pow(v - loo, 2)) AS cv FROM c JOIN f USING (id, pos)), t AS (SELECT sum(1 / s) AS tr FROM (SELECT pos, sum(k) AS s FROM k GROUP BY pos))"
named("cv_smoother", f"WITH {_FITTED} SELECT {_z('cv')} AS score FROM e", lambda spark, d: rows(spark, "score double", [(smooth.smoother_score(EMB(spark, d), 0.05, "cv"),)]))
named("aic_smoother", f"WITH {_FITTED} SELECT {_z(f'{M} * ln(mse) + 2 * tr')} AS score FROM e, t", lambda spark, d: rows(spark, "score double", [(smooth.smoother_score(EMB(spark, d), 0.05, "aic"),)]))
named("gcv_smoother_score", f"WITH {_FITTED} SELECT {_z(f'mse / pow(1 - tr / {M}, 2)')} AS score FROM e, t", lambda spark, d: rows(spark, "score double", [(smooth.smoother_score(EMB(spark, d), 0.05, "gcv"),)]))

# ---- distances ----

_FEW = "id <= 60"


def _few(spark, d):
    c = EMB(spark, d)
    return c.with_df(c.df.where(_FEW))


_DENSITY = f"z AS (SELECT id, pos, v - least(min(v) OVER (PARTITION BY id), 0) AS v FROM c), z1 AS (SELECT id, pos, v / sum(v * w) OVER (PARTITION BY id) + 1e-10 AS v FROM z JOIN w USING (pos)), z2 AS (SELECT id, pos, v / sum(v * w) OVER (PARTITION BY id) AS v FROM z1 JOIN w USING (pos))"
_KL = "sum(w * (a.v * ln(a.v / b.v) + b.v * ln(b.v / a.v))) / 2"
_HAUS = f"h AS (SELECT a.id AS i, b.id AS j, a.pos, min(pow((a.pos - b.pos) * {_H}, 2) + pow(a.v - b.v, 2)) AS d FROM c a JOIN c b ON a.id <> b.id GROUP BY ALL), g AS (SELECT i, j, max(d) AS d FROM h GROUP BY i, j)"
_FOURIER = f"k AS (SELECT id, k, sqrt(pow(sum(v * cos(2 * pi() * k * pos / {M})), 2) + pow(sum(v * sin(2 * pi() * k * pos / {M})), 2)) / {M} AS a FROM c, range(6) x(k) GROUP BY id, k)"
_WD = nm.simpson_weights((_GRID[1:] + _GRID[:-1]) / 2)
_DERIV = "w2 AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, {float(x)!r}::DOUBLE)" for k, x in enumerate(_WD)) + f") t(pos, w)), g AS (SELECT id, pos, (lead(v) OVER (PARTITION BY id ORDER BY pos) - v) / {_H} AS v FROM c)"
_PAIRS = {
    "lp": f"WITH {_C}, {_WEIGHTS} SELECT a.id AS i, b.id AS j, {_z('sqrt(sum(w * (a.v - b.v) * (a.v - b.v)))')} AS d FROM c a JOIN c b USING (pos) JOIN w USING (pos) WHERE {{0}} GROUP BY ALL",
    "kl": f"WITH {_C}, {_WEIGHTS}, {_DENSITY} SELECT a.id AS i, b.id AS j, {_z(_KL)} AS d FROM z2 a JOIN z2 b USING (pos) JOIN w USING (pos) WHERE {{0}} GROUP BY ALL",
    "deriv": f"WITH {_C}, {_DERIV} SELECT a.id AS i, b.id AS j, {_z('sqrt(sum(w * (a.v - b.v) * (a.v - b.v)))')} AS d FROM g a JOIN g b USING (pos) JOIN w2 USING (pos) WHERE {{0}} GROUP BY ALL",
    "fourier": f"WITH {_C}, {_FOURIER} SELECT a.id AS i, b.id AS j, {_z('sqrt(sum((a.a - b.a) * (a.a - b.a)))')} AS d FROM k a JOIN k b USING (k) WHERE {{0}} GROUP BY ALL",
    "hausdorff": f"WITH c0 AS (SELECT vec_id AS id, generate_subscripts(embedding, 1)::INT - 1 AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings), h AS (SELECT a.id AS i, b.id AS j, a.pos, min(pow((a.pos - b.pos) * {_H}, 2) + pow(a.v - b.v, 2)) AS d FROM c0 a JOIN c0 b ON {{0}} GROUP BY ALL), k AS (SELECT a.id AS j, b.id AS i, a.pos, min(pow((a.pos - b.pos) * {_H}, 2) + pow(a.v - b.v, 2)) AS d FROM c0 a JOIN c0 b ON {{1}} GROUP BY ALL), g AS (SELECT i, j, max(d) AS d FROM (SELECT i, j, d FROM h UNION ALL SELECT i, j, d FROM k) GROUP BY i, j) SELECT i, j, {_z('sqrt(d)')} AS d FROM g",
}
for _metric, _names in {"kl": "kl_distance_matrix", "fourier": "fourier_distance_matrix"}.items():
    named(_names, _PAIRS[_metric].format("a.id < b.id"), lambda spark, d, m=_metric: metrics.self_distances(EMB(spark, d), m, places=6))
named("hausdorff_distance_matrix", _PAIRS["hausdorff"].format("a.id < b.id", "b.id < a.id"), lambda spark, d: metrics.self_distances(EMB(spark, d), "hausdorff", places=6))
_CROSS = {"lp": "lp_cross_1d", "kl": "kl_cross_1d", "deriv": "deriv_cross_1d", "fourier": "fourier_cross_1d", "hausdorff": "hausdorff_cross_1d", "hshift": "hshift_cross_1d", "basis": "basis_coef_cross_1d", "pca": "pca_cross_1d"}
for _metric, _name in _CROSS.items():
    # a stated set of queries against all curves
    _sql = _PAIRS[_metric].format("a.id % 100 = 0", "b.id % 100 = 0") if _metric in _PAIRS else None
    named(_name, _sql, lambda spark, d, m=_metric: (lambda c: metrics.cross_distances(c.with_df(c.df.where("id % 100 = 0")), c, m, places=6))(EMB(spark, d)))
named("cross_distance_matrix", _PAIRS["lp"].format("a.id % 100 = 0"), lambda spark, d: (lambda c: metrics.cross_distances(c.with_df(c.df.where("id % 100 = 0")), c, places=6))(EMB(spark, d)))
for _metric, _name, _options in (("dtw", "dtw_cross_1d", {"width": 10}), ("soft_dtw", "soft_dtw_cross_1d", {}), ("soft_dtw_divergence", "soft_dtw_div_cross_1d", {})):
    named(_name, None, lambda spark, d, m=_metric, o=_options: (lambda c: rounded(metrics.cross_distances(c, c, m, **o)))(pointwise.normalize(REV(spark, d), "curve_standardize")))
named("dbscan_fd", f"{_D2}, e AS (SELECT i, j FROM d WHERE d <= 0.12 UNION ALL SELECT j, i FROM d WHERE d <= 0.12), g AS (SELECT vec_id AS id, count(j) + 1 AS n FROM embeddings LEFT JOIN e ON i = vec_id GROUP BY vec_id), k AS (SELECT id FROM g WHERE n >= 4), l AS (SELECT i, j FROM e WHERE i IN (FROM k) AND j IN (FROM k)), o AS (WITH RECURSIVE t AS (SELECT id AS a, id AS b FROM k UNION SELECT t.a, l.j FROM t JOIN l ON l.i = t.b) SELECT a AS id, min(b) AS root FROM t GROUP BY a), c2 AS (SELECT id, dense_rank() OVER (ORDER BY root) - 1 AS c FROM o), b AS (SELECT e.i AS id, min(c) AS b FROM e JOIN c2 ON c2.id = e.j GROUP BY e.i) SELECT vec_id AS id, coalesce(c, b)::INT AS cluster FROM embeddings LEFT JOIN c2 ON c2.id = vec_id LEFT JOIN b ON b.id = vec_id", lambda spark, d: cluster.dbscan_of(EMB(spark, d), 0.12, 4))

# ---- pairs of curves ----

_DIFF = f"CASE WHEN lag(v) OVER o IS NULL THEN (lead(v) OVER o - v) / {_H} WHEN lead(v) OVER o IS NULL THEN (v - lag(v) OVER o) / {_H} ELSE (lead(v) OVER o - lag(v) OVER o) / (2 * {_H}) END"
_BOTH = f"{_C}, y AS (SELECT id, pos, {_DIFF} AS y FROM c WINDOW o AS (PARTITION BY id ORDER BY pos))"
named("concurrent_regression", f"WITH {_BOTH} SELECT pos, round(regr_intercept(y, v), 4) + 0.0 AS intercept, round(regr_slope(y, v), 4) + 0.0 AS slope FROM c JOIN y USING (id, pos) GROUP BY pos", lambda spark, d: (lambda b: rounded(rows(spark, "pos int, intercept double, slope double", [(k, float(b[0][k]), float(b[1][k])) for k in range(M)]), 4))((lambda c: infer_concurrent(c))(EMB(spark, d))))
_UNIT = "(SELECT id, pos, ({0} - m) - avg({0} - m) OVER (PARTITION BY pos) AS u FROM (SELECT id, pos, {0}, sum({0} * w) OVER (PARTITION BY id) / sum(w) OVER (PARTITION BY id) AS m FROM {1} JOIN w USING (pos)))"
named("dynamical_correlation", f"WITH {_BOTH}, {_WEIGHTS}, a AS {_UNIT.format('v', 'c')}, b AS {_UNIT.format('y', 'y')}, s AS (SELECT id, sum(w * a.u * b.u) / sqrt(sum(w * a.u * a.u) * sum(w * b.u * b.u)) AS s FROM a JOIN b USING (id, pos) JOIN w USING (pos) GROUP BY id) SELECT {_z('avg(s)')} AS value FROM s", lambda spark, d: (lambda c: rows(spark, "value double", [(reduce.dynamical_correlation(c, pointwise.derivative(c)),)]))(EMB(spark, d)))


def infer_concurrent(c: Curves):
    from curvelake.operators import regress

    return regress.concurrent(pointwise.derivative(c), [c])


# ---- series ----

_CENTRED = f"{_S}, k AS (SELECT id, pos, v / 1e6 - avg(v / 1e6) OVER (PARTITION BY pos) AS v, dense_rank() OVER (ORDER BY id) AS k FROM c), u AS (SELECT (CASE WHEN pos = 0 THEN 1 / 3.0 WHEN pos = 79 THEN 1 / 2.0 WHEN pos = 78 THEN 1 / 3.0 + 1 / 2.0 WHEN pos % 2 = 1 THEN 4 / 3.0 ELSE 2 / 3.0 END)::DOUBLE AS w, pos FROM range(80) x(pos)), n AS (SELECT count(DISTINCT id)::DOUBLE AS n FROM c)"
_LAGGED = "SELECT h, a.pos AS s, b.pos AS t, sum(a.v * b.v) / any_value(n) AS c FROM k a JOIN range({0}, {1}) x(h) ON true JOIN k b ON b.k = a.k + h CROSS JOIN n GROUP BY h, a.pos, b.pos"


def _millions(spark, d):
    c = REV(spark, d)
    return c.with_df(c.df.select("id", F.transform("values", lambda x: x / 1e6).alias("values")))


named("functional_acf", f"WITH {_CENTRED}, h AS ({_LAGGED.format(0, 5)}), z AS (SELECT sum(w * c) AS z FROM h JOIN u ON u.pos = s WHERE h = 0 AND s = t) SELECT h::INT AS lag, {_z('sqrt(sum(p.w * q.w * c * c)) / any_value(z)')} AS acf FROM h JOIN u p ON p.pos = s JOIN u q ON q.pos = t, z WHERE h > 0 GROUP BY h", lambda spark, d: rows(spark, "lag int, acf double", [(k + 1, float(x)) for k, x in enumerate(infer.functional_acf(_millions(spark, d), 4))]))
named("functional_pacf", None, lambda spark, d: rows(spark, "lag int, pacf double", [(k + 1, float(x)) for k, x in enumerate(infer.partial_from_acf(infer.functional_acf(_millions(spark, d), 4)))]))
named("functional_difference", f"WITH {_S}, k AS (SELECT id, pos, v - lag(v) OVER (PARTITION BY pos ORDER BY id) AS v FROM c) SELECT id, pos::INT AS pos, round(v, 2) + 0.0 AS v FROM k WHERE v IS NOT NULL", lambda spark, d: infer.differenced(REV(spark, d)).long().select("id", "pos", r("v", 2).alias("v")))
named("long_run_covariance", f"WITH {_CENTRED}, h AS ({_LAGGED.format(0, 3)}) SELECT s::INT AS pos_s, t::INT AS pos_t, {_z('sum(c)')} AS cov FROM (SELECT s, t, c FROM h WHERE h = 0 UNION ALL SELECT s, t, (1 - h / 3.0) * c FROM h WHERE h > 0 UNION ALL SELECT t, s, (1 - h / 3.0) * c FROM h WHERE h > 0) GROUP BY s, t", lambda spark, d: cells(spark, infer.long_run_covariance(_millions(spark, d), 3), ("pos_s", "pos_t")).withColumnRenamed("value", "cov"))
_DFT = f"{_S}, f AS (SELECT id, k, sum(v / 1e6 * cos(2 * pi() * k * pos / 80)) AS re, sum(v / 1e6 * sin(2 * pi() * k * pos / 80)) AS im FROM c, range(41) x(k) GROUP BY id, k)"
named("estimate_period_fft", f"WITH {_DFT}, p AS (SELECT id, k, (re * re + im * im) / 80 * CASE WHEN k BETWEEN 1 AND 39 THEN 2 ELSE 1 END AS p FROM f WHERE k > 0), b AS (SELECT id, k, p, avg(p) OVER (PARTITION BY id) AS m FROM p QUALIFY row_number() OVER (PARTITION BY id ORDER BY p DESC, k) = 1) SELECT id, {_z('80.0::DOUBLE / k')} AS period, {_z('k / 80.0::DOUBLE')} AS frequency, {_z('p / m')} AS confidence FROM b", lambda spark, d: rounded(season.per_series(_millions(spark, d), season.period_fft, "period double, frequency double, power double, confidence double").select("id", "period", "frequency", "confidence")))
_ACF = f"{_S}, m AS (SELECT id, avg(v) AS m, var_pop(v) AS s FROM c GROUP BY id), a AS (SELECT a.id, (b.pos - a.pos)::INT AS lag, sum((a.v - m) * (b.v - m)) / (80 * any_value(s)) AS r FROM c a JOIN c b ON a.id = b.id AND b.pos BETWEEN a.pos AND a.pos + 40 JOIN m ON m.id = a.id GROUP BY ALL)"
named("estimate_period_acf", f"WITH {_ACF}, w AS (SELECT *, lag(r) OVER o AS before, lead(r) OVER o AS behind FROM a WINDOW o AS (PARTITION BY id ORDER BY lag)), p AS (SELECT id, lag, r FROM w WHERE lag >= 3 AND r > before AND r > behind AND r > 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY lag) = 1) SELECT m.id, lag::DOUBLE AS period, {_z('coalesce(r, 0)')} AS correlation FROM m LEFT JOIN p USING (id)", lambda spark, d: rounded(season.per_series(REV(spark, d), season.period_acf, "period double, correlation double").withColumn("period", F.nanvl("period", F.lit(None).cast("double")))))
named("hilbert_transform", f"WITH {_S}, x AS (SELECT id, pos, v / 1e6 - avg(v / 1e6) OVER (PARTITION BY id) AS v FROM c), f AS (SELECT id, k, sum(v * cos(2 * pi() * k * pos / 80)) AS re, -sum(v * sin(2 * pi() * k * pos / 80)) AS im, CASE WHEN k IN (0, 40) THEN 1 ELSE 2 END AS h FROM x, range(41) y(k) GROUP BY id, k), a AS (SELECT id, p.pos, sum(h * (re * cos(2 * pi() * k * p.pos / 80) - im * sin(2 * pi() * k * p.pos / 80))) / 80 AS re, sum(h * (re * sin(2 * pi() * k * p.pos / 80) + im * cos(2 * pi() * k * p.pos / 80))) / 80 AS im FROM f, range(80) p(pos) GROUP BY id, p.pos) SELECT id, pos::INT AS pos, {_z('sqrt(re * re + im * im)')} AS v FROM a", lambda spark, d: _long(Curves(season.per_series(_millions(spark, d), lambda v, t: (np.abs(season.hilbert(v - v.mean())),), "values array<double>"), np.arange(80.0))))
_LS = f"{_S}, x AS (SELECT id, pos AS t, v / 1e6 - avg(v / 1e6) OVER (PARTITION BY id) AS v FROM c), sd AS (SELECT id, var_samp(v) AS s2 FROM x GROUP BY id), w AS (SELECT k, 2 * pi() * k / 80 AS w FROM range(1, 40) y(k)), tau AS (SELECT k, w, atan2(sum(sin(2 * w * t)), sum(cos(2 * w * t))) / (2 * w) AS tau FROM w, range(80) z(t) GROUP BY k, w), p AS (SELECT id, k, (pow(sum(v * cos(w * (t - tau))), 2) / greatest(sum(pow(cos(w * (t - tau)), 2)), 1e-15) + pow(sum(v * sin(w * (t - tau))), 2) / greatest(sum(pow(sin(w * (t - tau)), 2)), 1e-15)) / (2 * any_value(s2)) AS p FROM x JOIN sd USING (id), tau GROUP BY id, k)"
named("lomb_scargle", f"WITH {_LS} SELECT id, {_z('k / 80.0::DOUBLE')} AS frequency, {_z('1 - pow(1 - exp(-p), 39)')} AS false_alarm FROM p QUALIFY row_number() OVER (PARTITION BY id ORDER BY p DESC, k) = 1", lambda spark, d: rounded(season.per_series(_millions(spark, d), lambda v, t: season.lomb_scargle(t, v, np.arange(1, 40) / 80)[1:], "frequency double, false_alarm double")))

# ---- irregular curves ----

named("cov_irreg", f"WITH {_E}, g AS (SELECT unnest([5.0, 15.0, 25.0])::DOUBLE AS g), m AS (SELECT g, sum(exp(-pow((t - g) / 2, 2) / 2) * v) / sum(exp(-pow((t - g) / 2, 2) / 2)) AS m FROM e, g GROUP BY g), x AS (SELECT e.*, v - m AS r FROM e, m QUALIFY row_number() OVER (PARTITION BY id, t, v ORDER BY abs(m.g - t), m.g) = 1), k AS (SELECT id, g, sum(exp(-pow((t - g) / 2, 2) / 2)) AS k, sum(exp(-pow((t - g) / 2, 2) / 2) * r) AS kr FROM x, g GROUP BY id, g) SELECT a.g AS s, b.g AS t, round(sum(a.kr * b.kr) / sum(a.k * b.k), 4) + 0.0 AS cov FROM k a JOIN k b USING (id) GROUP BY a.g, b.g", lambda spark, d: (lambda e: rounded(metrics.covariance_irregular(e, [5.0, 15.0, 25.0], 2.0, metrics.mean_irregular(e, [5.0, 15.0, 25.0], 2.0)), 4))(EV(spark, d)))
named("to_regular_grid", f"WITH {_E}, x AS (SELECT id, t, v, lead(t) OVER o AS t1, lead(v) OVER o AS v1 FROM e WINDOW o AS (PARTITION BY id ORDER BY t, v)), g AS (SELECT k::DOUBLE AS g FROM range(1, 30) y(k)) SELECT id, g::INT AS day, round(v + (v1 - v) * (g - t) / (t1 - t), 4) + 0.0 AS v FROM x JOIN g ON g >= t AND g < t1", lambda spark, d: metrics.to_regular(EV(spark, d), np.arange(1.0, 30.0)).select("id", F.posexplode("values").alias("day", "v")).where("NOT isnan(v)").select("id", (F.col("day") + 1).alias("day"), r("v", 4).alias("v")))
