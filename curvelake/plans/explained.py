"""Registered queries of the explanations, of models fitted to whole embedding curves.

A linear, a logistic and a Poisson model of the label on three principal components; the SQL
finds components and coefficients by itself and states each explanation from them.
Leave-one-out diagnostics take the line on the first component. What draws at random has no
SQL.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import functions as F

from curvelake.operators import explain, infer, pointwise, regress
from curvelake.operators.apply import sums
from curvelake.plans.basics import named
from curvelake.plans.components import components, least_squares, reweighted
from curvelake.plans.registry import _C, EMB, _z, rounded, rows

K = 3
ICEPT, COEF = "(SELECT c0 FROM co)", [f"(SELECT c{k} FROM co)" for k in (1, 2, 3)]
RESPONSE = {"linear": "label / 10.0::DOUBLE", "logistic": "(label < 5)::INT::DOUBLE", "product": "label::DOUBLE"}
_NAMES = "s1 AS a, s2 AS b, s3 AS c, label / 10.0::DOUBLE AS y, (label < 5)::INT AS u"
_FITS = {kind: reweighted(K, RESPONSE[kind], family) if family else least_squares(K, RESPONSE[kind]) for kind, family in (("linear", ""), ("logistic", "binomial"), ("product", "poisson"))}
_M = "m AS (SELECT avg(a) AS ma, avg(b) AS mb, avg(c) AS mc, count(*)::DOUBLE AS n FROM t)"
#: Widths and shares of intervals of the domain.
WIDTH, SHARE = 8, 0.15


def _x(kind: str) -> str:
    """CTEs of a fitted model: t (id, a, b, c: scores, y, u), co (c0..c3) and l (pos, l1..l3)."""
    return f"{components(K)}, {_FITS[kind]}, t AS MATERIALIZED (SELECT id, {_NAMES} FROM x)"


def _fitted(spark, d, kind: str) -> explain.Scored:
    c = EMB(spark, d)
    label = F.col("label").cast("double")
    c = c.with_df(c.df.withColumn("y", {"linear": label / 10, "logistic": (label < 5).cast("double"), "product": label}[kind]))
    return explain.of_model(c, "y", regress.linear(c, "y", K) if kind == "linear" else regress.glm(c, "y", {"logistic": "binomial", "product": "poisson"}[kind], K))


def _linear(spark, d):
    return _fitted(spark, d, "linear")


def _logistic(spark, d):
    return _fitted(spark, d, "logistic")


def _product(spark, d):
    """A predictor without a linear form: the mean of a Poisson model."""
    return _fitted(spark, d, "product")


def _f(kind: str, a: str = "a", b: str = "b", c: str = "c") -> str:
    line = f"({ICEPT} + {COEF[0]} * {a} + {COEF[1]} * {b} + {COEF[2]} * {c})"
    return {"linear": line, "logistic": f"(1 / (1 + exp(-{line})))", "product": f"exp({line})"}[kind]


MODELS = {"linear": _linear, "logistic": _logistic, "product": _product}
NAMES = {"linear": "{}", "logistic": "{}_logistic"}


def each(base: str, generic: str, sql, fn, kinds=("linear", "logistic", "product")) -> None:
    """Registers an explanation for each predictor, the last by its general name."""
    for kind in kinds:
        name = generic if kind == "product" else NAMES[kind].format(base)
        named(name, sql(kind) if sql else None, lambda spark, d, kind=kind: fn(MODELS[kind](spark, d), spark))


# ---- effects ----


def _pdp_sql(kind):
    return f"WITH {_x(kind)}, r AS (SELECT min(a) AS lo, max(a) AS hi FROM t), g AS (SELECT k, lo + (hi - lo) * k / 19 AS score FROM r, range(20) q(k)) SELECT k::INT AS k, {_z('score')} AS score, round(avg({_f(kind, a='score')}), 6) + 0.0 AS pdp FROM t, g GROUP BY k, score"


def _pdp(x, spark):
    grid, _, mean = explain.dependence(x, 0, 20)
    return rows(spark, "k int, score double, pdp double", [(k, float(a), float(b)) for k, (a, b) in enumerate(zip(grid, mean, strict=True))])


each("functional_pdp", "generic_pdp", _pdp_sql, _pdp)


def _ale_sql(kind):
    return f"""WITH {_x(kind)}, o AS (SELECT b, row_number() OVER (ORDER BY b) AS k, count(*) OVER () AS n FROM t),
e AS (SELECT DISTINCT b AS e FROM o WHERE k = 1 OR k = n OR k IN (SELECT ceil(j * n / 10.0) FROM range(1, 10) q(j))),
i AS (SELECT e AS lo, lead(e) OVER (ORDER BY e) AS hi, row_number() OVER (ORDER BY e) - 1 AS bin FROM e QUALIFY hi IS NOT NULL),
s AS (SELECT bin, any_value(lo) AS lo, any_value(hi) AS hi, count(*) AS n, avg({_f(kind, b='hi')} - {_f(kind, b='lo')}) AS d FROM t JOIN i ON b >= lo AND (b < hi OR bin = (SELECT max(bin) FROM i)) GROUP BY bin),
al AS (SELECT bin, lo, hi, n, sum(d) OVER (ORDER BY bin) AS ale FROM s)
SELECT {_z('lo')} AS low, {_z('hi')} AS high, {_z('ale - sum(ale * n) OVER () / sum(n) OVER ()')} AS ale, n::BIGINT AS n FROM al"""


each("fpc_ale", "generic_ale", _ale_sql, lambda x, spark: rows(spark, "low double, high double, ale double, n long", explain.accumulated(x, 1, 10)))


def _h_sql(kind):
    return f"""WITH {_x(kind)}, r AS (SELECT min(b) AS lb, max(b) AS hb, min(c) AS lc, max(c) AS hc FROM t),
g AS (SELECT i, j, lb + (hb - lb) * i / 4 AS gb, lc + (hc - lc) * j / 4 AS gc FROM r, range(5) p(i), range(5) q(j)),
hw AS (SELECT i, j, avg({_f(kind, b='gb', c='gc')}) AS w, avg({_f(kind, b='gb')}) AS one, avg({_f(kind, c='gc')}) AS two, avg({_f(kind)}) AS m FROM t, g GROUP BY i, j)
SELECT {_z('CASE WHEN sum((w - m) * (w - m)) > 0 THEN sum(pow(w - one - two + m, 2)) / sum((w - m) * (w - m)) ELSE 0 END')} AS h FROM hw"""


each("friedman_h_statistic", "generic_friedman_h", _h_sql, lambda x, spark: rows(spark, "h double", [(explain.interaction(x, 1, 2, 5),)]))

# ---- attributions ----


def _listed(df, column):
    return rounded(df.select("id", F.posexplode(column).alias("k", "value")))


named("fpc_shap_values", f"WITH {_x('linear')}, {_M} " + " UNION ALL ".join(f"SELECT id, {k} AS k, {_z(f'{COEF[k]} * ({v} - m{v})')} AS value FROM t, m" for k, v in enumerate("abc")), lambda spark, d: _listed(explain.linear_attributions(_linear(spark, d)), "values"))


def _shap_sql(kind):
    """Three components: all six coalitions weigh the same, and the normal matrix is 2 I + J."""
    value = {s: f"({_f(kind, *[v if v in s else 'm' + v for v in 'abc'])} - base)" for r in (1, 2) for s in itertools.combinations("abc", r)}
    held = {v: " + ".join(e for s, e in value.items() if v in s) for v in "abc"}
    total = " + ".join(f"h{v}" for v in "abc")
    return f"WITH {_x(kind)}, {_M}, sw AS (SELECT *, {_f(kind, 'ma', 'mb', 'mc')} AS base FROM t, m), h AS (SELECT id, " + ", ".join(f"{held[v]} AS h{v}" for v in "abc") + " FROM sw) " + " UNION ALL ".join(f"SELECT id, {k} AS k, {_z(f'h{v} / 2 - ({total}) / 10')} AS value FROM h" for k, v in enumerate("abc"))


each("fpc_shap_values", "generic_shap_values", _shap_sql, lambda x, spark: _listed(explain.attributions(x), "values"), ("logistic", "product"))
_MAP = " + ".join(f"{COEF[k]} * ({v} - m{v}) * l{k + 1}" for k, v in enumerate("abc"))
named("functional_saliency", f"WITH {_x('linear')}, {_M} SELECT id, pos::INT AS k, {_z(_MAP)} AS value FROM t, m, l", lambda spark, d: _listed(explain.saliency(_linear(spark, d))[0], "saliency"))
_BETA = " + ".join(f"{COEF[k]} * l{k + 1}" for k in range(3))
named("functional_saliency_logistic", f"WITH {_x('logistic')}, p AS (SELECT id, {_f('logistic')} AS p FROM t) SELECT id, pos::INT AS k, {_z(f'p * (1 - p) * ({_BETA})')} AS value FROM p, l", lambda spark, d: _listed(explain.saliency(_logistic(spark, d), "gradient")[0], "saliency"))
named("generic_saliency", f"WITH {components(K)}, v AS ({_shap_sql('product')}), s AS (SELECT id, pos, sum(value * CASE k WHEN 0 THEN l1 WHEN 1 THEN l2 ELSE l3 END) AS s FROM v, l GROUP BY id, pos) SELECT pos::INT AS pos, round(avg(abs(s)), 3) + 0.0 AS value FROM s GROUP BY pos", lambda spark, d: rounded(rows(spark, "pos int, value double", [(k, float(v)) for k, v in enumerate(explain.saliency(_product(spark, d), "shap")[1])]), 3))
named("lime_explanation", None, lambda spark, d: rounded(explain.local_surrogate(_linear(spark, d), 100)))
named("lime_explanation_logistic", None, lambda spark, d: rounded(explain.local_surrogate(_logistic(spark, d), 100)))
named("generic_lime", None, lambda spark, d: rounded(explain.local_surrogate(_product(spark, d), 100)))

# ---- importance ----

named("sobol_indices", f"WITH {_x('linear')}, s AS (SELECT sum(a * a) / (count(*) - 1) AS va, sum(b * b) / (count(*) - 1) AS vb, sum(c * c) / (count(*) - 1) AS vc, var_samp(y) AS vy FROM t) " + " UNION ALL ".join(f"SELECT {k}::INT AS component, {_z(f'pow({COEF[k]}, 2) * v{v} / vy')} AS share FROM s" for k, v in enumerate("abc")), lambda spark, d: rows(spark, "component int, share double", explain.variance_shares(_linear(spark, d))))
for _name, _kind in {"sobol_indices_logistic": "logistic", "generic_sobol_indices": "product"}.items():
    named(_name, None, lambda spark, d, kind=_kind: rows(spark, "component int, first double, total double", explain.sobol(MODELS[kind](spark, d))))
each("fpc_permutation_importance", "generic_permutation_importance", None, lambda x, spark: rows(spark, "component int, importance double, permuted double", explain.permutation_importance(x)))
each("conditional_permutation_importance", "generic_conditional_permutation_importance", None, lambda x, spark: rows(spark, "component int, importance double, permuted double", explain.permutation_importance(x, n_bins=4)))


_NORM = "(SELECT c1 * c1 + c2 * c2 + c3 * c3 FROM co)"


def _pointwise(name, kind, model):
    part = " + ".join(f"pow({COEF[k]} * l{k + 1}, 2) * v{v}" for k, v in enumerate("abc"))
    sql = f"WITH {_x(kind)}, s AS (SELECT sum(a * a) / (count(*) - 1) AS va, sum(b * b) / (count(*) - 1) AS vb, sum(c * c) / (count(*) - 1) AS vc FROM t), i AS (SELECT pos, {part} AS i FROM l, s) SELECT pos::INT AS pos, {_z('i')} AS importance, {_z('i / sum(i) OVER ()')} AS share FROM i"

    def run(spark, d):
        total, share, _ = explain.pointwise_importance(model(spark, d))
        return rows(spark, "pos int, importance double, share double", [(k, float(a), float(b)) for k, (a, b) in enumerate(zip(total, share, strict=True))])

    named(name, sql, run)


_pointwise("pointwise_importance", "linear", _linear)
_pointwise("pointwise_importance_logistic", "logistic", _logistic)


def _decomposition(name, kind, model):
    sql = f"WITH {_x(kind)} " + " UNION ALL ".join(f"SELECT {k}::INT AS component, pos::INT AS pos, {_z(f'{COEF[k]} * l{k + 1}')} AS value, {_z(f'pow({COEF[k]}, 2) / {_NORM}')} AS share FROM l" for k in range(3))

    def run(spark, d):
        parts, share = explain.beta_parts(model(spark, d))
        return rows(spark, "component int, pos int, value double, share double", [(j, k, float(v), float(share[j])) for j, line in enumerate(parts) for k, v in enumerate(line)])

    named(name, sql, run)


_decomposition("beta_decomposition", "linear", _linear)
_decomposition("beta_decomposition_logistic", "logistic", _logistic)


def _islands(given: str, squared: str, width: int, threshold: float, of: str = "l") -> str:
    return f"""WITH {given}, b AS (SELECT pos, {squared} AS s FROM {of}), wi AS (SELECT pos AS a, sum(s) OVER (ORDER BY pos ROWS BETWEEN CURRENT ROW AND {width - 1} FOLLOWING) AS m, sum(s) OVER () AS total, count(*) OVER (ORDER BY pos ROWS BETWEEN CURRENT ROW AND {width - 1} FOLLOWING) AS k FROM b),
h AS (SELECT a, m FROM wi WHERE k = {width} AND m >= {threshold} * total), il AS (SELECT a, m, sum(CASE WHEN a <= before + {width} THEN 0 ELSE 1 END) OVER (ORDER BY a) AS island FROM (SELECT *, lag(a) OVER (ORDER BY a) AS before FROM h))
SELECT min(a)::INT AS first, (max(a) + {width - 1})::INT AS last, {_z('sum(m)')} AS importance FROM il GROUP BY island"""


def _domains(name, kind, model):
    def run(spark, d):
        x = model(spark, d)
        return rows(spark, "first int, last int, importance double", explain.important_intervals(x.loadings @ x.coef, WIDTH, SHARE))

    named(name, _islands(_x(kind), f"pow({_BETA}, 2)", WIDTH, SHARE), run)


_domains("domain_selection", "linear", _linear)
_domains("domain_selection_logistic", "logistic", _logistic)
_ABS = f"{components(K)}, v AS ({_shap_sql('product')}), sm AS (SELECT pos, avg(abs(s)) AS s FROM (SELECT id, pos, sum(value * CASE k WHEN 0 THEN l1 WHEN 1 THEN l2 ELSE l3 END) AS s FROM v, l GROUP BY id, pos) GROUP BY pos)"
named("generic_domain_selection", _islands(_ABS, "pow(s, 2)", WIDTH, SHARE, "sm").replace(_z("sum(m)"), "round(sum(m), 3) + 0.0"), lambda spark, d: rounded(rows(spark, "first int, last int, importance double", explain.important_intervals(explain.saliency(_product(spark, d), "shap")[1], WIDTH, SHARE)), 3))

_CI = f"{_C}, s AS (SELECT pos, avg(v) AS m, stddev_samp(v) / sqrt(count(*)) AS se FROM c GROUP BY pos)"
_RUNS = "k AS (SELECT pos, CASE WHEN m - 1.96 * se > 0 THEN 1 WHEN m + 1.96 * se < 0 THEN -1 ELSE 0 END AS g FROM s), i AS (SELECT pos, g, pos - row_number() OVER (PARTITION BY g ORDER BY pos) AS island FROM k) SELECT min(pos)::INT AS first, max(pos)::INT AS last, g::INT AS sign FROM i WHERE g <> 0 GROUP BY g, island"


def _mean_and_error(spark, d):
    found = pointwise.summary(EMB(spark, d)).orderBy("pos").collect()
    n = EMB(spark, d).df.count()
    return np.array([r["mean"] for r in found]), np.array([r["std"] for r in found]) / np.sqrt(n)


def _regions(spark, found):
    return spark.createDataFrame([tuple(x) for x in found], "first int, last int, sign int")


def _bands(spark, d):
    m, se = _mean_and_error(spark, d)
    return _regions(spark, explain.significant_regions(m - 1.96 * se, m + 1.96 * se))


named("significant_regions", f"WITH {_CI}, {_RUNS}", _bands)
named("significant_regions_from_se", f"WITH {_CI}, {_RUNS}", lambda spark, d: _regions(spark, explain.significant_from_errors(*_mean_and_error(spark, d))))

# ---- diagnostics of a fitted line ----

_LINE = f"{_x('linear')}, f AS (SELECT regr_slope(y, a) AS slope, regr_intercept(y, a) AS i, avg(a) AS m, regr_sxx(y, a) AS sxx, count(*)::DOUBLE AS n FROM t), e AS (SELECT id, a, y, y - i - slope * a AS r, 1 / n + (a - m) * (a - m) / sxx AS h, n, m, sxx FROM t, f), s AS (SELECT sum(r * r) / (count(*) - 2) AS s2 FROM e), tl AS (SELECT *, sqrt((s2 * (n - 2) - r * r / (1 - h)) / (n - 3)) AS own FROM e, s)"


def _line(spark, d):
    t = _linear(spark, d).df.select("id", F.slice("scores", 1, 1).alias("scores"), "y")
    xx, xy = sums(t, lambda s, y: [explain._design(s).T @ explain._design(s), explain._design(s).T @ y], ["scores", "y"])
    b = np.linalg.solve(xx, xy)
    return explain.linear(t, float(b[0]), b[1:])


named("dfbetas_dffits", f"WITH {_LINE} SELECT id, {_z('(1 / n - m * (a - m) / sxx) * r / (1 - h) / own / sqrt(1 / n + m * m / sxx)')} AS dfbeta0, {_z('(a - m) / sxx * r / (1 - h) / own / sqrt(1 / sxx)')} AS dfbeta1, {_z('r / (own * sqrt(1 - h)) * sqrt(h / (1 - h))')} AS dffits FROM tl", lambda spark, d: rounded(explain.deletion_effects(_line(spark, d)).select("id", F.col("dfbetas")[0].alias("dfbeta0"), F.col("dfbetas")[1].alias("dfbeta1"), "dffits")))
named("loo_cv_press", f"WITH {_LINE} SELECT {_z('sum(pow(r / (1 - h), 2))')} AS press, {_z('1 - sum(pow(r / (1 - h), 2)) / regr_syy(y, a)')} AS loo_r2 FROM tl", lambda spark, d: rows(spark, "press double, loo_r2 double", [explain.left_out(_line(spark, d))]))
named("prediction_intervals", None, lambda spark, d: (lambda x: rounded(explain.prediction_intervals(x, x.df)))(_line(spark, d)))
_CORR = f"WITH {_x('linear')}, r AS (SELECT corr(a, b) AS ab, corr(a, c) AS ac, corr(b, c) AS bc FROM t), d AS (SELECT *, 1 + 2 * ab * ac * bc - ab * ab - ac * ac - bc * bc AS det FROM r) SELECT 0 AS component, {_z('(1 - bc * bc) / det')} AS vif FROM d UNION ALL SELECT 1, {_z('(1 - ac * ac) / det')} FROM d UNION ALL SELECT 2, {_z('(1 - ab * ab) / det')} FROM d"
for _name, _model in {"fpc_vif": _linear, "fpc_vif_logistic": _logistic, "generic_vif": _product}.items():
    named(_name, _CORR, lambda spark, d, m=_model: rows(spark, "component int, vif double", explain.variance_inflation(m(spark, d))))
_PROB = f"{_x('logistic')}, p AS (SELECT id, u, {_f('logistic')} AS p FROM t)"
_GROUPS = "o AS (SELECT p, u, row_number() OVER (ORDER BY p) AS k, count(*) OVER () AS n FROM p), e AS (SELECT list(p ORDER BY p) AS e FROM o WHERE k IN (SELECT ceil(j * n / 10.0) FROM range(1, 10) q(j))), g AS (SELECT len(list_filter(e, lambda c: c <= p)) AS g, count(*)::DOUBLE AS n, sum(p) AS sp, sum(u) AS su FROM o, e GROUP BY g)"
named("calibration_diagnostics", f"WITH {_PROB}, {_GROUPS}, h AS (SELECT sum(pow(su - sp, 2) / (n * (sp / n) * (1 - sp / n))) AS h FROM g) SELECT {_z('avg(pow(p - u, 2))')} AS brier, {_z('-avg(u * ln(p) + (1 - u) * ln(1 - p))')} AS log_loss, {_z('any_value(h)')} AS hosmer_lemeshow FROM p, h", lambda spark, d: rows(spark, "brier double, log_loss double, hosmer_lemeshow double", [tuple(explain.calibration(_logistic(spark, d))[0][k] for k in ("brier", "log_loss", "hosmer_lemeshow"))]))
named("expected_calibration_error", f"WITH {_PROB}, {_GROUPS}, b AS (SELECT count(*)::DOUBLE AS n, abs(sum(p) - sum(u)) / count(*) AS gap FROM p GROUP BY least(floor(p * 10), 9)) SELECT {_z('sum(n * gap) / sum(n)')} AS ece, {_z('max(gap)')} AS mce, round((SELECT sum(abs(sp - su)) / sum(n) FROM g), 6) + 0.0 AS ace FROM b", lambda spark, d: rows(spark, "ece double, mce double, ace double", [tuple(explain.calibration_error(_logistic(spark, d))[k] for k in ("ece", "mce", "ace"))]))

# ---- resampling ----

for _name, _model in {"explanation_stability": _linear, "explanation_stability_logistic": _logistic, "generic_stability": _product}.items():
    named(_name, None, lambda spark, d, m=_model: rows(spark, "metric_std double, rank_stability double", [(lambda s: (s["metric_std"], s["rank_stability"]))(explain.stability(m(spark, d), 50))]))
for _name, _model in {"regression_depth": _linear, "regression_depth_logistic": _logistic}.items():
    named(_name, None, lambda spark, d, m=_model: rounded(explain.regression_depth(m(spark, d), 50)[1]))
named("conformal_prediction_residuals", None, lambda spark, d: (lambda c: rounded(infer.conformal_linear(c, "label", c, 3)[0].select("id", "fit", "low", "high")))(EMB(spark, d)))
named("bootstrap_ci_fregre_lm", None, lambda spark, d: _interval(spark, explain.of_model(EMB(spark, d), "label", regress.linear(EMB(spark, d), "label", 3))))


def _interval(spark, x):
    """Percentile intervals of the coefficient function over refits."""
    coef, _ = explain.bootstrap(x, 100)
    beta = coef[:, 1:] @ x.loadings.T
    low, high = np.quantile(beta, [0.025, 0.975], axis=0)
    return rows(spark, "pos int, beta double, low double, high double", [(k, float(b), float(a), float(z)) for k, (b, a, z) in enumerate(zip(x.loadings @ x.coef, low, high, strict=True))])


def _binary(spark, d):
    c = EMB(spark, d)
    return c.with_df(c.df.withColumn("y", (F.col("label") < 5).cast("double")))


named("bootstrap_ci_functional_logistic", None, lambda spark, d: (lambda c: _interval(spark, explain.of_model(c, "y", regress.glm(c, "y", "binomial", 3))))(_binary(spark, d)))

# ---- examples ----

named("counterfactual_regression", f"WITH {_x('linear')}, p AS (SELECT id, (1 - {_f('linear')}) / {_NORM} AS g FROM t) SELECT id, " + ", ".join(f"{_z(f'g * {c}')} AS delta{k}" for k, c in enumerate(COEF)) + f", {_z(f'abs(g) * sqrt({_NORM})')} AS distance FROM p", lambda spark, d: rounded(explain.counterfactual(_linear(spark, d), 1.0).select("id", *[F.col("delta")[k].alias(f"delta{k}") for k in range(3)], "distance")))
named("counterfactual_logistic", None, lambda spark, d: rounded(explain.flip(_logistic(spark, d))))
named("generic_counterfactual", None, lambda spark, d: rounded(explain.search(_product(spark, d), 1.2)))


def _prototypes(x, spark):
    return rows(spark, "kind string, place int, id long, witness double", explain.prototypes(x, 3, 3, 0.2))


named("prototype_criticism", None, lambda spark, d: _prototypes(_linear(spark, d), spark))
named("generic_prototype_criticism", None, lambda spark, d: _prototypes(_product(spark, d), spark))


def _anchor(x, spark):
    found, precision, coverage = explain.anchor(x, 1)
    return rows(spark, "component int, low double, high double, precision double, coverage double", [(j, lo, hi, precision, coverage) for j, lo, hi in found])


each("anchor_explanation", "generic_anchor", None, _anchor)
