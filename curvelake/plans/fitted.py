"""Queries of models fitted to the tables: mixed models of customers' years, elastic models of
nations' revenue."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curvelake.functions import numeric as nm
from curvelake.operators import elastic_models, infer, mixed, models, selection, sparse, subspaces, surfaces
from curvelake.plans.basics import cells, named
from curvelake.plans.registry import _C, EMB, EV, REV, _smoothed, _z, curve_rows, rounded, rows
from curvelake.sources import curves as src
from curvelake.sources.curves import Curves

MONTHS = 12


def customer_years(spark: SparkSession, d: str, what: str = "o_totalprice", intercept: bool = False) -> Curves:
    """A curve for each customer and year: monthly revenue in 100,000 (or number of orders);
    the customer's balance in 1,000 is a covariate."""
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_custkey", "o_orderdate", F.col("o_totalprice").cast("double"))
    b = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_acctbal").cast("double") / 1000).alias("balance"))
    v = F.col(what) / 100000 if what == "o_totalprice" else F.lit(1.0)
    months = [F.sum(F.when(F.month("o_orderdate") == k + 1, v).otherwise(0.0)).alias(f"m{k}") for k in range(MONTHS)]
    years = o.groupBy("o_custkey", F.year("o_orderdate").alias("year")).agg(*months)
    x = F.array(*([F.lit(1.0)] if intercept else []), F.col("balance"))
    return Curves(years.join(b, "o_custkey").select((F.col("o_custkey") * 10000 + F.col("year")).cast("long").alias("id"), F.col("o_custkey").cast("long").alias("customer"), x.alias("x"), F.array(*[f"m{k}" for k in range(MONTHS)]).alias("values")), nm.unit_grid(MONTHS))


_YEARS = f"""k AS (SELECT o_custkey AS s, year(o_orderdate) AS y, month(o_orderdate) - 1 AS pos, sum(o_totalprice::DOUBLE / 100000) AS v FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer) GROUP BY ALL),
c AS (SELECT a.s, a.y, p.pos, coalesce(k.v, 0) AS v, c_acctbal::DOUBLE / 1000 AS b FROM (SELECT DISTINCT s, y FROM k) a CROSS JOIN (SELECT range AS pos FROM range({MONTHS})) p LEFT JOIN k ON k.s = a.s AND k.y = a.y AND k.pos = p.pos JOIN customer ON c_custkey = a.s)"""


def _over(e: str) -> str:
    return f"list_sum(list_transform(st, lambda g: {e}))"


_S = "(g.syy - 2 * (g1 * g.sy1 + g2 * g.sy2) + g1 * g1 * g.s11 + 2 * g1 * g2 * g.s12 + g2 * g2 * g.s22)"
_RSS = "(yy - 2 * (g1 * x1y + g2 * x2y) + g1 * g1 * x11 + 2 * g1 * g2 * x12 + g2 * g2 * x22)"
_SHARE = "(u / (u * g.n + e))"
#: Expectation-maximisation of a random intercept at every month, step by step.
_POINTWISE = f"""WITH RECURSIVE {_YEARS},
s AS (SELECT pos, s, count(*)::DOUBLE AS n, sum(b) AS b, sum(v) AS v FROM c GROUP BY pos, s),
g AS (SELECT pos, n, count(*)::DOUBLE AS m, sum(n * n) AS s11, sum(n * b) AS s12, sum(b * b) AS s22, sum(n * v) AS sy1, sum(b * v) AS sy2, sum(v * v) AS syy FROM s GROUP BY pos, n),
t AS (SELECT pos, count(*)::DOUBLE AS x11, sum(b) AS x12, sum(b * b) AS x22, sum(v) AS x1y, sum(b * v) AS x2y, sum(v * v) AS yy FROM c GROUP BY pos),
st AS (SELECT t.*, (SELECT list(struct_pack(n := n, m := m, s11 := s11, s12 := s12, s22 := s22, sy1 := sy1, sy2 := sy2, syy := syy) ORDER BY n) FROM g WHERE g.pos = t.pos) AS st FROM t),
i0 AS (SELECT *, ((x22 + 1e-8) * x1y - x12 * x2y) / ((x11 + 1e-8) * (x22 + 1e-8) - x12 * x12) AS g1, ((x11 + 1e-8) * x2y - x12 * x1y) / ((x11 + 1e-8) * (x22 + 1e-8) - x12 * x12) AS g2 FROM st),
i1 AS (SELECT *, {_over(f"{_S} / g.n")} AS ms, {_over("g.m")} AS ns FROM i0),
i2 AS (SELECT *, ({_RSS} - ms) / (x11 - ns) AS e0 FROM i1),
i3 AS (SELECT *, greatest(((ms - pow(x1y - g1 * x11 - g2 * x12, 2) / x11) / (ns - 1) - e0) / (x11 / ns), 0) AS u0 FROM i2),
r AS (SELECT pos, 0 AS it, g1, g2, CASE WHEN u0 < 1e-15 THEN 0.1 * e0 ELSE u0 END AS u, e0 AS e, false AS done FROM i3
 UNION ALL
 SELECT pos, it + 1, g1, g2, nu, ne, abs(nu - u) + abs(ne - e) < 1e-8 * (u + e) FROM (
  SELECT *, {_over(f"pow({_SHARE}, 2) * {_S} + g.m * u * (1 - {_SHARE} * g.n)")} / ns AS nu,
   ({_RSS} - {_over(f"(2 * {_SHARE} * g.n - pow({_SHARE} * g.n, 2)) * {_S} / g.n")} + {_over(f"g.n * g.m * u * (1 - {_SHARE} * g.n)")}) / (x11 - 2) AS ne FROM (
   SELECT *, (a22 * b1 - a12 * b2) / (a11 * a22 - a12 * a12) AS g1, (a11 * b2 - a12 * b1) / (a11 * a22 - a12 * a12) AS g2 FROM (
    SELECT pos, it, u, e, x11, x12, x22, x1y, x2y, yy, st, ns, (x11 - {_over(f"{_SHARE} * g.s11")}) / e + 1e-10 AS a11, (x12 - {_over(f"{_SHARE} * g.s12")}) / e AS a12, (x22 - {_over(f"{_SHARE} * g.s22")}) / e + 1e-10 AS a22,
     (x1y - {_over(f"{_SHARE} * g.sy1")}) / e AS b1, (x2y - {_over(f"{_SHARE} * g.sy2")}) / e AS b2
    FROM r JOIN i1 USING (pos) WHERE it < 30 AND NOT done)))),
f AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY pos ORDER BY it DESC) = 1),
h AS (SELECT f.pos, avg(o.g1) AS b1, avg(o.g2) AS b2 FROM f JOIN f o ON abs(o.pos - f.pos) <= 1 GROUP BY f.pos)
SELECT f.pos::INT AS pos, {_z("b1")} AS intercept, {_z("b2")} AS slope,
 {_z("b1 / sqrt(e * (x22 + 1e-8) / ((x11 + 1e-8) * (x22 + 1e-8) - x12 * x12))")} AS t_intercept,
 {_z("b2 / sqrt(e * (x11 + 1e-8) / ((x11 + 1e-8) * (x22 + 1e-8) - x12 * x12))")} AS t_slope, {_z("u")} AS sigma2_u, {_z("e")} AS sigma2_e
FROM f JOIN h USING (pos) JOIN t USING (pos)"""


def _pointwise(spark, d):
    p = mixed.pointwise(customer_years(spark, d, intercept=True), "customer", "x")
    return rows(spark, "pos int, intercept double, slope double, t_intercept double, t_slope double, sigma2_u double, sigma2_e double", [(k, *(float(v[k]) for v in (p.beta[0], p.beta[1], p.t[0], p.t[1], p.sigma2_u, p.sigma2_e))) for k in range(MONTHS)])


def _model(spark, d, **more) -> tuple[Curves, mixed.FunctionalMixed]:
    c = customer_years(spark, d, **more)
    return c, mixed.functional(c, "customer", "x", 3)


def _effects(spark, d) -> DataFrame:
    _, m = _model(spark, d)
    variance = m.random_variance()
    return rows(spark, "pos int, mean double, beta double, random_variance double", [(k, float(m.components.mean[k]), float(m.beta[0, k]), float(variance[k])) for k in range(MONTHS)])


def _predicted(spark, d) -> DataFrame:
    """The curve of every customer by its balance alone, as for one not seen."""
    _, m = _model(spark, d)
    new = spark.read.parquet(f"{d}/customer.parquet")
    return rounded(m.predict(new.select(F.col("c_custkey").cast("long").alias("customer"), F.array(F.col("c_acctbal").cast("double") / 1000).alias("x"))))


def _stacked(spark, d) -> DataFrame:
    """Revenue and number of orders, each with its own components and variances."""
    parts = []
    for k, what in enumerate(("o_totalprice", "orders")):
        c, m = _model(spark, d, what=what)
        parts.append(m.fitted(c).select(F.lit(k).alias("dim"), "id", "fitted"))
    return rounded(parts[0].unionByName(parts[1]))


named("fast_fmm", _POINTWISE, _pointwise)
named("fmm", None, _effects)
named("fmm_predict", None, _predicted)
named("fmm_test_fixed", None, lambda spark, d: rows(spark, "covariate int, statistic double, p double", [(k, float(a), float(b)) for k, (a, b) in enumerate(zip(*mixed.permutation_test(customer_years(spark, d), "customer", "x", 3, 99), strict=True))]))
named("dense_flmm", None, lambda spark, d: rounded(mixed.functional(customer_years(spark, d), "customer", "x", 3, max_iter=100, tol=1e-12).random_effects().withColumnRenamed("subject", "customer")))
named("multi_famm", None, _stacked)

# ---- elastic models: smoothed nation curves; every fifth nation is held out where new curves are wanted ----

REGIONS = list(range(5))


def _nations(spark, d, held_out: bool | None = None) -> Curves:
    """Curves with y (mean revenue in millions), region and whether it is one of the first two."""
    c = _smoothed(spark, d)
    y = REV(spark, d).df.select("id", (F.aggregate("values", F.lit(0.0), lambda a, x: a + x) / F.lit(src.MONTHS * 1e6)).alias("y"))
    n = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_regionkey").cast("int").alias("region"))
    df = c.df.join(y, "id").join(n, "id").withColumn("first", (F.col("region") < 2).cast("int"))
    return c.with_df(df if held_out is None else df.where((F.col("id") % 5 == 0) == F.lit(held_out)))


def _probability(df: DataFrame) -> DataFrame:
    return rounded(df.withColumn("probability", F.col("probabilities")[0]).drop("probabilities"))


named("elastic_regression", None, lambda spark, d: rounded(elastic_models.regression(_nations(spark, d), "y").fitted.select("id", "y", "fit")))
named("elastic_regression_with_config", None, lambda spark, d: (lambda m: curve_rows(spark, m.beta, names=("beta",)))(elastic_models.regression(_nations(spark, d), "y", 6, 0.1)))
named("predict_elastic_regression", None, lambda spark, d: rounded(elastic_models.regression(_nations(spark, d, False), "y").predict(_nations(spark, d, True)).select("id", "y", "fit")))
named("elastic_logistic", None, lambda spark, d: _probability(elastic_models.logistic(_nations(spark, d), "first", [1]).fitted.select("id", "y", "probabilities")))
named("elastic_logistic_with_config", None, lambda spark, d: curve_rows(spark, elastic_models.logistic(_nations(spark, d), "first", [1], 0.1).beta[0], names=("beta",)))
named("predict_elastic_logistic", None, lambda spark, d: _probability(elastic_models.logistic(_nations(spark, d, False), "first", [1]).predict(_nations(spark, d, True)).select("id", "probabilities")))
named("elastic_multinomial", None, lambda spark, d: rounded(elastic_models.predicted_class(elastic_models.logistic(_nations(spark, d), "region", REGIONS, 0.01).fitted, REGIONS).select("id", "y", "predicted", "probabilities")))
named("predict_elastic_multinomial", None, lambda spark, d: elastic_models.predicted_class(elastic_models.logistic(_nations(spark, d, False), "region", REGIONS, 0.01).predict(_nations(spark, d, True)), REGIONS).select("id", "region", "predicted"))
named("scalar_on_shape", None, lambda spark, d: curve_rows(spark, elastic_models.scalar_on_shape(_nations(spark, d), "y").beta, names=("beta",)))
named("predict_scalar_on_shape", None, lambda spark, d: rounded(elastic_models.scalar_on_shape(_nations(spark, d, False), "y").predict(_nations(spark, d, True)).select("id", "y", "score", "fit")))


def _split(spark, d, part: int) -> Curves:
    """Of the nations that are not held out, those that fit (0) or calibrate (1)."""
    c = _nations(spark, d, False)
    return c.with_df(c.df.where(F.col("id") % 2 == part))


def _interval(spark, d, model, alpha: float) -> DataFrame:
    """Held-out nations with an interval from the residuals of calibrating ones."""
    return rounded(models.conformal_of(model.predict(_split(spark, d, 1)), model.predict(_nations(spark, d, True)), alpha)[0].select("id", "y", "fit", "low", "high"))


for _name, _alpha, _options in (("conformal_elastic_regression", 0.1, {}), ("conformal_elastic_regression_with_config", 0.2, {"nbasis": 6, "lam": 0.1})):
    named(_name, None, lambda spark, d, a=_alpha, o=_options: _interval(spark, d, elastic_models.regression(_split(spark, d, 0), "y", **o), a))
for _name, _alpha, _k in (("conformal_elastic_pcr", 0.1, 3), ("conformal_elastic_pcr_with_config", 0.2, 2)):
    named(_name, None, lambda spark, d, a=_alpha, k=_k: _interval(spark, d, elastic_models.component_model(_split(spark, d, 0), "y", k), a))


def _classes(spark, d) -> DataFrame:
    m = elastic_models.logistic(_split(spark, d, 0), "first", [1])
    both = lambda c: m.predict(c).select("id", F.array(1 - F.col("probabilities")[0], F.col("probabilities")[0]).alias("probabilities"), F.col("first").alias("label"))
    return infer.conformal_classes(both(_nations(spark, d, True)).drop("label"), both(_split(spark, d, 1)), 0.1).select("id", F.array_join("set", ",").alias("classes"))


named("conformal_elastic_logistic", None, _classes)

# ---- many predictors: what customers ordered, month by month, and how much in the year ----


NAMES = ("revenue", "orders", "discount", "tax", "returned")


def _predictors(spark, d) -> DataFrame:
    """id, y, x: for each customer and year, curves of revenue, orders, discounts, taxes and
    returned items, one after another; y: the year's quantity in 100.

    Orders are sent to their customer and year before months become columns: rows stay narrow."""
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"))
    line = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", *[F.col(f"l_{x}").cast("double").alias(x) for x in ("extendedprice", "discount", "tax", "quantity")], (F.col("l_returnflag") == "R").cast("double").alias("returned"))
    per_order = line.groupBy("l_orderkey").agg(*[F.sum(x).alias(x) for x in ("discount", "tax", "returned", "quantity")], (F.sum("extendedprice") / 100000).alias("revenue"))
    both = o.join(per_order, F.col("o_orderkey") == F.col("l_orderkey")).withColumn("orders", F.lit(1.0)).select("o_custkey", "year", "month", "quantity", *NAMES).repartition("o_custkey", "year")
    months = [F.sum(F.when(F.col("month") == k + 1, F.col(x)).otherwise(0.0)) for x in NAMES for k in range(MONTHS)]
    years = both.groupBy("o_custkey", "year").agg((F.sum("quantity") / 100).alias("y"), F.array(*months).alias("x"))
    return years.select((F.col("o_custkey") * 10000 + F.col("year")).cast("long").alias("id"), "y", "x")


def _selected(spark, d) -> DataFrame:
    """Groups' norms under three penalties, each with its own cross-validated strength."""
    scores, out = selection.scores(_predictors(spark, d), [nm.unit_grid(MONTHS)] * len(NAMES)), []
    for how in ("lasso", "scad", "mcp"):
        m = selection.select(scores, how=how)
        out += [(how, p, bool(a), float(np.linalg.norm(b)), float(m.lam), float(m.r2)) for p, (a, b) in enumerate(zip(m.active, m.coef, strict=False))]
    return rows(spark, "penalty string, predictor int, active boolean, norm double, strength double, r2 double", out)


named("variable_selection", None, _selected)

LAGS, WINDOW, SPREAD = 20, 0.5, 0.05
_HISTORY = f"""WITH {_C}, g AS (SELECT range AS l, range * {WINDOW / LAGS!r}::DOUBLE AS u FROM range({LAGS})),
p AS (SELECT l, u, greatest((SELECT count(*) FROM range({src.EMBEDDING_POINTS}) x(k) WHERE k / {src.EMBEDDING_POINTS - 1}.0::DOUBLE < 1 - u) - 1, 0) AS pos FROM g),
x AS MATERIALIZED (SELECT id, label, l, u, v FROM c JOIN p USING (pos)),
s AS (SELECT l, u, regr_slope(label, v) AS s FROM x GROUP BY l, u),
r AS (SELECT a.l, sum(exp(-pow((a.u - b.u) / {SPREAD}, 2) / 2) * b.s) / sum(exp(-pow((a.u - b.u) / {SPREAD}, 2) / 2)) AS r FROM s a, s b GROUP BY a.l),
w AS (SELECT l, r / sqrt(sum(r * r) OVER () * {WINDOW / LAGS!r}) AS gamma FROM r),
h AS (SELECT id, any_value(label) AS label, sum(gamma * v) * {WINDOW / LAGS!r} AS h FROM x JOIN w USING (l) GROUP BY id)
SELECT id, {_z("h")} AS history, {_z("(SELECT regr_intercept(label, h) FROM h) + (SELECT regr_slope(label, h) FROM h) * h")} AS fit FROM h"""
named("history_index", _HISTORY, lambda spark, d: (lambda c: rounded(selection.history(c, "label", WINDOW, LAGS, SPREAD).predict(c).select("id", "history", "fit")))(EMB(spark, d)))

# ---- clusters in subspaces and up to warps ----

named("funfem_cluster", None, lambda spark, d: (lambda c: rounded(subspaces.discriminative(c, 3, 5).predict(c).select("id", "cluster", "probabilities")))(EMB(spark, d)))
named("funhddC_cluster", None, lambda spark, d: (lambda c: rounded(subspaces.subspaces(c, 3, 2).predict(c).select("id", "cluster", "probabilities")))(EMB(spark, d)))
named("align_cluster_fd", None, lambda spark, d: (lambda c: rounded(subspaces.align_clusters(c, 3)[1].select("id", "cluster", "distances")))(_smoothed(spark, d)))

# ---- surfaces: embeddings as 8 x 8 cells, on the label ----

SIDE, ROUGH = 8, (1.0, 10.0)
_EIGEN = np.linalg.eigh(surfaces.difference_penalty(SIDE))
_TURN = "u AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {k}, {float(_EIGEN[1][i, k])!r}::DOUBLE, {float(_EIGEN[0][k])!r}::DOUBLE)" for i in range(SIDE) for k in range(SIDE)) + ") t(i, k, u, e))"


def _surface_sql(rest: str, where: str = "true") -> str:
    """Cellwise lines, turned into the penalty's eigenvectors, scaled and turned back."""
    return f"""WITH {_C}, {_TURN}, raw AS MATERIALIZED (SELECT pos, pos // {SIDE} AS i, pos % {SIDE} AS j, regr_intercept(v, label) AS b0, regr_slope(v, label) AS b1 FROM c WHERE {where} GROUP BY pos),
f AS MATERIALIZED (SELECT a.k, b.k AS l, sum(a.u * b.u * b0) / (1 + {ROUGH[0]} * any_value(a.e) + {ROUGH[1]} * any_value(b.e)) AS f0, sum(a.u * b.u * b1) / (1 + {ROUGH[0]} * any_value(a.e) + {ROUGH[1]} * any_value(b.e)) AS f1 FROM raw JOIN u a ON a.i = raw.i JOIN u b ON b.i = raw.j GROUP BY a.k, b.k),
b AS MATERIALIZED (SELECT ({SIDE} * a.i + b.i)::INT AS pos, sum(a.u * b.u * f0) AS b0, sum(a.u * b.u * f1) AS b1 FROM f JOIN u a ON a.k = f.k JOIN u b ON b.k = f.l GROUP BY a.i, b.i)
{rest}"""


def _surfaces(spark, d) -> DataFrame:
    m = surfaces.regression(EMB(spark, d), ["label"], SIDE, SIDE, *ROUGH)
    return curve_rows(spark, m.beta[0], m.beta[1], m.r2, names=("intercept", "slope", "r2"))


def _held_out_surfaces(spark, d) -> DataFrame:
    c = EMB(spark, d)
    m = surfaces.regression(c.with_df(c.df.where("id % 100 != 0")), ["label"], SIDE, SIDE, *ROUGH)
    return rounded(m.predict(c.df.where("id % 100 = 0").select("id", "label")).select("id", F.posexplode("values").alias("pos", "value")))


named("fosr_2d", _surface_sql(f"SELECT pos, {_z('any_value(b0)')} AS intercept, {_z('any_value(b1)')} AS slope, {_z('1 - sum(pow(v - b0 - b1 * label, 2)) / (var_pop(v) * count(*))')} AS r2 FROM c JOIN b USING (pos) GROUP BY pos"), _surfaces)
named("predict_fosr_2d", _surface_sql(f"SELECT vec_id AS id, pos, {_z('b0 + b1 * label')} AS value FROM embeddings, b WHERE vec_id % 100 = 0", "id % 100 <> 0"), _held_out_surfaces)

# ---- sparse curves: users' events ----

DAYS = np.linspace(1, 29, 15)


def _kind(spark, d, kind: str) -> DataFrame:
    """Events of one type as (id, t, v)."""
    e = spark.read.parquet(f"{d}/events.parquet").where(F.col("event_type") == kind)
    t = (F.unix_micros(F.col("ts").cast("timestamp")) - 1704067200000000) / 86_400_000_000
    return e.select(F.col("user_id").cast("long").alias("id"), t.alias("t"), F.col("value").cast("double").alias("v")).where("t IS NOT NULL AND v IS NOT NULL")


named("face_covariance", None, lambda spark, d: rounded(cells(spark, sparse.covariance([EV(spark, d)], [DAYS], 2.0).cov, ("s", "t"))))
named("mface_covariance", None, lambda spark, d: rounded(cells(spark, sparse.covariance([_kind(spark, d, k) for k in ("view", "click", "purchase")], [DAYS] * 3, 2.0).cov, ("s", "t"))))
named("face_trajectory", None, lambda spark, d: (lambda e: rounded(sparse.trajectories(e, sparse.covariance([e], [DAYS], 2.0), 2)))(EV(spark, d)))
