"""Registered queries of the numerics: bases, quadrature, interpolation, scalar metrics.

Each goes through the library's function; the SQL states the formula by itself.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curvelake.functions import numeric as nm
from curvelake.operators import depth, metrics, pointwise, reduce, season, smooth
from curvelake.operators.apply import per_curve, sums
from curvelake.plans.registry import _BOTH, _C, _D2, _DAY, _GRID, _H, _LABEL, _PAIR, _R, _S, _WEIGHTS, EMB, REV, _z, curve_rows, query, r, rounded, rows  # noqa: F401
from curvelake.sources import curves as src

M = src.EMBEDDING_POINTS
_G = f"g AS (SELECT k::INT AS pos, k / {M - 1}.0::DOUBLE AS t FROM range({M}) x(k))"


def named(name: str, sql: str | None, fn) -> None:
    """Registers fn(spark, folder) under a name."""

    def run(spark, d):
        return fn(spark, d)

    run.__name__ = name
    query(sql)(run)


def cells(spark, matrix, names=("pos", "k")):
    """A matrix as rows (row, column, value)."""
    return rows(spark, f"{names[0]} int, {names[1]} int, value double", [(i, j, float(x)) for i, line in enumerate(np.atleast_2d(matrix)) for j, x in enumerate(line)])


def _products(c, phi) -> DataFrame:
    """Integrals of every curve times each function (points, functions): id, k, value."""
    w = c.weights[:, None]
    out = per_curve(c.df.select("id", "values"), lambda v: v @ (w * phi), "values array<double>")
    return rounded(out.select("id", F.posexplode("values").alias("k", "value")))


def _products_sql(table: str) -> str:
    """The same from a SELECT of pos, k, value."""
    return f"{_C}, {_WEIGHTS}, b AS MATERIALIZED ({table}) SELECT id, k, {_z('sum(w * v * value)')} AS value FROM c JOIN w USING (pos) JOIN b USING (pos) GROUP BY id, k"


def _basis(name: str, n: int, value: str, fn) -> None:
    """Every embedding's integrals with the functions of a basis."""
    named(name, f"WITH {_G}, {_products_sql(f'SELECT pos, k::INT AS k, {value} AS value FROM g, range({n}) x(k)')}", lambda spark, d: _products(EMB(spark, d), fn(_GRID)))


# ---- bases and eigenfunctions on the grid ----

_basis("constant_basis", 1, "1.0::DOUBLE", nm.constant_basis)
_basis("monomial_basis", 5, "CASE WHEN k = 0 THEN 1.0 ELSE pow(t, k) END", lambda t: nm.monomial_basis(t, 5))
_basis("power_basis", 4, "CASE k WHEN 0 THEN t WHEN 1 THEN sqrt(t) WHEN 2 THEN pow(t, 1.5) ELSE pow(t, 3) END", lambda t: nm.power_basis(t, [1, 0.5, 1.5, 3]))
_basis("exponential_basis", 3, "exp(t * CASE k WHEN 0 THEN -1 WHEN 1 THEN 0 ELSE 2 END)", lambda t: nm.exponential_basis(t, [-1, 0, 2]))
_basis("polygonal_basis", 5, "greatest(0.0, 1 - abs(t - k / 4.0) * 4)", lambda t: nm.polygonal_basis(t, np.linspace(0, 1, 5)))
_FOURIER = "CASE WHEN k = 0 THEN 1.0 WHEN k % 2 = 1 THEN {a} * sin(2 * pi() * ((k + 1) // 2) * t / {p}) ELSE {a} * cos(2 * pi() * ((k + 1) // 2) * t / {p}) END"
_basis("fourier_basis", 5, _FOURIER.format(a=1, p=1), lambda t: nm.fourier_basis(t, 5))
_basis("fourier_basis_with_period", 5, _FOURIER.format(a=1, p=0.4), lambda t: nm.fourier_basis(t, 5, 0.4))
_basis("fourier_eigenfunctions", 7, _FOURIER.format(a="sqrt(2)", p=1), lambda t: nm.eigenfunctions(t, 7))
_basis("legendre_eigenfunctions", 4, "CASE k WHEN 0 THEN 1.0 WHEN 1 THEN sqrt(3) * (2 * t - 1) WHEN 2 THEN sqrt(5) * (6 * t * t - 6 * t + 1) ELSE sqrt(7) * (20 * t * t * t - 30 * t * t + 12 * t - 1) END", lambda t: nm.eigenfunctions(t, 4, "legendre"))
_basis("wiener_eigenfunctions", 5, "sqrt(2) * sin((k + 0.5) * pi() * t)", lambda t: nm.eigenfunctions(t, 5, "wiener"))
_basis("eigenfunctions", 2, "CASE k WHEN 0 THEN sqrt(5) * (6 * t * t - 6 * t + 1) ELSE sqrt(7) * (20 * t * t * t - 30 * t * t + 12 * t - 1) END", lambda t: nm.eigenfunctions(t, 2, "legendre_high"))

def _bspline_sql(n: int, order: int) -> str:
    """Cox-de Boor recursion over equal knots of a unit grid, one step for each order."""
    size, step = n + order, 1 / (n + 1)
    out = f"WITH {_G}, b1 AS (SELECT pos, t, k, CASE WHEN floor(least(t, 1 - 1e-12) / {step!r}::DOUBLE) = k - {order - 1} THEN 1.0::DOUBLE ELSE 0.0 END AS b FROM g, range({size + order - 1}) x(k))"
    for o in range(2, order + 1):
        left = f"(a.t - (a.k - {order - 1}) * {step!r}) / ({o - 1} * {step!r}) * a.b"
        right = f"((a.k + {o} - {order - 1}) * {step!r} - a.t) / ({o - 1} * {step!r}) * c.b"
        out += f", b{o} AS (SELECT a.pos, a.t, a.k, {left} + {right} AS b FROM b{o - 1} a JOIN b{o - 1} c ON c.pos = a.pos AND c.k = a.k + 1)"
    return out + f", {_products_sql(f'SELECT pos, k::INT AS k, b AS value FROM b{order} WHERE k < {size}')}"


named("bspline_basis", _bspline_sql(8, 4), lambda spark, d: _products(EMB(spark, d), nm.bspline_basis(_GRID, 8)))


_MODEL = {"linear": "1.0::DOUBLE / k", "exponential": "exp(-k)", "wiener": "1 / pow((k - 0.5) * pi(), 2)"}
_FAMILY_SQL = f"WITH {_G}, {_C}, {_WEIGHTS}, f AS (SELECT pos, k, {_FOURIER.format(a='sqrt(2)', p=1)} AS value FROM g, range({{n}}) x(k)), s AS (SELECT id, k + 1 AS k, sum(w * v * value) AS s FROM c JOIN w USING (pos) JOIN f USING (pos) GROUP BY id, k), e AS (SELECT k, var_samp(s) AS own FROM s GROUP BY k)"


def _spread_of(spark, d, n: int) -> np.ndarray:
    """Variances of the embeddings' scores on the first n Fourier eigenfunctions."""
    c = EMB(spark, d)
    phi = c.weights[:, None] * nm.eigenfunctions(_GRID, n)
    m, total = sums(c.df.select("values"), lambda v: [np.array([len(v)]), (v @ phi).sum(0)], ["values"])
    mean = total / m[0]
    return sums(c.df.select("values"), lambda v: [((v @ phi - mean) ** 2).sum(0)], ["values"])[0] / (m[0] - 1)


def _eigenvalues(name: str, family: str) -> None:
    """A family's eigenvalues beside the variances that the embeddings' scores have."""
    named(name, f"{_FAMILY_SQL.format(n=8)} SELECT k::INT AS k, {_z(_MODEL[family])} AS value, {_z('own')} AS own FROM e", lambda spark, d: rows(spark, "k int, value double, own double", [(k + 1, float(x), float(y)) for k, (x, y) in enumerate(zip(nm.eigenvalues(8, family), _spread_of(spark, d, 8), strict=True))]))


_eigenvalues("eigenvalues_linear", "linear")
_eigenvalues("eigenvalues_exponential", "exponential")
_eigenvalues("eigenvalues_wiener", "wiener")
_SHARES = " UNION ALL ".join(f"SELECT '{f}' AS family, k::INT AS k, {_z(f'own / sum(own) OVER () - ({e}) / sum({e}) OVER ()')} AS value FROM e" for f, e in _MODEL.items())
named("eigenvalues", f"{_FAMILY_SQL.format(n=5)} {_SHARES}", lambda spark, d: (lambda own: rows(spark, "family string, k int, value double", [(f, k + 1, float(x)) for f in _MODEL for k, x in enumerate(own / own.sum() - nm.eigenvalues(5, f) / nm.eigenvalues(5, f).sum())]))(_spread_of(spark, d, 5)))

# ---- covariance kernels: every embedding's mean square under each kernel ----

_KERNELS = {"gaussian": "exp(-(s - t) * (s - t) / 0.08)", "exponential": "exp(-abs(s - t) / 0.2)", "matern32": "(1 + sqrt(3) * abs(s - t) / 0.2) * exp(-sqrt(3) * abs(s - t) / 0.2)", "matern52": "(1 + sqrt(5) * abs(s - t) / 0.2 + 5 * (s - t) * (s - t) / 0.12) * exp(-sqrt(5) * abs(s - t) / 0.2)", "brownian": "least(s, t)", "periodic": "exp(-2 * pow(sin(pi() * abs(s - t)), 2) / 0.04)", "linear": "s * t"}


def _under_kernels(spark, d) -> DataFrame:
    c = EMB(spark, d)
    inner = [np.outer(c.weights, c.weights) * nm.covariance_kernel(_GRID, _GRID, k) for k in _KERNELS]
    out = per_curve(c.df.select("id", "values"), lambda v: np.stack([np.einsum("np,pq,nq->n", v, a, v) for a in inner], 1), "values array<double>")
    return rounded(out.select("id", F.posexplode("values").alias("k", "value")).select("id", F.element_at(F.array(*[F.lit(k) for k in _KERNELS]), F.col("k") + 1).alias("kernel"), "value"))


_COVARIANCES = " UNION ALL ".join(f"SELECT '{k}' AS kernel, a.pos AS i, b.pos AS j, {e} AS value FROM (SELECT pos, t AS s FROM g) a, g b" for k, e in _KERNELS.items())
named("covariance_matrix", f"WITH {_G}, {_C}, {_WEIGHTS}, k AS MATERIALIZED ({_COVARIANCES}), x AS MATERIALIZED (SELECT id, pos, w * v AS v FROM c JOIN w USING (pos)), h AS MATERIALIZED (SELECT kernel, id, i, sum(value * v) AS v FROM k JOIN x ON x.pos = j GROUP BY kernel, id, i) SELECT id, kernel, {_z('sum(h.v * x.v)')} AS value FROM h JOIN x ON x.id = h.id AND x.pos = i GROUP BY h.id, id, kernel".replace("SELECT id, kernel", "SELECT h.id AS id, kernel").replace("GROUP BY h.id, id, kernel", "GROUP BY h.id, kernel"), _under_kernels)

# ---- quadrature and interpolation ----

_SIMPSON = f"CASE WHEN pos = 0 THEN {_H} / 3 WHEN pos = {M - 1} THEN {_H} / 2 WHEN pos = {M - 2} THEN {_H} / 3 + {_H} / 2 WHEN pos % 2 = 1 THEN 4 * {_H} / 3 ELSE 2 * {_H} / 3 END"
named("simpsons_weights", f"WITH {_C} SELECT id, {_z(f'sum(v * ({_SIMPSON}))')} AS integral FROM c GROUP BY id", lambda spark, d: rounded(per_curve(EMB(spark, d).df.select("id", "values"), lambda v: v @ nm.simpson_weights(_GRID), "integral double")))
_PLANE = nm.simpson_weights_2d(nm.unit_grid(16), nm.unit_grid(4))
_EDGE = "CASE WHEN {k} = 0 THEN {h} / 3 WHEN {k} = {m} - 1 THEN {h} / 2 WHEN {k} = {m} - 2 THEN {h} / 3 + {h} / 2 WHEN {k} % 2 = 1 THEN 4 * {h} / 3 ELSE 2 * {h} / 3 END"
_CELL = f"({_EDGE.format(k='(pos % 16)', h='(1 / 15.0::DOUBLE)', m=16)}) * ({_EDGE.format(k='(pos // 16)', h='(1 / 3.0::DOUBLE)', m=4)})"
named("simpsons_weights_2d", f"WITH {_C} SELECT id, {_z(f'sum(v * {_CELL})')} AS integral FROM c GROUP BY id", lambda spark, d: rounded(per_curve(EMB(spark, d).df.select("id", "values"), lambda v: v @ _PLANE, "integral double")))


def _kernel(name: str, sql: str, fn, schema: str = "values array<double>", source=EMB) -> None:
    """A kernel over curves whose array result is listed by position."""

    def run(spark, d):
        c = source(spark, d)
        out = per_curve(c.df.select("id", "values"), lambda v: fn(v, c.grid), schema)
        return out.select("id", F.posexplode("values").alias("pos", "x")).select("id", "pos", r("x").alias("v"))

    named(name, sql, run)


_kernel("trapz", f"WITH {_C}, s AS (SELECT id, (v + lag(v) OVER (PARTITION BY id ORDER BY pos)) / 2 * {_H} AS a FROM c) SELECT id, 0 AS pos, {_z('sum(a)')} AS v FROM s GROUP BY id", lambda v, t: nm.trapz(v, t)[:, None])
_kernel("cumulative_trapz", f"WITH {_C}, s AS (SELECT id, pos, coalesce((v + lag(v) OVER (PARTITION BY id ORDER BY pos)) / 2 * {_H}, 0) AS a FROM c) SELECT id, pos, {_z('sum(a) OVER (PARTITION BY id ORDER BY pos)')} AS v FROM s", nm.cumulative_trapz)
_EVEN = f"{_H} / 3 * (coalesce(lag(v, 2) OVER o, 0) + 4 * lag(v) OVER o + v)"
_kernel("cumulative_simpson", f"WITH {_C}, s AS (SELECT id, pos, CASE WHEN pos = 0 THEN 0 WHEN pos % 2 = 0 THEN {_EVEN} ELSE 0 END AS a, CASE WHEN pos % 2 = 1 THEN (v + lag(v) OVER o) / 2 * {_H} ELSE 0 END AS b FROM c WINDOW o AS (PARTITION BY id ORDER BY pos)) SELECT id, pos, {_z('sum(a) OVER (PARTITION BY id ORDER BY pos) + b')} AS v FROM s", nm.cumulative_simpson)
_NEW = "n AS (SELECT k::INT AS pos, (k / 40.0)::DOUBLE AS x FROM range(41) y(k))"
_NEXT = f"k AS (SELECT id, pos, pos * {_H} AS t, v, lead(v) OVER (PARTITION BY id ORDER BY pos) AS nxt FROM c), f AS (SELECT id, n.pos, x, t, v, nxt, (x - t) / {_H} AS u FROM n JOIN k ON k.pos = least(floor(x / {_H}), {M - 2}))"
_LINEAR = f"WITH {_C}, {_NEW}, {_NEXT} SELECT id, pos, {_z('v + u * (nxt - v)')} AS v FROM f"
_kernel("linear_interp", _LINEAR, lambda v, t: nm.interp(np.arange(41) / 40, t, v))


def _resample(name: str, sql: str, grid, kind: str = "linear", outside: str = "boundary", fill: float = 0.0) -> None:
    def run(spark, d):
        out = pointwise.interpolate(EMB(spark, d), grid, kind, outside, fill)
        return out.long().select("id", "pos", r("v").alias("v"))

    named(name, sql, run)


_resample("fdata_interpolate", _LINEAR, np.arange(41) / 40)
_SLOPE = f"CASE WHEN lag(v) OVER o IS NULL THEN (lead(v) OVER o - v) / {_H} WHEN lead(v) OVER o IS NULL THEN (v - lag(v) OVER o) / {_H} ELSE (lead(v) OVER o - lag(v) OVER o) / (2 * {_H}) END"
_resample("fdata_interpolate_cubic", f"WITH {_C}, {_NEW}, s AS (SELECT id, pos, v, {_SLOPE} AS m FROM c WINDOW o AS (PARTITION BY id ORDER BY pos)), k AS (SELECT id, pos, pos * {_H} AS t, v, m, lead(v) OVER o AS v1, lead(m) OVER o AS m1 FROM s WINDOW o AS (PARTITION BY id ORDER BY pos)), f AS (SELECT id, n.pos, v, m, v1, m1, (x - t) / {_H} AS u FROM n JOIN k ON k.pos = least(floor(x / {_H}), {M - 2})) SELECT id, pos, {_z(f'v * (2 * u * u * u - 3 * u * u + 1) + m * {_H} * (u * u * u - 2 * u * u + u) + v1 * (3 * u * u - 2 * u * u * u) + m1 * {_H} * (u * u * u - u * u)')} AS v FROM f", np.arange(41) / 40, "cubic")
_resample("fdata_interpolate_with_policy", f"WITH {_C}, n AS (SELECT k::INT AS pos, (k / 20.0 - 0.2)::DOUBLE AS x FROM range(29) y(k)), {_NEXT.replace('JOIN k ON k.pos = least(floor(x', 'LEFT JOIN k ON x BETWEEN 0 AND 1 AND k.pos = least(floor(x')}, i AS (SELECT DISTINCT id FROM c) SELECT i.id, n.pos, {_z('coalesce(v + u * (nxt - v), -1)')} AS v FROM i CROSS JOIN n LEFT JOIN f ON f.id = i.id AND f.pos = n.pos", np.arange(29) / 20 - 0.2, "linear", "fill", -1.0)
_kernel("gradient_uniform", f"WITH {_C}, s AS (SELECT id, pos, v, list(v) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS y FROM c) SELECT id, pos, {_z(f'(CASE WHEN pos = 0 THEN -25 * y[1] + 48 * y[2] - 36 * y[3] + 16 * y[4] - 3 * y[5] WHEN pos = 1 THEN -3 * y[1] - 10 * y[2] + 18 * y[3] - 6 * y[4] + y[5] WHEN pos = {M - 2} THEN 3 * y[{M}] + 10 * y[{M - 1}] - 18 * y[{M - 2}] + 6 * y[{M - 3}] - y[{M - 4}] WHEN pos = {M - 1} THEN 25 * y[{M}] - 48 * y[{M - 1}] + 36 * y[{M - 2}] - 16 * y[{M - 3}] + 3 * y[{M - 4}] ELSE y[pos - 1] - 8 * y[pos] + 8 * y[pos + 2] - y[pos + 3] END) / (12 * {_H})')} AS v FROM s", nm.gradient)
_UNEVEN = _GRID**2
_kernel("gradient_nonuniform", f"WITH {_C}, k AS (SELECT id, pos, v, pow(pos * {_H}, 2) AS t FROM c), a AS (SELECT id, pos, v, t, CASE WHEN pos = 0 THEN 1 WHEN pos = {M - 1} THEN {M - 2} ELSE pos END AS mid FROM k), j AS (SELECT a.id, a.pos, a.t AS x, p.t AS t0, p.v AS y0, q.t AS t1, q.v AS y1, s.t AS t2, s.v AS y2 FROM a JOIN k p ON p.id = a.id AND p.pos = mid - 1 JOIN k q ON q.id = a.id AND q.pos = mid JOIN k s ON s.id = a.id AND s.pos = mid + 1) SELECT id, pos, {_z('y0 * (2 * x - t1 - t2) / ((t0 - t1) * (t0 - t2)) + y1 * (2 * x - t0 - t2) / ((t1 - t0) * (t1 - t2)) + y2 * (2 * x - t0 - t1) / ((t2 - t0) * (t2 - t1))')} AS v FROM j", lambda v, t: nm.gradient(v, _UNEVEN))
_kernel("gradient", f"WITH {_C}, y AS (SELECT id, max(CASE WHEN pos = 0 THEN v END) AS a, max(CASE WHEN pos = 1 THEN v END) AS b, max(CASE WHEN pos = 2 THEN v END) AS c FROM c GROUP BY id) SELECT id, k::INT AS pos, round(CASE k WHEN 0 THEN (-3 * a + 4 * b - c) / (2 * {_H}) WHEN 1 THEN (c - a) / (2 * {_H}) ELSE (a - 4 * b + 3 * c) / (2 * {_H}) END, 6) + 0.0 AS v FROM y, range(3) x(k)", lambda v, t: nm.gradient(v[:, :3], t[:3]))


@query(f"WITH {_C}, b AS (SELECT id, pos, CASE WHEN pos % 7 = 3 OR pos > 60 THEN NULL ELSE v END AS v FROM c), f AS (SELECT id, pos, v, last_value(v IGNORE NULLS) OVER p AS a, last_value(CASE WHEN v IS NULL THEN NULL ELSE pos END IGNORE NULLS) OVER p AS i, first_value(v IGNORE NULLS) OVER q AS z, first_value(CASE WHEN v IS NULL THEN NULL ELSE pos END IGNORE NULLS) OVER q AS j FROM b WINDOW p AS (PARTITION BY id ORDER BY pos ROWS UNBOUNDED PRECEDING), q AS (PARTITION BY id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) SELECT id, pos, {_z('coalesce(v, a + (z - a) * (pos - i) / (j - i), a, z)')} AS v FROM f")
def impute_missing_values(spark, d):
    c = EMB(spark, d)
    holes = F.transform("values", lambda x, k: F.when((k % 7 == 3) | (k > 60), F.lit(float("nan"))).otherwise(x))
    return pointwise.impute(c.with_df(c.df.withColumn("values", holes))).long().select("id", "pos", r("v").alias("v"))


named("gaussian_kernel", f"WITH {_C} SELECT id, pos, {_z('exp(-v * v / (2 * 0.3 * 0.3))')} AS v FROM c", lambda spark, d: per_curve(EMB(spark, d).df.select("id", "values"), lambda v: nm.gaussian_kernel(v, 0.3), "values array<double>").select("id", F.posexplode("values").alias("pos", "x")).select("id", "pos", r("x").alias("v")))
named("quantile_sorted", f"WITH {_C} SELECT id, {_z('quantile_cont(v, 0.3)')} AS q FROM c GROUP BY id", lambda spark, d: rounded(per_curve(EMB(spark, d).df.select("id", "values"), lambda v: np.quantile(v, 0.3, axis=1), "q double")))
named("sort_nan_safe", f"WITH {_C}, s AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY v) - 1 AS pos, v FROM c) SELECT id, pos::INT AS pos, {_z('v')} AS v FROM s", lambda spark, d: EMB(spark, d).df.select("id", F.posexplode(F.array_sort("values")).alias("pos", "x")).select("id", "pos", r("x").alias("v")))
named("extract_curves", f"WITH {_C} SELECT id, pos, {_z('v')} AS v FROM c", lambda spark, d: EMB(spark, d).long().select("id", "pos", r("v").alias("v")))
named("l2_distance", f"{_D2} SELECT i, j, {_z('d')} AS d FROM d WHERE i < 10", lambda spark, d: rounded(metrics.cross_distances(EMB(spark, d).with_df(EMB(spark, d).df.where("id < 10")), EMB(spark, d)).where("i < j")))

# ---- criteria of a straight line fitted to each curve ----

_FIT = f"WITH {_C}, f AS (SELECT id, count(*) AS n, regr_syy(v, pos) AS tss, regr_syy(v, pos) - regr_sxy(v, pos) * regr_sxy(v, pos) / regr_sxx(v, pos) AS rss FROM c GROUP BY id) SELECT id, "


def _criterion(name: str, sql: str, fn) -> None:
    def run(spark, d):
        def kernel(v):
            x = np.arange(M, dtype=float)
            b = np.polynomial.polynomial.polyfit(x, v.T, 1)
            fit = (b[0][:, None] + b[1][:, None] * x) if v.ndim == 2 else None
            return np.array([fn(y, f) for y, f in zip(v, fit, strict=True)])

        return rounded(per_curve(EMB(spark, d).df.select("id", "values"), kernel, "value double"))

    named(name, f"{_FIT}{_z(sql)} AS value FROM f", run)


_criterion("r_squared", "1 - rss / tss", nm.r_squared)
_criterion("r_squared_adj", "1 - rss / tss * (n - 1) / (n - 2)", lambda y, f: nm.r_squared_adj(nm.r_squared(y, f), len(y), 1))
_criterion("aic", "n * ln(rss / n) + 4", lambda y, f: nm.aic(((y - f) ** 2).sum(), len(y), 2))
_criterion("bic", "n * ln(rss / n) + 2 * ln(n)", lambda y, f: nm.bic(((y - f) ** 2).sum(), len(y), 2))

# ---- scalar metrics: order totals against their customer's mean ----

_OWN = "o AS (SELECT o_totalprice::DOUBLE / 1000 AS y, avg(o_totalprice::DOUBLE / 1000) OVER (PARTITION BY o_custkey) AS fit FROM orders)"


def _orders(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_custkey", (F.col("o_totalprice").cast("double") / 1000).alias("y"))
    return o.select("y", F.avg("y").over(Window.partitionBy("o_custkey")).alias("fit"))


_METRICS = {"rmse": "sqrt(avg((y - fit) * (y - fit)))", "mae": "avg(abs(y - fit))", "r_squared": "1 - sum((y - fit) * (y - fit)) / (var_pop(y) * count(y))"}
for _name, _expr in _METRICS.items():
    named(f"metric_{_name}", f"WITH {_OWN} SELECT {_z(_expr)} AS {_name} FROM o", lambda spark, d, n=_name: rounded(pointwise.regression_metrics(_orders(spark, d)).select(n)))
named("regression_metrics", f"WITH {_OWN} SELECT " + ", ".join(f"{_z(e)} AS {n}" for n, e in _METRICS.items()) + " FROM o", lambda spark, d: rounded(pointwise.regression_metrics(_orders(spark, d))))
_HITS = "h AS (SELECT avg(CASE WHEN (o_totalprice > 150000) = (o_orderpriority < '3') THEN 1.0::DOUBLE ELSE 0 END) AS accuracy, sum((o_totalprice > 150000 AND o_orderpriority < '3')::INT)::DOUBLE AS tp, sum((o_orderpriority < '3')::INT) AS p, sum((o_totalprice > 150000)::INT) AS t FROM orders)"


def _labels_of(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").select((F.col("o_totalprice") > 150000).cast("int").alias("y"), (F.col("o_orderpriority") < "3").cast("int").alias("fit"))


for _name, _expr in {"accuracy": "accuracy", "precision": "tp / p", "recall": "tp / t", "f1": "2 * tp / (p + t)"}.items():
    named(f"metric_{_name}", f"WITH {_HITS} SELECT {_z(_expr)} AS {_name} FROM h", lambda spark, d, n=_name: rounded(pointwise.classification_metrics(_labels_of(spark, d)).select(n)))

# ---- scores of forecasts: every curve against the mean curve, moved up to be positive ----

_MOVED = f"WITH {_C}, {_WEIGHTS}, p AS (SELECT id, pos, v + 2 AS v FROM c), m AS (SELECT pos, avg(v) AS f FROM p GROUP BY pos)"


def _forecast(spark, d, name):
    c = EMB(spark, d)
    up = c.with_df(c.df.select("id", F.transform("values", lambda x: x + 2).alias("values")))
    mean = [float(x["mean"]) for x in pointwise.mean(up).orderBy("pos").collect()]
    return rounded(pointwise.scores(up, c.with_df(up.df.select("id", F.lit(mean).alias("values")))).select(name))


for _name, _expr in {"mape": "w * abs(v - f) / greatest(abs(v), 1e-10)", "msle": "w * pow(ln(1 + v) - ln(1 + f), 2)"}.items():
    named(f"functional_{_name}", f"{_MOVED}, s AS (SELECT id, sum({_expr}) AS s FROM p JOIN m USING (pos) JOIN w USING (pos) GROUP BY id) SELECT {_z('avg(s)')} AS {_name} FROM s", lambda spark, d, n=_name: _forecast(spark, d, n))

# ---- pointwise operators on curves and surfaces ----

named("normalize_with_argvals", f"WITH {_C}, {_WEIGHTS}, s AS (SELECT id, sqrt(sum(w * v * v)) AS s FROM c JOIN w USING (pos) GROUP BY id) SELECT id, pos, {_z('v / s')} AS v FROM c JOIN s USING (id)", lambda spark, d: rounded(pointwise.normalize(EMB(spark, d), "curve_lp").long()))
named("depth_based_median", f"WITH {_C}, {_R}, f AS (SELECT id, round(avg(least(le / n, 1 - le / n)), 12) AS d FROM r GROUP BY id) SELECT id FROM f ORDER BY d DESC, id DESC LIMIT 1", lambda spark, d: pointwise.deepest(depth.fraiman_muniz(EMB(spark, d)).select("id", F.round("depth", 12).alias("depth"))))
named("functional_depth", f"WITH {_C}, {_R} SELECT id, round(avg(1 - (lt * (lt - 1) / 2 + (n - le) * (n - le - 1) / 2) / (n * (n - 1) / 2)), 12) + 0.0 AS depth FROM r GROUP BY id", lambda spark, d: rounded(depth.depth(EMB(spark, d), "mbd"), 12))


@query(f"WITH {_C}, d AS (SELECT id, pos, CASE WHEN lag(v) OVER o IS NULL THEN (lead(v) OVER o - v) / {_H} WHEN lead(v) OVER o IS NULL THEN (v - lag(v) OVER o) / {_H} ELSE (lead(v) OVER o - lag(v) OVER o) / (2 * {_H}) END AS v FROM c WINDOW o AS (PARTITION BY id ORDER BY pos)) SELECT c.pos AS pos_s, d.pos AS pos_t, {_z('covar_samp(c.v, d.v)')} AS cov FROM c JOIN d USING (id) GROUP BY ALL")
def cross_covariance(spark, d):
    c = EMB(spark, d)
    return cells(spark, pointwise.cross_covariance(c, pointwise.derivative(c)), ("pos_s", "pos_t")).withColumnRenamed("value", "cov")


_SURFACE = f"WITH {_C}, q AS (SELECT id, pos % 8 AS s, pos // 8 AS t, v FROM c), x AS (SELECT id, s, t, CASE WHEN s = 0 THEN (lead(v) OVER o - v) * 7 WHEN s = 7 THEN (v - lag(v) OVER o) * 7 ELSE (lead(v) OVER o - lag(v) OVER o) * 3.5 END AS v FROM q WINDOW o AS (PARTITION BY id, t ORDER BY s))"
named("deriv_2d", f"{_SURFACE} SELECT id, (s + 8 * t)::INT AS pos, {_z('v')} AS v FROM x", lambda spark, d: pointwise.derivative_2d(EMB(spark, d), nm.unit_grid(8), nm.unit_grid(8)).select("id", F.posexplode("values").alias("pos", "x")).select("id", "pos", r("x").alias("v")))
named("mean_2d", f"WITH {_C} SELECT (pos % 8)::INT AS s, (pos // 8)::INT AS t, {_z('avg(v)')} AS mean FROM c GROUP BY pos", lambda spark, d: pointwise.mean(EMB(spark, d)).select((F.col("pos") % 8).alias("s"), F.floor(F.col("pos") / 8).cast("int").alias("t"), r("mean").alias("mean")))
named("andrews_transform", None, lambda spark, d: rounded(reduce.andrews(EMB(spark, d).df.select("id", F.col("values").alias("features")), np.linspace(-np.pi, np.pi, 21))))
named("andrews_transform_rows", f"WITH {_C}, a AS (SELECT k::INT AS pos, (-pi() + k * pi() / 10) AS t FROM range(21) y(k)) SELECT id, a.pos, {_z('sum(CASE WHEN c.pos = 0 THEN v / sqrt(2) WHEN c.pos % 2 = 1 THEN v * sin(((c.pos + 1) // 2) * t) ELSE v * cos((c.pos // 2) * t) END)')} AS v FROM c, a GROUP BY id, a.pos", lambda spark, d: reduce.andrews(EMB(spark, d).df.select("id", F.col("values").alias("features")), np.linspace(-np.pi, np.pi, 21)).select("id", F.posexplode("curve").alias("pos", "x")).select("id", "pos", r("x").alias("v")))
