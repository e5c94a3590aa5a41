"""Regression with curves as predictors or responses, over small normal equations."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvelake.functions import numeric as nm
from curvelake.functions import special
from curvelake.operators.apply import per_curve, sums
from curvelake.operators.reduce import Fpca, fpca, pls
from curvelake.sources.curves import Curves, unit_grid


def _design(s, z):
    one = np.ones((len(s), 1))
    return np.hstack([one, s] + ([z] if z is not None and z.size else []))


def _table(c: Curves, model, covariates: list[str]) -> DataFrame:
    """The curve table with scores, and covariates packed as an array z."""
    out = per_curve(c.df, model.project, "scores array<double>")
    return out.withColumn("z", F.array(*[F.col(x).cast("double") for x in covariates]) if covariates else F.array().cast("array<double>"))


def _columns(covariates):
    return ["scores", "z"] if covariates else ["scores"]


def _stack(args, covariates):
    return _design(args[0], args[1] if covariates else None)


@dataclass
class Linear:
    """y on scores (and covariates): coefficients, their errors, beta(t), fit criteria."""

    basis: Fpca
    coef: np.ndarray
    se: np.ndarray
    beta: np.ndarray
    beta_se: np.ndarray
    r2: float
    r2_adj: float
    sigma2: float
    gcv: float
    aic: float
    bic: float
    covariates: list

    def predict(self, c: Curves) -> DataFrame:
        t = _table(c, self.basis, self.covariates)
        k = self.basis.loadings.shape[1]
        b = [float(x) for x in self.coef]
        fit = F.lit(b[0]) + F.aggregate(F.zip_with("scores", F.lit(b[1 : k + 1]), lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
        if self.covariates:
            fit = fit + F.aggregate(F.zip_with("z", F.lit(b[k + 1 :]), lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
        return t.withColumn("fit", fit).drop("scores", "z")


def _unit(c: Curves) -> Curves:
    """The same curves on a unit grid, as score-based models take them."""
    return Curves(c.df, unit_grid(len(c.grid)))


def linear(c: Curves, y: str, k: int = 3, covariates: list[str] | None = None, basis=None) -> Linear:
    """Least squares on principal scores (of the unit grid)."""
    covariates = covariates or []
    c = _unit(c)
    basis = basis or fpca(c, k)
    t = _table(c, basis, covariates)
    cols = [*_columns(covariates), y]

    def parts(*a):
        x, v = _stack(a, covariates), a[-1]
        return [x.T @ x, x.T @ v, np.array([len(v), v.sum(), (v**2).sum()])]

    xx, xy, (n, sy, syy) = sums(t, parts, cols)
    coef = np.linalg.solve(xx, xy)
    rss = float(sums(t, lambda *a: [np.array([((a[-1] - _stack(a, covariates) @ coef) ** 2).sum()])], cols)[0][0])
    p = len(coef)
    s2 = rss / max(n - p, 1)
    cov = s2 * np.linalg.inv(xx)
    k = basis.loadings.shape[1]
    r2 = 1 - rss / (syy - sy * sy / n)
    band = np.sqrt(np.maximum(np.einsum("tk,kl,tl->t", basis.loadings, cov[1 : k + 1, 1 : k + 1], basis.loadings), 0))
    return Linear(basis, coef, np.sqrt(np.diag(cov)), basis.loadings @ coef[1 : k + 1], band, r2, nm.r_squared_adj(r2, int(n), p - 1), s2, rss / n / (1 - p / n) ** 2, nm.aic(rss, int(n), p), nm.bic(rss, int(n), p), covariates)


def linear_pls(c: Curves, y: str, k: int = 3, covariates: list[str] | None = None) -> Linear:
    """Least squares on PLS scores."""
    model = pls(c, y, k)
    shim = Fpca(model.mean, model.rotation / c.weights[:, None], np.ones(model.rotation.shape[1]), c.weights, 0)
    return linear(c, y, k, covariates, shim)


def choose_components(c: Curves, y: str, most: int = 6, criterion: str = "gcv") -> tuple[int, list[float]]:
    found = [getattr(linear(c, y, k), criterion) for k in range(1, most + 1)]
    return int(np.argmin(found)) + 1, found


def cross_validate(c: Curves, y: str, ks=range(1, 6), n_folds: int = 5, seed: int = 42) -> dict[int, float]:
    """Mean squared error by number of components, over folds of a seeded hash."""
    from curvelake.operators.pointwise import folds

    df, out = folds(c.df, n_folds, seed), {}
    for k in ks:
        total = n = 0.0
        for f in range(n_folds):
            model = linear(c.with_df(df.where(F.col("fold") != f)), y, k)
            got = model.predict(c.with_df(df.where(F.col("fold") == f))).agg(F.sum(F.pow(F.col(y) - F.col("fit"), F.lit(2.0))).alias("s"), F.count("*").alias("n")).first()
            total, n = total + got["s"], n + got["n"]
        out[k] = total / n
    return out


FAMILIES = {
    # family: (inverse link, derivative of the mean in the predictor, variance)
    "gaussian": (lambda e: e, lambda m: np.ones_like(m), lambda m: np.ones_like(m)),
    "binomial": (lambda e: 1 / (1 + np.exp(-np.clip(e, -500, 500))), lambda m: m * (1 - m), lambda m: m * (1 - m)),
    "poisson": (lambda e: np.exp(np.clip(e, -30, 30)), lambda m: m, lambda m: m),
    "gamma": (lambda e: np.exp(np.clip(e, -30, 30)), lambda m: m, lambda m: m * m),
}


@dataclass
class Glm:
    basis: Fpca
    coef: np.ndarray
    se: np.ndarray
    beta: np.ndarray
    family: str
    deviance: float
    iterations: int
    covariates: list

    def predict(self, c: Curves) -> DataFrame:
        t = _table(c, self.basis, self.covariates)
        inverse, coef = FAMILIES[self.family][0], self.coef
        cols = _columns(self.covariates)
        import pyarrow as pa

        from curvelake.operators.apply import matrix

        keep = [x for x in t.columns if x not in ("scores", "z")]
        from pyspark.sql import types as T

        schema = T.StructType([*(t.schema[x] for x in keep), T.StructField("fit", T.DoubleType())])

        def run(batches):
            for b in batches:
                if b.num_rows:
                    x = _stack([matrix(b.column(n)) for n in cols], self.covariates)
                    yield pa.RecordBatch.from_arrays([*(b.column(n) for n in keep), pa.array(inverse(x @ coef))], names=schema.names)

        return t.mapInArrow(run, schema)


def glm(c: Curves, y: str, family: str = "binomial", k: int = 3, covariates: list[str] | None = None, max_iter: int = 25, tol: float = 1e-6) -> Glm:
    """Iteratively reweighted least squares on scores; each step is one pass of sums."""
    if family not in FAMILIES:
        raise ValueError(f"no family {family}")
    covariates = covariates or []
    c = _unit(c)
    basis = fpca(c, k)
    t = _table(c, basis, covariates)
    inverse, slope, variance = FAMILIES[family]
    cols = [*_columns(covariates), y]
    coef = np.zeros(1 + basis.loadings.shape[1] + len(covariates))
    for it in range(1, max_iter + 1):
        def parts(*a, coef=coef):
            x, v = _stack(a, covariates), a[-1]
            eta = x @ coef
            mu = inverse(eta)
            d = np.maximum(slope(mu), 1e-10)
            w = d * d / np.maximum(variance(mu), 1e-10)
            return [x.T @ (x * w[:, None]), x.T @ (w * (eta + (v - mu) / d))]

        xx, xz = sums(t, parts, cols)
        new = np.linalg.solve(xx + 1e-10 * np.eye(len(xx)), xz)
        moved = float(np.abs(new - coef).max())
        coef = new
        if moved < tol:
            break

    def dev(*a):
        x, v = _stack(a, covariates), a[-1]
        mu = np.maximum(inverse(x @ coef), 1e-12)
        if family == "binomial":
            mu = np.clip(mu, 1e-12, 1 - 1e-12)
            d = -2 * (v * np.log(mu) + (1 - v) * np.log(1 - mu))
        elif family == "poisson":
            d = 2 * (np.where(v > 0, v * np.log(np.maximum(v, 1e-12) / mu), 0) - (v - mu))
        elif family == "gamma":
            d = 2 * (-np.log(np.maximum(v, 1e-12) / mu) + (v - mu) / mu)
        else:
            d = (v - x @ coef) ** 2
        return [np.array([d.sum()])]

    k = basis.loadings.shape[1]
    return Glm(basis, coef, np.sqrt(np.diag(np.linalg.inv(xx))), basis.loadings @ coef[1 : k + 1], family, float(sums(t, dev, cols)[0][0]), it, covariates)


def robust(c: Curves, y: str, k: int = 3, how: str = "huber", tuning: float = 1.345, max_iter: int = 100, tol: float = 1e-6) -> Linear:
    """Least absolute (l1) or Huber regression on scores by reweighting."""
    model = linear(c, y, k)
    c = _unit(c)
    t = _table(c, model.basis, [])
    coef = model.coef
    for _ in range(max_iter):
        def parts(*a, coef=coef):
            x, v = _design(a[0], None), a[-1]
            r = np.abs(v - x @ coef)
            w = 1 / np.maximum(r, 1e-6) if how == "l1" else np.minimum(1, tuning / np.maximum(r, 1e-12))
            return [x.T @ (x * w[:, None]), x.T @ (w * v)]

        xx, xy = sums(t, parts, ["scores", y])
        new = np.linalg.solve(xx, xy)
        moved = float(np.abs(new - coef).max())
        coef = new
        if moved < tol:
            break
    model.coef, model.beta = coef, model.basis.loadings @ coef[1:]
    return model


def ridge(c: Curves, y: str, lam: float, intercept: bool = True) -> tuple[float, np.ndarray]:
    """(intercept, coefficients) of y on grid values with an L2 penalty."""
    n, sx, sy = sums(c.df, lambda v, t: [np.array([len(v)]), v.sum(0), np.array([t.sum()])], ["values", y])
    mx, my = (sx / n[0], sy[0] / n[0]) if intercept else (np.zeros_like(sx), 0.0)
    xx, xy = sums(c.df, lambda v, t: [(v - mx).T @ (v - mx), (v - mx).T @ (t - my)], ["values", y])
    b = np.linalg.solve(xx + lam * np.eye(len(xx)), xy)
    return float(my - mx @ b), b


def nonparametric(distances: DataFrame, y: DataFrame, h: float) -> DataFrame:
    """id, fit: leave-one-out kernel means of y (id, y) over mirrored distances (i, j, d);
    the own value where no kernel mass falls."""
    k = F.exp(-F.col("d") * F.col("d") / (2 * h * h))
    rows = distances.join(y.select(F.col("id").alias("j"), F.col("y").alias("yj")), "j").groupBy(F.col("i").alias("id")).agg(F.sum(k).alias("w"), F.sum(k * F.col("yj")).alias("wy"))
    return y.join(rows, "id", "left").select("id", "y", F.when(F.col("w") > 1e-15, F.col("wy") / F.col("w")).otherwise(F.col("y")).alias("fit"))


def nonparametric_of(c: Curves, y: DataFrame, h: float) -> DataFrame:
    """``nonparametric`` with the L2 distances of curves: id, y, fit from sums over blocks, without
    rows of pairs."""
    from curvelake.operators.apply import against
    from curvelake.operators.metrics import squares

    root = np.sqrt(c.weights)

    def kernel(a, b):
        k = np.exp(squares(a[:, :-2] * root, b[:, :-2] * root) / (-2 * h * h))
        k[a[:, -1, None] == b[:, -1]] = 0  # the curve itself
        return k.sum(1), k @ b[:, -2]

    rows = c.df.select("id", "values").join(y, "id")
    packed = rows.select("id", F.concat("values", F.array(F.col("y").cast("double"), F.col("id").cast("double"))).alias("values"))
    got = against(packed, packed, kernel, "w double, wy double")
    return y.join(got, "id", "left").select("id", "y", F.when(F.col("w") > 1e-15, F.col("wy") / F.col("w")).otherwise(F.col("y")).alias("fit"))


def predict_nonparametric(cross: DataFrame, y: DataFrame, h: float) -> DataFrame:
    """id, fit for new curves i against training curves j; 0 where no kernel mass falls."""
    k = F.exp(-F.col("d") * F.col("d") / (2 * h * h))
    rows = cross.join(y.select(F.col("id").alias("j"), F.col("y").alias("yj")), "j").groupBy(F.col("i").alias("id")).agg(F.sum(k).alias("w"), F.sum(k * F.col("yj")).alias("wy"))
    return rows.select("id", F.when(F.col("w") > 1e-15, F.col("wy") / F.col("w")).otherwise(0.0).alias("fit"))


def function_on_scalar(c: Curves, covariates: list[str], lam: float = 0.0):
    """beta (columns, points): ridge-type solve with a second-difference penalty over the design
    columns; a negative lam picks one by GCV. Also (fitted variance by point, r2, lam, gcv)."""
    df = c.df.withColumn("z", F.array(*[F.col(x).cast("double") for x in covariates]))
    xx, xy, yy, s, n = sums(df, lambda v, z: [_design(z, None).T @ _design(z, None), _design(z, None).T @ v, (v**2).sum(0), v.sum(0), np.array([len(v)])], ["values", "z"])
    p = len(xx)
    d = nm.difference_matrix(p, 2) if p >= 3 else np.zeros((1, p))
    pen = d.T @ d

    def solve(q):
        inv = np.linalg.inv(xx + q * pen + 1e-12 * np.eye(p))
        b = inv @ xy
        rss = yy - 2 * (b * xy).sum(0) + (b * (xx @ b)).sum(0)
        edf = np.trace(inv @ xx)
        return b, rss, float((rss.mean() / n[0]) / (1 - edf / n[0]) ** 2)

    if lam < 0:
        lam = min((10.0**e for e in range(-6, 7)), key=lambda q: solve(q)[2])
    b, rss, gcv = solve(lam)
    total = yy - s * s / n[0]
    return b, rss / max(n[0] - p, 1), 1 - rss / np.maximum(total, 1e-15), lam, gcv


def predict_function_on_scalar(df: DataFrame, covariates: list[str], beta: np.ndarray) -> DataFrame:
    z = df.withColumn("z", F.array(*[F.col(x).cast("double") for x in covariates]))
    return per_curve(z, lambda x: _design(x, None) @ beta, "values array<double>", values="z")


def fanova(c: Curves, group: str, n_perm: int = 100, seed: int = 1):
    """(F by point, integrated F, p): pointwise F of group means, labels permuted within batches
    of replicates; (1 + #{>=}) / (1 + B)."""
    groups = sorted(r[0] for r in c.df.select(group).distinct().collect())
    at = {g: i for i, g in enumerate(groups)}
    w, b = c.weights, n_perm
    frame = c.df.withColumn("_g", F.coalesce(*[F.when(F.col(group) == g, F.lit(float(i))) for g, i in at.items()]))
    frame = frame.withColumn("_id", F.col("id").cast("double"))
    sizes = np.array([r["count"] for r in sorted(frame.groupBy("_g").count().collect(), key=lambda r: r["_g"])], float)
    n, g = int(sizes.sum()), len(groups)
    ids = [r["id"] for r in frame.select("id").orderBy("id").collect()] if n_perm else []  # labels only: one number a curve
    labels = np.array([r["_g"] for r in frame.select("id", "_g").orderBy("id").collect()]) if n_perm else None
    perms = [labels] + [np.random.default_rng(seed + k).permutation(labels) for k in range(b)] if n_perm else []
    place = {i: k for k, i in enumerate(ids)}

    def parts(v, own, gid):
        use = [own] if not n_perm else [p[[place[int(i)] for i in gid]] for p in perms]
        return [np.array([[v[u == k].sum(0) for k in range(g)] for u in use]), v.sum(0), (v**2).sum(0)]

    group_sums, s, ss = sums(frame, parts, ["values", "_g", "_id"])
    between = (group_sums**2 / sizes[None, :, None]).sum(1) - s**2 / n
    within = ss - (group_sums**2 / sizes[None, :, None]).sum(1)
    f = (between / (g - 1)) / np.maximum(within / (n - g), 1e-15)
    total = f @ w
    return f[0], float(total[0]), (1 + int((total[1:] >= total[0]).sum())) / (1 + b) if n_perm else math.nan


def function_on_function(x: Curves, y: Curves, kx: int = 3, ky: int = 3, lam: float = 1e-8):
    """(beta(s, t), coefficients, bases): regression of response scores on predictor scores."""
    bx, by = fpca(x, kx), fpca(y, ky)
    both = x.df.select("id", F.col("values").alias("x")).join(y.df.select("id", F.col("values").alias("y")), "id")
    a, b = sums(both, lambda u, v: [bx.project(u).T @ bx.project(u), bx.project(u).T @ by.project(v)], ["x", "y"])
    coef = np.linalg.solve(a + lam * np.eye(len(a)), b)
    return bx.loadings @ coef @ by.loadings.T, coef, (bx, by)


def predict_function_on_function(x: Curves, fitted) -> DataFrame:
    _, coef, (bx, by) = fitted
    return per_curve(x.df, lambda v: by.rebuild(bx.project(v) @ coef), "values array<double>")


def concurrent(y: Curves, xs: list[Curves], h: float | None = None) -> np.ndarray:
    """(1 + predictors, points): least squares at every point with a tiny ridge, each
    coefficient curve smoothed by local lines if h is given."""
    df = y.df.select("id", F.col("values").alias("y"))
    for k, x in enumerate(xs):
        df = df.join(x.df.select("id", F.col("values").alias(f"x{k}")), "id")

    def parts(v, *x):
        d = np.stack([np.ones_like(v), *x], 2)
        return [np.einsum("nmp,nmq->mpq", d, d), np.einsum("nmp,nm->mp", d, v)]

    xx, xy = sums(df, parts, ["y", *[f"x{k}" for k in range(len(xs))]])
    b = np.array([np.linalg.solve(a + 1e-10 * np.eye(len(a)), c) for a, c in zip(xx, xy, strict=True)]).T
    if h:
        from curvelake.operators.smooth import local_polynomial

        b = np.array([local_polynomial(y.grid, row, y.grid, h, 1) for row in b])
    return b


# ---- diagnostics of a linear model ----


def f_test(r2: float, n: int, p: int) -> tuple[float, float]:
    f = (r2 / p) / ((1 - r2) / (n - p - 1))
    return f, 1 - special.f_cdf(f, p, n - p - 1)


def influence(c: Curves, y: str, model: Linear) -> DataFrame:
    """id, residual, leverage, cooks, studentized, dffits of every curve."""
    t = _table(_unit(c), model.basis, model.covariates)
    cols = _columns(model.covariates)
    xx = sums(t, lambda *a: [_stack(a, model.covariates).T @ _stack(a, model.covariates), np.array([len(a[0])])], cols)
    inv, n, p, s2, coef = np.linalg.inv(xx[0]), int(xx[1][0]), len(model.coef), model.sigma2, model.coef
    packed = t.select("id", F.concat("scores", "z", F.array(F.col(y).cast("double"))).alias("row"))

    def kernel(row):
        x = _design(row[:, :-1], None)
        r = row[:, -1] - x @ coef
        lev = np.einsum("np,pq,nq->n", x, inv, x)
        cook = r**2 * lev / (p * s2 * (1 - lev) ** 2)
        s_i = (s2 * (n - p) - r**2 / (1 - lev)) / (n - p - 1)
        stud = r / np.sqrt(np.maximum(s_i * (1 - lev), 1e-300))
        return r, lev, cook, stud, stud * np.sqrt(lev / (1 - lev))

    return per_curve(packed, kernel, "residual double, leverage double, cooks double, studentized double, dffits double", values="row")


def press(diagnostics: DataFrame) -> DataFrame:
    e = F.col("residual") / (1 - F.col("leverage"))
    return diagnostics.agg(F.sum(e * e).alias("press"), F.avg(e * e).alias("loo_mse"))
