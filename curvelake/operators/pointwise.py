"""Pointwise statistics, scalings, norms and derivatives of curves.

Statistics over curves are group-bys over grid positions with partial aggregation;
per-curve results are array expressions or Arrow kernels; nothing is gathered.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvelake.functions import numeric as nm
from curvelake.operators.apply import moments, numbered, per_curve, sums
from curvelake.sources.curves import Curves


def array(values) -> Column:
    return F.lit([float(v) for v in values])


def summary(c: Curves) -> DataFrame:
    """pos, mean, variance and std (n - 1) of every grid position."""
    return c.long().groupBy("pos").agg(F.avg("v").alias("mean"), F.var_samp("v").alias("variance"), F.stddev_samp("v").alias("std"))


def mean(c: Curves) -> DataFrame:
    return summary(c).select("pos", "mean")


def center(c: Curves) -> Curves:
    mu = sums(c.df, lambda v: [np.array([len(v)]), v.sum(0)], ["values"])
    m = mu[1] / mu[0][0]
    return c.with_df(c.df.withColumn("values", F.zip_with("values", array(m), lambda a, b: a - b)))


def covariance(c: Curves) -> np.ndarray:
    """Sample covariance of the grid positions (n - 1): partial sums of outer products."""
    n, _, scatter = moments(c.df)
    if n < 2:
        raise ValueError("a covariance needs two curves")
    return scatter / (n - 1)


def covariance_rows(c: Curves) -> DataFrame:
    cov = covariance(c)
    m = len(cov)
    return c.df.sparkSession.createDataFrame([(i, j, float(cov[i, j])) for i in range(m) for j in range(m)], "pos_s int, pos_t int, cov double")


def cross_covariance(a: Curves, b: Curves) -> np.ndarray:
    """m1 x m2 covariance of samples paired by id."""
    both = a.df.select("id", F.col("values").alias("x")).join(b.df.select("id", F.col("values").alias("y")), "id")
    n, sx, sy = sums(both, lambda x, y: [np.array([len(x)]), x.sum(0), y.sum(0)], ["x", "y"])
    mx, my = sx / n[0], sy / n[0]
    return sums(both, lambda x, y: [(x - mx).T @ (y - my)], ["x", "y"])[0] / (n[0] - 1)


def dot(values: Column, weights) -> Column:
    """Sum of values times weights, an expression."""
    return F.aggregate(F.zip_with(values, array(weights), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)


def integrate(c: Curves) -> DataFrame:
    return c.df.select("id", dot(F.col("values"), c.weights).alias("integral"))


def norm_lp(c: Curves, p: float = 2.0) -> DataFrame:
    """id, norm: (sum of w |v|^p)^(1/p) with Simpson weights; p = inf is the largest modulus."""
    v = F.col("values")
    if p == float("inf"):
        return c.df.select("id", F.array_max(F.transform(v, F.abs)).alias("norm"))
    if p <= 0:
        raise ValueError("p must be positive")
    inner = F.transform(v, (lambda x: F.abs(x)) if p == 1 else (lambda x: x * x) if p == 2 else (lambda x: F.pow(F.abs(x), F.lit(p))))
    total = dot(inner, c.weights)
    return c.df.select("id", (total if p == 1 else F.sqrt(total) if p == 2 else F.pow(total, F.lit(1 / p))).alias("norm"))


SCALINGS = ("center", "autoscale", "pareto", "range", "curve_center", "curve_standardize", "curve_range", "curve_lp")


def normalize(c: Curves, how: str, p: float = 2.0) -> Curves:
    """Scalings by grid position (center, autoscale, pareto, range) or by curve."""
    if how not in SCALINGS:
        raise ValueError(f"no scaling {how}")
    if not how.startswith("curve"):
        n, mu, scatter = moments(c.df)
        sd = np.sqrt(np.diag(scatter) / max(n - 1, 1))
        if how == "range":
            rows = c.long().groupBy("pos").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("pos").collect()
            shift, scale = np.array([r["lo"] for r in rows]), np.array([r["hi"] - r["lo"] for r in rows])
        else:
            shift, scale = mu, {"center": np.ones_like(sd), "autoscale": sd, "pareto": np.sqrt(sd)}[how]
        scale = np.where(scale > 1e-15, scale, 1.0)
        return c.with_df(c.df.withColumn("values", F.zip_with(F.zip_with("values", array(shift), lambda a, b: a - b), array(scale), lambda a, b: a / b)))
    w = c.weights

    def kernel(v):
        if how == "curve_lp":
            norm = (np.abs(v) ** p @ w) ** (1 / p)
            return v / np.where(norm > 1e-15, norm, 1.0)[:, None]
        if how == "curve_range":
            lo, span = v.min(1, keepdims=True), np.ptp(v, 1)[:, None]
            return (v - lo) / np.where(span > 1e-15, span, 1.0)
        v = v - v.mean(1, keepdims=True)
        if how == "curve_standardize":
            sd = v.std(1, ddof=1, keepdims=True)
            v = v / np.where(sd > 1e-15, sd, 1.0)
        return v

    return c.with_df(per_curve(c.df, kernel, "values array<double>"))


def derivative(c: Curves, order: int = 1) -> Curves:
    """Repeated central differences with one-sided ends."""
    return c.with_df(per_curve(c.df, lambda v: nm.derivative(v, c.grid, order), "values array<double>"))


def derivative_2d(c: Curves, s, t, direction: str = "s") -> DataFrame:
    """Partial derivatives of flattened surfaces, first axis fastest: s, t or st."""
    s, t = nm.as_grid(s), nm.as_grid(t)

    def kernel(v):
        x = v.reshape(len(v), len(t), len(s))
        if "s" in direction:
            x = nm.central_differences(x, s)
        if "t" in direction:
            x = np.swapaxes(nm.central_differences(np.swapaxes(x, 1, 2), t), 1, 2)
        return x.reshape(len(v), -1)

    return per_curve(c.df, kernel, "values array<double>")


def interpolate(c: Curves, grid, kind: str = "linear", outside: str = "boundary", fill: float = float("nan")) -> Curves:
    return Curves(per_curve(c.df, lambda v: nm.resample(grid, c.grid, v, kind, outside, fill), "values array<double>"), grid)


def impute(c: Curves, how: str = "linear", value: float = 0.0) -> Curves:
    return c.with_df(per_curve(c.df, lambda v: nm.impute(v, c.grid, how, value), "values array<double>"))


def geometric_median(c: Curves, weights=None, max_iter: int = 100, tol: float = 1e-6) -> np.ndarray:
    """Weiszfeld's L1 median: each step is one weighted sum over the table."""
    w = c.weights if weights is None else np.asarray(weights, float)
    n, total = sums(c.df, lambda v: [np.array([len(v)]), v.sum(0)], ["values"])
    mid = total / n[0]
    for _ in range(max_iter):
        def step(v, mid=mid):
            d = 1 / np.maximum(np.sqrt((v - mid) ** 2 @ w), 1e-10)
            return [np.array([d.sum()]), d @ v]

        mass, top = sums(c.df, step, ["values"])
        new = top / mass[0]
        moved = float(np.sqrt((new - mid) ** 2 @ w))
        mid = new
        if moved < tol:
            break
    return mid


def trimmed_mean(c: Curves, depths: DataFrame, share: float) -> DataFrame:
    """pos, mean of all but the floor(share * n) shallowest curves; ties go by id."""
    n = c.df.count()
    drop = numbered(depths, "depth", "id").where(F.col("rank") <= int(share * n)).select("id")
    return mean(c.with_df(c.df.join(drop, "id", "left_anti")))


def deepest(depths: DataFrame) -> DataFrame:
    """The id of the deepest curve; the last id of equals."""
    return depths.agg(F.max_by("id", F.struct("depth", "id")).alias("id"))


def inner_products(c: Curves, places: int | None = None) -> DataFrame:
    """(i, j, product), i <= j, of all pairs, with Simpson weights."""
    from curvelake.operators.apply import self_pairs

    w = c.weights
    own = c.df.select(F.col("id").alias("i"), F.col("id").alias("j"), dot(F.transform("values", lambda x: x * x), w).alias("product"))
    own = own if places is None else own.withColumn("product", F.round("product", places) + F.lit(0.0))
    return self_pairs(c.df, lambda a, b: (a * w) @ b.T, "product", places=places).union(own)


# ---- scores of forecasts: y and f paired by id ----


def scores(y: Curves, f: Curves) -> DataFrame:
    """mae, mse, mape, msle, explained_variance: integrals per curve, averaged."""
    w = y.weights
    both = y.df.select("id", F.col("values").alias("y")).join(f.df.select("id", F.col("values").alias("f")), "id")
    e = F.zip_with("y", "f", lambda a, b: a - b)
    ratio = F.zip_with("y", "f", lambda a, b: F.abs(a - b) / F.greatest(F.abs(a), F.lit(1e-10)))
    logs = F.zip_with("y", "f", lambda a, b: F.pow(F.log1p(a) - F.log1p(b), F.lit(2.0)))
    span = float(w.sum())
    sq = lambda x, m: F.transform(x, lambda v: (v - m) * (v - m))
    rows = both.withColumn("e", e).withColumn("me", dot(F.col("e"), w) / span).withColumn("my", dot(F.col("y"), w) / span)
    rows = rows.select(dot(F.transform("e", F.abs), w).alias("ae"), dot(F.transform("e", lambda v: v * v), w).alias("se"), dot(ratio, w).alias("pe"), dot(logs, w).alias("le"), (1 - dot(sq("e", F.col("me")), w) / dot(sq("y", F.col("my")), w)).alias("ev"))
    return rows.agg(F.avg("ae").alias("mae"), F.avg("se").alias("mse"), F.avg("pe").alias("mape"), F.avg("le").alias("msle"), F.avg("ev").alias("explained_variance"))


# ---- cross-validation plumbing and scalar metrics ----


def folds(df: DataFrame, k: int, seed: int = 42, by: str | None = None) -> DataFrame:
    """df with ``fold``: rank by a seeded hash modulo k, within classes if ``by`` is given."""
    keyed = df.withColumn("_key", F.xxhash64(F.lit(seed), "id"))
    return numbered(keyed, "_key", "id", name="_place", by=(by,) if by else ()).withColumn("fold", ((F.col("_place") - 1) % k).cast("int")).drop("_key", "_place").select(*df.columns, "fold")


def regression_metrics(df: DataFrame, y: str = "y", fit: str = "fit") -> DataFrame:
    e = F.col(y) - F.col(fit)
    return df.agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), (1 - F.sum(e * e) / (F.var_pop(y) * F.count(y))).alias("r_squared"))


def classification_metrics(df: DataFrame, y: str = "y", fit: str = "fit", positive: int = 1) -> DataFrame:
    hit = lambda a, b: F.sum(F.when(a & b, 1).otherwise(0))
    t, p = F.col(y) == positive, F.col(fit) == positive
    rows = df.agg(F.avg(F.when(F.col(y) == F.col(fit), 1.0).otherwise(0.0)).alias("accuracy"), hit(t, p).alias("tp"), hit(~t, p).alias("fp"), hit(t, ~p).alias("fn"))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return rows.select("accuracy", share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1"))
