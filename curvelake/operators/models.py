"""Models over several predictors, kernels and groups: regression, classification, conformal
regions, multivariate and covariate-adjusted charts, lagged forecasts, metric-space statistics.

Fits are sums over tables; pairwise ones take distance tables.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvelake.functions import numeric as nm
from curvelake.functions import special
from curvelake.operators import infer, metrics, monitor, pointwise, reduce, regress
from curvelake.operators.apply import moments, nearest, numbered, other_sums, per_curve, row_statistics, sums
from curvelake.sources.curves import Curves


def stacked(parts: list[Curves], ks: list[int], keep: tuple[str, ...] = ()) -> tuple[DataFrame, list]:
    """(id, the first table's columns ``keep``, scores of all parts one after another; their bases)."""
    out, bases = None, []
    for j, (c, k) in enumerate(zip(parts, ks, strict=True)):
        basis = reduce.fpca(c, k)
        bases.append(basis)
        own = per_curve(c.df.select("id", *(keep if j == 0 else ()), "values"), basis.project, f"s{j} array<double>")
        out = own if out is None else out.join(own, "id")
    return out.select("id", *keep, F.concat(*[f"s{j}" for j in range(len(parts))]).alias("scores")), bases


def _design(s):
    return np.hstack([np.ones((len(s), 1)), s])


def linear_multi(parts: list[Curves], y: str, ks: list[int]):
    """(intercept and slopes, bases, R squared, table with fit) of y on the scores of several curves."""
    table, bases = stacked(parts, ks, (y,))
    table = table.withColumn(y, F.col(y).cast("double"))
    xx, xy, m = sums(table, lambda s, v: [_design(s).T @ _design(s), _design(s).T @ v, np.array([len(v), v.sum(), (v**2).sum()])], ["scores", y])
    b = np.linalg.solve(xx + 1e-10 * np.eye(len(xx)), xy)
    rss = m[2] - 2 * b @ xy + b @ xx @ b
    return b, bases, float(1 - rss / (m[2] - m[1] ** 2 / m[0])), per_curve(table, lambda s: _design(s) @ b, "fit double", values="scores")


def linear_multi_cv(parts: list[Curves], y: str, ks: list[list[int]], n_folds: int = 3, seed: int = 42) -> list[tuple[str, float]]:
    """(component counts, mean squared error over folds); the bases are those of all rows."""
    out = []
    for k in ks:
        table = pointwise.folds(stacked(parts, k, (y,))[0].withColumn(y, F.col(y).cast("double")), n_folds, seed).persist()
        loss = n = 0.0
        for f in range(n_folds):
            xx, xy = sums(table.where(F.col("fold") != f), lambda s, v: [_design(s).T @ _design(s), _design(s).T @ v], ["scores", y])
            b = np.linalg.solve(xx + 1e-10 * np.eye(len(xx)), xy)
            got = sums(table.where(F.col("fold") == f), lambda s, v, b=b: [np.array([((v - _design(s) @ b) ** 2).sum(), len(v)])], ["scores", y])[0]
            loss, n = loss + got[0], n + got[1]
        table.unpersist()
        out.append((",".join(map(str, k)), float(loss / n)))
    return out


def _loo_means(c: Curves, table: DataFrame, extra: list[str], weigh, count: int) -> DataFrame:
    """table with w0, wy0, w1 ...: for each of the ``count`` matrices of weigh(L2 distances, extra
    columns of both sides) its sums over the other curves, of 1 and of y; no rows of pairs."""
    fn, e = metrics.lp(c.weights), len(extra) + 1
    packed = c.df.select("id", "values").join(table.select("id", F.array(*[F.col(x).cast("double") for x in [*extra, "y"]]).alias("_e")), "id").select("id", F.concat("values", "_e").alias("values"))

    def kernel(a, b):
        of_a, of_b = (np.column_stack([np.ones(len(x)), x[:, -1]]) for x in (a, b))
        return [(w, of_a, of_b) for w in weigh(fn(a[:, :-e], b[:, :-e]), a[:, -e:-1], b[:, -e:-1])]

    sums_ = other_sums(packed, kernel, 2 * count)
    return table.join(sums_.select("id", *[F.col(f"s{2 * k + j}").alias(f"{name}{k}") for k in range(count) for j, name in enumerate(("w", "wy"))]), "id", "left")


def _loo_fit(k: int):
    return F.when(F.col(f"w{k}") > 1e-15, F.col(f"wy{k}") / F.col(f"w{k}")).otherwise(F.col("y"))


def mixed_kernel(c: Curves, table: DataFrame, h: float, hz: float) -> DataFrame:
    """id, y, fit: leave-one-out means under the product of kernels of the L2 distance of curves
    and of a covariate; table: id, y, z."""

    def weigh(d, own, other):
        u = (own - other.T) / hz
        return [np.exp(-d * d / (2 * h * h)) * np.exp(-u * u / 2)]

    return _loo_means(c, table, ["z"], weigh, 1).select("id", "y", _loo_fit(0).alias("fit"))


def kernel_cv(c: Curves, y: DataFrame, hs) -> list[tuple[float, float]]:
    """(bandwidth, leave-one-out mean squared error) under the L2 distance, all in one pass; y: id, y."""
    means = _loo_means(c, y, [], lambda d, *_: [np.exp(-d * d / (2 * h * h)) for h in hs], len(hs))
    got = means.agg(*[F.avg(F.pow(F.col("y") - _loo_fit(k), F.lit(2.0))) for k in range(len(hs))]).first()
    return [(float(h), float(e)) for h, e in zip(hs, got, strict=True)]


def ridge_cv(c: Curves, y: str, phi: np.ndarray, lams, n_folds: int = 3, seed: int = 42) -> list[tuple[float, float]]:
    """(penalty, mean squared error over folds) of y on basis coefficients."""
    inv = np.linalg.pinv(phi)
    table = pointwise.folds(per_curve(c.df.select("id", y, "values"), lambda v: v @ inv.T, "scores array<double>").withColumn(y, F.col(y).cast("double")), n_folds, seed).persist()
    parts = [sums(table.where(F.col("fold") == f), lambda s, v: [_design(s).T @ _design(s), _design(s).T @ v, np.array([(v**2).sum(), len(v)])], ["scores", y]) for f in range(n_folds)]
    table.unpersist()
    out = []
    for lam in lams:
        loss = n = 0.0
        for f in range(n_folds):
            xx, xy = (sum(parts[g][j] for g in range(n_folds) if g != f) for j in (0, 1))
            pen = lam * np.eye(len(xx))
            pen[0, 0] = 0
            b = np.linalg.solve(xx + pen, xy)
            loss += parts[f][2][0] - 2 * b @ parts[f][1] + b @ parts[f][0] @ b
            n += parts[f][2][1]
        out.append((float(lam), float(loss / n)))
    return out


def additive(c: Curves, y: str, k: int = 3, h: float = 0.3, rounds: int = 5, grid: int = 41) -> tuple[float, list[tuple[np.ndarray, np.ndarray]], DataFrame]:
    """(mean, (points, effect) of each standardised score, table with fit): kernel smoothers on
    partial residuals, one score after another; smoothers are sums on a grid of points."""
    basis = reduce.fpca(c, k)
    sd = np.sqrt(np.maximum(basis.eigenvalues, 1e-300))
    table = per_curve(c.df.select("id", y, "values"), lambda v: basis.project(v) / sd, "scores array<double>").withColumn(y, F.col(y).cast("double")).persist()
    n, total = sums(table, lambda s, v: [np.array([len(v)]), np.array([v.sum()])], ["scores", y])
    mean, at = float(total[0] / n[0]), np.linspace(-3, 3, grid)
    effects = [np.zeros(grid) for _ in range(k)]
    fitted = lambda s, skip=None: sum(np.interp(s[:, j], at, effects[j]) for j in range(k) if j != skip)
    for _ in range(rounds):
        for j in range(k):
            def parts(s, v, j=j):
                r = v - mean - fitted(s, j)
                w = np.exp(-(np.subtract.outer(at, s[:, j]) ** 2) / (2 * h * h))
                return [w.sum(1), w @ r]

            mass, top = sums(table, parts, ["scores", y])
            effects[j] = top / np.maximum(mass, 1e-10)
            level = float(sums(table, lambda s, v, j=j: [np.array([np.interp(s[:, j], at, effects[j]).sum()])], ["scores", y])[0][0] / n[0])
            effects[j] = effects[j] - level
    return mean, [(at, e) for e in effects], per_curve(table, lambda s: mean + fitted(s), "fit double", values="scores")


# ---- classification ----


def score_nearest(c: Curves, components: int, k: int) -> DataFrame:
    """(i, j, d, rank) of the k nearest by unweighted principal scores; only scores are sent."""
    n, mu, scatter = moments(c.df)
    vec = np.linalg.eigh(scatter)[1][:, ::-1][:, :components]
    return nearest(per_curve(c.df.select("id", "values"), lambda v: (v - mu) @ vec, "_s array<double>").select("id", F.col("_s").alias("values")), metrics.euclidean(), k)


def best_kernel(c: Curves, labels: DataFrame, hs) -> list[tuple[float, float]]:
    """(bandwidth, leave-one-out accuracy) of the kernel vote by L2 distances, all in one pass;
    labels: id, label."""
    from curvelake.operators.cluster import kernel_classify

    hit = kernel_classify(c, labels, hs).agg(*[F.avg((F.col("label") == F.col(f"predicted{k}")).cast("double")) for k in range(len(hs))]).first()
    return [(float(h), float(x)) for h, x in zip(hs, hit, strict=True)]


def classify_cv(c: Curves, label: str, k: int = 3, quadratic: bool = False, n_folds: int = 3, seed: int = 42) -> list[tuple[int, float]]:
    """(fold, share of errors) of discriminant rules."""
    from curvelake.operators.cluster import classify, discriminant

    df, out = pointwise.folds(c.df, n_folds, seed), []
    for f in range(n_folds):
        decide = discriminant(c.with_df(df.where(F.col("fold") != f).drop("fold")), label, k, quadratic)[0]
        got = classify(c.with_df(df.where(F.col("fold") == f).drop("fold")), decide)
        out.append((f, float(got.agg(F.avg((F.col(label) != F.col("predicted")).cast("double"))).first()[0])))
    return out


# ---- conformal regions ----


def conformal_of(scored: DataFrame, new: DataFrame, alpha: float = 0.1) -> tuple[DataFrame, float]:
    """(new with low and high; half width): residuals of a fitted predictor on calibration rows
    (y, fit), nothing is refitted."""
    q = infer.conformal_quantile(scored.select(F.abs(F.col("y") - F.col("fit")).alias("r")), "r", alpha)
    return new.withColumn("low", F.col("fit") - q).withColumn("high", F.col("fit") + q), q


def cross_conformal(c: Curves, y: str, new: Curves, k: int = 3, n_folds: int = 5, alpha: float = 0.1, seed: int = 42) -> tuple[DataFrame, float]:
    """(new with fit, low, high; half width): out-of-fold residuals pooled, intervals about the
    mean of the folds' models."""
    df = pointwise.folds(c.df, n_folds, seed)
    residuals, fits = None, None
    for f in range(n_folds):
        model = regress.linear(c.with_df(df.where(F.col("fold") != f).drop("fold")), y, k)
        own = model.predict(c.with_df(df.where(F.col("fold") == f).drop("fold"))).select(F.abs(F.col(y) - F.col("fit")).alias("r"))
        fit = model.predict(new).select("id", F.col("fit").alias(f"f{f}"))
        residuals = own if residuals is None else residuals.union(own)
        fits = fit if fits is None else fits.join(fit, "id")
    q = infer.conformal_quantile(residuals, "r", alpha)
    mean = sum((F.col(f"f{f}") for f in range(1, n_folds)), F.col("f0")) / n_folds
    return fits.select("id", mean.alias("fit"), (mean - q).alias("low"), (mean + q).alias("high")), q


def jackknife_plus(c: Curves, y: str, new: Curves, k: int = 3, alpha: float = 0.1) -> DataFrame:
    """id, low, high: order statistics of every leave-one-out prediction plus or minus its own
    residual. The components are those of all rows; leaving a row out of the least squares is exact.

    All n left-out rows meet every new row in tiles: a left-out row is its coefficients and residual.
    """
    c, new = regress._unit(c), regress._unit(new)
    basis = reduce.fpca(c, k)
    given = c.df.select("id", "values", F.col(y).cast("double").alias("_y"))
    parts = lambda v, t: (lambda d: [d.T @ d, d.T @ t, np.array([len(t)])])(_design(basis.project(v)))
    gram, xy, n = sums(given, parts, ["values", "_y"])
    inv, n = np.linalg.inv(gram), int(n[0])
    b = inv @ xy
    lo, hi = math.floor(alpha * (n + 1)) - 1, math.ceil((1 - alpha) * (n + 1)) - 1

    def leave(v):
        d, t = _design(basis.project(v[:, :-1])), v[:, -1]
        r = (t - d @ b) / (1 - np.einsum("np,pq,nq->n", d, inv, d))
        return np.hstack([b[None] - (d @ inv) * r[:, None], np.abs(r)[:, None]])  # coefficients without each row, its residual

    left = per_curve(given.select("id", F.concat("values", F.array("_y")).alias("values")), leave, "_left array<double>").select("id", F.col("_left").alias("values"))
    if not left.where(F.exists("values", lambda x: F.isnan(x) | (F.abs(x) == math.inf))).isEmpty():
        raise ValueError("without some row the coefficients are not determined")
    design = per_curve(new.df.select("id", "values"), lambda v: _design(basis.project(v)), "_design array<double>").select("id", F.col("_design").alias("values"))

    def ends(rows, block):
        p, e = rows @ block[:, :-1].T, block[:, -1]
        return p - e, p + e

    found = row_statistics(design, left, ends, [max(lo, 0), min(hi, n - 1)])
    return found.select("id", F.col("v0").alias("low") if lo >= 0 else F.lit(-math.inf).alias("low"), F.col("v1").alias("high") if hi < n else F.lit(math.inf).alias("high"))


# ---- charts ----


def multivariate_chart(parts: list[Curves], k: int = 3, alpha: float = 0.05, ridge: float = 0.0):
    """(id, t2, spe and alarms; limits): components of several variables stacked, limits from
    chi-square and matched moments."""
    means, scales, loadings, eigenvalues, splits = reduce.mfpca(parts, k)
    both = None
    for j, c in enumerate(parts):
        own = c.df.select("id", F.col("values").alias(f"v{j}"))
        both = own if both is None else both.join(own, "id")
    packed = both.select("id", F.concat(*[f"v{j}" for j in range(len(parts))]).alias("values"))
    mean = np.concatenate(means)
    scale = np.concatenate([np.full(len(m), s) for m, s in zip(means, scales, strict=True)])
    lam = np.maximum(eigenvalues, ridge) if ridge else eigenvalues

    def kernel(v):
        x = (v - mean) / scale
        s = x @ loadings
        return (s**2 / lam).sum(1), ((x - s @ loadings.T) ** 2).sum(1)

    stats = per_curve(packed, kernel, "t2 double, spe double").persist()
    m, q = stats.agg(F.avg("spe"), F.var_samp("spe")).first()
    limits = monitor.t2_limit(alpha, k), monitor.spe_limit(m, q, alpha)
    return stats.withColumn("t2_alarm", F.col("t2") > limits[0]).withColumn("spe_alarm", F.col("spe") > limits[1]), limits


def adjusted_residuals(c: Curves, covariates: list[str]) -> Curves:
    """Curves minus their regression on covariates, for covariate-adjusted charts."""
    beta = regress.function_on_scalar(c, covariates)[0]
    fit = regress.predict_function_on_scalar(c.df.select("id", *covariates), covariates, beta).select("id", F.col("values").alias("fit"))
    return c.with_df(c.df.select("id", "values").join(fit, "id").select("id", F.zip_with("values", "fit", lambda a, b: a - b).alias("values")))


def regularized_t2(scores: DataFrame, eigenvalues, floor: float) -> DataFrame:
    """scores (id, scores) with t2, eigenvalues at least ``floor``."""
    lam = [float(max(x, floor)) for x in eigenvalues]
    return scores.select("id", F.aggregate(F.zip_with("scores", F.lit(lam), lambda s, v: s * s / v), F.lit(0.0), lambda a, x: a + x).alias("t2"))


def window_profiles(c: Curves, x: str, width: int, step: int) -> Curves:
    """Slope curves of regressions on x over moving windows of curves in the order of id; each
    curve adds its sums to the windows it lies in."""
    rows = numbered(c.df.select("id", "values", F.col(x).cast("double").alias("x")), "id", name="k")
    first = F.greatest(F.ceil((F.col("k") - width) / step), F.lit(0)).cast("int")
    last = F.floor((F.col("k") - 1) / step).cast("int")
    n = rows.count()
    windows = max(0, (n - width) // step + 1)
    rows = rows.withColumn("w", F.explode(F.sequence(first, last))).where(F.col("w") < windows)
    long = rows.select("w", "x", F.posexplode("values").alias("pos", "v"))
    slope = long.groupBy("w", "pos").agg(F.covar_pop("x", "v").alias("c"), F.var_pop("x").alias("s"))
    wide = slope.groupBy(F.col("w").cast("long").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", (F.col("c") / F.col("s")).alias("b")))), lambda z: z["b"]).alias("values"))
    return c.with_df(wide)


# ---- series of curves ----


def lagged(c: Curves) -> DataFrame:
    """id, x (a curve), y (the next one in the order of id)."""
    r = numbered(c.df.select("id", "values"), "id", name="k")
    return r.select("id", "k", F.col("values").alias("x")).join(r.select((F.col("k") - 1).alias("k"), F.col("values").alias("y")), "k").select("id", "x", "y")


def next_curve(c: Curves, k: int = 3) -> np.ndarray:
    """The next curve by one partial least squares regression on the last curve for each point:
    all points share the covariances of one pass."""
    pairs = lagged(c)
    n, sx, sy = sums(pairs, lambda x, y: [np.array([len(x)]), x.sum(0), y.sum(0)], ["x", "y"])
    mx, my = sx / n[0], sy / n[0]
    xx, xy = sums(pairs, lambda x, y: [(x - mx).T @ (x - mx), (x - mx).T @ (y - my)], ["x", "y"])
    last = np.array(c.df.agg(F.max_by("values", "id")).first()[0])
    out = np.empty(len(my))
    for p in range(len(my)):
        g, b, rot, coef = xx.copy(), xy[:, p].copy(), [], []
        loads = []
        for _ in range(k):
            size = np.linalg.norm(b)
            if size < 1e-12:
                break
            w = b / size
            r = w.copy()
            for q, v in zip(loads, rot, strict=True):
                r = r - (q @ w) * v
            t2 = float(w @ g @ w)
            if t2 < 1e-12:
                break
            load = g @ w / t2
            c1 = float(w @ b) / t2
            rot.append(r)
            loads.append(load)
            coef.append(c1)
            g = g - t2 * np.outer(load, load)
            b = b - t2 * c1 * load
        out[p] = my[p] + sum(c1 * float((last - mx) @ r) for c1, r in zip(coef, rot, strict=True))
    return out


def differential_operator(c: Curves, order: int = 1) -> np.ndarray:
    """(order, points): by point, the coefficients of the equation D^m x + b_{m-1} D^{m-1} x + ... + b_0 x = 0
    by least squares over curves."""
    def parts(v):
        d = [nm.derivative(v, c.grid, j) for j in range(order + 1)]
        x = np.stack(d[:order], 2)
        return [np.einsum("nmp,nmq->mpq", x, x), np.einsum("nmp,nm->mp", x, d[order])]

    xx, xy = sums(c.df, parts, ["values"])
    return np.array([-np.linalg.solve(a + 1e-10 * np.eye(order), b) for a, b in zip(xx, xy, strict=True)]).T


# ---- groups in a metric space ----


def quantile_anova(c: Curves, group: str) -> tuple[float, float]:
    """(statistic, p) of group Frechet variances of densities in the Wasserstein space: the
    excess of the total variance over the groups' own and the spread of these, chi-square(k - 1)."""
    q = lambda v: np.array([infer.quantile_function(f, c.grid, len(c.grid)) for f in v])
    groups = sorted(r[0] for r in c.df.select(group).distinct().collect())
    stats = []
    for g in [None, *groups]:
        df = c.df if g is None else c.df.where(F.col(group) == g)
        n, s = sums(df, lambda v: [np.array([len(v)]), q(v).sum(0)], ["values"])
        mean = s / n[0]
        d = lambda v, mean=mean: nm.trapz((q(v) - mean) ** 2, np.linspace(0, 1, len(mean)))
        a, b = sums(df, lambda v, d=d: [np.array([d(v).sum()]), np.array([(d(v) ** 2).sum()])], ["values"])
        stats.append((n[0], a[0] / n[0], max(b[0] / n[0] - (a[0] / n[0]) ** 2, 1e-15)))
    (n, total, _), own = stats[0], stats[1:]
    share = np.array([x[0] / n for x in own])
    v, s2 = np.array([x[1] for x in own]), np.array([x[2] for x in own])
    f = total - float(share @ v)
    spread = sum(share[i] * share[j] / (s2[i] * s2[j]) * (v[i] - v[j]) ** 2 for i in range(len(own)) for j in range(i))
    t = n * spread / float((share / s2).sum()) + n * f * f / float((share**2 * s2).sum())
    return float(t), float(1 - special.chi2_cdf(t, len(own) - 1))


