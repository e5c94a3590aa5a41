"""Tests, bands, tolerance and conformal regions.

Draws belong to (seed, replicate, id) or (seed, replicate, block of ids), so results do not
depend on how rows are dealt. Multipliers are drawn row by row. Permutations and resamples
draw on the driver how many rows of each kind fall into each block, then within the block,
which gives the law of a draw over the whole table; no task holds more than a block.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvelake.functions import numeric as nm
from curvelake.functions import special
from curvelake.operators.apply import block_sums, matrix, moments, numbered, order_statistics, per_curve, sums
from curvelake.operators.reduce import fpca, solve_fpca
from curvelake.sources.curves import Curves

MOST_ROWS = 20_000


def rows_of(c: Curves, *columns: str):
    """Values (and columns) of a table of MOST_ROWS curves at most, by id."""
    got = c.df.orderBy("id").select("values", *columns).limit(MOST_ROWS + 1).collect()
    if len(got) > MOST_ROWS:
        raise ValueError(f"resampling takes {MOST_ROWS} curves at most; take a sample first")
    return (np.array([r["values"] for r in got]), *(np.array([r[x] for r in got]) for x in columns))


def replicates(spark, n: int, one, seed: int) -> np.ndarray:
    """one(generator) for each replicate, in order."""
    import pandas as pd

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"b": pdf["id"], "x": [float(one(np.random.default_rng(seed + int(b)))) for b in pdf["id"]]})

    return np.array([r["x"] for r in spark.range(n).repartition(min(n, 64)).mapInPandas(run, "b long, x double").orderBy("b").collect()])


def p_value(observed: float, null: np.ndarray) -> float:
    return (1 + int((null >= observed).sum())) / (1 + len(null))


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 well mixed bits of 64-bit keys."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def row_draws(ids, n: int, seed: int) -> np.ndarray:
    """Uniform bits of shape (rows, n), by id, replicate and seed."""
    step = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        own = _mixed(np.asarray(ids, np.int64).astype(np.uint64) * step + np.uint64(seed) * np.uint64(0xD1342543DE82EF95))
        return _mixed(own[:, None] + (np.arange(n, dtype=np.uint64) + np.uint64(1)) * step)


def row_normals(ids, n: int, seed: int) -> np.ndarray:
    """Standard normal multipliers (rows, n) by Box and Muller."""
    u = ((row_draws(ids, 2 * n, seed) >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53
    return np.sqrt(-2 * np.log(u[:, :n])) * np.cos(2 * math.pi * u[:, n:])


def row_signs(ids, n: int, seed: int) -> np.ndarray:
    return np.where(row_draws(ids, n, seed) >> np.uint64(63), 1.0, -1.0)


def multiplier_sums(df: DataFrame, residuals, n_boot: int, seed: int) -> np.ndarray:
    """(n_boot, points): sums over rows of standard normals times residuals(values)."""
    return sums(df, lambda i, v: [row_normals(i, n_boot, seed).T @ residuals(v)], ["id", "values"])[0]


def permuted_sums(df: DataFrame, group: str, labels: list, n_perm: int, seed: int, centre) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sizes, sums by group, squares, sums by permuted group) of values about ``centre``; the
    last has shape (n_perm, groups, points)."""
    own = lambda g: np.array([g == x for x in labels], float)
    sizes, total, square = sums(df, lambda v, g: [own(g).sum(1), own(g) @ (v - centre), ((v - centre) ** 2).sum(0)], ["values", group])
    kinds = sizes.astype(np.int64)

    def dealt(counts):
        """(n_perm, blocks, groups): labels that a permutation brings into each block."""
        out = np.zeros((n_perm, len(counts), len(kinds)), np.int64)
        for b in range(n_perm):
            rng, left = np.random.default_rng([seed, b]), kinds.copy()
            for k, size in enumerate(counts):
                out[b, k] = rng.multivariate_hypergeometric(left, size, method="marginals") if size else 0
                left -= out[b, k]
        return out

    def one(block, share, v):
        out, x = np.empty((n_perm, len(kinds), v.shape[1])), v - centre
        for b in range(n_perm):
            lab = np.random.default_rng([seed, b, block]).permutation(np.repeat(np.arange(len(kinds)), share[b]))
            out[b] = np.equal(lab, np.arange(len(kinds))[:, None]).astype(float) @ x
        return [out]

    return sizes, total, square, block_sums(df.select("id", "values"), one, ["values"], lambda counts: np.moveaxis(dealt(counts), 1, 0))[0]


def resampled_moments(df: DataFrame, n_boot: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums (n_boot, k) and sums of products (n_boot, k, k) over bootstrap samples of array rows."""

    def dealt(counts):
        n = int(counts.sum())
        return np.stack([np.random.default_rng([seed, b]).multinomial(n, counts / n) for b in range(n_boot)], 1)

    def one(block, share, s):
        total, products = np.empty((n_boot, s.shape[1])), np.empty((n_boot, s.shape[1], s.shape[1]))
        for b in range(n_boot):
            w = np.bincount(np.random.default_rng([seed, b, block]).integers(0, len(s), share[b]), minlength=len(s)).astype(float)
            total[b], products[b] = w @ s, (s * w[:, None]).T @ s
        return [total, products]

    return tuple(block_sums(df.select("id", "values"), one, ["values"], dealt))


def mean_of(c: Curves) -> tuple[int, np.ndarray]:
    n, total = sums(c.df, lambda v: [np.array([len(v)]), v.sum(0)], ["values"])
    return int(n[0]), total / n[0]


def mean_and_variance(c: Curves, change=lambda v: v) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, mean, sample variance) by position of change(values), in two passes."""
    n, total = sums(c.df, lambda v: [np.array([len(v)]), change(v).sum(0)], ["values"])
    mean = total / n[0]
    return int(n[0]), mean, sums(c.df, lambda v: [((change(v) - mean) ** 2).sum(0)], ["values"])[0] / max(n[0] - 1, 1)


def groups_of(c: Curves, group: str) -> list:
    return sorted(r[0] for r in c.df.select(group).distinct().collect())


def t_permutation(c: Curves, group: str, n_perm: int = 200, seed: int = 1) -> tuple[float, float]:
    """(integrated squared difference of two group means, p)."""
    w, labels, mu = c.weights, groups_of(c, group), mean_of(c)[1]
    if len(labels) != 2:
        raise ValueError("a two-sample test takes two groups")
    n, own, _, drawn = permuted_sums(c.df, group, labels, n_perm, seed, mu)
    stat = lambda s: (s[..., 0, :] / n[0] - s[..., 1, :] / n[1]) ** 2 @ w
    obs = float(stat(own))
    return obs, p_value(obs, stat(drawn))


def f_permutation(c: Curves, group: str, n_perm: int = 200, seed: int = 1) -> tuple[float, float]:
    w, labels, mu = c.weights, groups_of(c, group), mean_of(c)[1]
    size, own, square, drawn = permuted_sums(c.df, group, labels, n_perm, seed, mu)
    k, n = len(labels), size.sum()

    def stat(s):
        between = (s**2 / size[:, None]).sum(-2)  # values are about their overall mean
        return between / (k - 1) / np.maximum((square - between) / (n - k), 1e-15) @ w

    obs = float(stat(own))
    return obs, p_value(obs, stat(drawn))


def oneway(c: Curves, group: str) -> tuple[float, float]:
    """(V, p): integrated between-group squares; a scaled chi-square by the covariance diagonal."""
    groups = sorted(r[0] for r in c.df.select(group).distinct().collect())
    w = c.weights
    n, s, q = sums(c.df, lambda v, g: [np.array([(g == x).sum() for x in groups], float), np.array([v[g == x].sum(0) for x in groups]), (v**2).sum(0)], ["values", group])
    mean = s / n[:, None]
    v = float((n[:, None] * (mean - s.sum(0) / n.sum()) ** 2).sum(0) @ w)
    var = (q - (n[:, None] * mean**2).sum(0)) / (n.sum() - len(groups))
    e1, e2 = float(w @ var), float((w * var) @ (w * var))
    scale, dof = e2 / e1, (len(groups) - 1) * e1 * e1 / e2
    return v, 1 - special.chi2_cdf(v / scale, dof)


def two_sample_mean(a: Curves, b: Curves, k: int = 3) -> tuple[float, float]:
    """(T2, p): difference of mean scores of pooled components over their variances, chi-square(k)."""
    n1, m1, s1 = moments(a.df)
    n2, m2, s2 = moments(b.df)
    model = solve_fpca(n1 + n2 - 1, (n1 * m1 + n2 * m2) / (n1 + n2), s1 + s2, a.weights, k)
    d = (m1 - m2) * a.weights @ model.loadings
    t2 = float(n1 * n2 / (n1 + n2) * (d**2 / np.maximum(model.singular**2 / (n1 + n2 - 2), 1e-15)).sum())
    return t2, 1 - special.chi2_cdf(t2, k)


def mean_band(c: Curves, h: float, alpha: float = 0.05, n_boot: int = 500, seed: int = 42):
    """(centre, lower, upper, critical value): local-linear mean, multiplier bootstrap of the
    largest studentised deviation."""
    from curvelake.operators.smooth import local_polynomial_hat

    hat = local_polynomial_hat(c.grid, c.grid, h, 1)
    n, mean, var = mean_and_variance(c, lambda v: v @ hat.T)
    sd = np.sqrt(var)
    sup = np.abs(multiplier_sums(c.df, lambda v: (v @ hat.T - mean) / np.maximum(sd, 1e-12), n_boot, seed) / math.sqrt(n)).max(1)
    crit = float(np.sort(sup)[math.ceil((1 - alpha) * n_boot) - 1])
    half = crit * sd / math.sqrt(n)
    return mean, mean - half, mean + half, crit


def two_sample_band(a: Curves, b: Curves, h: float, alpha: float = 0.05, **options) -> tuple[bool, tuple]:
    """Whether zero leaves the band of paired differences of rows in the order of id."""
    left, right = (numbered(c.df.select("id", F.col("values").alias(v)), "id").select(F.col("rank").alias("id"), v) for c, v in ((a, "x"), (b, "y")))
    d = Curves(left.join(right, "id").select("id", F.zip_with("x", "y", lambda p, q: p - q).alias("values")), a.grid)
    band = mean_band(d, h, alpha, **options)
    return bool(((band[1] > 0) | (band[2] < 0)).any()), band


def equivalence(a: Curves, b: Curves, delta: float, alpha: float = 0.05, n_boot: int = 500, seed: int = 1) -> tuple[bool, float]:
    """Two one-sided tests of the largest mean difference by a multiplier bootstrap band."""
    (n1, m1, v1), (n2, m2, v2) = mean_and_variance(a), mean_and_variance(b)
    d, se = m1 - m2, np.sqrt(v1 / n1 + v2 / n2)
    # one table's ids may be the other's too: each has its own draws
    x, y = multiplier_sums(a.df, lambda v: v - m1, n_boot, 2 * seed), multiplier_sums(b.df, lambda v: v - m2, n_boot, 2 * seed + 1)
    sup = np.abs((x / n1 - y / n2) / np.maximum(se, 1e-12)).max(1)
    crit = float(np.sort(sup)[math.ceil((1 - 2 * alpha) * n_boot) - 1])
    return bool((np.abs(d) + crit * se).max() < delta), float(np.abs(d).max())


def tolerance_band(c: Curves, k: int = 3, coverage: float = 0.95, n_boot: int = 200, simultaneous: bool = False, seed: int = 1):
    """(centre, half width): bootstrap of component scores on a unit grid."""
    from curvelake.sources.curves import unit_grid

    c = Curves(c.df, unit_grid(len(c.grid)))
    model = fpca(c, k)
    scores = per_curve(c.df.select("id", "values"), model.project, "s array<double>").select("id", F.col("s").alias("values"))
    total, products = resampled_moments(scores, n_boot, seed)
    n = model.n
    cov = (products - total[:, :, None] * total[:, None, :] / n) / (n - 1)
    sd = np.sqrt(np.maximum(np.einsum("pi,bij,pj->bp", model.loadings, cov, model.loadings), 0)).mean(0)
    if simultaneous:
        sup = per_curve(scores, lambda s: np.abs(s @ model.loadings.T / np.maximum(sd, 1e-12)).max(1), "sup double")
        return model.mean, order_statistics(sup, "sup", [math.ceil(n * coverage) - 1])[0] * sd
    return model.mean, special.normal_quantile_rational((1 + coverage) / 2) * sd


def conformal_quantile(scores: DataFrame, column: str, alpha: float) -> float:
    """sorted[ceil((n + 1)(1 - alpha)) - 1], infinite beyond n."""
    n = scores.count()
    k = math.ceil((n + 1) * (1 - alpha))
    if k > n:
        return math.inf
    return order_statistics(scores, column, [k - 1])[0]


def conformal_band(c: Curves, alpha: float = 0.1, share: float = 0.5, how: str = "sup", seed: int = 42):
    """(centre, half width) of a split conformal band about the mean of one part."""
    u = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1_000_000)) / 1_000_000
    fit, cal = c.df.where(u < share), c.df.where(u >= share)
    n, s = sums(fit, lambda v: [np.array([len(v)]), v.sum(0)], ["values"])
    mean = s / n[0]
    w = c.weights
    score = (lambda v: np.abs(v - mean).max(1)) if how == "sup" else (lambda v: np.sqrt((v - mean) ** 2 @ w / len(w)))
    return mean, conformal_quantile(per_curve(cal.select("id", "values"), score, "score double"), "score", alpha)


def conformal_linear(c: Curves, y: str, new: Curves, k: int = 3, alpha: float = 0.1, share: float = 0.5, seed: int = 42) -> tuple[DataFrame, float]:
    """(new curves with fit, low, high; half width): refitted on one part, calibrated on the other."""
    from curvelake.operators.regress import linear

    u = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1_000_000)) / 1_000_000
    model = linear(c.with_df(c.df.where(u < share)), y, k)
    res = model.predict(c.with_df(c.df.where(u >= share))).select("id", F.abs(F.col(y) - F.col("fit")).alias("r"))
    q = conformal_quantile(res, "r", alpha)
    return model.predict(new).withColumn("low", F.col("fit") - q).withColumn("high", F.col("fit") + q), q


def conformal_classes(probabilities: DataFrame, calibration: DataFrame, alpha: float = 0.1, how: str = "lac") -> DataFrame:
    """id, set: classes (places in the probability array) kept by the least ambiguous rule or by
    cumulated probability. calibration: id, probabilities, label (a place)."""
    own = F.get("probabilities", F.col("label").cast("int"))
    above = lambda p, x: F.aggregate(p, F.lit(0.0), lambda s, v: s + F.when(v >= x, v).otherwise(0.0))
    score = 1 - own if how == "lac" else above(F.col("probabilities"), own)
    q = conformal_quantile(calibration.select(score.alias("s")), "s", alpha)
    keep = (lambda p: 1 - p <= q) if how == "lac" else (lambda p: above(F.col("probabilities"), p) <= q)
    marked = F.transform("probabilities", lambda p, k: F.when(keep(p), k))
    return probabilities.select("id", F.array_compact(marked).alias("set"))


def goodness_of_fit(residuals, fit) -> tuple[float, float]:
    """(F, p): residuals on 1, z, z^2, z^3 of the standardised fit, F(3, n - 4)."""
    r, z = np.asarray(residuals, float), np.asarray(fit, float)
    z = (z - z.mean()) / z.std(ddof=1)
    x = np.vander(z, 4, increasing=True)
    rss = float(((r - x @ np.linalg.lstsq(x, r, rcond=None)[0]) ** 2).sum())
    return _lack_of_fit(float(((r - r.mean()) ** 2).sum()), rss, len(r))


def _lack_of_fit(tss: float, rss: float, n: int) -> tuple[float, float]:
    f = ((tss - rss) / 3) / (rss / (n - 4))
    return f, 1 - special.f_cdf(f, 3, n - 4)


def goodness_of_fit_of(df: DataFrame, y: str, fit: str) -> tuple[float, float]:
    """``goodness_of_fit`` of a table's columns, from its sums."""
    n, sy, sf = (float(x[0]) for x in sums(df, lambda a, b: [np.array([len(a)]), np.array([(a - b).sum()]), np.array([b.sum()])], [y, fit]))
    mr, mf = sy / n, sf / n
    sd = math.sqrt(sums(df, lambda b: [np.array([((b - mf) ** 2).sum()])], [fit])[0][0] / (n - 1))
    x = lambda b: np.vander((b - mf) / sd, 4, increasing=True)
    xx, xr, tss = sums(df, lambda a, b: [x(b).T @ x(b), x(b).T @ (a - b - mr), np.array([((a - b - mr) ** 2).sum()])], [y, fit])
    beta = np.linalg.lstsq(xx, xr, rcond=None)[0]
    rss = sums(df, lambda a, b: [np.array([((a - b - mr - x(b) @ beta) ** 2).sum()])], [y, fit])[0][0]
    return _lack_of_fit(float(tss[0]), float(rss), int(n))


# ---- densities and metric-space statistics ----


def normalize_density(f, t) -> np.ndarray:
    return f / nm.trapz(f, t)[..., None]


def quantile_function(f, t, m: int = 101) -> np.ndarray:
    cdf = nm.cumulative_trapz(f, t)
    cdf /= cdf[-1]
    keep = np.concatenate([[True], np.diff(cdf) > 0])
    return np.interp(np.linspace(0, 1, max(m, 101)), cdf[keep], t[keep])


def wasserstein2(f, g, t) -> float:
    a, b = quantile_function(f, t, len(t)), quantile_function(g, t, len(t))
    return math.sqrt(float(nm.trapz((a - b) ** 2, np.linspace(0, 1, len(a)))))


def lqd(f, t, m: int | None = None) -> np.ndarray:
    """Log quantile density: -log f at the quantiles."""
    u = np.linspace(0, 1, m or len(t))
    cdf = nm.cumulative_trapz(f, t)
    return np.interp(u, cdf / cdf[-1], -np.log(np.maximum(f, 1e-12)))


def inverse_lqd(q, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    """(t, density) of a log quantile density, scaled to the domain."""
    u = np.linspace(0, 1, len(q))
    t = nm.cumulative_trapz(np.exp(q), u)
    t = low + (high - low) * t / t[-1]
    f = np.exp(-q)
    return t, f / nm.trapz(f, t)


def barycenter(densities, t, weights=None) -> tuple[np.ndarray, np.ndarray]:
    """(points, density) whose quantile function is the weighted mean of quantile functions."""
    q = np.average([quantile_function(f, t, len(t)) for f in densities], 0, weights)
    u = np.linspace(0, 1, len(q))
    return q, 1 / np.maximum(nm.central_differences(q, u), 1e-12)


def global_frechet_weights(x, x0) -> np.ndarray:
    """1 + (x - mean)' S^-1 (x0 - mean); may be negative."""
    x = np.atleast_2d(np.asarray(x, float).T).T
    d = x - x.mean(0)
    s = np.atleast_2d(np.cov(x.T, bias=True)) + 1e-6 * np.eye(x.shape[1])
    return 1 + d @ np.linalg.solve(s, np.atleast_1d(x0) - x.mean(0))


def local_frechet_weights(x, x0: float, h: float) -> np.ndarray:
    d = np.asarray(x, float) - x0
    k = np.exp(-(d**2) / (2 * h * h))
    m0, m1, m2 = k.mean(), (k * d).mean(), (k * d * d).mean()
    return k * (m2 - m1 * d) / max(m0 * m2 - m1 * m1, 1e-15)


def interval_p_values(p: np.ndarray) -> np.ndarray:
    """Largest Fisher-combined p over the circular intervals that hold each component, from
    uncombined permutation statistics of shape (1 + B, components): row 0 is observed."""
    stat = np.asarray(p, float)
    b, k = stat.shape
    own = (np.argsort(np.argsort(-stat, 0), 0) + 1) / b
    out = own[0].copy()
    for size in range(2, k + 1):
        for start in range(k):
            at = (start + np.arange(size)) % k
            f = -2 * np.log(own[:, at]).sum(1)
            out[at] = np.maximum(out[at], (f >= f[0]).mean())
    return out


# ---- functional time series: curves in the order of id ----


def autocovariance(c: Curves, lag: int) -> np.ndarray:
    """C_h over n, from pairs of curves h apart joined by their rank."""
    r = numbered(c.df.select("id", "values"), "id", name="k").select("k", "values")
    n, s = sums(c.df, lambda v: [np.array([len(v)]), v.sum(0)], ["values"])
    mu = s / n[0]
    pair = r.withColumnRenamed("values", "x").join(r.select((F.col("k") - lag).alias("k"), F.col("values").alias("y")), "k")
    return sums(pair, lambda x, y: [(x - mu).T @ (y - mu)], ["x", "y"])[0] / n[0]


def functional_acf(c: Curves, lags: int) -> np.ndarray:
    """Hilbert-Schmidt norms of C_h over the integral of C_0's diagonal."""
    w = c.weights
    trace = float(np.diag(autocovariance(c, 0)) @ w)
    return np.array([math.sqrt(float((autocovariance(c, h) ** 2 * np.outer(w, w)).sum())) / trace for h in range(1, lags + 1)])


def partial_from_acf(r) -> np.ndarray:
    """Durbin-Levinson."""
    out, phi = [], np.zeros(0)
    for k in range(len(r)):
        a = (r[k] - (phi @ r[:k][::-1] if k else 0)) / max(1 - (phi @ r[:k] if k else 0), 1e-12)
        phi = np.append(phi - a * phi[::-1], a)
        out.append(a)
    return np.array(out)


def differenced(c: Curves) -> Curves:
    r = numbered(c.df.select("id", "values"), "id", name="_k")
    d = r.join(r.select((F.col("_k") + 1).alias("_k"), F.col("values").alias("_p")), "_k")
    return c.with_df(d.select("id", F.zip_with("values", "_p", lambda a, b: a - b).alias("values")))


def long_run_covariance(c: Curves, bandwidth: int | None = None) -> np.ndarray:
    b = int(c.df.count() ** (1 / 3)) if bandwidth is None else bandwidth
    out = autocovariance(c, 0)
    for h in range(1, b):
        ch = autocovariance(c, h)
        out = out + (1 - h / b) * (ch + ch.T)
    return out


def ar_fit(x, most: int | None = None) -> tuple[np.ndarray, float]:
    """Yule-Walker coefficients of the order of least AIC, and the mean."""
    from curvelake.operators.season import acf

    x = np.asarray(x, float)
    most = _most_lags(len(x)) if most is None else most
    return _yule_walker(acf(x, most), x.var(), len(x)), float(x.mean())


def _most_lags(n: int) -> int:
    return int(min(10 * math.log10(n), n - 1, n // 4))


def _yule_walker(r: np.ndarray, variance: float, n: int) -> np.ndarray:
    """Coefficients of the order of least AIC, up to the last lag of r."""
    best = (math.inf, np.zeros(0))
    for p in range(len(r)):
        phi = np.linalg.solve(np.array([[r[abs(i - j)] for j in range(p)] for i in range(p)]), r[1 : p + 1]) if p else np.zeros(0)
        s2 = variance * (1 - phi @ r[1 : p + 1])
        score = n * math.log(max(s2, 1e-300)) + 2 * p
        if score < best[0]:
            best = (score, phi)
    return best[1]


def _lag_products(x: np.ndarray, off: int, most: int, stop: int | None = None) -> np.ndarray:
    """Row h: sum of x[i] x[i - h] over i from ``off`` on, and below off + h if ``stop`` is None."""
    out = np.zeros((most + 1, x.shape[1]))
    for h in range(most + 1):
        a, b = max(off, h), min(len(x), off + h) if stop is None else stop
        if a < b:
            out[h] = (x[a:b] * x[a - h : b - h]).sum(0)
    return out


def autocovariances(df: DataFrame, column: str, most: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(n, mean, covariances of lags 0..most over n, the last rows) of an array column by id.

    Sorted partitions add up their own products; those across a border come from the
    ``most`` rows on either side of it, which are all that reaches the driver.
    """
    import pickle

    import pyarrow as pa
    from pyspark import TaskContext

    keep = max(most, 1)

    def run(batches):
        n, total, products, head, tail = 0, 0.0, 0.0, None, None
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(0))
                both = x if tail is None else np.concatenate([tail, x])
                products = products + _lag_products(both, len(both) - len(x), most, len(both))
                n, total, tail = n + len(x), total + x.sum(0), both[-keep:]
                head = x[:keep] if head is None else head if len(head) == keep else np.concatenate([head, x])[:keep]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([pickle.dumps((n, total, products, head, tail))], pa.binary())], names=["part", "payload"])

    parts = df.orderBy("id").select(column).mapInArrow(run, "part int, payload binary").collect()
    n, total, products, first, last = 0, 0.0, 0.0, None, None
    for row in sorted(parts, key=lambda r: r["part"]):
        k, t, p, head, tail = pickle.loads(bytes(row["payload"]))
        n, total, products = n + k, total + t, products + p
        if last is not None:
            products = products + _lag_products(np.concatenate([last, head]), len(last), most)
        first = head if first is None else np.concatenate([first, head])[:keep]
        last = tail if last is None else np.concatenate([last, tail])[-keep:]
    mean = total / n
    ends = np.array([first[:h].sum(0) + last[len(last) - h :].sum(0) for h in range(most + 1)])
    lags = np.arange(most + 1)[:, None]
    return n, mean, (products - mean * (2 * total - ends) + (n - lags) * mean**2) / n, last


def forecast(c: Curves, k: int = 3, steps: int = 1) -> np.ndarray:
    """Curves 1..steps ahead: an AR model for each score series of the components."""
    model = fpca(c, k)
    from curvelake.operators.reduce import scores

    n, mean, cov, last = autocovariances(scores(c, model), "scores", _most_lags(c.df.count()))
    out = np.zeros((steps, len(mean)))
    for j, mu in enumerate(mean):
        r = cov[:, j] / cov[0, j] if n * cov[0, j] > 1e-15 else np.zeros(len(cov))
        phi = _yule_walker(r, cov[0, j], n)
        past = list(last[:, j] - mu)
        for h in range(steps):
            x = sum(a * past[-1 - i] for i, a in enumerate(phi))
            past.append(x)
            out[h, j] = x + mu
    return model.rebuild(out)


def stationarity(c: Curves, n_perm: int = 200, seed: int = 1) -> tuple[float, float]:
    """KPSS-style norm of partial sums, with p by permuting rows."""
    x, = rows_of(c)
    w, n = c.weights, len(x)
    r = x - x.mean(0)
    stat = lambda y: float((np.cumsum(y, 0) ** 2 @ w).sum() / n**2)
    obs = stat(r)
    return obs, p_value(obs, replicates(c.df.sparkSession, n_perm, lambda g: stat(r[g.permutation(n)]), seed))
