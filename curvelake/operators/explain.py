"""Explanations of score-based models: effects, attributions, interactions, importance, stability.

A ``Scored`` table holds component scores and a response; its predictor is any function of
a matrix of scores, so linear, logistic and other models go through the same operators.
Effects are sums over the table (``apply.sums``), attributions one kernel per row.

Rows are permuted within buckets of about BUCKET rows drawn by a hash: each takes the value
of the next row of its bucket in a second hash's order, so no table is sorted in one task.
Replicates reweight rows by Poisson(1) draws seeded by replicate and id, and keep the basis.
Quantiles that cut bins are approximate above 10,000 rows (Spark's ``percentile_approx``).
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curvelake.functions import special
from curvelake.operators.apply import against, per_curve, sums

BUCKET = 4096
ACCURACY = 10_000
#: Coalitions are enumerated up to so many components, drawn beyond.
ENUMERATED = 12


@dataclass
class Scored:
    """df: id, scores (array of k), y; predict: a matrix of scores to predictions.

    coef (the linear predictor's slopes), intercept and loadings (points, k) where the
    model has them; ``classify`` compares predictions with 1/2 instead of by squares.
    """

    df: DataFrame
    predict: Callable[[np.ndarray], np.ndarray]
    k: int
    coef: np.ndarray | None = None
    intercept: float = 0.0
    loadings: np.ndarray | None = None
    classify: bool = False

    def __getstate__(self):
        return {**self.__dict__, "df": None}


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def linear(df: DataFrame, intercept: float, coef, loadings=None, logistic: bool = False) -> Scored:
    """A linear or logistic predictor with given coefficients."""
    coef = np.asarray(coef, float)

    def predict(s):
        eta = intercept + s @ coef
        return sigmoid(eta) if logistic else eta

    return Scored(df, predict, len(coef), coef, intercept, None if loadings is None else np.asarray(loadings, float), logistic)


def of_model(c, y: str, model) -> Scored:
    """The scores of a fitted ``regress.Linear`` or ``regress.Glm`` without covariates."""
    from curvelake.operators import regress

    table = regress._table(regress._unit(c), model.basis, []).select("id", "scores", F.col(y).cast("double").alias("y"))
    family = getattr(model, "family", "gaussian")
    k = model.basis.loadings.shape[1]
    out = linear(table, float(model.coef[0]), model.coef[1 : k + 1], model.basis.loadings, family == "binomial")
    if family in ("gaussian", "binomial"):
        return out
    inverse, coef = regress.FAMILIES[family][0], model.coef
    return replace(out, predict=lambda s: inverse(coef[0] + s @ coef[1 : k + 1]))


def _mean_scores(x: Scored) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, means, sums of squares over n - 1) of the scores."""
    n, s, ss = sums(x.df, lambda v: [np.array([len(v)]), v.sum(0), (v**2).sum(0)], ["scores"])
    return int(n[0]), s / n[0], ss / max(n[0] - 1, 1)


def _bounds(x: Scored, component: int) -> tuple[float, float]:
    v = F.col("scores")[component]
    low, high = x.df.agg(F.min(v), F.max(v)).first()
    return float(low), float(high) if abs(high - low) >= 1e-15 else float(low) + 1.0


def score_grid(x: Scored, component: int, n_grid: int) -> np.ndarray:
    return np.linspace(*_bounds(x, component), n_grid)


def _edges(df: DataFrame, column, n_bins: int) -> list[float]:
    """Cuts between n_bins bins of about equal counts, without the ends."""
    cuts = df.agg(F.percentile_approx(column, [b / n_bins for b in range(1, n_bins)], ACCURACY)).first()[0] if n_bins > 1 else []
    return sorted(set(map(float, cuts or [])))


# ---- effects ----


def dependence(x: Scored, component: int, n_grid: int = 20) -> tuple[np.ndarray, DataFrame, np.ndarray]:
    """(grid, id with ``ice``: predictions along the grid, their mean)."""
    grid = score_grid(x, component, n_grid)

    def ice(s):
        out = np.empty((len(s), n_grid))
        for g, value in enumerate(grid):
            moved = s.copy()
            moved[:, component] = value
            out[:, g] = x.predict(moved)
        return out

    n, total = sums(x.df, lambda s: [np.array([len(s)]), ice(s).sum(0)], ["scores"])
    return grid, per_curve(x.df.select("id", "scores"), ice, "ice array<double>", values="scores"), total / n[0]


def accumulated(x: Scored, component: int, n_bins: int = 10) -> list[tuple[float, float, float, int]]:
    """(lower edge, upper edge, effect, rows) of bins: mean changes of the prediction across
    bins, added up and centred by rows."""
    low, high = _bounds(x, component)
    edges = np.array([low, *[e for e in _edges(x.df, F.col("scores")[component], n_bins) if low < e < high], high])
    bins = len(edges) - 1

    def parts(s):
        b = np.clip(np.searchsorted(edges, s[:, component], "right") - 1, 0, bins - 1)
        up, down = s.copy(), s.copy()
        up[:, component], down[:, component] = edges[b + 1], edges[b]
        return [np.bincount(b, minlength=bins), np.bincount(b, x.predict(up) - x.predict(down), bins)]

    n, delta = sums(x.df, parts, ["scores"])
    effect = np.cumsum(delta / np.maximum(n, 1))
    effect -= (effect * n).sum() / n.sum()
    return [(float(edges[b]), float(edges[b + 1]), float(effect[b]), int(n[b])) for b in range(bins)]


def interaction(x: Scored, j: int, k: int, n_grid: int = 10) -> float:
    """Friedman's H squared of two components on grids of their ranges."""
    gj, gk = score_grid(x, j, n_grid), score_grid(x, k, n_grid)

    def parts(s):
        one, two, both = np.zeros(n_grid), np.zeros(n_grid), np.zeros((n_grid, n_grid))
        for a in range(n_grid):
            moved = s.copy()
            moved[:, j] = gj[a]
            one[a] = x.predict(moved).sum()
            for b in range(n_grid):
                moved[:, k] = gk[b]
                both[a, b] = x.predict(moved).sum()
            moved = s.copy()
            moved[:, k] = gk[a]
            two[a] = x.predict(moved).sum()
        return [np.array([len(s)]), x.predict(s).sum()[None], one, two, both]

    n, whole, one, two, both = sums(x.df, parts, ["scores"])
    mean = whole[0] / n[0]
    both, one, two = both / n[0], one / n[0], two / n[0]
    spread = ((both - mean) ** 2).sum()
    return float(((both - one[:, None] - two[None] + mean) ** 2).sum() / spread) if spread > 0 else 0.0


# ---- attributions ----


def linear_attributions(x: Scored) -> DataFrame:
    """id, values: slope times distance from the mean score, the exact attribution of a linear model."""
    _, mean, _ = _mean_scores(x)
    return per_curve(x.df.select("id", "scores"), lambda s: (s - mean) * x.coef, "values array<double>", values="scores")


def _coalitions(k: int, n_samples: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Coalitions (0/1) and their weights: all proper ones with the weight they would have on
    average in draws of a uniform size, or such draws."""
    kernel = lambda s: (k - 1) / (math.comb(k, s) * s * (k - s)) if 0 < s < k else 1e6
    if k == 1:
        return np.ones((1, 1)), np.ones(1)
    if k <= ENUMERATED:
        sets = np.array([m for m in itertools.product((0.0, 1.0), repeat=k) if 0 < sum(m) < k])
        size = sets.sum(1).astype(int)
        return sets, np.array([kernel(s) / math.comb(k, s) for s in size])
    r = np.random.default_rng(seed)
    size = r.integers(1, k, n_samples)
    sets = (np.argsort(r.random((n_samples, k)), 1).argsort(1) < size[:, None]).astype(float)
    return sets, np.array([kernel(s) for s in size])


def attribution_kernel(x: Scored, n_samples: int = 1000, seed: int = 1):
    """scores -> values: weighted least squares of coalition predictions, absent scores at their means."""
    _, mean, _ = _mean_scores(x)
    sets, weight = _coalitions(x.k, n_samples, seed)
    solve = np.linalg.solve(sets.T @ (sets * weight[:, None]) + 1e-10 * np.eye(x.k), sets.T * weight)
    base = x.predict(mean[None])[0]

    def values(s):
        y = np.stack([x.predict(np.where(m > 0, s, mean)) for m in sets], 1) - base
        return y @ solve.T

    return values


def attributions(x: Scored, n_samples: int = 1000, seed: int = 1) -> DataFrame:
    """id, values: kernel SHAP values of any predictor."""
    return per_curve(x.df.select("id", "scores"), attribution_kernel(x, n_samples, seed), "values array<double>", values="scores")


def saliency(x: Scored, how: str = "linear", n_samples: int = 1000, seed: int = 1) -> tuple[DataFrame, np.ndarray]:
    """(id, saliency by point; its mean modulus): attributions carried back by the loadings.

    how: linear, gradient (of a logistic predictor) or shap (any predictor).
    """
    if how == "gradient":
        beta = x.loadings @ x.coef
        kernel = lambda s: (lambda p: (p * (1 - p))[:, None] * beta)(x.predict(s))
    elif how == "shap":
        values = attribution_kernel(x, n_samples, seed)
        kernel = lambda s: values(s) @ x.loadings.T
    else:
        _, mean, _ = _mean_scores(x)
        kernel = lambda s: ((s - mean) * x.coef) @ x.loadings.T
    n, total = sums(x.df, lambda s: [np.array([len(s)]), np.abs(kernel(s)).sum(0)], ["scores"])
    return per_curve(x.df.select("id", "scores"), kernel, "saliency array<double>", values="scores"), total / n[0]


def local_surrogate(x: Scored, n_samples: int = 200, width: float = 1.0, seed: int = 1) -> DataFrame:
    """id, intercept, slopes, r2: a line fitted to predictions around each row, points drawn
    with the scores' deviations (seed plus id) and weighted by distance."""
    n, mean, ss = _mean_scores(x)
    sd = np.sqrt(np.maximum(ss - mean**2 * n / max(n - 1, 1), 0))

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for i, s in zip(pdf["id"], pdf["scores"], strict=True):
                away = np.random.default_rng(seed + int(i)).standard_normal((n_samples, x.k)) * sd
                y = x.predict(np.asarray(s, float) + away)
                w = np.exp(-(away**2).sum(1) / (2 * width * width))
                d = np.hstack([np.ones((n_samples, 1)), away])
                b = np.linalg.solve(d.T @ (d * w[:, None]) + 1e-10 * np.eye(x.k + 1), d.T @ (w * y))
                total = (w * (y - np.average(y, weights=w)) ** 2).sum()
                rows.append((int(i), float(b[0]), b[1:].tolist(), float(np.clip(1 - (w * (y - d @ b) ** 2).sum() / total, 0, 1)) if total > 0 else 0.0))
            yield pd.DataFrame(rows, columns=["id", "intercept", "slopes", "r2"])

    return x.df.select("id", "scores").mapInPandas(run, "id long, intercept double, slopes array<double>, r2 double")


# ---- importance ----


def _shuffled(df: DataFrame, n: int, by: list, seed: int, *columns: str) -> DataFrame:
    """df with new_<column>: the values of the row that follows in a hash order of its bucket."""
    buckets = max(1, -(-n // BUCKET))
    keyed = df.withColumn("_bucket", F.pmod(F.xxhash64(F.lit(seed), "id", *by), F.lit(buckets)))
    order = Window.partitionBy(*by, "_bucket").orderBy(F.xxhash64(F.lit(seed + 1), "id", *by), "id")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return keyed.select(*df.columns, *[F.coalesce(F.lead(c).over(order), F.first(c).over(whole)).alias(f"new_{c}") for c in columns])


def _metric(x: Scored, total: np.ndarray, n: float, sst: float) -> np.ndarray:
    """R squared from squared errors, or accuracy from hits."""
    return total / n if x.classify else 1 - total / sst


def _loss(x: Scored, s, y):
    p = x.predict(s)
    return ((p >= 0.5) == (y > 0.5)).astype(float) if x.classify else (y - p) ** 2


def _baseline(x: Scored) -> tuple[float, float, float]:
    n, sy, syy, loss = sums(x.df, lambda s, y: [np.array([v]) for v in (len(y), y.sum(), (y**2).sum(), _loss(x, s, y).sum())], ["scores", "y"])
    sst = float(syy[0] - sy[0] ** 2 / n[0])
    return float(n[0]), sst, float(_metric(x, loss, n[0], sst)[0])


def permutation_importance(x: Scored, n_perm: int = 10, seed: int = 1, n_bins: int = 0) -> list[tuple[int, float, float]]:
    """(component, importance, mean permuted metric): the fall of R squared (of accuracy) when a
    component's scores are permuted; with n_bins, among rows whose other scores add up alike."""
    n, sst, base = _baseline(x)
    df = x.df.select("id", "scores", "y").crossJoin(F.broadcast(x.df.sparkSession.range(n_perm * x.k).select((F.col("id") / x.k).cast("int").alias("rep"), (F.col("id") % x.k).cast("int").alias("component"))))  # replicates: a parameter
    df = df.withColumn("own", F.get("scores", F.col("component")))
    by = ["rep", "component"]
    if n_bins > 1:
        rest = lambda j: F.aggregate("scores", F.lit(0.0), lambda a, v: a + F.abs(v)) - F.abs(F.col("scores")[j])
        cuts = [[float(c) for c in _edges(x.df, rest(j), n_bins)] for j in range(x.k)]
        bin_of = F.coalesce(*[F.when(F.col("component") == j, F.size(F.filter(F.lit(c), lambda e, j=j: e <= rest(j)))) for j, c in enumerate(cuts) if c], F.lit(0))
        df, by = df.withColumn("bin", bin_of), [*by, "bin"]
    df = _shuffled(df, int(n), by, seed, "own")

    def parts(s, y, j, rep, new):
        moved, j = s.copy(), j.astype(int)
        moved[np.arange(len(s)), j] = new
        return [np.bincount(j, _loss(x, moved, y), x.k)]

    loss = sums(df, parts, ["scores", "y", "component", "rep", "new_own"])[0] / n_perm
    after = _metric(x, loss, n, sst)
    return [(j, base - float(after[j]), float(after[j])) for j in range(x.k)]


def pointwise_importance(x: Scored) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(importance by point, shares of their sum, by component and point): squared slope times
    loading, times the score's variance."""
    _, _, variance = _mean_scores(x)
    parts = (x.coef[:, None] * x.loadings.T) ** 2 * variance[:, None]
    total = parts.sum(0)
    return total, total / total.sum() if total.sum() > 0 else total, parts


def variance_shares(x: Scored) -> list[tuple[int, float]]:
    """(component, share of the response's variance) of a linear model; first and total are the same."""
    n, sst, _ = _baseline(x)
    _, _, variance = _mean_scores(x)
    return [(j, float(x.coef[j] ** 2 * variance[j] / (sst / (n - 1)))) for j in range(x.k)]


def sobol(x: Scored, seed: int = 1) -> list[tuple[int, float, float]]:
    """(component, first-order, total): every row is once the first sample, a permuted one the second."""
    n, _, _ = _mean_scores(x)
    df = _shuffled(x.df.select("id", "scores"), n, [], seed, "scores")

    def parts(a, b):
        fa, fb = x.predict(a), x.predict(b)
        first, total = np.empty(x.k), np.empty(x.k)
        for j in range(x.k):
            mixed = a.copy()
            mixed[:, j] = b[:, j]
            fm = x.predict(mixed)
            first[j], total[j] = (fb * (fm - fa)).sum(), ((fa - fm) ** 2).sum()
        return [np.array([fa.sum(), (fa**2).sum()]), first, total]

    (s, ss), first, total = sums(df, parts, ["scores", "new_scores"])
    variance = ss / n - (s / n) ** 2
    return [(j, float(first[j] / n / variance), float(total[j] / (2 * n * variance))) for j in range(x.k)] if variance > 0 else [(j, 0.0, 0.0) for j in range(x.k)]


# ---- intervals of the domain ----


def important_intervals(beta, width: int, threshold: float) -> list[tuple[int, int, float]]:
    """(first, last, importance): windows that hold at least ``threshold`` of the squared
    coefficient, overlapping and touching ones joined and added up, the greatest first."""
    share = np.asarray(beta, float) ** 2
    if not 0 < width <= len(share) or threshold <= 0:
        raise ValueError("a window has to fit and the threshold to be positive")
    mass = np.convolve(share, np.ones(width), "valid")
    out: list[list] = []
    for a in np.flatnonzero(mass >= threshold * share.sum()) if share.sum() > 0 else []:
        if out and a <= out[-1][1] + 1:
            out[-1][1], out[-1][2] = int(a) + width - 1, out[-1][2] + float(mass[a])
        else:
            out.append([int(a), int(a) + width - 1, float(mass[a])])
    return sorted((tuple(x) for x in out), key=lambda x: -x[2])


def significant_regions(lower, upper) -> list[tuple[int, int, int]]:
    """(first, last, sign): maximal runs of points whose interval leaves out zero on one side."""
    sign = np.where(np.asarray(lower) > 0, 1, np.where(np.asarray(upper) < 0, -1, 0))
    cut = np.flatnonzero(np.diff(sign, prepend=2, append=2))
    return [(int(a), int(b) - 1, int(sign[a])) for a, b in itertools.pairwise(cut) if sign[a]]


def significant_from_errors(beta, se, z: float = 1.96) -> list[tuple[int, int, int]]:
    beta, se = np.asarray(beta, float), np.asarray(se, float)
    return significant_regions(beta - z * se, beta + z * se)


def beta_parts(x: Scored) -> tuple[np.ndarray, np.ndarray]:
    """(components, points) of the coefficient function, and each one's share of squared slopes."""
    return x.coef[:, None] * x.loadings.T, x.coef**2 / max(float((x.coef**2).sum()), 1e-300)


# ---- diagnostics ----


def variance_inflation(x: Scored) -> list[tuple[int, float]]:
    """(component, VIF): the diagonal of the inverse correlation of the scores."""
    n, mean, _ = _mean_scores(x)
    scatter = sums(x.df, lambda s: [(s - mean).T @ (s - mean)], ["scores"])[0]
    sd = np.sqrt(np.maximum(np.diag(scatter), 1e-300))
    return [(j, float(v)) for j, v in enumerate(np.diag(np.linalg.inv(scatter / np.outer(sd, sd))))]


def _design(s):
    return np.hstack([np.ones((len(s), 1)), s])


def _gram(x: Scored) -> tuple[int, np.ndarray, float]:
    """(n, inverse of X'X with an intercept, residual variance) of a linear model."""
    n, xx, rss = sums(x.df, lambda s, y: [np.array([len(y)]), _design(s).T @ _design(s), np.array([((y - x.predict(s)) ** 2).sum()])], ["scores", "y"])
    return int(n[0]), np.linalg.inv(xx), float(rss[0] / max(n[0] - x.k - 1, 1))


def deletion_effects(x: Scored) -> DataFrame:
    """id, dfbetas (intercept first), dffits of a linear model."""
    n, inv, s2 = _gram(x)
    p, root = x.k + 1, np.sqrt(np.diag(inv))
    packed = x.df.select("id", F.concat("scores", F.array("y")).alias("row"))

    def kernel(row):
        d, r = _design(row[:, :-1]), row[:, -1] - x.predict(row[:, :-1])
        lev = np.einsum("np,pq,nq->n", d, inv, d)
        own = np.sqrt(np.maximum((s2 * (n - p) - r**2 / (1 - lev)) / (n - p - 1), 1e-300))
        return (d @ inv) * (r / (1 - lev) / own)[:, None] / root, r / (own * np.sqrt(1 - lev)) * np.sqrt(lev / (1 - lev))

    return per_curve(packed, kernel, "dfbetas array<double>, dffits double", values="row")


def t_quantile(p: float, df: float) -> float:
    """Quantile of Student's t for p above 1/2, from the F distribution of its square."""
    low, high = 0.0, 1e4
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 0.5 + special.f_cdf(mid * mid, 1, df) / 2 < p else (low, mid)
    return (low + high) / 2


def prediction_intervals(x: Scored, new: DataFrame, level: float = 0.95) -> DataFrame:
    """new (id, scores) with fit, low, high of a linear model."""
    n, inv, s2 = _gram(x)
    t = t_quantile((1 + level) / 2, n - x.k - 1)

    def kernel(s):
        d, fit = _design(s), x.predict(s)
        half = t * np.sqrt(s2 * (1 + np.einsum("np,pq,nq->n", d, inv, d)))
        return fit, fit - half, fit + half

    return per_curve(new.select("id", "scores"), kernel, "fit double, low double, high double", values="scores")


def left_out(x: Scored) -> tuple[float, float]:
    """(PRESS, R squared of leave-one-out predictions) of a linear model, by leverage."""
    _, inv, _ = _gram(x)

    def parts(s, y):
        d = _design(s)
        e = (y - x.predict(s)) / (1 - np.einsum("np,pq,nq->n", d, inv, d))
        return [np.array([len(y), y.sum(), (y**2).sum(), (e**2).sum()])]

    n, sy, syy, press = sums(x.df, parts, ["scores", "y"])[0]
    return float(press), float(1 - press / (syy - sy * sy / n))


def calibration(x: Scored, n_groups: int = 10) -> tuple[dict[str, float], list[tuple[int, float, float]]]:
    """(Brier score, log loss, Hosmer-Lemeshow statistic; rows, mean prediction and mean response
    of groups of about equal counts by prediction)."""
    p = per_curve(x.df.select("id", "scores", "y"), lambda s: x.predict(s), "p double", values="scores").drop("scores")
    cuts = np.array(_edges(p, F.col("p"), n_groups))
    groups = len(cuts) + 1

    def parts(v, y):
        g = np.searchsorted(cuts, v, "right")
        q = np.clip(v, 1e-15, 1 - 1e-15)
        loss = -(y * np.log(q) + (1 - y) * np.log(1 - q))
        return [np.array([len(y), ((v - y) ** 2).sum(), loss.sum()]), np.bincount(g, minlength=groups), np.bincount(g, v, groups), np.bincount(g, y, groups)]

    (n, brier, loss), count, sp, sy = sums(p, parts, ["p", "y"])
    held = count > 0
    expected, share = sp[held], sp[held] / count[held]
    chi = (sy[held] - expected) ** 2 / np.maximum(count[held] * share * (1 - share), 1e-15)
    return {"brier": brier / n, "log_loss": loss / n, "hosmer_lemeshow": float(chi.sum())}, [(int(c), float(a / c), float(b / c)) for c, a, b in zip(count[held], sp[held], sy[held], strict=True)]


def calibration_error(x: Scored, n_bins: int = 10) -> dict[str, float]:
    """ece and mce over bins of equal width, ace over groups of about equal counts."""
    def parts(s, y):
        v = x.predict(s)
        b = np.minimum((v * n_bins).astype(int), n_bins - 1)
        return [np.bincount(b, minlength=n_bins), np.bincount(b, v, n_bins), np.bincount(b, y, n_bins)]

    n, sp, sy = sums(x.df, parts, ["scores", "y"])
    gap = np.abs(sp - sy) / np.maximum(n, 1)
    ace = sum(c * abs(a - b) for c, a, b in calibration(x, n_bins)[1])
    return {"ece": float((gap * n).sum() / n.sum()), "mce": float(gap.max()), "ace": ace / float(n.sum())}


# ---- resampling ----


def bootstrap(x: Scored, n_boot: int = 100, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients, intercept first; R squared or accuracy) of n_boot refits on Poisson weights."""
    def weights(ids):
        return np.stack([np.random.default_rng([seed, int(i)]).poisson(1.0, n_boot) for i in ids]).astype(float)

    def normal(s, y, ids, coef=None):
        d, w = _design(s), weights(ids)
        if coef is None:
            return [np.einsum("nb,np,nq->bpq", w, d, d), np.einsum("nb,np,n->bp", w, d, y)]
        mu = sigmoid(d @ coef.T)
        var = np.maximum(mu * (1 - mu), 1e-10)
        z = d @ coef.T + (y[:, None] - mu) / var
        return [np.einsum("nb,np,nq->bpq", w * var, d, d), np.einsum("nb,np->bp", w * var * z, d)]

    columns, p = ["scores", "y", "id"], x.k + 1
    df = x.df.withColumn("id", F.col("id").cast("double"))
    coef = None
    for _ in range(8 if x.classify else 1):
        start = np.zeros((n_boot, p)) if coef is None and x.classify else coef
        xx, xy = sums(df, lambda s, y, i, start=start: normal(s, y, i, start), columns)
        coef = np.linalg.solve(xx + 1e-10 * np.eye(p), xy[..., None])[..., 0]

    def score(s, y, ids):
        w, fit = weights(ids), _design(s) @ coef.T
        hit = ((fit >= 0) == (y[:, None] > 0.5)) if x.classify else (y[:, None] - fit) ** 2
        return [w.sum(0), (w * y[:, None]).sum(0), (w * y[:, None] ** 2).sum(0), (w * hit).sum(0)]

    n, sy, syy, loss = sums(df, score, columns)
    return coef, loss / n if x.classify else 1 - loss / (syy - sy**2 / n)


def _ranks(v: np.ndarray) -> np.ndarray:
    order, out = np.argsort(v, kind="stable"), np.empty(len(v))
    out[order] = np.arange(1, len(v) + 1)
    return np.array([out[np.abs(v - a) < 1e-15].mean() for a in v])


def stability(x: Scored, n_boot: int = 100, seed: int = 1) -> dict:
    """Spread over refits: beta_std and beta_cv by point, coef_std, metric_std, and the mean
    Spearman correlation of the components' ranks by modulus of slope."""
    coef, metric = bootstrap(x, n_boot, seed)
    beta = coef[:, 1:] @ x.loadings.T
    mean, std = beta.mean(0), beta.std(0, ddof=1)
    ranks = np.array([_ranks(v) for v in np.abs(coef[:, 1:])])
    ranks -= ranks.mean(1, keepdims=True)
    norm = np.linalg.norm(ranks, axis=1, keepdims=True)
    r = ranks / np.where(norm > 1e-12, norm, 1)
    pairs = (r @ r.T)[np.triu_indices(n_boot, 1)]
    return {"beta_std": std, "beta_cv": np.where(np.abs(mean) > 1e-15, std / np.maximum(np.abs(mean), 1e-300), 0.0), "coef_std": coef[:, 1:].std(0, ddof=1), "metric_std": float(metric.std(ddof=1)), "rank_stability": float(pairs.mean())}


def regression_depth(x: Scored, n_boot: int = 100, seed: int = 1) -> tuple[float, DataFrame]:
    """(depth of the slopes among refits; id, depth of the scores), both Fraiman-Muniz."""
    from curvelake.operators import depth
    from curvelake.sources.curves import Curves

    boot = bootstrap(x, n_boot, seed)[0][:, 1:]
    share = (boot <= x.coef).mean(0)
    scores = Curves(x.df.select("id", F.col("scores").alias("values")), np.arange(x.k, dtype=float))
    return float(np.minimum(share, 1 - share).mean()), depth.fraiman_muniz(scores)


# ---- examples ----


def counterfactual(x: Scored, target: float) -> DataFrame:
    """id, delta (of the scores), distance: the least move that takes a linear model to a target."""
    norm = float(x.coef @ x.coef)

    def kernel(s):
        delta = ((target - x.predict(s)) / max(norm, 1e-300))[:, None] * x.coef
        return delta, np.linalg.norm(delta, axis=1)

    return per_curve(x.df.select("id", "scores"), kernel, "delta array<double>, distance double", values="scores")


def flip(x: Scored, max_iter: int = 200, step: float = 0.1) -> DataFrame:
    """id, delta, distance, flipped: steps along the slopes until a logistic prediction changes class."""
    def kernel(s):
        start = x.predict(s) >= 0.5
        now, done = s.copy(), np.zeros(len(s), bool)
        for _ in range(max_iter):
            p = x.predict(now)
            done = (p >= 0.5) != start
            if done.all():
                break
            slope = (p * (1 - p))[:, None] * x.coef
            now = np.where(done[:, None], now, now + step * np.where(start, -1.0, 1.0)[:, None] * slope / np.maximum(np.linalg.norm(slope, axis=1, keepdims=True), 1e-12))
        return now - s, np.linalg.norm(now - s, axis=1), (x.predict(now) >= 0.5) != start

    return per_curve(x.df.select("id", "scores"), kernel, "delta array<double>, distance double, flipped boolean", values="scores")


def search(x: Scored, target: float, max_iter: int = 200, step: float = 0.1, tol: float = 1e-3) -> DataFrame:
    """id, delta, distance, reached: gradient steps of any predictor towards a target value."""
    def kernel(s):
        now = s.copy()
        for _ in range(max_iter):
            gap = target - x.predict(now)
            if (np.abs(gap) <= tol).all():
                break
            slope = np.stack([(x.predict(now + 1e-5 * e) - x.predict(now - 1e-5 * e)) / 2e-5 for e in np.eye(x.k)], 1)
            move = gap[:, None] * slope / np.maximum((slope**2).sum(1, keepdims=True), 1e-12)
            size = np.linalg.norm(move, axis=1, keepdims=True)
            now = now + np.where((np.abs(gap) > tol)[:, None], move * np.minimum(1, step / np.maximum(size, 1e-12)), 0)
        return now - s, np.linalg.norm(now - s, axis=1), np.abs(target - x.predict(now)) <= tol

    return per_curve(x.df.select("id", "scores"), kernel, "delta array<double>, distance double, reached boolean", values="scores")


def prototypes(x: Scored, n_prototypes: int = 5, n_criticisms: int = 5, bandwidth: float | None = None) -> list[tuple[str, int, int, float]]:
    """(kind, rank, id, witness): greedy prototypes of the score distribution by kernel mean
    discrepancy, and the rows they represent least. Without a bandwidth, the median distance of
    2,000 rows drawn by a hash."""
    from curvelake.operators.apply import matrix

    table = x.df.select("id", F.col("scores").alias("values"))
    if bandwidth is None:
        v = matrix(table.orderBy(F.xxhash64("id")).limit(2000).select("values").toArrow().column(0))
        d = np.sqrt(np.maximum(((v[:, None] - v[None]) ** 2).sum(2), 0))[np.triu_indices(len(v), 1)]
        bandwidth = max(float(np.sort(d)[len(d) // 2]), 1e-10) if len(d) else 1.0
    h = 2 * bandwidth**2
    kernel = lambda a, b: np.exp(-np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T, 0) / h)
    n = table.count()
    mu = against(table, table, lambda a, b: kernel(a, b).sum(1), "total double").select("id", (F.col("total") / n).alias("mu"))
    state = table.join(mu, "id").persist()
    try:
        chosen: list[tuple[int, np.ndarray]] = []

        def near(points) -> F.Column:
            total = F.lit(0.0)
            for p in points:
                gap = F.aggregate(F.zip_with("values", F.lit([float(u) for u in p]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b)
                total = total + F.exp(-gap / h)
            return total / max(len(points), 1)

        for _ in range(n_prototypes):
            gain = 2 * F.col("mu") - near([p for _, p in chosen])
            left = state.where(~F.col("id").isin([i for i, _ in chosen])) if chosen else state
            best = left.agg(F.max_by(F.struct("id", "values"), F.struct(gain, -F.col("id"))).alias("b")).first()["b"]
            chosen.append((best["id"], np.array(best["values"])))
        seen = state.withColumn("witness", F.col("mu") - near([p for _, p in chosen]))
        ids = [i for i, _ in chosen]
        own = {r["id"]: r["witness"] for r in seen.where(F.col("id").isin(ids)).select("id", "witness").collect()}
        worst = seen.where(~F.col("id").isin(ids)).orderBy(F.desc(F.abs("witness")), "id").limit(n_criticisms).select("id", "witness").collect()
    finally:
        state.unpersist()
    return [("prototype", k, i, float(own[i])) for k, i in enumerate(ids)] + [("criticism", k, r["id"], float(r["witness"])) for k, r in enumerate(worst)]


def anchor(x: Scored, observation: int, precision: float = 0.95, n_bins: int = 4, tolerance: float | None = None) -> tuple[list[tuple[int, float, float]], float, float]:
    """(conditions (component, low, high), precision, coverage): score bins of one row, added one
    by one by precision, under which predictions agree with its own.

    Predictions agree when their classes do, or within ``tolerance`` (a deviation of the
    predictions where none is given).
    """
    cuts = [_edges(x.df, F.col("scores")[j], n_bins) for j in range(x.k)]
    row = np.array(x.df.where(F.col("id") == observation).select("scores").first()["scores"], float)
    own = x.predict(row[None])[0]
    if not x.classify and tolerance is None:
        n, s, ss = sums(x.df, lambda v: [np.array([len(v)]), x.predict(v).sum()[None], (x.predict(v) ** 2).sum()[None]], ["scores"])
        tolerance = math.sqrt(max(float(ss[0] / n[0] - (s[0] / n[0]) ** 2), 0))
    ranges = []
    for j, c in enumerate(cuts):
        b = int(np.searchsorted(c, row[j], "right"))
        ranges.append(([-math.inf, *c][b], [*c, math.inf][b]))
    chosen: list[int] = []
    best = (0.0, 1.0)
    while len(chosen) < x.k:
        left = [j for j in range(x.k) if j not in chosen]

        def parts(s, left=left, chosen=tuple(chosen)):
            p = x.predict(s)
            same = (p >= 0.5) == (own >= 0.5) if x.classify else np.abs(p - own) <= tolerance
            inside = np.stack([(s[:, j] >= lo) & (s[:, j] < hi) for j, (lo, hi) in enumerate(ranges)], 1)
            held = inside[:, list(chosen)].all(1)[:, None] & inside[:, left]
            return [np.array([len(s)]), held.sum(0), (held & same[:, None]).sum(0)]

        n, held, same = sums(x.df, parts, ["scores"])
        share = np.where(held > 0, same / np.maximum(held, 1), -1)
        at = int(np.argmax(share))
        if share[at] < 0:
            break
        chosen.append(left[at])
        best = (float(share[at]), float(held[at] / n[0]))
        if best[0] >= precision:
            break
    return [(j, *ranges[j]) for j in chosen], *best
