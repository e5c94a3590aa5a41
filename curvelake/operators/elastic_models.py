"""Elastic regression: a slope on the domain and a warp of every curve, fitted in turn.

A curve enters by its SRSF q; its predictor is alpha + integral of (q o g) sqrt(g') beta
for its warp g.  Given the slope, a curve's best warp depends on that curve alone, so a
round is one kernel over the table; given the warps, the slope needs sums of the size of
its basis only.  Warps are never carried from round to round: each round makes them from
the base table and the last slope, so no plan grows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvelake.functions import numeric as nm
from curvelake.operators import elastic, smooth
from curvelake.operators.apply import held, per_curve, sums
from curvelake.operators.explain import sigmoid
from curvelake.sources.curves import Curves

HALVINGS = 20


def warped(q: np.ndarray, g: np.ndarray, t: np.ndarray) -> np.ndarray:
    """(q o g) sqrt(g') of each row."""
    slope = np.maximum(np.array([nm.gradient(x, t) for x in g]), 0)
    return np.array([np.interp(x, t, y) for x, y in zip(g, q, strict=True)]) * np.sqrt(slope)


def _centred(t, w: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Warps composed with the inverse of their mean."""
    return np.array([elastic.compose(x, w, t) for x in g])


def _mean_inverse(df: DataFrame, t: np.ndarray, column: str = "warp", tol: float = 1e-6) -> np.ndarray:
    """Inverse of the Karcher mean of a column of warps (as square-root slopes on the sphere)."""
    u = (t - t[0]) / (t[-1] - t[0])
    roots = per_curve(df.select(column), lambda g: np.array([elastic.psi((x - t[0]) / (t[-1] - t[0]), u) for x in g]), "psi array<double>", values=column)
    with held(roots) as roots:
        n, total = sums(roots, lambda p: [np.array([len(p)]), p.sum(0)], ["psi"])
        mu = total / n[0]
        mu = mu / np.sqrt(max(float(nm.trapz(mu * mu, u)), 1e-15))
        for _ in range(20):
            v = sums(roots, lambda p, mu=mu: [np.sum([elastic.sphere_log(mu, x, u) for x in p], 0)], ["psi"])[0] / n[0]
            if np.sqrt(float(nm.trapz(v * v, u))) < tol:
                break
            mu = elastic.sphere_exp(mu, v, u)
    return t[0] + (t[-1] - t[0]) * elastic.invert(elastic.psi_to_warp(mu, u), u)


def _moved(new: np.ndarray, old: np.ndarray) -> float:
    return float(np.linalg.norm(new - old) / max(np.linalg.norm(old), 1e-10))


# ---- a scalar response ----


@dataclass
class ElasticRegression:
    alpha: float
    beta: np.ndarray
    grid: np.ndarray
    fitted: DataFrame | None  # id, y, warp, fit of the training rows
    r2: float
    n_iter: int

    def predict(self, c: Curves) -> DataFrame:
        """All columns but values, with fit: new curves are taken as they are, without a warp."""
        t, a, b = self.grid, self.alpha, self.beta * nm.simpson_weights(self.grid)
        return per_curve(c.df, lambda v: elastic.srsf(v, t) @ b + a, "fit double")


def _toward(q, beta, alpha, y, t, lam) -> np.ndarray:
    """The warp of each row whose prediction is nearest to y: between the warps to beta and to
    -beta, by bisection."""
    w = beta * nm.simpson_weights(t)
    predict = lambda g: warped(q, g, t) @ w + alpha
    many = np.repeat(beta[None], len(q), 0)
    up, down = elastic.warp_dp_many(many, q, t, lam), elastic.warp_dp_many(-many, q, t, lam)
    at_up, at_down = predict(up), predict(down)
    swap = (at_up >= at_down)[:, None]
    low, high = np.where(swap, down, up), np.where(swap, up, down)
    out, open_ = (low + high) / 2, np.ones(len(q), bool)
    for found, at in ((down, at_down), (up, at_up)):
        hit = np.abs(at - y) < 1e-10
        out[hit], open_[hit] = found[hit], False
    for _ in range(15):
        middle = (low + high) / 2
        at = predict(middle)
        out[open_] = middle[open_]
        open_ &= np.abs(at - y) >= 1e-6
        under = (at < y)[:, None]
        low, high = np.where(under, middle, low), np.where(under, high, middle)
    out[open_] = ((low + high) / 2)[open_]
    return out


def regression(c: Curves, y: str, nbasis: int = 10, lam: float = 0.0, max_iter: int = 20, tol: float = 1e-4) -> ElasticRegression:
    """Scalar response on warped SRSFs; the slope in cubic splines with a roughness penalty.

    The warp of a curve is where its prediction meets its response, between the two extremes
    that the slope allows; warps are centred each round.
    """
    t = c.grid
    weights = nm.simpson_weights(t)
    knots = max(nbasis - 4, 2)
    basis, penalty = nm.bspline_basis(t, knots, 4), smooth.bspline_penalty(t, knots, 4, 2)
    with held(c.df.select("id", F.col(y).cast("double").alias("y"), "values")) as base:
        n, s, ss = sums(base, lambda v: [np.array([len(v)]), np.array([v.sum()]), np.array([(v**2).sum()])], ["y"])
        alpha, beta = s[0] / n[0], np.zeros(len(t))
        turned = base.withColumn("warp", F.lit([float(x) for x in t]))
        kept = None
        for step in range(max_iter):
            def parts(v, g, r):
                phi = warped(elastic.srsf(v, t), g, t) @ (basis * weights[:, None])
                return [phi.T @ phi, phi.T @ r, phi.sum(0)]

            xx, xy, x = sums(turned, parts, ["values", "warp", "y"])
            coef = _solve(xx + lam * penalty, xy - alpha * x)
            new = basis @ coef
            alpha = (s[0] - x @ coef) / n[0]
            stop, beta = _moved(new, beta) < tol and step > 0, new
            if stop or step == max_iter - 1 and max_iter > 1:
                break
            turned, kept = _turned(base, t, beta, alpha, lam, kept)
        w = beta * weights
        fitted = per_curve(turned.select("id", "y", "warp", F.concat("values", "warp").alias("_v")), lambda v: warped(elastic.srsf(v[:, : len(t)], t), v[:, len(t) :], t) @ w + alpha, "fit double", values="_v").persist()
        sse = sums(fitted, lambda r, f: [np.array([((r - f) ** 2).sum()])], ["y", "fit"])[0][0]
        if kept is not None:
            kept.unpersist()
    total = ss[0] - s[0] ** 2 / n[0]
    return ElasticRegression(float(alpha), beta, t, fitted, float(1 - sse / total) if total > 0 else 0.0, step + 1)


def _solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.solve(np.linalg.cholesky(a).T, np.linalg.solve(np.linalg.cholesky(a), b))
    except np.linalg.LinAlgError:
        return np.linalg.lstsq(a, b, rcond=1e-10)[0]


def _turned(base: DataFrame, t, beta, alpha, lam, before: DataFrame | None):
    """base with centred warps to the slope, and what is kept in memory of it."""
    def kernel(v):
        curves, y = v[:, :-1], v[:, -1]
        return _toward(elastic.srsf(curves, t), beta, alpha, y, t, 0.01 * lam)

    kept = per_curve(base.select("id", "y", "values", F.concat("values", F.array("y")).alias("_v")), kernel, "raw array<double>", values="_v").persist()
    inverse = _mean_inverse(kept, t, "raw")
    if before is not None:
        before.unpersist()
    return per_curve(kept, lambda g: _centred(t, inverse, g), "warp array<double>", values="raw"), kept


@dataclass
class ElasticComponents:
    """Least squares on amplitude components about a template; new curves are aligned to it."""

    coef: np.ndarray  # intercept and slopes
    template: np.ndarray
    mean: np.ndarray
    vectors: np.ndarray
    grid: np.ndarray
    options: dict

    def predict(self, c: Curves) -> DataFrame:
        t, b, template, mean, vectors, options = self.grid, self.coef, self.template, self.mean, self.vectors, self.options
        return per_curve(c.df, lambda v: _amplitudes(v, template, mean, vectors, t, options) @ b[1:] + b[0], "fit double")


def _amplitudes(v, template, mean, vectors, t, options) -> np.ndarray:
    y = elastic.align_many(np.repeat(template[None], len(v), 0), v, t, **options)[1]
    mid = y[:, len(t) // 2]
    return (np.hstack([elastic.srsf(y, t), (np.sign(mid) * np.sqrt(np.abs(mid)))[:, None]]) - mean) @ vectors


def component_model(c: Curves, y: str, k: int = 3, max_iter: int = 20, tol: float = 1e-4, **options) -> ElasticComponents:
    """y on the scores of the first k amplitude components of curves aligned to their Karcher mean."""
    t = c.grid
    template = elastic.karcher_mean(c, max_iter, tol, **options)
    with held(elastic.align_to(c.with_df(c.df.select("id", F.col(y).cast("double").alias("y"), "values")), template, **options)) as aligned:
        mean, vectors, _ = elastic.vertical_fpca(aligned, t, k)
        mid = len(t) // 2

        def parts(v, r):
            x = np.hstack([elastic.srsf(v, t), (np.sign(v[:, mid]) * np.sqrt(np.abs(v[:, mid])))[:, None]])
            x = np.hstack([np.ones((len(v), 1)), (x - mean) @ vectors])
            return [x.T @ x, x.T @ r]

        xx, xy = sums(aligned, parts, ["aligned", "y"])
    return ElasticComponents(_solve(xx + 1e-10 * np.eye(len(xx)), xy), template, mean, vectors, t, options)


# ---- classes ----


@dataclass
class ElasticLogistic:
    """One slope for each class against the others; a single one for a two-class response."""

    classes: list
    alpha: np.ndarray
    beta: np.ndarray  # (classes, points)
    grid: np.ndarray
    loss: np.ndarray
    n_iter: np.ndarray
    fitted: DataFrame | None = field(default=None, repr=False)  # id, y, probabilities of the training rows

    def predict(self, c: Curves) -> DataFrame:
        """All columns but values, with probabilities: of the class (two classes), or of every
        class, to a sum of one."""
        t, a, b = self.grid, self.alpha, (self.beta * nm.simpson_weights(self.grid)).T
        return per_curve(c.df, lambda v: _shares(sigmoid(elastic.srsf(v, t) @ b + a)), "probabilities array<double>")


def _shares(p: np.ndarray) -> np.ndarray:
    if p.shape[1] == 1:
        return p
    total = p.sum(1, keepdims=True)
    return np.where(total < 1e-15, 1 / p.shape[1], p / np.where(total < 1e-15, 1, total))


def logistic(c: Curves, y: str, classes: list, lam: float = 0.0, max_iter: int = 20, tol: float = 1e-4) -> ElasticLogistic:
    """Each class of ``classes`` against all others: a gradient step with a halving line search
    for the slope, then every curve is warped to its side of the slope.

    All classes take their steps in the same passes: one for gradients, one that tries every
    step size, one for warps.
    """
    t, k = c.grid, len(classes)
    weights, m = nm.simpson_weights(t), len(c.grid)
    target = F.array(*[F.when(F.col(y) == v, 1.0).otherwise(0.0) for v in classes])
    with held(c.df.select("id", F.col(y).alias("y"), target.alias("target"), "values")) as base:
        alpha, beta = np.zeros(k), np.zeros((k, m))
        live, steps = np.ones(k, bool), np.zeros(k, int)
        turned, kept = base.withColumn("warps", F.lit([float(x) for x in np.tile(t, k)])), None

        def moved(v, g):
            q = elastic.srsf(v, t)
            return np.stack([warped(q, g[:, j * m : (j + 1) * m], t) for j in range(k)], 1)  # (rows, classes, points)

        def losses(eta, z):
            p = np.clip(sigmoid(eta), 1e-15, 1 - 1e-15)
            return -(z * np.log(p) + (1 - z) * np.log(1 - p)).sum(0)

        for _ in range(max_iter):
            if not live.any():
                break
            steps[live] += 1

            def gradient(v, g, z, alpha=alpha, beta=beta):
                x = moved(v, g)
                eta = np.einsum("ikm,km->ik", x, beta * weights) + alpha
                e = sigmoid(eta) - z
                return [np.array([len(v)]), e.sum(0), np.einsum("ik,ikm->km", e, x) * weights, losses(eta, z)]

            n, ga, gb, now = sums(turned, gradient, ["values", "warps", "target"])
            ga, gb = ga / n[0], gb / n[0] + lam * beta
            now = now / n[0] + 0.5 * lam * (beta**2).sum(1)
            size = 0.5 ** np.arange(HALVINGS)

            def trials(v, g, z, alpha=alpha, beta=beta, ga=ga, gb=gb):
                x = moved(v, g)
                eta, way = np.einsum("ikm,km->ik", x, beta * weights) + alpha, np.einsum("ikm,km->ik", x, gb * weights) + ga
                return [np.stack([losses(eta - s * way, z) for s in size])]

            tried = sums(turned, trials, ["values", "warps", "target"])[0] / n[0]
            tried += 0.5 * lam * np.array([((beta - s * gb) ** 2).sum(1) for s in size])
            enough = tried <= now - 1e-4 * size[:, None] * (ga**2 + (gb**2).sum(1))
            step = np.where(enough.any(0), size[enough.argmax(0)], 0.5**HALVINGS)
            new = np.where(live[:, None], beta - step[:, None] * gb, beta)
            alpha = np.where(live, alpha - step * ga, alpha)
            still = np.array([_moved(a, b) >= tol for a, b in zip(new, beta, strict=True)]) | (steps < 2)
            beta, before, live = new, kept, live & still
            if not live.any():
                break

            def turn(v, beta=beta):
                q, z = elastic.srsf(v[:, :m], t), 2 * v[:, m:] - 1
                return np.hstack([elastic.warp_dp_many(z[:, j : j + 1] * beta[j], q, t, 0.01 * lam) for j in range(k)])

            kept = per_curve(base.select("id", "y", "target", "values", F.concat("values", "target").alias("_v")), turn, "warps array<double>", values="_v").persist()
            turned = kept
        w, a = beta * weights, alpha
        fitted = per_curve(turned.select("id", "y", F.concat("values", "warps").alias("_v")), lambda v: _shares(sigmoid(np.einsum("ikm,km->ik", moved(v[:, :m], v[:, m:]), w) + a)), "probabilities array<double>", values="_v").persist()
        fitted.count()
        if kept is not None:
            kept.unpersist()
    return ElasticLogistic(list(classes), alpha, beta, t, now, steps, fitted)


def predicted_class(scored: DataFrame, classes: list) -> DataFrame:
    """scored with predicted: the class of the greatest probability, the first of equals; of two
    classes (one probability) whether it is a half at least."""
    p = F.col("probabilities")
    if len(classes) == 1:
        return scored.withColumn("predicted", (p[0] >= 0.5).cast("int"))
    return scored.withColumn("predicted", F.get(F.array(*[F.lit(v) for v in classes]), (F.array_position(p, F.array_max(p)) - 1).cast("int")))


# ---- a response on shapes ----


@dataclass
class ScalarOnShape:
    """y = h(shape score) + g(integral of the curve)."""

    beta: np.ndarray
    h: np.ndarray
    g: np.ndarray
    grid: np.ndarray
    r2: float
    n_iter: int

    def predict(self, c: Curves) -> DataFrame:
        """All columns but values, with score and fit; new curves are warped to the slope."""
        t, beta, weights = self.grid, self.beta, nm.simpson_weights(self.grid)
        h, g = self.h, self.g

        def kernel(v):
            score = _scores(v, beta, t)
            return score, _with_intercept(score, h) + _without(v @ weights, g)

        return per_curve(c.df, kernel, "score double, fit double")


def _scores(v, beta, t, lam: float = 0.0) -> np.ndarray:
    q = elastic.srsf(v, t)
    return warped(q, elastic.warp_dp_many(np.repeat(beta[None], len(q), 0), q, t, lam), t) @ (beta * nm.simpson_weights(t))


def _without(x, coef):
    return sum((c * x ** (j + 1) for j, c in enumerate(coef)), np.zeros(len(x)))


def _with_intercept(x, coef):
    return sum((c * x**j for j, c in enumerate(coef)), np.zeros(len(x)))


def _normal(a, b):
    return np.linalg.solve(a + 1e-10 * np.eye(len(a)), b)


def scalar_on_shape(c: Curves, y: str, nbasis: int = 11, lam: float = 1e-3, degree: int = 2, index: int = 0, rounds: int = 10, steps: int = 15, tol: float = 1e-4, penalty: float = 0.0) -> ScalarOnShape:
    """A unit slope in Fourier functions for warped SRSFs, a polynomial g of the curve's
    integral and, for index > 0, a polynomial h of that degree on the score, in turn.

    Every inner step warps all curves to the slope and refits it; warps are centred, and the
    scores of a round are taken from curves warped to its last slope.
    """
    t = c.grid
    weights = nm.simpson_weights(t)
    basis = nm.fourier_basis(t, nbasis)
    rough = smooth.fourier_penalty(nbasis, float(t[-1] - t[0]), 2)
    unit = lambda b: b / max(np.sqrt(float((b * b) @ weights)), 1e-15)
    beta, g, h = unit(basis[:, 0]), np.zeros(degree), np.array([0.0, 1.0])
    with held(c.df.select(F.col(y).cast("double").alias("y"), "values")) as base:
        for turn in range(rounds):
            first = beta
            for inner in range(steps):
                def parts(v, r, beta=beta, g=g):
                    q = elastic.srsf(v, t)
                    phi = warped(q, elastic.warp_dp_many(np.repeat(beta[None], len(q), 0), q, t, penalty), t) @ (basis * weights[:, None])
                    return [phi.T @ phi, phi.T @ (r - _without(v @ weights, g))]

                xx, xy = sums(base, parts, ["values", "y"])
                new = unit(basis @ _solve(xx + lam * rough, xy))
                stop, beta = _moved(new, beta) < tol and inner > 0, new
                if stop:
                    break
            powers = lambda x, k, low: np.stack([x**j for j in range(low, k + 1)], 1)
            with held(per_curve(base, lambda v, beta=beta: (_scores(v, beta, t, penalty), v @ weights), "score double, f0 double")) as scored:
                if index:
                    a, b = sums(scored, lambda r, s, f, g=g: [powers(s, index, 0).T @ powers(s, index, 0), powers(s, index, 0).T @ (r - _without(f, g))], ["y", "score", "f0"])
                    h = _normal(a, b)
                if degree:
                    a, b = sums(scored, lambda r, s, f, h=h: [powers(f, degree, 1).T @ powers(f, degree, 1), powers(f, degree, 1).T @ (r - _with_intercept(s, h))], ["y", "score", "f0"])
                    g = _normal(a, b)
                n, s, ss, sse = sums(scored, lambda r, x, f, g=g, h=h: [np.array([len(r)]), np.array([r.sum()]), np.array([(r**2).sum()]), np.array([((r - _with_intercept(x, h) - _without(f, g)) ** 2).sum()])], ["y", "score", "f0"])
            if turn and _moved(beta, first) < tol:
                break
    total = ss[0] - s[0] ** 2 / n[0]
    return ScalarOnShape(beta, h, g, t, float(1 - sse[0] / total) if total > 0 else 0.0, turn + 1)
