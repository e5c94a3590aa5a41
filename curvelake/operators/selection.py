"""Choosing among many functional predictors, and regression on a weighted history.

Both read the table once or twice: Gram blocks of all predictors' scores (by fold), or of a
curve's lagged values.  Penalty paths, cross-validation and fits then run on those blocks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvelake.functions.numeric import simpson_weights
from curvelake.operators import reduce, smooth
from curvelake.operators.apply import per_curve, sums
from curvelake.sources.curves import Curves

SCAD, MCP = 3.7, 3.0


@dataclass
class Gram:
    """Sums over rows of x x', x y, y^2, x, y and rows."""

    xx: np.ndarray
    xy: np.ndarray
    yy: float
    x: np.ndarray
    y: float
    n: float

    def __sub__(self, o: Gram) -> Gram:
        return Gram(self.xx - o.xx, self.xy - o.xy, self.yy - o.yy, self.x - o.x, self.y - o.y, self.n - o.n)

    def errors(self, b: np.ndarray, intercept: float) -> float:
        """Sum of squared errors of intercept + x'b."""
        return float(self.yy - 2 * intercept * self.y - 2 * b @ self.xy + intercept**2 * self.n + 2 * intercept * (self.x @ b) + b @ self.xx @ b)


def shrink(norm: float, lam: float, how: str) -> float:
    """What a group's least-squares norm is multiplied by."""
    if norm <= 0:
        return 0.0
    soft = max(0.0, 1 - lam / norm)
    if how == "mcp":
        return soft / (1 - 1 / MCP) if norm <= MCP * lam else 1.0
    if how == "scad":
        if norm <= 2 * lam:
            return soft
        return max(0.0, 1 - SCAD * lam / ((SCAD - 1) * norm)) / (1 - 1 / (SCAD - 1)) if norm <= SCAD * lam else 1.0
    return soft


def group_descent(xx: np.ndarray, xy: np.ndarray, groups: list[np.ndarray], lam: float, how: str = "lasso", free: np.ndarray | None = None, max_iter: int = 200, tol: float = 1e-6) -> tuple[np.ndarray, int, bool]:
    """(coefficients, sweeps, converged) by blocks: a group's least squares on what the others
    leave, shrunk by its norm and the root of its size; ``free`` columns are not penalised."""
    b = np.zeros(len(xy))
    blocks = [(g, lam * math.sqrt(len(g))) for g in groups] + ([(free, 0.0)] if free is not None and len(free) else [])
    for sweep in range(1, max_iter + 1):
        moved = 0.0
        for g, penalty in blocks:
            own = xx[np.ix_(g, g)]
            best = np.linalg.solve(own + 1e-10 * np.eye(len(g)), xy[g] - xx[g] @ b + own @ b[g])
            new = best * (shrink(float(np.linalg.norm(best)), penalty, how) if penalty else 1.0)
            moved = max(moved, float(np.abs(new - b[g]).max()))
            b[g] = new
        if moved < tol:
            return b, sweep, True
    return b, max_iter, False


@dataclass
class Scores:
    """Components of every predictor, Gram blocks of their scores (then covariates) by fold, and
    the table of id, y and x: the scores."""

    components: list
    folds: list
    scored: DataFrame


def gathered(predictors: list[Curves], y: str, covariates: str | None = None) -> DataFrame:
    """id, y and x: the values of several curves of the same ids one after another, then the
    covariates; y and covariates are in the first table."""
    table = predictors[0].df.select("id", F.col(y).cast("double").alias("y"), F.col("values").alias("_v0"), *([F.col(covariates).alias("_z")] if covariates else []))
    for p, c in enumerate(predictors[1:], 1):
        table = table.join(c.df.select("id", F.col("values").alias(f"_v{p}")), "id")
    return table.select("id", "y", F.concat(*[f"_v{p}" for p in range(len(predictors))], *(["_z"] if covariates else [])).alias("x"))


def scores(table: DataFrame, grids: list[np.ndarray], k: int = 3, n_folds: int = 5) -> Scores:
    """Two passes over a table as ``gathered`` gives it, whatever the number of predictors: the
    mean, then by fold (ids modulo n_folds) the products of all values about it. Components come
    from the products' blocks, and turn them into those of the scores."""
    ends = np.cumsum([len(g) for g in grids])
    own = [slice(e - len(g), e) for g, e in zip(grids, ends, strict=True)]
    n, total = sums(table, lambda x: [np.array([len(x)]), x.sum(0)], ["x"])
    mean = total / n[0]
    mean[ends[-1] :] = 0  # covariates stay as they are

    def parts(ids, x, v):
        fold, x = ids.astype(np.int64) % n_folds, x - mean
        each = [(x[fold == f], v[fold == f]) for f in range(n_folds)]
        return [np.stack([a.T @ a for a, _ in each]), np.stack([a.T @ b for a, b in each]), np.array([[(b**2).sum(), b.sum(), len(b)] for _, b in each]), np.stack([a.sum(0) for a, _ in each])]

    xx, xy, scalars, x = sums(table, parts, ["id", "x", "y"])
    scatter = xx.sum(0)
    bases = [reduce.solve_fpca(int(n[0]), mean[s], scatter[s, s], simpson_weights(g), k) for s, g in zip(own, grids, strict=True)]
    sizes, free = [m.loadings.shape[1] for m in bases], len(mean) - ends[-1]
    turn = np.zeros((len(mean), sum(sizes) + free))
    for s, m, e in zip(own, bases, np.cumsum(sizes), strict=True):
        turn[s, e - m.loadings.shape[1] : e] = m.weights[:, None] * m.loadings
    turn[ends[-1] :, sum(sizes) :] = np.eye(free)
    folds = [Gram(turn.T @ a @ turn, b @ turn, float(yy), c @ turn, float(sy), float(rows)) for a, b, c, (yy, sy, rows) in zip(xx, xy, x, scalars, strict=True)]
    return Scores(bases, folds, per_curve(table.select("id", "y", "x"), lambda v: (v - mean) @ turn, "x array<double>", values="x"))


@dataclass
class Selection:
    components: list
    groups: list
    coef: list  # an array for each predictor, then one of the covariates
    intercept: float
    active: list
    lam: float
    r2: float
    sweeps: int
    converged: bool
    path: list  # (penalty, cross-validated error)
    scored: DataFrame

    def fitted(self) -> DataFrame:
        """id, y, fit of the rows that were fitted."""
        b, a = np.concatenate(self.coef), self.intercept
        return per_curve(self.scored, lambda x: a + x @ b, "fit double", values="x")


def select(predictors: list[Curves] | Scores, y: str = "y", k: int = 3, lam: float = 0.0, how: str = "lasso", covariates: str | None = None, n_grid: int = 20, n_folds: int = 5, max_iter: int = 200, tol: float = 1e-6) -> Selection:
    """Group penalty (lasso, scad, mcp; or ls: none) on the component scores of several curves
    of the same ids; y and covariates (an array column) are in the first table. With ``Scores``
    no table is read; they have their own k, covariates and folds.

    ``lam`` of 0 takes the one of least error over folds (ids modulo n_folds) on a geometric
    grid from a hundredth of the largest useful penalty to it: the one that leaves no group
    by itself, whatever the number of rows.
    """
    if how not in ("lasso", "scad", "mcp", "ls"):
        raise ValueError(f"no penalty {how}")
    data = predictors if isinstance(predictors, Scores) else scores(gathered(predictors, y, covariates), [c.grid for c in predictors], k, n_folds)
    bases, folds = data.components, data.folds
    sizes = [m.loadings.shape[1] for m in bases]
    whole = Gram(*[sum(getattr(f, x) for f in folds) for x in ("xx", "xy", "yy", "x", "y", "n")])
    ends = np.cumsum(sizes)
    groups = [np.arange(e - s, e) for s, e in zip(sizes, ends, strict=True)]
    free = np.arange(ends[-1], len(whole.xy))
    centred = lambda g: g.xy - g.x * (g.y / g.n)
    path, sweeps, converged = [], 1, True
    if how == "ls":
        b, lam = np.linalg.solve(whole.xx, centred(whole)), 0.0
    else:
        if lam <= 0:
            alone = [np.linalg.solve(whole.xx[np.ix_(g, g)] + 1e-10 * np.eye(len(g)), centred(whole)[g]) for g in groups]
            top = max(max(float(np.linalg.norm(b)) / math.sqrt(len(b)) for b in alone), 1e-10)
            for i in range(max(n_grid, 2)):
                at = top * 0.01 ** (1 - (i + 1) / max(n_grid, 2))
                wrong = 0.0
                for f in folds:
                    rest = whole - f
                    if f.n and rest.n:
                        wrong += f.errors(group_descent(rest.xx, centred(rest), groups, at, how, free, max_iter, tol)[0], rest.y / rest.n)
                path.append((at, wrong / whole.n))
            lam = min(path, key=lambda p: p[1])[0]
        b, sweeps, converged = group_descent(whole.xx, centred(whole), groups, lam, how, free, max_iter, tol)
    intercept = whole.y / whole.n
    total = whole.yy - whole.y**2 / whole.n
    coef = [b[g] for g in groups] + ([b[free]] if len(free) else [])
    active = [how == "ls" or float(np.linalg.norm(b[g])) > tol for g in groups]
    return Selection(bases, groups, coef, intercept, active, lam, 1 - whole.errors(b, intercept) / total if total > 0 else 0.0, sweeps, converged, path, data.scored)


# ---- history ----


@dataclass
class History:
    """y on the integral of a curve's last values times a weight of the lag."""

    lags: np.ndarray
    gamma: np.ndarray
    intercept: float
    slope: float
    bandwidth: float
    r2: float
    places: np.ndarray
    width: float

    def predict(self, c: Curves) -> DataFrame:
        """All columns but values, with history (the score) and fit."""
        at, g, a, b = self.places, self.gamma * self.width, self.intercept, self.slope
        return per_curve(c.df, lambda v: (v[:, at] @ g, a + b * (v[:, at] @ g)), "history double, fit double")


def history(c: Curves, y: str, window: float, n_lags: int = 20, bandwidth: float = 0.0, kernel: str = "gaussian") -> History:
    """Slopes of y on each lagged value, smoothed over lags to a weight of unit norm, then a line
    on the weighted history; a bandwidth of 0 is chosen by generalised cross-validation."""
    t = c.grid
    if not 0 < window <= t[-1] - t[0]:
        raise ValueError("the window has to be positive and within the domain")
    n_lags = max(n_lags, 1)
    width = window / n_lags
    lags = width * np.arange(n_lags)
    places = np.clip(np.searchsorted(t, t[-1] - lags, "left") - 1, 0, len(t) - 1)

    def parts(v, r):
        x = v[:, places]
        return [np.array([len(r), r.sum(), (r**2).sum()]), x.sum(0), x.T @ x, x.T @ r]

    (n, sy, syy), sx, xx, xy = sums(c.df.select("values", F.col(y).cast("double").alias("y")), parts, ["values", "y"])
    scatter, with_y = xx - np.outer(sx, sx) / n, xy - sx * sy / n
    own = np.diag(scatter)
    signal = np.where(own > 1e-15, with_y / np.where(own > 1e-15, own, 1), 0.0)
    if bandwidth <= 0:
        span = lags[-1] - lags[0] if n_lags > 1 else 1.0
        tries = np.linspace(max(width, span / 50), max(span, width), 20)

        def gcv(h):
            hat = smooth.nw_matrix(lags, h, kernel)
            left = 1 - np.trace(hat) / n_lags
            return float((((hat @ signal - signal) ** 2).mean()) / left**2) if left > 1e-9 else math.inf

        bandwidth = max(float(min(tries, key=gcv)), width)
    raw = smooth.nadaraya_watson(lags, signal, lags, bandwidth, kernel)
    norm = math.sqrt(float((raw**2).sum() * width))
    gamma = raw / norm if norm > 1e-15 else np.full(n_lags, 1 / math.sqrt(n_lags))
    g = gamma * width
    sxx, sxy = float(g @ scatter @ g), float(g @ with_y)
    slope = sxy / sxx if sxx > 1e-15 else 0.0
    total = syy - sy**2 / n
    return History(lags, gamma, float(sy / n - slope * (g @ sx) / n), slope, bandwidth, float(slope * sxy / total) if total > 0 else 0.0, places, width)
