"""Principal components, partial least squares and their relatives.

Fits reduce the table to matrices of grid size by partial sums; the driver solves
those; scoring is one Arrow kernel per curve.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvelake.functions import numeric as nm
from curvelake.operators.apply import moments, per_curve, sums
from curvelake.sources.curves import Curves


@dataclass
class Fpca:
    """Integration-weighted principal components; loadings (points, components)."""

    mean: np.ndarray
    loadings: np.ndarray
    singular: np.ndarray
    weights: np.ndarray
    n: int

    @property
    def eigenvalues(self) -> np.ndarray:
        return self.singular**2 / max(self.n - 1, 1)

    def project(self, v: np.ndarray) -> np.ndarray:
        return (v - self.mean) * self.weights @ self.loadings

    def rebuild(self, scores: np.ndarray) -> np.ndarray:
        return self.mean + scores @ self.loadings.T


def solve_fpca(n: int, mean, scatter, w, k: int) -> Fpca:
    """From the scatter matrix: eigenvectors of the weighted scatter, the largest loading
    of each positive, divided by the root weights."""
    root = np.sqrt(w)
    val, vec = np.linalg.eigh(scatter * np.outer(root, root))
    k = min(k, n, len(w))
    val, vec = val[::-1][:k], vec[:, ::-1][:, :k]
    vec = vec * np.sign(vec[np.abs(vec).argmax(0), np.arange(k)])
    return Fpca(mean, vec / root[:, None], np.sqrt(np.maximum(val, 0)), w, n)


def fpca(c: Curves, k: int = 3) -> Fpca:
    n, mean, scatter = moments(c.df)
    return solve_fpca(n, mean, scatter, c.weights, k)


def scores(c: Curves, model: Fpca) -> DataFrame:
    """All columns but values, with scores."""
    return per_curve(c.df, model.project, "scores array<double>")


def reconstruct(scored: DataFrame, model: Fpca) -> DataFrame:
    return per_curve(scored, model.rebuild, "values array<double>", values="scores")


def fpca_of_derivatives(c: Curves, k: int = 3, order: int = 1) -> Fpca:
    from curvelake.operators.pointwise import derivative

    return fpca(derivative(c, order), k)


def dynamical_correlation(a: Curves, b: Curves) -> float:
    """Mean inner product of curves centred over the domain, then over curves, at unit norm."""
    w = a.weights
    both = a.df.select("id", F.col("values").alias("x")).join(b.df.select("id", F.col("values").alias("y")), "id")
    level = lambda v: v - (v @ w / w.sum())[:, None]
    n, sx, sy = sums(both, lambda x, y: [np.array([len(x)]), level(x).sum(0), level(y).sum(0)], ["x", "y"])

    def unit(v, mu):
        v = level(v) - mu
        return v / np.maximum(np.sqrt(v**2 @ w), 1e-15)[:, None]

    return float(sums(both, lambda x, y: [np.array([((unit(x, sx / n[0]) * unit(y, sy / n[0])) @ w).sum()])], ["x", "y"])[0][0] / n[0])


def singular_functions(a: Curves, b: Curves, k: int = 3):
    """SVD of the weighted cross-covariance: (left, values, right) singular functions."""
    from curvelake.operators.pointwise import cross_covariance

    rx, ry = np.sqrt(a.weights), np.sqrt(b.weights)
    u, s, vt = np.linalg.svd(cross_covariance(a, b) * np.outer(rx, ry))
    return u[:, :k] / rx[:, None], s[:k], vt[:k].T / ry[:, None]


def smooth_covariance_fpca(c: Curves, h: float, k: int = 3) -> Fpca:
    """Components of the covariance smoothed on both sides by a kernel."""
    n, mean, scatter = moments(c.df)
    s = np.exp(-(np.subtract.outer(c.grid, c.grid) ** 2) / (2 * h * h))
    s /= s.sum(1, keepdims=True)
    return solve_fpca(n, mean, s @ scatter @ s.T, c.weights, k)


@dataclass
class Pls:
    """Integration-weighted PLS of a scalar; scores of centred curves by ``rotation``."""

    mean: np.ndarray
    weights: np.ndarray
    loadings: np.ndarray
    rotation: np.ndarray
    y_mean: float
    coefficients: np.ndarray

    def project(self, v):
        return (v - self.mean) @ self.rotation


def pls(c: Curves, y: str, k: int = 3) -> Pls:
    """NIPALS on moments: deflation of X'X and X'y, so the table is read twice."""
    n, sx, sy = sums(c.df, lambda v, t: [np.array([len(v)]), v.sum(0), np.array([t.sum()])], ["values", y])
    mean, ym, w = sx / n[0], sy[0] / n[0], c.weights
    xx, xy = sums(c.df, lambda v, t: [(v - mean).T @ (v - mean), (v - mean).T @ (t - ym)], ["values", y])
    rw, m = np.sqrt(w), len(w)
    g, b = xx * np.outer(rw, rw), xy * rw
    ws, ps, qs = [], [], []
    for _ in range(min(k, m, int(n[0]) - 1)):
        a = b / max(np.linalg.norm(b), 1e-300)
        tt = a @ g @ a
        if tt <= 1e-14:
            break
        p, q = g @ a / tt, b @ a / tt
        g, b = g - tt * np.outer(p, p), b - tt * q * p
        ws.append(a)
        ps.append(p)
        qs.append(q)
    wm, pm = np.array(ws).T, np.array(ps).T
    rot = wm @ np.linalg.inv(pm.T @ wm)
    return Pls(mean, wm / rw[:, None], pm / rw[:, None], rw[:, None] * rot, ym, np.array(qs))


def mfpca(parts: list[Curves], k: int = 3, weighted: bool = True):
    """Components of several variables: plain SVD of stacked blocks, each centred and, if
    weighted, over the root of its mean column variance. (means, scales, loadings, eigenvalues, splits)"""
    df, names = None, []
    for p, part in enumerate(parts):
        own = part.df.select("id", F.col("values").alias(f"x{p}"))
        names.append(f"x{p}")
        df = own if df is None else df.join(own, "id")
    n, *totals = sums(df, lambda *v: [np.array([len(v[0])]), *(x.sum(0) for x in v)], names)
    means = [t / n[0] for t in totals]
    scatter = sums(df, lambda *v: [np.hstack([x - m for x, m in zip(v, means, strict=True)]).T @ np.hstack([x - m for x, m in zip(v, means, strict=True)])], names)[0]
    var, at, scale = np.diag(scatter) / (n[0] - 1), 0, []
    for m in means:
        scale.append(np.full(len(m), np.sqrt(max(var[at : at + len(m)].mean(), 1e-15)) if weighted else 1.0))
        at += len(m)
    s = np.concatenate(scale)
    val, vec = np.linalg.eigh(scatter / np.outer(s, s))
    return means, scale, vec[:, ::-1][:, :k], np.maximum(val[::-1][:k], 0) / (n[0] - 1), df


def andrews(df: DataFrame, t) -> DataFrame:
    """Andrews curves of rows with array features: x1/sqrt 2 + x2 sin t + x3 cos t + ..."""
    t = np.asarray(t, float)

    def kernel(x):
        cols = [np.full(len(t), 1 / np.sqrt(2)) if k == 0 else (np.sin if k % 2 else np.cos)((k + 1) // 2 * t) for k in range(x.shape[1])]
        return x @ np.array(cols)

    return per_curve(df, kernel, "curve array<double>", values="features")


def pace(df: DataFrame, grid, h: float, k: int = 3, noise: float | None = None):
    """Sparse FPCA of rows (id, t, v): kernel mean and covariance, eigenfunctions, scores by
    conditional expectation. (mean, loadings, eigenvalues, noise variance, scores table)"""
    from curvelake.operators.metrics import covariance_irregular, mean_irregular, sorted_points

    grid = nm.as_grid(grid)
    mean = mean_irregular(df, grid, h)
    mu = np.array([r["mean"] for r in mean.orderBy("target").collect()], float)
    rows = covariance_irregular(df, grid, h, mean).collect()
    at = {float(g): i for i, g in enumerate(grid)}
    cov = np.zeros((len(grid), len(grid)))
    for r in rows:
        cov[at[r["s"]], at[r["t"]]] = r["cov"]
    cov = (cov + cov.T) / 2
    rw = np.sqrt(nm.simpson_weights(grid))
    val, vec = np.linalg.eigh(cov * np.outer(rw, rw))
    lam, phi = np.maximum(val[::-1][:k], 1e-10), vec[:, ::-1][:, :k] / rw[:, None]
    if noise is None:
        noise = max(float(np.mean(np.diag(cov))) * 0.1, 1e-6)
    import pyarrow as pa

    def run(batches):
        for b in batches:
            out = []
            for t, v in zip(b.column("t").to_pylist(), b.column("v").to_pylist(), strict=True):
                p = np.stack([np.interp(t, grid, phi[:, j]) for j in range(phi.shape[1])], 1)
                sigma = p * lam @ p.T + noise * np.eye(len(t))
                out.append((lam * (p.T @ np.linalg.solve(sigma, np.asarray(v) - np.interp(t, grid, mu)))).tolist())
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, pa.list_(pa.float64()))], names=["id", "scores"])

    return mu, phi, lam, noise, sorted_points(df).mapInArrow(run, "id long, scores array<double>")
