"""Smoothers of sampled curves and basis fits; hat matrices are of grid size."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame

from curvelake.functions import numeric as nm
from curvelake.operators.apply import per_curve, sums
from curvelake.sources.curves import Curves


def _weights(x, new, h: float, kernel: str) -> np.ndarray:
    if kernel not in nm.KERNELS:
        raise ValueError(f"no kernel {kernel}")
    return nm.KERNELS[kernel](np.subtract.outer(new, x) / h)


def nadaraya_watson(x, y, new, h: float, kernel: str = "gaussian") -> np.ndarray:
    """Kernel means; 0 where the weights sum to 1e-10 or less."""
    k = _weights(x, new, h, kernel)
    mass = k.sum(1)
    return np.where(mass > 1e-10, (np.atleast_2d(y) @ k.T) / np.where(mass > 1e-10, mass, 1), 0.0).reshape(np.shape(y)[:-1] + (len(new),))


def local_polynomial(x, y, new, h: float, degree: int = 1, kernel: str = "gaussian") -> np.ndarray:
    return np.asarray(y, float) @ local_polynomial_hat(x, new, h, degree, kernel).T


def local_polynomial_hat(x, new, h: float, degree: int = 1, kernel: str = "gaussian") -> np.ndarray:
    """Rows of weights that give the fit at each new point; a kernel mean where the local
    system is singular."""
    k, out = _weights(x, new, h, kernel), np.zeros((len(new), len(x)))
    for i, t in enumerate(new):
        p = np.vander(np.asarray(x) - t, degree + 1, increasing=True)
        a = p.T @ (p * k[i][:, None])
        if np.linalg.cond(a) < 1e14:
            out[i] = np.linalg.solve(a, (p * k[i][:, None]).T)[0]
        elif k[i].sum() > 1e-10:
            out[i] = k[i] / k[i].sum()
    return out


def knn(x, y, new, k: int) -> np.ndarray:
    """Mean of the k nearest points; equals by place."""
    near = np.argsort(np.abs(np.subtract.outer(new, x)), axis=1, kind="stable")[:, :k]
    return np.asarray(y)[..., near].mean(-1)


def nw_matrix(x, h: float, kernel: str = "gaussian") -> np.ndarray:
    k = _weights(x, x, h, kernel)
    return k / np.maximum(k.sum(1, keepdims=True), 1e-10)


def smooth(c: Curves, h: float, how: str = "nw", degree: int = 1, kernel: str = "gaussian", k: int = 5, grid=None) -> Curves:
    new = c.grid if grid is None else nm.as_grid(grid)
    fits = {
        "nw": lambda v: nadaraya_watson(c.grid, v, new, h, kernel),
        "local": lambda v: local_polynomial(c.grid, v, new, h, degree, kernel),
        "knn": lambda v: knn(c.grid, v, new, k),
    }
    if how not in fits:
        raise ValueError(f"no smoother {how}")
    return Curves(per_curve(c.df, fits[how], "values array<double>"), new)


def smoother_score(c: Curves, h: float, criterion: str = "gcv", kernel: str = "gaussian") -> float:
    """Mean over curves of the leave-one-out error (cv), GCV or AIC of kernel means."""
    s = nw_matrix(c.grid, h, kernel)
    m = len(c.grid)
    if criterion == "cv":
        s = s - np.diag(np.diag(s))
        s = s / np.maximum(s.sum(1, keepdims=True), 1e-10)
    n, rss = sums(c.df, lambda v: [np.array([len(v)]), np.array([((v - v @ s.T) ** 2).sum()])], ["values"])
    mean = float(rss[0] / n[0])
    if criterion == "cv":
        return mean / m
    tr = float(np.trace(s))
    return mean / m / (1 - tr / m) ** 2 if criterion == "gcv" else m * math.log(max(mean / m, 1e-300)) + 2 * tr


def best_bandwidth(c: Curves, criterion: str = "gcv", tries: int = 50, kernel: str = "gaussian") -> tuple[float, float]:
    h0 = (c.grid[-1] - c.grid[0]) / len(c.grid) ** 0.2
    found = [(smoother_score(c, h, criterion, kernel), h) for h in np.linspace(h0 / 5, 5 * h0, tries)]
    return min(found)[1], min(found)[0]


# ---- basis fits ----


def project(c: Curves, phi: np.ndarray) -> DataFrame:
    """Least squares coefficients of every curve."""
    inv = np.linalg.pinv(phi)
    return per_curve(c.df, lambda v: v @ inv.T, "coefs array<double>")


def evaluate(df: DataFrame, phi: np.ndarray, grid) -> Curves:
    return Curves(per_curve(df, lambda b: b @ phi.T, "values array<double>", values="coefs"), grid)


def bspline_penalty(t, nknots: int, order: int = 4, derivative: int = 2, fine: int = 512) -> np.ndarray:
    """Integral of products of basis derivatives, by fine quadrature."""
    g = np.linspace(t[0], t[-1], fine)
    knots = nm.bspline_knots(np.asarray(t), nknots, order)
    d = _bspline_derivative(g, knots, order, derivative)
    return d.T @ (d * nm.simpson_weights(g)[:, None])


def _bspline_derivative(x, knots, order: int, k: int) -> np.ndarray:
    if not k:
        return nm.bspline_from_knots(x, knots, order)
    low = _bspline_derivative(x, knots, order - 1, k - 1)
    n = len(knots) - order
    a = np.array([(order - 1) / (knots[i + order - 1] - knots[i]) if knots[i + order - 1] > knots[i] else 0 for i in range(n + 1)])
    return low[:, :n] * a[:n] - low[:, 1 : n + 1] * a[1 : n + 1]


def fourier_penalty(n: int, period: float, derivative: int = 2) -> np.ndarray:
    f = np.array([(k + 1) // 2 for k in range(n)], float)
    return np.diag((2 * math.pi * f / period) ** (2 * derivative))


def smooth_basis(c: Curves, phi: np.ndarray, penalty: np.ndarray, lam: float):
    """(coefficients table, edf, gcv, aic, bic) of penalised least squares."""
    a = np.linalg.solve(phi.T @ phi + lam * penalty + 1e-10 * np.eye(phi.shape[1]), phi.T)
    hat = phi @ a
    m, edf = len(c.grid), float(np.trace(hat))
    n, rss = (float(x[0]) for x in sums(c.df, lambda v: [np.array([len(v)]), np.array([((v - v @ hat.T) ** 2).sum()])], ["values"]))
    gcv = rss / (n * m) / max((1 - edf / m) ** 2, 1e-15)
    return per_curve(c.df, lambda v: v @ a.T, "coefs array<double>"), edf, gcv, nm.aic(rss, int(n * m), n * edf), nm.bic(rss, int(n * m), n * edf)


def smooth_basis_best(c: Curves, phi, penalty, criterion: str = "gcv", exponents=np.linspace(-8, 4, 25)):
    k = {"gcv": 2, "aic": 3, "bic": 4}[criterion]
    lam = min((10.0**e for e in exponents), key=lambda q: smooth_basis(c, phi, penalty, q)[k])
    return lam, smooth_basis(c, phi, penalty, lam)


def pspline(c: Curves, nbasis: int, lam: float, order: int = 2):
    """Cubic splines of max(nbasis - 4, 2) knots with a difference penalty:
    (coefficients table, basis, edf, gcv, aic, bic); the criteria count edf once."""
    phi = nm.bspline_basis(c.grid, max(nbasis - 4, 2))
    d = nm.difference_matrix(phi.shape[1], order)
    a = np.linalg.solve(phi.T @ phi + lam * d.T @ d, phi.T)
    hat = phi @ a
    edf, m = float(np.trace(hat)), len(c.grid)
    n, rss = (float(x[0]) for x in sums(c.df, lambda v: [np.array([len(v)]), np.array([((v - v @ hat.T) ** 2).sum()])], ["values"]))
    gcv = rss / (n * m) / max((1 - edf / m) ** 2, 1e-15)
    return per_curve(c.df, lambda v: v @ a.T, "coefs array<double>"), phi, edf, gcv, nm.aic(rss, int(n * m), edf), nm.bic(rss, int(n * m), edf)


def pspline_best(c: Curves, nbasis: int, order: int = 2):
    """The penalty 1 or 3.16 times 10^-6..10^6 of least GCV; the first of equals."""
    lam = min((b * 10.0**e for e in range(-6, 7) for b in (1, 3.16)), key=lambda q: pspline(c, nbasis, q, order)[3])
    return lam, pspline(c, nbasis, lam, order)


def fourier_fit(c: Curves, nbasis: int):
    """Least squares on an odd number of Fourier columns, three at least: (table, basis, edf, gcv)."""
    n = max(3, nbasis + (nbasis % 2 == 0))
    phi = nm.fourier_basis(c.grid, n)
    hat, m = phi @ np.linalg.pinv(phi), len(c.grid)
    k, rss = (float(x[0]) for x in sums(c.df, lambda v: [np.array([len(v)]), np.array([((v - v @ hat.T) ** 2).sum()])], ["values"]))
    return project(c, phi), phi, float(n), rss / (k * m) / (1 - n / m) ** 2


def choose_basis(c: Curves, fourier_sizes=(3, 5, 7, 9), spline_sizes=(6, 8, 10, 12), lam: float = 1.0) -> DataFrame:
    """id, kind, nbasis, gcv: the basis of least GCV of every curve."""
    m = len(c.grid)
    hats = []
    for n in fourier_sizes:
        phi = nm.fourier_basis(c.grid, n)
        hats.append(("fourier", n, phi @ np.linalg.pinv(phi)))
    for n in spline_sizes:
        phi = nm.bspline_basis(c.grid, max(n - 4, 2))
        d = nm.difference_matrix(phi.shape[1], 2)
        hats.append(("pspline", n, phi @ np.linalg.solve(phi.T @ phi + lam * d.T @ d, phi.T)))

    def kernel(v):
        g = np.stack([((v - v @ h.T) ** 2).mean(1) / (1 - np.trace(h) / m) ** 2 for _, _, h in hats], 1)
        best = g.argmin(1)
        return [hats[b][0] for b in best], [hats[b][1] for b in best], g.min(1)

    return per_curve(c.df.select("id", "values"), kernel, "kind string, nbasis int, gcv double")


def choose_nbasis(c: Curves, sizes=range(5, 16), criterion: str = "gcv") -> tuple[int, dict[int, float]]:
    found = {}
    for n in sizes:
        phi = nm.bspline_basis(c.grid, max(n - 4, 2))
        got = smooth_basis(c, phi, np.zeros((phi.shape[1],) * 2), 0.0)
        found[n] = got[{"gcv": 2, "aic": 3, "bic": 4}[criterion]]
    return min(found, key=found.get), found
