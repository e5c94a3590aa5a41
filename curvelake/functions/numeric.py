"""Numerics of sampled curves: quadrature, differences, interpolation, kernels, criteria.

Arrays are (curves, points); grids are increasing.  Bad input raises ValueError.
"""

from __future__ import annotations

import math

import numpy as np


def as_grid(t) -> np.ndarray:
    t = np.asarray(t, float)
    if t.ndim != 1 or not len(t) or (np.diff(t) <= 0).any():
        raise ValueError("a grid needs increasing points")
    return t


def unit_grid(m: int) -> np.ndarray:
    return np.linspace(0.0, 1.0, m)


def simpson_weights(t) -> np.ndarray:
    """Quadrature weights: Simpson's rule over pairs of intervals, a trapezoid on an odd last one."""
    t = as_grid(t)
    n = len(t)
    if n == 1:
        return np.ones(1)
    h = np.diff(t)
    w = np.zeros(n)
    if n == 2:
        return np.full(2, h[0] / 2)
    pairs = (n - 1) // 2
    a, b = h[0 : 2 * pairs : 2], h[1 : 2 * pairs : 2]
    total = a + b
    k = 2 * np.arange(pairs)
    np.add.at(w, k, total / 6 * (2 - b / a))
    np.add.at(w, k + 1, total**3 / (6 * a * b))
    np.add.at(w, k + 2, total / 6 * (2 - a / b))
    if (n - 1) % 2:
        w[-2:] += h[-1] / 2
    return w


def simpson_weights_2d(s, t) -> np.ndarray:
    """Weights of a flattened surface, first axis fastest."""
    return np.outer(simpson_weights(t), simpson_weights(s)).ravel()


def trapz(y, t) -> np.ndarray:
    y = np.asarray(y, float)
    return ((y[..., 1:] + y[..., :-1]) / 2 * np.diff(t)).sum(-1)


def cumulative_trapz(y, t) -> np.ndarray:
    out = np.zeros_like(np.asarray(y, float))
    out[..., 1:] = np.cumsum((y[..., 1:] + y[..., :-1]) / 2 * np.diff(t), -1)
    return out


def cumulative_simpson(y, t) -> np.ndarray:
    """Running integral: Simpson's rule at even points, one trapezoid more at odd ones."""
    y = np.asarray(y, float)
    out = np.zeros_like(y)
    h = np.diff(t)
    n = y.shape[-1]
    for k in range(1, n):
        if k % 2:
            out[..., k] = out[..., k - 1] + h[k - 1] * (y[..., k - 1] + y[..., k]) / 2
        else:
            a, b = h[k - 2], h[k - 1]
            s = a + b
            out[..., k] = out[..., k - 2] + s / 6 * ((2 - b / a) * y[..., k - 2] + s * s / (a * b) * y[..., k - 1] + (2 - a / b) * y[..., k])
    return out


def interp(x, t, y) -> np.ndarray:
    """Linear interpolation of each row of y, clamped at the ends."""
    y = np.atleast_2d(y)
    return np.array([np.interp(x, t, row) for row in y])


def hermite(x, t, y) -> np.ndarray:
    """Cubic Hermite interpolation with finite-difference slopes, clamped at the ends."""
    y = np.atleast_2d(np.asarray(y, float))
    x = np.clip(x, t[0], t[-1])
    d = np.gradient(y, t, axis=1)
    k = np.clip(np.searchsorted(t, x, "right") - 1, 0, len(t) - 2)
    h = t[k + 1] - t[k]
    u = (x - t[k]) / h
    return y[:, k] * (2 * u**3 - 3 * u**2 + 1) + d[:, k] * h * (u**3 - 2 * u**2 + u) + y[:, k + 1] * (3 * u**2 - 2 * u**3) + d[:, k + 1] * h * (u**3 - u**2)


def resample(x, t, y, kind: str = "linear", outside: str = "boundary", fill: float = math.nan) -> np.ndarray:
    """Rows of y at new points; outside the grid: boundary, exception, fill or periodic."""
    x = np.asarray(x, float)
    out = (x < t[0]) | (x > t[-1])
    if out.any() and outside == "exception":
        raise ValueError("points outside the grid")
    if outside == "periodic":
        x = t[0] + np.mod(x - t[0], t[-1] - t[0])
    got = (hermite if kind == "cubic" else interp)(x, t, y)
    if outside == "fill":
        got[:, out] = fill
    return got


def central_differences(y, t) -> np.ndarray:
    """First derivative: central inside, one-sided at the ends."""
    y, t = np.asarray(y, float), np.asarray(t, float)
    out = np.empty_like(y)
    out[..., 1:-1] = (y[..., 2:] - y[..., :-2]) / (t[2:] - t[:-2])
    out[..., 0] = (y[..., 1] - y[..., 0]) / (t[1] - t[0])
    out[..., -1] = (y[..., -1] - y[..., -2]) / (t[-1] - t[-2])
    return out


def derivative(y, t, order: int = 1) -> np.ndarray:
    for _ in range(order):
        y = central_differences(y, t)
    return y


_STENCILS = np.array([[-25, 48, -36, 16, -3], [-3, -10, 18, -6, 1], [1, -8, 0, 8, -1], [-1, 6, -18, 10, 3], [3, -16, 36, -48, 25]]) / 12.0  # fixed values


def gradient(y, t) -> np.ndarray:
    """Five-point derivative on an even grid, three-point Lagrange otherwise."""
    y, t = np.asarray(y, float), as_grid(t)
    n, h = len(t), np.diff(t)
    if n == 1:
        return np.zeros_like(y)
    if n >= 5 and np.allclose(h, h[0], rtol=1e-9, atol=0):
        out = np.empty_like(y)
        win = np.lib.stride_tricks.sliding_window_view(y, 5, -1)
        out[..., 2:-2] = win @ _STENCILS[2]
        out[..., 0], out[..., 1] = win[..., 0, :] @ _STENCILS[0], win[..., 0, :] @ _STENCILS[1]
        out[..., -2], out[..., -1] = win[..., -1, :] @ _STENCILS[3], win[..., -1, :] @ _STENCILS[4]
        return out / h[0]
    return np.gradient(y, t, axis=-1, edge_order=2 if n >= 3 else 1)


def quantile(x, p: float) -> float:
    """Linear quantile of type 7."""
    return float(np.quantile(np.asarray(x, float), p))


def gaussian_kernel(d, h: float):
    d = np.asarray(d, float)
    return np.exp(-(d**2) / (2 * h * h)) if h >= 1e-15 else np.zeros_like(d)


KERNELS = {
    "gaussian": lambda u: np.exp(-(u**2) / 2) / math.sqrt(2 * math.pi),
    "epanechnikov": lambda u: np.where(np.abs(u) <= 1, 0.75 * (1 - u**2), 0.0),
    "tricube": lambda u: np.where(np.abs(u) <= 1, (1 - np.minimum(np.abs(u), 1) ** 3) ** 3, 0.0),
}


def r_squared(y, fit) -> float:
    y, fit = np.asarray(y, float), np.asarray(fit, float)
    total = ((y - y.mean()) ** 2).sum()
    return float(1 - ((y - fit) ** 2).sum() / total) if total > 1e-15 else 0.0


def r_squared_adj(r2: float, n: int, p: int) -> float:
    return 1 - (1 - r2) * (n - 1) / (n - p - 1)


def aic(rss: float, n: int, p: float) -> float:
    return n * math.log(rss / n) + 2 * p


def bic(rss: float, n: int, p: float) -> float:
    return n * math.log(rss / n) + p * math.log(n)


def impute(y, t, how: str = "linear", value: float = 0.0) -> np.ndarray:
    """Rows without NaN: by neighbours (flat at the ends), the row's mean, or a constant."""
    y = np.array(y, float)
    for row in y:
        bad = np.isnan(row)
        if bad.all():
            raise ValueError("a curve without values")
        if bad.any():
            row[bad] = np.interp(t[bad], t[~bad], row[~bad]) if how == "linear" else (row[~bad].mean() if how == "mean" else value)
    return y


# ---- bases ----


def bspline_knots(t, nknots: int, order: int) -> np.ndarray:
    """Equally spaced knots, extended by order - 1 steps on either side."""
    step = (t[-1] - t[0]) / (nknots + 1)
    return t[0] + step * np.arange(-(order - 1), nknots + order + 1)


def bspline_from_knots(t, knots, order: int) -> np.ndarray:
    """Cox-de Boor recursion: a column for each basis function."""
    t = np.asarray(t, float)
    last = len(knots) - order
    b = ((t[:, None] >= knots[None, :-1]) & (t[:, None] < knots[None, 1:])).astype(float)
    top = t >= knots[last]
    b[top] = 0
    b[top, last - 1] = 1
    for k in range(2, order + 1):
        left = knots[k - 1 : -1] - knots[: -k]
        right = knots[k:] - knots[1 : len(knots) - k + 1]
        a = np.divide(t[:, None] - knots[None, : -k], left, out=np.zeros((len(t), len(left))), where=left > 0) * b[:, :-1]
        c = np.divide(knots[None, k:] - t[:, None], right, out=np.zeros((len(t), len(right))), where=right > 0) * b[:, 1:]
        b = a + c
    return b


def bspline_basis(t, nknots: int, order: int = 4) -> np.ndarray:
    return bspline_from_knots(t, bspline_knots(t, nknots, order), order)


def fourier_basis(t, n: int, period: float | None = None) -> np.ndarray:
    """1, sin, cos, sin 2, cos 2, ... without scaling; the phase starts at the first point."""
    period = t[-1] - t[0] if period is None else period
    x = 2 * math.pi * (np.asarray(t) - t[0]) / period
    return np.stack([np.ones(len(t)) if k == 0 else (np.sin if k % 2 else np.cos)((k + 1) // 2 * x) for k in range(n)], 1)


def monomial_basis(t, n: int) -> np.ndarray:
    return np.vander(t, n, increasing=True)


def power_basis(t, exponents) -> np.ndarray:
    return np.asarray(t, float)[:, None] ** np.asarray(exponents, float)[None, :]


def exponential_basis(t, rates) -> np.ndarray:
    return np.exp(np.outer(t, rates))


def constant_basis(t) -> np.ndarray:
    return np.ones((len(t), 1))


def polygonal_basis(t, knots) -> np.ndarray:
    return np.stack([np.interp(t, knots, e) for e in np.eye(len(knots))], 1)


def difference_matrix(n: int, order: int) -> np.ndarray:
    return np.diff(np.eye(n), order, axis=0)


def eigenfunctions(t, n: int, family: str = "fourier") -> np.ndarray:
    if family == "fourier":
        b = fourier_basis(t, n)
        b[:, 1:] *= math.sqrt(2)
        return b
    if family in ("legendre", "legendre_high"):
        first = 2 if family == "legendre_high" else 0
        return np.stack([np.polynomial.legendre.legval(2 * t - 1, np.eye(k + 1)[k]) * math.sqrt(2 * k + 1) for k in range(first, first + n)], 1)
    if family == "wiener":
        return np.stack([math.sqrt(2) * np.sin((k - 0.5) * math.pi * t) for k in range(1, n + 1)], 1)
    raise ValueError(f"no family {family}")


def eigenvalues(n: int, family: str = "linear") -> np.ndarray:
    k = np.arange(1, n + 1)
    known = {"linear": 1.0 / k, "exponential": np.exp(-k), "wiener": 1 / ((k - 0.5) * math.pi) ** 2}
    if family not in known:
        raise ValueError(f"no family {family}")
    return known[family]


def covariance_kernel(s, t, kind: str = "gaussian", length: float = 0.2, variance: float = 1.0) -> np.ndarray:
    d = np.abs(np.subtract.outer(s, t))
    if kind == "gaussian":
        return variance * np.exp(-(d**2) / (2 * length**2))
    if kind == "exponential":
        return variance * np.exp(-d / length)
    if kind == "matern32":
        u = math.sqrt(3) * d / length
        return variance * (1 + u) * np.exp(-u)
    if kind == "matern52":
        u = math.sqrt(5) * d / length
        return variance * (1 + u + u * u / 3) * np.exp(-u)
    if kind == "brownian":
        return variance * np.minimum.outer(s, t)
    if kind == "periodic":
        return variance * np.exp(-2 * np.sin(math.pi * d) ** 2 / length**2)
    if kind == "linear":
        return variance * np.multiply.outer(s, t)
    raise ValueError(f"no kernel {kind}")
