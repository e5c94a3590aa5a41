"""Covariances of sparsely observed curves, of one variable or several, and trajectories.

A user's kernel-weighted products over all pairs of observations are products of two sums,
so every user is one row of sums at the grid's points, and the covariance is one product of
those rows: no pairs of observations are made.  Smoothing and the projection to a positive
semi-definite matrix work on matrices of the grid's size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvelake.functions import numeric as nm
from curvelake.operators.apply import sums
from curvelake.operators.metrics import mean_irregular


@dataclass
class SparseCovariance:
    """Means and covariance on grids of several variables, laid end to end."""

    grids: list
    means: list
    cov: np.ndarray

    def block(self, p: int, q: int) -> np.ndarray:
        at = np.cumsum([0, *map(len, self.grids)])
        return self.cov[at[p] : at[p + 1], at[q] : at[q + 1]]


def _weight(t, g: float, h: float):
    u = (F.col(t) - g) / h
    return F.exp(-u * u / 2)


def _level(grid: np.ndarray, mean: np.ndarray, t: str):
    """The mean at the grid's point nearest to t (the lower of two)."""
    near = F.array_min(F.transform(F.lit([float(g) for g in grid]), lambda g: F.abs(g - F.col(t))))
    place = F.array_position(F.transform(F.lit([float(g) for g in grid]), lambda g: F.abs(g - F.col(t)) == near), F.lit(True))
    return F.get(F.lit([float(x) for x in mean]), (place - 1).cast("int"))


def smoothed(cov: np.ndarray, grids: list, h: float) -> np.ndarray:
    """Each block between two kernel averages along the grid."""
    parts = [np.exp(-((g[:, None] - g) ** 2) / (2 * h * h)) for g in grids]
    parts = [k / k.sum(1, keepdims=True) for k in parts]
    at = np.cumsum([0, *map(len, grids)])
    whole = np.zeros((at[-1], at[-1]))
    for k, a, b in zip(parts, at[:-1], at[1:], strict=True):
        whole[a:b, a:b] = k
    return whole @ cov @ whole.T


def projected(cov: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The covariance operator without its negative eigenvalues."""
    root = np.sqrt(weights)
    val, vec = np.linalg.eigh((cov + cov.T) / 2 * np.outer(root, root))
    phi = vec / np.where(root > 1e-15, root, 1)[:, None]
    return (phi * np.maximum(val, 0)) @ phi.T


def covariance(variables: list[DataFrame], grids: list, h: float) -> SparseCovariance:
    """From tables (id, t, v), one for each variable, of the same ids."""
    if h <= 0 or not np.isfinite(h):
        raise ValueError("the bandwidth has to be positive")
    grids = [nm.as_grid(g) for g in grids]
    means, table = [], None
    for p, (df, grid) in enumerate(zip(variables, grids, strict=True)):
        mean = {r["target"]: r["mean"] or 0.0 for r in mean_irregular(df, grid, h).collect()}  # a row for each point of the grid
        means.append(np.array([mean[float(g)] for g in grid]))
        rows = df.select("id", "t", (F.col("v") - _level(grid, means[-1], "t")).alias("r"))
        k = [F.sum(_weight("t", float(g), h)) for g in grid]
        kr = [F.sum(_weight("t", float(g), h) * F.col("r")) for g in grid]
        own = rows.groupBy("id").agg(F.array(*k).alias(f"k{p}"), F.array(*kr).alias(f"r{p}"))
        table = own if table is None else table.join(own, "id", "outer")
    none = [F.coalesce(f"{x}{p}", F.lit([0.0] * len(g))) for x in "kr" for p, g in enumerate(grids)]
    flat = table.select(F.concat(*none[: len(grids)]).alias("k"), F.concat(*none[len(grids) :]).alias("r"))
    kk, rr = sums(flat, lambda k, r: [k.T @ k, r.T @ r], ["k", "r"])
    raw = np.where(kk > 0, rr / np.where(kk > 0, kk, 1), 0.0)
    weights = np.concatenate([nm.simpson_weights(g) for g in grids])
    return SparseCovariance(grids, means, projected(smoothed(raw, grids, h), weights))


def trajectories(df: DataFrame, model: SparseCovariance, k: int = 3, noise: float | None = None, z: float = 1.96) -> DataFrame:
    """id, fitted (on the grid) and half (of a pointwise band) of a single variable's curves, by
    conditional expectation given k components of the covariance and an error variance."""
    import pyarrow as pa

    from curvelake.operators.metrics import sorted_points

    grid, mean, cov = model.grids[0], model.means[0], model.block(0, 0)
    root = np.sqrt(nm.simpson_weights(grid))
    val, vec = np.linalg.eigh(cov * np.outer(root, root))
    lam, phi = np.maximum(val[::-1][:k], 1e-10), vec[:, ::-1][:, :k] / root[:, None]
    noise = max(float(np.mean(np.diag(cov))) * 0.1, 1e-6) if noise is None else noise

    def run(batches):
        for b in batches:
            fitted, half = [], []
            for t, v in zip(b.column("t").to_pylist(), b.column("v").to_pylist(), strict=True):
                p = np.stack([np.interp(t, grid, phi[:, j]) for j in range(phi.shape[1])], 1)
                gain = np.linalg.solve(p * lam @ p.T + noise * np.eye(len(t)), p * lam).T
                left = np.diag(lam) - gain @ (p * lam)
                fitted.append((mean + phi @ (gain @ (np.asarray(v) - np.interp(t, grid, mean)))).tolist())
                half.append((z * np.sqrt(np.maximum(np.einsum("tj,jk,tk->t", phi, left, phi), 0))).tolist())
            kind = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(fitted, kind), pa.array(half, kind)], names=["id", "fitted", "half"])

    return sorted_points(df).mapInArrow(run, "id long, fitted array<double>, half array<double>")
