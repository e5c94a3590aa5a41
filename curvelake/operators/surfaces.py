"""Surfaces on scalar predictors, with coefficient surfaces smoothed in both directions.

One pass adds up predictors' products with each other and with every cell.  The penalty is
a Kronecker sum of two second-difference penalties, so smoothing is a scaling in the
eigenvectors of the two small matrices, and every strength is tried on the same sums.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvelake.functions import numeric as nm
from curvelake.operators.apply import per_curve, sums
from curvelake.sources.curves import Curves

STRENGTHS = (0.0, 1e-6, 1e-4, 1e-2, 0.1, 1.0, 10.0, 100.0, 1000.0)


def difference_penalty(m: int) -> np.ndarray:
    """Squares of second differences; nothing below three points."""
    d = nm.difference_matrix(m, 2) if m > 2 else np.zeros((1, m))
    return d.T @ d


@dataclass
class Surface:
    """Cells row by row: m1 x m2 of them, flattened."""

    beta: np.ndarray  # intercept first: (predictors + 1, cells)
    se: np.ndarray  # (predictors, cells)
    r2: np.ndarray
    strengths: tuple[float, float]
    gcv: float
    predictors: list

    def predict(self, df: DataFrame) -> DataFrame:
        """df (with the predictors' columns) and its surfaces."""
        beta = self.beta
        x = df.withColumn("_x", F.array(*[F.col(c).cast("double") for c in self.predictors]))
        return per_curve(x, lambda v: beta[0] + v @ beta[1:], "values array<double>", values="_x")


def smooth_surface(raw: np.ndarray, m1: int, m2: int, ls: float, lt: float) -> np.ndarray:
    """Each row of cells that solves (I + ls P1 x I + lt I x P2) b = raw."""
    a, u = np.linalg.eigh(difference_penalty(m1))
    b, v = np.linalg.eigh(difference_penalty(m2))
    turned = np.einsum("ik,pij,jl->pkl", u, raw.reshape(-1, m1, m2), v) / (1 + ls * a[:, None] + lt * b)
    return np.einsum("ik,pkl,jl->pij", u, turned, v).reshape(len(raw), -1)


def regression(c: Curves, predictors: list[str], m1: int, m2: int, ls: float = -1.0, lt: float = -1.0) -> Surface:
    """Least squares in every cell, then smoothed coefficient surfaces; a negative strength is
    chosen by generalised cross-validation."""
    p = len(predictors) + 1
    table = c.df.select("values", F.array(*[F.col(x).cast("double") for x in predictors]).alias("x"))

    def parts(v, x):
        d = np.hstack([np.ones((len(v), 1)), x])
        return [np.array([len(v)]), d.T @ d, d.T @ v, (v**2).sum(0), v.sum(0)]

    n, xx, xy, yy, y = sums(table, parts, ["values", "x"])
    n = n[0]
    if len(yy) != m1 * m2:
        raise ValueError(f"surfaces need {m1 * m2} cells")
    if n < p + 1:
        raise ValueError(f"at least {p + 1} surfaces are needed")
    raw = np.linalg.solve(xx, xy)
    left = lambda b: yy - 2 * (b * xy).sum(0) + np.einsum("pc,pq,qc->c", b, xx, b)
    score = lambda b: float(left(b).sum() / (n * m1 * m2 * max(1 - p / n, 1e-10) ** 2))
    tries = [(a, b) for a in ([ls] if ls >= 0 else STRENGTHS) for b in ([lt] if lt >= 0 else STRENGTHS)]
    best = min(tries, key=lambda k: score(smooth_surface(raw, m1, m2, *k)))
    beta = smooth_surface(raw, m1, m2, *best)
    residual, total = left(beta), yy - y**2 / n
    se = np.sqrt(np.maximum(np.outer(np.diag(np.linalg.inv(xx))[1:], residual / max(n - p, 1)), 0))
    return Surface(beta, se, np.where(total > 1e-15, 1 - residual / np.where(total > 1e-15, total, 1), 0.0), best, score(beta), list(predictors))
