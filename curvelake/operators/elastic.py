"""Elastic registration: square-root velocity functions, dynamic programming, Karcher means.

Kernels work on single curves and pairs; tables go through Arrow, one curve or one pair
of blocks at a time.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame

from curvelake.functions import numeric as nm
from curvelake.operators.apply import held, per_curve, self_pairs, sums
from curvelake.sources.curves import Curves

REACH = 7
STEPS = [(a, b) for a in range(1, REACH + 1) for b in range(1, REACH + 1) if math.gcd(a, b) == 1]


def srsf(f, t) -> np.ndarray:
    d = nm.central_differences(f, t)
    return np.sign(d) * np.sqrt(np.abs(d))


def srsf_inverse(q, t, first: float = 0.0) -> np.ndarray:
    return first + nm.cumulative_simpson(q * np.abs(q), t)


def _unit(q):
    n = np.linalg.norm(q)
    return q / n if n > 1e-12 else q


def warp_dp(q1, q2, t, lam: float = 0.0, band: float = 0.0) -> np.ndarray:
    """The warp of t that carries q2 onto q1: cheapest path over coprime steps of up to seven.

    The cost of a step is the integral of (q1 - q2(gamma) sqrt(slope))^2, plus
    lam (slope - 1)^2 over its length; the first of equal steps stays.
    """
    return warp_dp_many(np.asarray(q1, float)[None], np.asarray(q2, float)[None], t, lam, band)[0]


#: Bytes of step costs that are held at once.
COST_BYTES = 48 << 20


def warp_dp_many(q1, q2, t, lam: float = 0.0, band: float = 0.0) -> np.ndarray:
    """warp_dp() of each row of q1 and q2, some at a time: step costs come from matrix products,
    then a row of all tables is filled at once.

    Rows may be curves in a space: (pairs, points, dimensions).
    """
    q1, q2 = (q[:, :, None] if q.ndim == 2 else q for q in (np.asarray(q1, float), np.asarray(q2, float)))
    q1, q2 = (q / np.where((n := np.sqrt((q**2).sum((1, 2), keepdims=True))) > 1e-12, n, 1) for q in (q1, q2))
    pairs, m = q1.shape[:2]
    radius = math.ceil(band * m) if 0 < band < 1 else m
    some = max(1, COST_BYTES // (8 * len(STEPS) * m * m))
    parts = [_warps(q1[k : k + some], q2[k : k + some], np.asarray(t, float), lam, radius) for k in range(0, pairs, some)]
    return np.concatenate(parts) if parts else np.empty((0, m))


def _at(q: np.ndarray, back: int, parts: int) -> np.ndarray:
    """Values at the midpoints of ``parts`` equal parts of the last ``back`` intervals before each
    point from ``back`` on: (pairs, points, parts and dimensions)."""
    m = q.shape[1]
    out = []
    for k in range(parts):
        x = (k + 0.5) / parts * back
        low = int(x)
        left, right = q[:, low : m - back + low], q[:, low + 1 : m - back + low + 1]
        out.append(left + (x - low) * (right - left))
    return np.concatenate(out, 2)


def _step_costs(q1, q2, t, lam: float) -> np.ndarray:
    """(points of q1, pairs, steps, points of q2): the cost of every step that ends there."""
    pairs, m = q1.shape[:2]
    out = np.full((m, pairs, len(STEPS), m), np.inf)
    for s, (a, b) in enumerate(STEPS):
        if a >= m or b >= m:
            continue
        parts = max(a, b)  # midpoints fine enough for either curve's grid
        p, q = _at(q1, a, parts), _at(q2, b, parts)
        dt = (t[a:] - t[:-a])[:, None]
        slope = (t[b:] - t[:-b])[None] / dt
        cost = (p**2).sum(2)[:, :, None] - 2 * np.sqrt(slope) * (p @ q.swapaxes(1, 2)) + slope * (q**2).sum(2)[:, None]
        out[a:, :, s, b:] = (np.maximum(cost, 0) * (dt / parts) + lam * (slope - 1) ** 2 * dt).swapaxes(0, 1)
    return out


def _warps(q1, q2, t, lam: float, radius: int) -> np.ndarray:
    pairs, m = q1.shape[:2]
    costs = _step_costs(q1, q2, t, lam)
    best = np.full((pairs, m + REACH, m + REACH), np.inf)  # REACH rows and columns before the first
    best[:, REACH, REACH] = 0
    step_of = np.full((m, pairs, m), -1, np.int8)
    back, left = np.array(STEPS).T
    for i in range(1, m):
        lo, hi = max(1, i - radius), min(m, i + radius + 1)
        if lo >= hi:
            continue
        columns = np.arange(lo, hi)[None] + REACH - left[:, None]
        total = best[:, (i + REACH - back)[:, None], columns] + costs[i][:, :, lo:hi]
        step = total.argmin(1)  # the first of equal ones
        least = np.take_along_axis(total, step[:, None], 1)[:, 0]
        best[:, i + REACH, lo + REACH : hi + REACH] = least
        step_of[i][:, lo:hi] = np.where(np.isfinite(least), step, -1)
    out = np.empty((pairs, m))
    for p in range(pairs):
        i = j = m - 1
        x, y = [t[i]], [t[j]]
        while i > 0 and j > 0 and step_of[i, p, j] >= 0:
            a, b = STEPS[step_of[i, p, j]]
            i, j = i - a, j - b
            x.append(t[i])
            y.append(t[j])
        out[p] = normalize_warp(np.interp(t, x[::-1], y[::-1]), t)
    return out


def normalize_warp(g, t) -> np.ndarray:
    g = np.maximum.accumulate(np.array(g, float))
    span = g[-1] - g[0]
    g = t[0] + (g - g[0]) * (t[-1] - t[0]) / span if span > 1e-15 else np.array(t, float)
    g[0], g[-1] = t[0], t[-1]
    return g


def normalize_warp_rows(v, t) -> np.ndarray:
    """Warps from rows of any values: their running sums of moduli, scaled to the domain."""
    return np.array([normalize_warp(np.cumsum(np.abs(x)), t) for x in v])


def apply_warp(f, g, t) -> np.ndarray:
    return np.interp(g, t, f)


def compose(g1, g2, t) -> np.ndarray:
    return np.interp(g2, t, g1)


def invert(g, t) -> np.ndarray:
    return np.interp(t, g, t)


def inverse_error(g, t) -> float:
    return float(np.abs(compose(g, invert(g, t), t) - t).max())


def align(f1, f2, t, lam: float = 0.0, band: float = 0.0):
    """(warp, aligned f2, distance): the distance of the SRSF of the warped curve."""
    g, w, d = align_many(np.asarray(f1, float)[None], np.asarray(f2, float)[None], t, lam, band)
    return g[0], w[0], float(d[0])


def align_many(f1, f2, t, lam: float = 0.0, band: float = 0.0):
    """align() of each row of f1 and f2."""
    g = warp_dp_many(srsf(f1, t), srsf(f2, t), t, lam, band)
    w = np.array([apply_warp(y, x, t) for x, y in zip(g, f2, strict=True)])
    return g, w, np.sqrt((srsf(f1, t) - srsf(w, t)) ** 2 @ nm.simpson_weights(t))


def psi(g, t) -> np.ndarray:
    return np.sqrt(np.maximum(nm.gradient(g, t), 0))


def psi_to_warp(p, t) -> np.ndarray:
    return normalize_warp(nm.cumulative_trapz(p * p, t), t)


def sphere_log(mu, p, t) -> np.ndarray:
    d = float(np.clip(nm.trapz(mu * p, t), -1, 1))
    theta = math.acos(d)
    return np.zeros_like(mu) if theta < 1e-10 else theta / math.sin(theta) * (p - d * mu)


def sphere_exp(mu, v, t) -> np.ndarray:
    n = math.sqrt(max(float(nm.trapz(v * v, t)), 0))
    return mu if n < 1e-10 else math.cos(n) * mu + math.sin(n) * v / n


def phase_distance(g, t) -> float:
    """Geodesic distance of a warp from the identity, on a unit domain."""
    u = (t - t[0]) / (t[-1] - t[0])
    return math.acos(float(np.clip(nm.trapz(psi((g - t[0]) / (t[-1] - t[0]), u), u), -1, 1)))


def elastic_kernel(t, lam: float = 0.0, band: float = 0.0, part: str = "elastic"):
    def fn(a, b):
        out = np.empty((len(a), len(b)))
        for i, x in enumerate(a):
            g, _, d = align_many(np.repeat(x[None], len(b), 0), b, t, lam, band)
            out[i] = d if part != "phase" else [phase_distance(y, t) for y in g]
        return out

    return fn


def distances(c: Curves, lam: float = 0.0, band: float = 0.0, part: str = "elastic") -> DataFrame:
    """(i, j, d) of amplitude (elastic) or phase distances of all pairs."""
    return self_pairs(c.df, elastic_kernel(c.grid, lam, band, part), size=block_size(c.grid))


def block_size(t) -> int:
    """Curves of a block: a pair's table has as many cells as the square of its points."""
    return max(4, min(64, 100_000 // len(t) ** 2))


def depth(d_amplitude: DataFrame) -> DataFrame:
    from pyspark.sql import functions as F

    from curvelake.operators.metrics import mirrored

    return mirrored(d_amplitude).groupBy(F.col("i").alias("id")).agg((1 / (1 + F.avg("d"))).alias("depth"))


def align_to(c: Curves, target, lam: float = 0.0, band: float = 0.0) -> DataFrame:
    """All columns but values, with aligned curve, warp and distance."""
    def kernel(v):
        g, w, d = align_many(np.repeat(np.asarray(target, float)[None], len(v), 0), v, c.grid, lam, band)
        return w, g, d

    return per_curve(c.df, kernel, "aligned array<double>, warp array<double>, distance double")


def karcher_mean(c: Curves, max_iter: int = 20, tol: float = 1e-4, lam: float = 0.0, band: float = 0.0, weights=None) -> np.ndarray:
    """Template of a table: each step aligns every curve to the mean SRSF and averages, one pass
    of sums; starts from the curve nearest to the mean SRSF."""
    with held(c.df.select("values")) as df:
        return _karcher_mean(c.with_df(df), max_iter, tol, lam, band, weights)


def _karcher_mean(c: Curves, max_iter: int, tol: float, lam: float, band: float, weights) -> np.ndarray:
    t = c.grid
    n, total, first = sums(c.df, lambda v: [np.array([len(v)]), srsf(v, t).sum(0), np.array([v[:, 0].sum()])], ["values"])
    q, f0 = total / n[0], first[0] / n[0]
    for _ in range(max_iter):
        mean = srsf_inverse(q, t, f0)

        def step(v, mean=mean):
            _, y, d = align_many(np.repeat(mean[None], len(v), 0), v, t, lam, band)
            w = np.ones(len(v)) if weights is None else np.array([weights(x) for x in d])
            return [w @ srsf(y, t), np.array([w.sum()])]

        total, mass = sums(c.df, step, ["values"])
        new = total / mass[0]
        moved = np.linalg.norm(new - q) / max(np.linalg.norm(q), 1e-12)
        q = new
        if moved < tol:
            break
    return srsf_inverse(q, t, f0)


def karcher_median(c: Curves, **options) -> np.ndarray:
    return karcher_mean(c, weights=lambda d: 1 / max(d, 1e-10), **options)


def warp_complexity(g, t) -> float:
    return phase_distance(g, t)


def warp_smoothness(g, t) -> float:
    return float(nm.trapz(nm.derivative(g, t, 2) ** 2, t))


def warp_statistics(aligned: DataFrame, t) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(Karcher mean warp, pointwise mean, pointwise standard deviation)."""
    with held(aligned.select("warp")) as rows:
        return _warp_statistics(rows, t)


def _warp_statistics(rows: DataFrame, t) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, s, q = sums(rows, lambda w: [np.array([len(w)]), w.sum(0), (w**2).sum(0)], ["warp"])
    mu, u = np.ones(len(t)), (t - t[0]) / (t[-1] - t[0])
    for _ in range(20):
        v = sums(rows, lambda w, mu=mu: [np.sum([sphere_log(mu, psi((x - t[0]) / (t[-1] - t[0]), u), u) for x in w], 0)], ["warp"])[0] / n[0]
        mu = sphere_exp(mu, 0.5 * v, u)
        if math.sqrt(float(nm.trapz(v * v, u))) < 1e-5:
            break
    return t[0] + (t[-1] - t[0]) * psi_to_warp(mu, u), s / n[0], np.sqrt(np.maximum(q / n[0] - (s / n[0]) ** 2, 0))


def vertical_fpca(aligned: DataFrame, t, k: int = 3):
    """Components of aligned SRSFs with a signed root of the value at the middle appended:
    (mean, vectors, eigenvalues), unweighted."""
    mid = len(t) // 2
    aug = lambda v: np.hstack([srsf(v, t), (np.sign(v[:, mid]) * np.sqrt(np.abs(v[:, mid])))[:, None]])
    n, s = sums(aligned, lambda v: [np.array([len(v)]), aug(v).sum(0)], ["aligned"])
    mu = s / n[0]
    val, vec = np.linalg.eigh(sums(aligned, lambda v: [(aug(v) - mu).T @ (aug(v) - mu)], ["aligned"])[0] / (n[0] - 1))
    return mu, vec[:, ::-1][:, :k], val[::-1][:k]


def horizontal_fpca(aligned: DataFrame, t, k: int = 3):
    """Components of shooting vectors of the warps at their mean: (mean psi, vectors, eigenvalues)."""
    u = (t - t[0]) / (t[-1] - t[0])
    with held(aligned.select("warp")) as rows:
        mean = _warp_statistics(rows, t)[0]
        mu = psi((mean - t[0]) / (t[-1] - t[0]), u)
        shoot = lambda w: np.array([sphere_log(mu, psi((x - t[0]) / (t[-1] - t[0]), u), u) for x in w])
        n, g = sums(rows, lambda w: [np.array([len(w)]), shoot(w).T @ shoot(w)], ["warp"])
    val, vec = np.linalg.eigh(g / (n[0] - 1))
    return mu, vec[:, ::-1][:, :k], val[::-1][:k]


def shift_register(c: Curves, max_shift: float, tol: float = 1e-6) -> DataFrame:
    """id, shift, values: least squares shifts against the raw mean, golden section, one pass."""
    t, w = c.grid, c.weights
    n, s = sums(c.df, lambda v: [np.array([len(v)]), v.sum(0)], ["values"])
    mean, ratio = s / n[0], (math.sqrt(5) - 1) / 2

    def best(x):
        cost = lambda h: float((np.interp(t + h, t, x) - mean) ** 2 @ w)
        a, b = -max_shift, max_shift
        while b - a > tol:
            p, q = b - ratio * (b - a), a + ratio * (b - a)
            a, b = (a, q) if cost(p) < cost(q) else (p, b)
        h = (a + b) / 2
        return h, np.interp(t + h, t, x)

    def kernel(v):
        rows = [best(x) for x in v]
        return [r[0] for r in rows], np.array([r[1] for r in rows])

    return per_curve(c.df.select("id", "values"), kernel, "shift double, aligned array<double>")


def landmarks(v, t, kind: str = "peak", prominence: float = 0.0) -> list[float]:
    from curvelake.operators.season import peaks

    if kind == "peak":
        return peaks(v, t, 0.0, prominence)[0]
    if kind == "valley":
        return peaks(-v, t, 0.0, prominence)[0]
    x = v if kind == "zero" else nm.derivative(v, t, 2)
    k = np.flatnonzero(np.sign(x[:-1]) * np.sign(x[1:]) < 0)
    return [float(t[i] - x[i] * (t[i + 1] - t[i]) / (x[i + 1] - x[i])) for i in k]


def landmark_warp(own, target, t) -> np.ndarray:
    """A monotone cubic warp through (target, own) pairs and the ends."""
    x = np.concatenate([[t[0]], target, [t[-1]]])
    y = np.concatenate([[t[0]], own, [t[-1]]])
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    slope = np.concatenate([[d[0]], [0 if a * b <= 0 else 2 * a * b / (a + b) for a, b in zip(d[:-1], d[1:], strict=True)], [d[-1]]])
    k = np.clip(np.searchsorted(x, t, "right") - 1, 0, len(h) - 1)
    u = (t - x[k]) / h[k]
    g = y[k] * (2 * u**3 - 3 * u**2 + 1) + slope[k] * h[k] * (u**3 - 2 * u**2 + u) + y[k + 1] * (3 * u**2 - 2 * u**3) + slope[k + 1] * h[k] * (u**3 - u**2)
    return normalize_warp(g, t)


def amplitude_changepoint(aligned: DataFrame, t, order: str = "id") -> tuple[int, float]:
    """(position, statistic): largest CUSUM norm of aligned curves in order. Prefix sums come from
    a window over chunk totals, so order is not gathered in one task."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    rows = aligned.select(order, F.posexplode("aligned").alias("pos", "v"))
    n = aligned.count()
    w = Window.partitionBy("pos").orderBy(order)
    tot = rows.groupBy("pos").agg(F.sum("v").alias("total"))
    s = rows.withColumn("s", F.sum("v").over(w)).withColumn("k", F.row_number().over(w)).join(F.broadcast(tot), "pos")  # a row per grid point
    d = F.col("s") - F.col("k") / n * F.col("total")
    weight = F.get(F.lit([float(x) for x in nm.simpson_weights(t)]), F.col("pos"))
    best = s.groupBy("k").agg((F.sum(d * d * weight) / n).alias("stat")).agg(F.max(F.struct("stat", F.col("k"))).alias("m")).first()["m"]
    return int(best["k"]), float(best["stat"])
