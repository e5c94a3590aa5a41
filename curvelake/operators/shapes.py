"""Elastic statistics beyond pairs and means: tangent vectors, quality, constraints, curves in
space, closed curves and shapes, models of amplitude and phase, regression and change.

Tables go through Arrow, one curve or a block of pairs at a time; fits are sums over the
table. Curves in a space of d dimensions are flattened, one dimension after another.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvelake.functions import numeric as nm
from curvelake.operators import elastic
from curvelake.operators.apply import cross_pairs, numbered, per_curve, quantiles, self_pairs, sums
from curvelake.sources.curves import Curves

# ---- pairs ----


def cross_distances(a: Curves, b: Curves, lam: float = 0.0, band: float = 0.0, part: str = "elastic") -> DataFrame:
    """(i, j, d) of every curve of a and of b."""
    return cross_pairs(a.df, b.df, elastic.elastic_kernel(a.grid, lam, band, part), size=elastic.block_size(a.grid))


def decomposition(c: Curves, target, lam: float = 0.0, band: float = 0.0) -> DataFrame:
    """id, amplitude and phase distance to a target curve."""
    target = np.asarray(target, float)[None]

    def kernel(v):
        g, _, d = elastic.align_many(np.repeat(target, len(v), 0), v, c.grid, lam, band)
        return d, np.array([elastic.phase_distance(x, c.grid) for x in g])

    return per_curve(c.df.select("id", "values"), kernel, "amplitude double, phase double")


def geodesic(f1, f2, t, steps: int = 5, lam: float = 0.0) -> np.ndarray:
    """Curves on the straight line between the SRSF of f1 and the aligned one of f2."""
    _, w, _ = elastic.align(f1, f2, t, lam)
    a, b = elastic.srsf(f1, t), elastic.srsf(w, t)
    return np.array([elastic.srsf_inverse((1 - s) * a + s * b, t, (1 - s) * f1[0] + s * w[0]) for s in np.linspace(0, 1, steps)])


def align_through(f1, f2, t, own, target, lam: float = 0.0) -> tuple[np.ndarray, np.ndarray, float]:
    """(warp, warped f2, distance) of a warp through landmark pairs (target on f1, own on f2):
    the pieces between them are aligned apart."""
    q1, q2 = elastic.srsf(np.asarray(f1, float), t), elastic.srsf(np.asarray(f2, float), t)
    x = np.concatenate([[t[0]], np.sort(target), [t[-1]]])
    y = np.concatenate([[t[0]], np.sort(own), [t[-1]]])
    out = np.empty(len(t))
    for a, b, u, v in zip(x[:-1], x[1:], y[:-1], y[1:], strict=True):
        here = (t >= a) & (t <= b)
        grid = np.linspace(0, 1, max(int(here.sum()), 4))
        p, q = np.interp(a + grid * (b - a), t, q1), np.interp(u + grid * (v - u), t, q2) * math.sqrt((v - u) / (b - a))
        g = elastic.warp_dp(p, q, grid, lam)
        out[here] = u + (v - u) * np.interp((t[here] - a) / (b - a), grid, g)
    g = elastic.normalize_warp(out, t)
    w = elastic.apply_warp(f2, g, t)
    return g, w, float(np.sqrt((q1 - elastic.srsf(w, t)) ** 2 @ nm.simpson_weights(t)))


def align_coarse_to_fine(f1, f2, t, factor: int = 4, lam: float = 0.0, band: float = 0.15):
    """align() on every factor-th point first; what is left is aligned in a band on all points."""
    k = np.unique(np.append(np.arange(0, len(t), factor), len(t) - 1))
    g = np.interp(t, t[k], elastic.align(np.asarray(f1)[k], np.asarray(f2)[k], t[k], lam)[0])
    h, _, _ = elastic.align(f1, elastic.apply_warp(f2, g, t), t, lam, band)
    whole = elastic.normalize_warp(elastic.compose(g, h, t), t)
    w = elastic.apply_warp(f2, whole, t)
    return whole, w, float(np.sqrt((elastic.srsf(f1, t) - elastic.srsf(w, t)) ** 2 @ nm.simpson_weights(t)))


def partial_match(query, f, t, sizes: int = 5, lam: float = 0.0) -> tuple[float, float, float]:
    """(first, last, distance) of the window of f that a curve on the unit domain matches best:
    windows of half to all of the domain, moved by a tenth of their size."""
    query = np.asarray(query, float)
    u = np.linspace(0, 1, len(query))
    best = (float(t[0]), float(t[-1]), math.inf)
    for size in np.linspace(0.5, 1, sizes) * (t[-1] - t[0]):
        for a in np.arange(t[0], t[-1] - size + 1e-9, size / 10):
            piece = np.interp(a + u * size, t, f)
            d = elastic.align(query, piece, u, lam)[2]
            if d < best[2] - 1e-12:
                best = (float(a), float(a + size), d)
    return best


# ---- tangent vectors ----


def _mean_srsf(c: Curves, target) -> np.ndarray:
    q = elastic.srsf(np.asarray(target, float), c.grid)
    return q / max(math.sqrt(float(q**2 @ c.weights)), 1e-12)


def tangent_vectors(c: Curves, target, lam: float = 0.0, band: float = 0.0, method: str = "log") -> DataFrame:
    """id, vector, norm, first: aligned unit SRSFs as tangent vectors at the target's.

    method: log (the sphere's inverse exponential) or difference.
    """
    mu, w, target = _mean_srsf(c, target), c.weights, np.asarray(target, float)[None]

    def kernel(v):
        _, y, _ = elastic.align_many(np.repeat(target, len(v), 0), v, c.grid, lam, band)
        q = elastic.srsf(y, c.grid)
        norm = np.sqrt(q**2 @ w)
        q = q / np.maximum(norm, 1e-12)[:, None]
        if method == "difference":
            return q - mu, norm, v[:, 0]
        d = np.clip(q @ (w * mu), -1, 1)
        angle = np.arccos(d)
        return np.where(angle < 1e-10, 0, angle / np.maximum(np.sin(angle), 1e-12))[:, None] * (q - d[:, None] * mu), norm, v[:, 0]

    return per_curve(c.df.select("id", "values"), kernel, "vector array<double>, norm double, first double")


def from_tangent(vectors: DataFrame, c: Curves, target) -> Curves:
    """Curves of tangent vectors (id, vector, norm, first) at the target."""
    mu, w = _mean_srsf(c, target), c.weights
    packed = vectors.select("id", F.concat(F.array("norm", "first"), "vector").alias("row"))

    def kernel(row):
        v = row[:, 2:]
        n = np.sqrt(v**2 @ w)
        q = np.cos(n)[:, None] * mu + (np.where(n > 1e-10, np.sin(n) / np.maximum(n, 1e-12), 1.0))[:, None] * v
        return np.array([elastic.srsf_inverse(x * s, c.grid, f) for x, s, f in zip(q, row[:, 0], row[:, 1], strict=True)])

    return c.with_df(per_curve(packed, kernel, "values array<double>", values="row"))


# ---- quality ----


def quality(c: Curves, aligned: DataFrame) -> dict[str, float]:
    """Mean complexity and smoothness of the warps, and integrated variances: total, amplitude
    (after alignment), phase (the rest). aligned: id, values, aligned, warp."""
    t, w = c.grid, c.weights
    n, s, q, a, b, g = sums(aligned, lambda v, y, x: [np.array([len(v)]), v.sum(0), (v**2).sum(0), y.sum(0), (y**2).sum(0), np.array([sum(elastic.warp_complexity(k, t) for k in x), sum(elastic.warp_smoothness(k, t) for k in x)])], ["values", "aligned", "warp"])
    total, amplitude = (float((u / n[0] - (m / n[0]) ** 2) @ w) for u, m in ((q, s), (b, a)))
    return {"complexity": float(g[0] / n[0]), "smoothness": float(g[1] / n[0]), "total": total, "amplitude": amplitude, "phase": max(total - amplitude, 0.0)}


def least_squares_score(c: Curves, aligned: DataFrame, derivative: int = 0) -> float:
    """Integrated squared distance to the leave-one-out mean after alignment over that before;
    of derivatives for the Sobolev form."""
    t, w = c.grid, c.weights
    d = lambda v: nm.derivative(v, t, derivative) if derivative else v
    n, s, q, a, b = sums(aligned, lambda v, y: [np.array([len(v)]), d(v).sum(0), (d(v) ** 2).sum(0), d(y).sum(0), (d(y) ** 2).sum(0)], ["values", "aligned"])
    # sum over i of (x_i - mean of the others)^2 is (n / (n - 1))^2 times the scatter
    before, after = (float((u - m**2 / n[0]) @ w) for u, m in ((q, s), (b, a)))
    return after / before if before > 1e-15 else 0.0


def correlation_score(c: Curves, aligned: DataFrame) -> float:
    """Sum of pairwise correlations after alignment over that before: sums of standardised curves."""
    z = lambda v: (v - v.mean(1, keepdims=True)) / np.maximum(np.linalg.norm(v - v.mean(1, keepdims=True), axis=1, keepdims=True), 1e-12)
    n, a, b = sums(aligned, lambda v, y: [np.array([len(v)]), z(v).sum(0), z(y).sum(0)], ["values", "aligned"])
    before, after = (float(x @ x - n[0]) for x in (a, b))
    return after / before if abs(before) > 1e-15 else 0.0


def consistency(curves: np.ndarray, t, lam: float = 0.0) -> float:
    """Mean error of warps composed around triples of a few curves, against the direct warp."""
    n = len(curves)
    warp = {(i, j): elastic.align(curves[i], curves[j], t, lam)[0] for i in range(n) for j in range(n) if i != j}
    errors = [nm.trapz(np.abs(elastic.compose(warp[j, k], warp[i, j], t) - warp[i, k]), t) / (t[-1] - t[0]) for i in range(n) for j in range(n) for k in range(n) if len({i, j, k}) == 3]
    return float(np.mean(errors)) if errors else 0.0


def choose_penalty(c: Curves, lams=(0.0, 0.01, 0.1, 1.0), n_folds: int = 3, seed: int = 42, band: float = 0.0) -> list[tuple[float, float]]:
    """(penalty, mean squared distance of held-out aligned curves to the mean of the others)."""
    from curvelake.operators.pointwise import folds

    df, out = folds(c.df.select("id", "values"), n_folds, seed), []
    for lam in lams:
        total = n = 0.0
        for k in range(n_folds):
            rest = c.with_df(df.where(F.col("fold") != k))
            m, s = sums(rest.df, lambda v: [np.array([len(v)]), v.sum(0)], ["values"])
            mean = s / m[0]

            def loss(v, mean=mean, lam=lam):
                _, y, _ = elastic.align_many(np.repeat(mean[None], len(v), 0), v, c.grid, lam, band)
                return [np.array([((y - mean) ** 2 @ c.weights).sum(), len(v)])]

            got = sums(df.where(F.col("fold") == k), loss, ["values"])[0]
            total, n = total + got[0], n + got[1]
        out.append((float(lam), float(total / n)))
    return out


def peak_counts(c: Curves, lams=(0.0, 0.1, 1.0), prominence: float = 0.1, band: float = 0.0) -> list[tuple[float, int]]:
    """(penalty, peaks of the mean of aligned curves)."""
    from curvelake.operators.season import peaks

    n, s = sums(c.df, lambda v: [np.array([len(v)]), v.sum(0)], ["values"])
    target, out = s / n[0], []
    for lam in lams:
        mean = sums(c.df, lambda v, lam=lam: [elastic.align_many(np.repeat(target[None], len(v), 0), v, c.grid, lam, band)[1].sum(0)], ["values"])[0] / n[0]
        out.append((float(lam), len(peaks(mean, c.grid, 0.0, prominence)[0])))
    return out


# ---- outliers and boxes of phase ----


def outliers(c: Curves, target, alpha: float = 0.05, lam: float = 0.0, band: float = 0.0) -> tuple[DataFrame, float]:
    """(id, amplitude, phase, distance, outlier; threshold): elastic distance to a target above
    its 1 - alpha quantile."""
    both = decomposition(c, target, lam, band).withColumn("distance", F.sqrt(F.col("amplitude") * F.col("amplitude") + F.col("phase") * F.col("phase"))).persist()
    limit = quantiles(both, "distance", [1 - alpha])[0]
    return both.withColumn("outlier", F.col("distance") > limit), limit


def phase_boxplot(aligned: DataFrame, t, factor: float = 1.5) -> tuple[list[tuple[float, ...]], DataFrame]:
    """(median, lower, upper, whisker low, whisker high by point; id, depth, central, outlier) of warps."""
    from curvelake.operators import depth

    w = Curves(aligned.select("id", F.col("warp").alias("values")), t)
    depths = depth.modified_band(w)
    box, marked = depth.boxplot(w, depths, factor)
    median = w.df.join(numbered(depths.withColumn("_s", -F.col("depth")), "_s", "id").where("rank = 1").select("id"), "id").first()["values"]
    found = box.orderBy("pos").collect()
    return [(float(m), r["lower"], r["upper"], max(r["fence_low"], float(t[0])), min(r["fence_high"], float(t[-1]))) for m, r in zip(median, found, strict=True)], marked


def transfer(source: Curves, target: Curves, lam: float = 0.0, band: float = 0.0) -> tuple[np.ndarray, DataFrame]:
    """(warp that carries the source's mean to the target's, the target's curves aligned to the
    source's mean): the target's own warps are composed with that bridge."""
    means = []
    for c in (source, target):
        n, s = sums(c.df, lambda v: [np.array([len(v)]), v.sum(0)], ["values"])
        means.append(s / n[0])
    bridge = elastic.align(means[0], means[1], source.grid, lam, band)[0]
    t, own = source.grid, means[1]

    def kernel(v):
        g, _, _ = elastic.align_many(np.repeat(own[None], len(v), 0), v, t, lam, band)
        g = np.array([elastic.normalize_warp(elastic.compose(x, bridge, t), t) for x in g])
        y = np.array([elastic.apply_warp(f, x, t) for f, x in zip(v, g, strict=True)])
        return y, g, np.sqrt((elastic.srsf(y, t) - elastic.srsf(means[0][None], t)) ** 2 @ source.weights)

    return bridge, per_curve(target.df.select("id", "values"), kernel, "aligned array<double>, warp array<double>, distance double")


# ---- curves in a space ----


def srsf_nd(f, t) -> np.ndarray:
    """(..., points, dimensions): velocity over the root of its length."""
    v = np.moveaxis(nm.central_differences(np.moveaxis(np.asarray(f, float), -2, -1), t), -1, -2)
    speed = np.linalg.norm(v, axis=-1, keepdims=True)
    return v / np.sqrt(np.maximum(speed, 1e-12))


def srsf_inverse_nd(q, t, first=0.0) -> np.ndarray:
    g = np.moveaxis(q * np.linalg.norm(q, axis=-1, keepdims=True), -2, -1)
    return np.moveaxis(nm.cumulative_simpson(g, t), -1, -2) + np.asarray(first)


def _warped(f, g, t):
    return np.stack([np.interp(g, t, f[:, k]) for k in range(f.shape[1])], 1)


def align_nd(f1, f2, t, lam: float = 0.0, band: float = 0.0):
    """(warps, warped f2, distances) of rows of curves (rows, points, dimensions)."""
    q1 = srsf_nd(f1, t)
    g = elastic.warp_dp_many(q1, srsf_nd(f2, t), t, lam, band)
    w = np.stack([_warped(f, x, t) for f, x in zip(f2, g, strict=True)])
    return g, w, np.sqrt(((q1 - srsf_nd(w, t)) ** 2).sum(2) @ nm.simpson_weights(t))


def _unflat(v, dims: int) -> np.ndarray:
    return np.swapaxes(v.reshape(len(v), dims, -1), 1, 2)


def _flat(f) -> np.ndarray:
    return np.swapaxes(f, 1, 2).reshape(len(f), -1)


def distances_nd(df: DataFrame, t, dims: int, lam: float = 0.0, band: float = 0.0) -> DataFrame:
    """(i, j, d) of flattened curves (id, values)."""
    def fn(a, b):
        y = _unflat(b, dims)
        return np.stack([align_nd(np.repeat(x[None], len(y), 0), y, t, lam, band)[2] for x in _unflat(a, dims)])

    return self_pairs(df, fn, size=elastic.block_size(t))


def karcher_mean_nd(df: DataFrame, t, dims: int, max_iter: int = 5, tol: float = 1e-4, lam: float = 0.0, band: float = 0.0) -> np.ndarray:
    """(points, dimensions): the mean SRSF of curves aligned to it, carried back."""
    n, s, first = sums(df, lambda v: [np.array([len(v)]), srsf_nd(_unflat(v, dims), t).sum(0), _unflat(v, dims)[:, 0].sum(0)], ["values"])
    q, start = s / n[0], first / n[0]
    for _ in range(max_iter):
        mean = srsf_inverse_nd(q, t, start)

        def step(v, mean=mean):
            f = _unflat(v, dims)
            return [srsf_nd(align_nd(np.repeat(mean[None], len(f), 0), f, t, lam, band)[1], t).sum(0)]

        new = sums(df, step, ["values"])[0] / n[0]
        moved = np.linalg.norm(new - q) / max(np.linalg.norm(q), 1e-12)
        q = new
        if moved < tol:
            break
    return srsf_inverse_nd(q, t, start)


def covariance_nd(df: DataFrame, t, dims: int, mean, k: int = 3, lam: float = 0.0, band: float = 0.0):
    """(covariance of flattened aligned SRSFs about the mean's, components, eigenvalues)."""
    mu = _flat(srsf_nd(mean[None], t))[0]

    def parts(v):
        f = _unflat(v, dims)
        x = _flat(srsf_nd(align_nd(np.repeat(mean[None], len(f), 0), f, t, lam, band)[1], t)) - mu
        return [np.array([len(v)]), x.T @ x]

    n, g = sums(df, parts, ["values"])
    cov = g / max(n[0] - 1, 1)
    val, vec = np.linalg.eigh(cov)
    return cov, vec[:, ::-1][:, :k], val[::-1][:k]


# ---- closed curves and shapes ----


def align_closed(f1, f2, t, starts: int = 8, lam: float = 0.0, band: float = 0.0):
    """(shift, warp, warped f2, distance) of closed curves (points, dimensions; the last point is
    the first): the start of f2 that fits best."""
    m = len(t) - 1
    shifts = [round(k * m / starts) for k in range(starts)]
    moved = np.stack([np.concatenate([(r := np.roll(f2[:m], -k, 0)), r[:1]]) for k in shifts])
    g, w, d = align_nd(np.repeat(np.asarray(f1)[None], len(shifts), 0), moved, t, lam, band)
    k = int(np.argmin(d))
    return shifts[k], g[k], w[k], float(d[k])


def scaled(v, w) -> np.ndarray:
    """Curves without level and size: centred, at unit norm of their SRSF's square (total variation)."""
    v = v - (v @ w / w.sum())[:, None]
    size = np.sqrt(v**2 @ w)
    return v / np.maximum(size, 1e-12)[:, None]


def shapes(c: Curves) -> Curves:
    """Representatives of curves up to level and size."""
    return c.with_df(per_curve(c.df, lambda v: scaled(v, c.weights), "values array<double>"))


def shape_distances(c: Curves, lam: float = 0.0, band: float = 0.0) -> DataFrame:
    return elastic.distances(shapes(c), lam, band)


def shape_mean(c: Curves, **options) -> np.ndarray:
    return elastic.karcher_mean(shapes(c), **options)


def mean_band(c: Curves, n_boot: int = 20, alpha: float = 0.05, seed: int = 1, lam: float = 0.0, band: float = 0.0):
    """(mean, lower, upper) of aligned curves: Poisson reweighting by id, in one pass."""
    n, s = sums(c.df, lambda v: [np.array([len(v)]), v.sum(0)], ["values"])
    target = s / n[0]

    def parts(v, ids):
        y = elastic.align_many(np.repeat(target[None], len(v), 0), v, c.grid, lam, band)[1]
        w = np.stack([np.random.default_rng([seed, int(i)]).poisson(1.0, n_boot) for i in ids]).astype(float)
        return [y.sum(0), w.T @ y, w.sum(0)]

    total, draws, mass = sums(c.df.withColumn("_id", F.col("id").cast("double")), parts, ["values", "_id"])
    low, high = np.quantile(draws / np.maximum(mass, 1)[:, None], [alpha / 2, 1 - alpha / 2], axis=0)
    return total / n[0], low, high


# ---- models of amplitude and phase ----


def joint_fpca(aligned: DataFrame, t, k: int = 3, balance: float | None = None):
    """(mean, vectors, eigenvalues, balance) of aligned SRSFs beside shooting vectors of the warps,
    the latter times ``balance`` (by default the ratio of the two total deviations)."""
    u = (t - t[0]) / (t[-1] - t[0])
    mu = elastic.psi((elastic.warp_statistics(aligned, t)[0] - t[0]) / (t[-1] - t[0]), u)
    mid = len(t) // 2
    amp = lambda v: np.hstack([elastic.srsf(v, t), (np.sign(v[:, mid]) * np.sqrt(np.abs(v[:, mid])))[:, None]])
    shoot = lambda w: np.array([elastic.sphere_log(mu, elastic.psi((x - t[0]) / (t[-1] - t[0]), u), u) for x in w])
    n, a, aa, b, bb = sums(aligned, lambda v, w: [np.array([len(v)]), amp(v).sum(0), (amp(v) ** 2).sum(0), shoot(w).sum(0), (shoot(w) ** 2).sum(0)], ["aligned", "warp"])
    if balance is None:
        va, vb = (float((q / n[0] - (s / n[0]) ** 2).sum()) for q, s in ((aa, a), (bb, b)))
        balance = math.sqrt(va / vb) if vb > 1e-15 else 1.0
    mean = np.concatenate([a, balance * b]) / n[0]
    row = lambda v, w: np.hstack([amp(v), balance * shoot(w)]) - mean
    g = sums(aligned, lambda v, w: [row(v, w).T @ row(v, w)], ["aligned", "warp"])[0] / (n[0] - 1)
    val, vec = np.linalg.eigh(g)
    return mean, vec[:, ::-1][:, :k], val[::-1][:k], balance


def sample_model(aligned: DataFrame, t, n: int, k: int = 3, joint: bool = False, seed: int = 1) -> DataFrame:
    """id, values, warp: curves drawn from normal scores of amplitude and phase components,
    apart or jointly; each row from its own seed."""
    import pandas as pd

    u, mid, m = (t - t[0]) / (t[-1] - t[0]), len(t) // 2, len(t)
    mu = elastic.psi((elastic.warp_statistics(aligned, t)[0] - t[0]) / (t[-1] - t[0]), u)
    if joint:
        mean, vec, val, balance = joint_fpca(aligned, t, k)
        draw = lambda r: mean + vec @ (np.sqrt(np.maximum(val, 0)) * r.standard_normal(len(val)))
        split = lambda x: (x[: m + 1], (x[m + 1 :] - mean[m + 1 :]) / balance)
    else:
        va, vb = elastic.vertical_fpca(aligned, t, k), elastic.horizontal_fpca(aligned, t, k)
        draw = lambda r: (va[0] + va[1] @ (np.sqrt(np.maximum(va[2], 0)) * r.standard_normal(k)), vb[1] @ (np.sqrt(np.maximum(vb[2], 0)) * r.standard_normal(k)))
        split = lambda x: x

    def one(i):
        q, v = split(draw(np.random.default_rng(seed + int(i))))
        f = elastic.srsf_inverse(q[:m], t)
        f = f + np.sign(q[m]) * q[m] ** 2 - f[mid]
        g = t[0] + (t[-1] - t[0]) * elastic.psi_to_warp(elastic.sphere_exp(mu, v, u), u)
        return np.interp(g, t, f).tolist(), g.tolist()

    def run(batches):
        for pdf in batches:
            got = [one(i) for i in pdf["id"]]
            yield pd.DataFrame({"id": pdf["id"], "values": [x[0] for x in got], "warp": [x[1] for x in got]})

    return aligned.sparkSession.range(n).mapInPandas(run, "id long, values array<double>, warp array<double>")


def tolerance_bands(aligned: DataFrame, t, coverage: float = 0.95, n_boot: int = 50, seed: int = 1):
    """((lower, upper) of aligned curves, (lower, upper) of warps): bootstrap tolerance bands."""
    from curvelake.operators.infer import tolerance_band

    out = []
    for column in ("aligned", "warp"):
        center, half = tolerance_band(Curves(aligned.select("id", F.col(column).alias("values")), t), 3, coverage, n_boot, seed=seed)
        out.append((center - half, center + half))
    low, high = (np.maximum.accumulate(np.clip(x, t[0], t[-1])) for x in out[1])
    return out[0], (low, high)


# ---- regression on aligned curves ----


def amplitude_scores(aligned: DataFrame, t, k: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """id, scores of the amplitude components, and the columns ``keep``."""
    mean, vec, _ = elastic.vertical_fpca(aligned, t, k)
    mid = len(t) // 2
    aug = lambda v: np.hstack([elastic.srsf(v, t), (np.sign(v[:, mid]) * np.sqrt(np.abs(v[:, mid])))[:, None]])
    return per_curve(aligned.select("id", *keep, "aligned"), lambda v: (aug(v) - mean) @ vec, "scores array<double>", values="aligned")


def phase_scores(aligned: DataFrame, t, k: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """id, scores of the phase components, and the columns ``keep``."""
    mu, vec, _ = elastic.horizontal_fpca(aligned, t, k)
    u = (t - t[0]) / (t[-1] - t[0])
    shoot = lambda w: np.array([elastic.sphere_log(mu, elastic.psi((x - t[0]) / (t[-1] - t[0]), u), u) for x in w])
    return per_curve(aligned.select("id", *keep, "warp"), lambda w: shoot(w) @ vec, "scores array<double>", values="warp")


def component_regression(aligned: DataFrame, t, y: str, k: int = 3, part: str = "amplitude", logistic: bool = False, ridge: float = 1e-6):
    """(intercept and slopes, the scored table with fit): y on amplitude, phase or both parts' scores."""
    from curvelake.operators.explain import sigmoid

    tables = {"amplitude": lambda: amplitude_scores(aligned, t, k, (y,)), "phase": lambda: phase_scores(aligned, t, k, (y,))}
    if part == "joint":
        scored = tables["amplitude"]().join(tables["phase"]().select("id", F.col("scores").alias("_p")), "id").withColumn("scores", F.concat("scores", "_p")).drop("_p")
    else:
        scored = tables[part]()
    scored = scored.withColumn(y, F.col(y).cast("double")).persist()
    design = lambda s: np.hstack([np.ones((len(s), 1)), s])
    b = None
    for _ in range(10 if logistic else 1):
        def parts(s, v, b=b):
            x = design(s)
            if not logistic:
                return [x.T @ x, x.T @ v]
            mu = sigmoid(x @ b) if b is not None else np.full(len(v), 0.5)
            w = np.maximum(mu * (1 - mu), 1e-10)
            eta = x @ b if b is not None else np.zeros(len(v))
            return [x.T @ (x * w[:, None]), x.T @ (w * (eta + (v - mu) / w))]

        xx, xy = sums(scored, parts, ["scores", y])
        b = np.linalg.solve(xx + ridge * np.eye(len(xx)), xy)
    fit = per_curve(scored, lambda s: sigmoid(design(s) @ b) if logistic else design(s) @ b, "fit double", values="scores")
    return b, fit


def attribution(aligned: DataFrame, t, y: str, k: int = 2) -> DataFrame:
    """id, amplitude, phase: what the two parts' scores add to a joint component regression."""
    b, _ = component_regression(aligned, t, y, k, "joint")
    amp, ph = amplitude_scores(aligned, t, k), phase_scores(aligned, t, k).select("id", F.col("scores").alias("phase"))
    dot = lambda c, w: F.aggregate(F.zip_with(c, F.lit([float(x) for x in w]), lambda p, q: p * q), F.lit(0.0), lambda p, q: p + q)
    return amp.join(ph, "id").select("id", dot("scores", b[1 : k + 1]).alias("amplitude"), dot("phase", b[k + 1 :]).alias("phase"))


# ---- change ----


def score_changepoint(scored: DataFrame, order: str = "id") -> tuple[int, float, float]:
    """(position, statistic, p) of the largest weighted CUSUM of the scores in an order; p by the
    Kolmogorov limit of its least probable component."""
    from pyspark.sql import Window

    n, s, q = sums(scored, lambda v: [np.array([len(v)]), v.sum(0), (v**2).sum(0)], ["scores"])
    mean = s / n[0]
    sd = np.sqrt(np.maximum(q / n[0] - mean**2, 1e-15))
    rows = numbered(scored.select(order, "scores"), order, name="k").select("k", F.posexplode("scores").alias("pos", "v"))
    chunk = F.floor((F.col("k") - 1) / 100_000)
    rows = rows.withColumn("z", (F.col("v") - F.get(F.lit([float(x) for x in mean]), F.col("pos"))) / F.get(F.lit([float(x) for x in sd]), F.col("pos"))).withColumn("chunk", chunk)
    before = rows.groupBy("pos", "chunk").agg(F.sum("z").alias("whole"))
    before = before.select("pos", "chunk", (F.sum("whole").over(Window.partitionBy("pos").orderBy("chunk")) - F.col("whole")).alias("before"))
    own = F.sum("z").over(Window.partitionBy("pos", "chunk").orderBy("k"))
    walk = rows.withColumn("own", own).join(before, ["pos", "chunk"]).select("k", "pos", (F.abs(F.col("own") + F.col("before")) / math.sqrt(n[0])).alias("s"))
    best = walk.groupBy("k").agg(F.max("s").alias("s")).agg(F.max_by(F.struct("k", "s"), F.struct("s", -F.col("k"))).alias("m")).first()["m"]
    x = float(best["s"])
    tail = 2 * sum((-1) ** (j - 1) * math.exp(-2 * j * j * x * x) for j in range(1, 101))
    return int(best["k"]), x, float(min(max(1 - (1 - min(max(tail, 0), 1)) ** len(mean), 0), 1))


def warp_posterior(f1, f2, t, draws: int = 200, k: int = 5, noise: float = 0.1, seed: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean warp, lower, upper): Metropolis draws of a warp's tangent coefficients at the identity
    around the best warp, given normal errors of the aligned SRSFs."""
    u = (t - t[0]) / (t[-1] - t[0])
    basis = np.stack([math.sqrt(2) * np.sin(j * math.pi * u) if j % 2 else math.sqrt(2) * np.cos(j * math.pi * u) for j in range(1, k + 1)])
    q1, one, w = elastic.srsf(f1, t), np.ones(len(t)), nm.simpson_weights(t)
    best = elastic.align(f1, f2, t)[0]
    rng, b = np.random.default_rng(seed), np.zeros(k)

    def warp(b):
        g = t[0] + (t[-1] - t[0]) * elastic.psi_to_warp(elastic.sphere_exp(one, b @ basis, u), u)
        return elastic.normalize_warp(elastic.compose(best, g, t), t)

    def energy(b):
        return float((q1 - elastic.srsf(elastic.apply_warp(f2, warp(b), t), t)) ** 2 @ w) / (2 * noise**2) + float(b @ b) / 2

    now, kept = energy(b), []
    for i in range(2 * draws):
        step = b + 0.05 * rng.standard_normal(k)
        e = energy(step)
        if math.log(max(rng.random(), 1e-300)) < now - e:
            b, now = step, e
        if i >= draws:
            kept.append(warp(b))
    got = np.array(kept)
    return got.mean(0), *np.quantile(got, [0.025, 0.975], axis=0)


