"""Clusters in subspaces of their own, in a discriminative one, and up to warps.

Every step is one pass that adds up, for each cluster, its weight, first and second moments
under the members' probabilities (or aligned SRSFs); subspaces, likelihoods and templates
follow from those sums on the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvelake.operators import cluster, elastic
from curvelake.operators.apply import held, per_curve, sums
from curvelake.operators.reduce import fpca
from curvelake.sources.curves import Curves

FLOOR = 1e-8


def _shares(logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(probabilities, log of the sums) of rows of log densities."""
    top = logs.max(1, keepdims=True)
    e = np.exp(logs - top)
    return e / e.sum(1, keepdims=True), top[:, 0] + np.log(e.sum(1))


def _moments(df: DataFrame, member) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """(log likelihood, weights, first and second moments by cluster) under member(values) ->
    (probabilities, log likelihoods)."""

    def parts(v):
        r, ll = member(v)
        return [np.array([ll.sum()]), r.sum(0), r.T @ v, np.einsum("nk,np,nq->kpq", r, v, v)]

    ll, n, first, second = sums(df, parts, ["values"])
    return float(ll[0]), n, first, second


def _nearest(mid, w):
    """Hard membership: the nearest centre."""
    def member(v):
        own = cluster._square(v, mid, w).argmin(1)
        return np.eye(len(mid))[own], np.zeros(len(v))

    return member


@dataclass
class Discriminative:
    """Mixture of diagonal normal distributions on directions that tell clusters apart."""

    basis: object
    directions: np.ndarray  # (components, directions)
    weights: np.ndarray
    means: np.ndarray
    variances: np.ndarray
    log_likelihood: float
    n_iter: int
    converged: bool

    def _logs(self):
        u, pi, mu, var = self.directions, self.weights, self.means, self.variances
        return lambda s: np.log(np.maximum(pi, 1e-300)) - 0.5 * (np.log(var).sum(1) + (((s @ u)[:, None] - mu) ** 2 / var).sum(2) + u.shape[1] * math.log(2 * math.pi))

    def predict(self, c: Curves) -> DataFrame:
        """All columns but values, with cluster and probabilities."""
        logs, basis = self._logs(), self.basis

        def assign(v):
            p = _shares(logs(basis.project(v)))[0]
            return p.argmax(1), p

        return per_curve(c.df, assign, "cluster int, probabilities array<double>")


def discriminative(c: Curves, k: int, components: int = 5, directions: int = 0, max_iter: int = 100, tol: float = 1e-6, seed: int = 1) -> Discriminative:
    """Fisher expectation-maximisation on component scores: expectation in the directions, then
    new directions from the spread between clusters over that within. Starts from k-means."""
    if k < 1 or components < 1:
        raise ValueError("clusters and components have to be 1 at least")
    basis = fpca(c, components)
    q = basis.loadings.shape[1]
    p = min(max(k - 1, 1) if directions == 0 else directions, q)
    with held(per_curve(c.df.select("id", "values"), basis.project, "values array<double>")) as scored:
        s = Curves(scored, np.arange(q, dtype=float))
        mid = cluster._kmeans(s, cluster._seeds(s, k, seed), 100, 1e-6)
        u = np.eye(q)[:, :p]
        _, n, first, second = _moments(scored.select("values"), _nearest(mid, s.weights))
        last, converged = -math.inf, False
        for step in range(1, max_iter + 1):
            mean = first / np.maximum(n, 1e-10)[:, None]
            spread = second / np.maximum(n, 1e-10)[:, None, None] - np.einsum("kp,kq->kpq", mean, mean)
            model = Discriminative(basis, u, n / n.sum(), mean @ u, np.maximum(np.einsum("pd,kpq,qd->kd", u, spread, u), FLOOR), last, step, False)
            logs = model._logs()
            ll, n, first, second = _moments(scored.select("values"), lambda v, logs=logs: _shares(logs(v)))
            model.log_likelihood = ll
            mean = first / np.maximum(n, 1e-10)[:, None]
            centre = first.sum(0) / n.sum()
            between = np.einsum("k,kp,kq->pq", np.maximum(n, 1), mean - centre, mean - centre)
            within = second.sum(0) - np.einsum("k,kp,kq->pq", n, mean, mean)
            within += max(np.trace(within) / q * 1e-4, FLOOR) * np.eye(q)
            if step > 1 and abs(ll - last) < tol:
                converged = True
                break
            last = ll
            u = np.linalg.svd(np.linalg.solve(within, between))[0][:, :p]
    model.converged = converged
    return model


@dataclass
class Subspaces:
    """Clusters with a subspace each: variances along its directions, one variance off it."""

    weights: np.ndarray
    means: np.ndarray
    directions: list  # (points, dimensions) of each cluster
    variances: list
    noise: np.ndarray
    log_likelihood: float
    bic: float
    icl: float
    n_iter: int
    converged: bool

    def _logs(self):
        pi, mu, us, a, b = self.weights, self.means, self.directions, self.variances, self.noise
        m = mu.shape[1]

        def logs(v):
            out = np.empty((len(v), len(pi)))
            for j in range(len(pi)):
                d = v - mu[j]
                z = d @ us[j]
                off = np.maximum((d**2).sum(1) - (z**2).sum(1), 0)
                out[:, j] = math.log(max(pi[j], 1e-300)) - 0.5 * (np.log(a[j]).sum() + (z**2 / a[j]).sum(1) + (m - len(a[j])) * math.log(b[j]) + off / b[j] + m * math.log(2 * math.pi))
            return out

        return logs

    def predict(self, c: Curves) -> DataFrame:
        """All columns but values, with cluster and probabilities."""
        logs = self._logs()

        def assign(v):
            p = _shares(logs(v))[0]
            return p.argmax(1), p

        return per_curve(c.df, assign, "cluster int, probabilities array<double>")


def _subspace(n: np.ndarray, first, second, dims: int | None, share: float, floor: float) -> Subspaces:
    k, m = first.shape
    mean = first / np.maximum(n, 1e-10)[:, None]
    us, variances, noise = [], [], np.full(k, floor)
    for j in range(k):
        val, vec = np.linalg.eigh(second[j] / max(n[j], 1e-10) - np.outer(mean[j], mean[j]))
        val, vec = np.maximum(val[::-1], 0), vec[:, ::-1]
        d = dims if dims is not None else int(np.searchsorted(np.cumsum(val), share * val.sum()) + 1)
        d = max(1, min(d, m - 1))
        us.append(vec[:, :d])
        variances.append(np.maximum(val[:d], floor))
        noise[j] = max(val[d:].sum() / (m - d), floor)
    return Subspaces(n / n.sum(), mean, us, variances, noise, -math.inf, math.inf, math.inf, 0, False)


def subspaces(c: Curves, k: int, dims: int | None = 2, share: float = 0.9, max_iter: int = 100, tol: float = 1e-6, n_init: int = 3, seed: int = 42) -> Subspaces:
    """Mixture whose clusters have their own subspaces; the best of n_init starts from k-means.
    Without ``dims`` a cluster takes as many directions as hold ``share`` of its variance."""
    with held(c.df.select("id", "values")) as df:
        n, s, ss = sums(df, lambda v: [np.array([len(v)]), v.sum(0), (v**2).sum(0)], ["values"])
        floor = max(1e-6 * float((ss / n[0] - (s / n[0]) ** 2).mean()), 1e-12)
        own = c.with_df(df)
        models = []
        for start in range(n_init):
            mid = cluster._kmeans(own, cluster._seeds(own, k, seed + start), 100, 1e-6)
            models.append(_subspace(*_moments(df.select("values"), _nearest(mid, c.weights))[1:], dims, share, floor))
        live = list(range(n_init))
        for step in range(1, max_iter + 1):
            # all starts that still move go through the table together
            kernels = [models[i]._logs() for i in live]

            def parts(v, kernels=kernels):
                out = []
                for logs in kernels:
                    r, ll = _shares(logs(v))
                    out += [np.array([ll.sum()]), r.sum(0), r.T @ v, np.einsum("nk,np,nq->kpq", r, v, v)]
                return out

            got = sums(df.select("values"), parts, ["values"])
            for place, i in enumerate(list(live)):
                ll, mass, first, second = got[4 * place : 4 * place + 4]
                last = models[i].log_likelihood
                models[i].log_likelihood, models[i].n_iter = float(ll[0]), step
                if step > 1 and abs(float(ll[0]) - last) < tol:
                    models[i].converged = True
                    live.remove(i)
                elif step < max_iter:
                    models[i] = _subspace(mass, first, second, dims, share, floor)
                    models[i].log_likelihood = float(ll[0])
            if not live:
                break
        best = max(models, key=lambda m: m.log_likelihood)
        logs = best._logs()
        entropy = sums(df.select("values"), lambda v: [np.array([-(p := _shares(logs(v))[0]).ravel() @ np.log(np.maximum(p, 1e-300)).ravel()])], ["values"])[0][0]
    m = len(c.grid)
    free = k - 1 + k * (m + 1) + sum(len(a) * (m - (len(a) + 1) / 2) + len(a) for a in best.variances)
    best.bic = -2 * best.log_likelihood + free * math.log(n[0])
    best.icl = best.bic + 2 * float(entropy)
    return best


# ---- up to warps ----


def align_clusters(c: Curves, k: int, max_iter: int = 10, karcher_iter: int = 5, tol: float = 1e-3, lam: float = 0.0, seed: int = 42) -> tuple[np.ndarray, DataFrame, int, bool]:
    """(templates, c's columns but values with cluster and distances, rounds, whether labels came
    to rest): every curve goes to the template of least elastic distance, and each cluster's
    template becomes the Karcher mean of its curves, all clusters in the same passes.

    The first templates are k curves drawn by a hash of their ids; a cluster left empty takes
    the curve that is farthest from its own template.
    """
    t = c.grid
    first = c.df.orderBy(F.xxhash64(F.lit(seed), "id"), "id").select("values").limit(k).collect()
    if len(first) < k:
        raise ValueError("fewer curves than clusters")
    templates = np.array([r["values"] for r in first])

    def near(templates):
        def kernel(v):
            d = np.stack([elastic.align_many(np.repeat(x[None], len(v), 0), v, t, lam)[2] for x in templates], 1)
            return d.argmin(1), d

        return kernel

    with held(c.df) as df:
        before, rest = None, False
        for step in range(1, max_iter + 1):
            found = per_curve(df, near(templates), "cluster int, distances array<double>")
            labelled = df.select("id", "values").join(found.select("id", "cluster", F.col("distances")[F.col("cluster")].alias("own")), "id").persist()
            labels = labelled.agg(F.sum(F.xxhash64("id", "cluster").cast("decimal(20,0)")), F.count("*")).first()
            if labels == before:
                rest = True
                labelled.unpersist()
                break
            before = labels
            templates = _templates(labelled, templates, t, karcher_iter, tol, lam)
            labelled.unpersist()
    return templates, per_curve(c.df, near(templates), "cluster int, distances array<double>"), step, rest


def _templates(labelled: DataFrame, templates: np.ndarray, t, max_iter: int, tol: float, lam: float) -> np.ndarray:
    """The Karcher mean of each cluster, all aligned in the same passes."""
    k = len(templates)
    one = lambda g: np.eye(k)[g.astype(int)]
    n, q, f0 = sums(labelled, lambda v, g: [one(g).sum(0), one(g).T @ elastic.srsf(v, t), one(g).T @ v[:, 0]], ["values", "cluster"])
    live = n > 0
    q, f0 = q / np.maximum(n, 1)[:, None], f0 / np.maximum(n, 1)
    for _ in range(max_iter):
        means = np.array([elastic.srsf_inverse(x, t, f) for x, f in zip(q, f0, strict=True)])

        def step(v, g, means=means):
            y = elastic.align_many(means[g.astype(int)], v, t, lam)[1]
            return [one(g).T @ elastic.srsf(y, t)]

        new = sums(labelled, step, ["values", "cluster"])[0] / np.maximum(n, 1)[:, None]
        moved = np.linalg.norm(new - q, axis=1) / np.maximum(np.linalg.norm(q, axis=1), 1e-12)
        q = new
        if moved[live].max() < tol:
            break
    out = np.array([elastic.srsf_inverse(x, t, f) for x, f in zip(q, f0, strict=True)])
    if not live.all():
        far = labelled.orderBy(F.desc("own"), "id").select("values").limit(int((~live).sum())).collect()
        out[~live] = [r["values"] for r in far]
    return out
