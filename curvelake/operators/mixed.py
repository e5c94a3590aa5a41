"""Functional mixed models: curves of subjects seen several times, with fixed effects.

A random intercept's weights depend on a subject only through its number of rows, so
everything the iterations need is a few sums over subjects by that number.  One pass adds
up each subject's rows (partial sums first, so a subject with many rows is no hot key), a
second adds up subjects of equal size, and expectation-maximisation for all responses runs
on those small arrays; the table is not read again until subjects' effects are written.

Responses are component scores, a few for each curve, or the values at grid points; the
grid bounds the width of the sums.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curvelake.operators import reduce
from curvelake.operators.apply import block_sums, matrix, per_curve, sums
from curvelake.sources.curves import Curves

LEAST = 1e-15


@dataclass
class Totals:
    """Sums over rows (x x', x y, y^2, x, y) and, by rows of a subject, over subjects of the
    products of their row sums; q responses, p covariates."""

    n: int
    xx: np.ndarray
    xy: np.ndarray
    yy: np.ndarray
    x: np.ndarray
    y: np.ndarray
    size: np.ndarray
    subjects: np.ndarray
    sxx: np.ndarray
    sxy: np.ndarray
    syy: np.ndarray

    def squares(self, gamma: np.ndarray) -> np.ndarray:
        """Sum of squared residuals of each response."""
        return self.yy - 2 * (gamma * self.xy).sum(0) + np.einsum("pq,pr,rq->q", gamma, self.xx, gamma)

    def between(self, gamma: np.ndarray) -> np.ndarray:
        """By subject size: the sum over subjects of their squared residual sums."""
        return self.syy - 2 * np.einsum("pq,gpq->gq", gamma, self.sxy) + np.einsum("pq,gpr,rq->gq", gamma, self.sxx, gamma)


@dataclass
class Fit:
    gamma: np.ndarray
    sigma2_u: np.ndarray
    sigma2_e: np.ndarray
    n_iter: np.ndarray
    converged: np.ndarray


def by_subject(df: DataFrame, subject: str, x: str, y: str, p: int, q: int, by: list[str] | None = None, more: list | None = None) -> DataFrame:
    """(by,) subject, n, sx and sy (and sums ``more`` of x and y): each subject's rows added up."""
    by = by or []
    add = lambda name, k: [F.sum(F.get(F.col(name), F.lit(j))).alias(f"_{name}{j}") for j in range(k)]
    both = df.select(*by, F.col(subject).alias("subject"), F.col(x).alias("x"), F.col(y).alias("y"), *([F.col(y).alias("scores")] if more else []))
    grouped = both.groupBy(*by, "subject").agg(F.count("*").alias("n"), *add("x", p), *add("y", q), *(more or []))
    listed = lambda name, k: F.array(*[F.col(f"_{name}{j}") for j in range(k)]).cast("array<double>")
    return grouped.select(*by, "subject", "n", listed("x", p).alias("sx"), listed("y", q).alias("sy"), *[c for c in grouped.columns if c.startswith("xy")])


def _by_size(subjects: DataFrame, p: int, q: int, by: list[str], xy: list[str]):
    """For each group of ``by``: its key and the sums over subjects of equal size (with those of
    the columns xy), which are few: sizes that differ add up to the rows at most."""
    schema = T.StructType.fromDDL("rep int, n long, k int, v double")
    width = 1 + p * p + p * q + q + len(xy)

    def parts(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            rep, many = np.asarray(batch.column("rep")), np.asarray(batch.column("n"))
            a = np.reshape(matrix(batch.column("sx")) if p else np.zeros((len(many), 0)), (len(many), p))
            b, m = matrix(batch.column("sy")), np.reshape([np.asarray(batch.column(c)) for c in xy], (len(xy), len(many)))
            for r, size in np.unique(np.stack([rep, many], 1), axis=0):
                at = (rep == r) & (many == size)
                v = np.concatenate([[at.sum()], (a[at].T @ a[at]).ravel(), (a[at].T @ b[at]).ravel(), (b[at] ** 2).sum(0), m[:, at].sum(1)])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(width, r), pa.int32()), pa.array(np.full(width, size)), pa.array(np.arange(width), pa.int32()), pa.array(v)], names=schema.names)

    key = F.col(by[0]).cast("int") if by else F.lit(0)
    got = subjects.select(key.alias("rep"), "n", "sx", "sy", *xy).mapInArrow(parts, schema).groupBy("rep", "n", "k").agg(F.sum("v").alias("v")).orderBy("rep", "n", "k").toPandas()
    cut = np.cumsum([1, p * p, p * q, q])
    for r, rows in got.groupby("rep"):
        table = rows["v"].to_numpy().reshape(-1, width)
        g = len(table)
        sums_of = {"size": rows["n"].to_numpy()[::width].astype(float), "subjects": table[:, 0], "sxx": table[:, cut[0] : cut[1]].reshape(g, p, p), "sxy": table[:, cut[1] : cut[2]].reshape(g, p, q), "syy": table[:, cut[2] : cut[3]]}
        yield r, sums_of | ({"xy": table[:, cut[3] :].sum(0).reshape(p, q)} if xy else {})


def totals(df: DataFrame, subjects: DataFrame, x: str, y: str, p: int, q: int) -> Totals:
    """The sums of a table (x and y as arrays of p and q) and of its subjects."""

    def rows(xs, ys):
        xs = np.reshape(xs, (len(ys), p))
        return [np.array([len(ys)]), xs.T @ xs, xs.T @ ys, (ys**2).sum(0), xs.sum(0), ys.sum(0)]

    n, xx, xy, yy, sx, sy = sums(df.select(*([x] if p else []), y), rows if p else (lambda ys: rows(np.zeros((len(ys), 0)), ys)), [x, y] if p else [y])
    _, sized = next(_by_size(subjects, p, q, [], []))
    return Totals(int(n[0]), np.reshape(xx, (p, p)), np.reshape(xy, (p, q)), yy, np.reshape(sx, p), sy, **sized)


def fit(t: Totals, max_iter: int = 50, tol: float = 1e-10) -> Fit:
    """Fixed effects by generalised least squares and variance components by restricted
    expectation-maximisation, for every response by itself, from sums alone."""
    p, q = len(t.x), len(t.yy)
    n_subjects = t.subjects.sum()
    gamma = np.linalg.solve(t.xx + 1e-8 * np.eye(p), t.xy) if p else np.zeros((0, q))
    per = t.size[:, None]
    mean_squares = t.between(gamma) / per
    grand = (t.y - t.x @ gamma) / t.n
    free = t.n - n_subjects
    e = (t.squares(gamma) - mean_squares.sum(0)) / free if free > 0 else np.full(q, 1e-6)
    u = np.maximum(((mean_squares.sum(0) - t.n * grand**2) / max(n_subjects - 1, 1) - e) / (t.n / n_subjects), 0)
    e = np.where(e < LEAST, 1e-6, e)
    u = np.where(u < LEAST, 0.1 * e, u)
    steps, done = np.zeros(q, int), np.zeros(q, bool)
    for _ in range(max_iter):
        live = ~done
        if not live.any():
            break
        steps[live] += 1
        w = u / (u + e / per)  # by size and response
        if p:
            for k in np.flatnonzero(live):
                share = w[:, k] / t.size
                a = (t.xx - np.einsum("g,gpr->pr", share, t.sxx)) / e[k] + 1e-10 * np.eye(p)
                gamma[:, k] = np.linalg.solve(a, (t.xy[:, k] - share @ t.sxy[:, :, k]) / e[k])
        sq = t.between(gamma)
        left = t.subjects[:, None] * u * (1 - w)  # conditional variances
        new_u = np.maximum((w**2 * sq / per**2 + left).sum(0) / n_subjects, LEAST)
        new_e = np.maximum((t.squares(gamma) - ((2 * w - w**2) * sq / per).sum(0) + (per * left).sum(0)) / max(t.n - p, 1), LEAST)
        change = np.abs(new_u - u) + np.abs(new_e - e)
        close = change < tol * (u + e)
        u, e = np.where(live, new_u, u), np.where(live, new_e, e)
        done |= live & close
    return Fit(gamma, u, e, steps, done)


def effects(subjects: DataFrame, f: Fit, p: int, name: str = "u") -> DataFrame:
    """subject, n and its predicted random effects, one for each response."""

    def kernel(batches):
        for batch in batches:
            if batch.num_rows:
                n, b = np.asarray(batch.column("n"), float)[:, None], matrix(batch.column("sy"))
                a = np.reshape(matrix(batch.column("sx")) if p else np.zeros((len(n), 0)), (len(n), p))
                u = f.sigma2_u / np.maximum(f.sigma2_u + f.sigma2_e / n, LEAST) * (b - a @ f.gamma) / n
                values = pa.ListArray.from_arrays(pa.array(np.arange(len(u) + 1) * u.shape[1], pa.int32()), pa.array(u.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("subject"), batch.column("n"), values], names=["subject", "n", name])

    schema = T.StructType([subjects.schema["subject"], T.StructField("n", T.LongType()), T.StructField(name, T.ArrayType(T.DoubleType()))])
    return subjects.select("subject", "n", "sx", "sy").mapInArrow(kernel, schema)


@dataclass
class FunctionalMixed:
    """Curves = mean + x' beta(t) + b_subject(t) + error, by component scores."""

    components: reduce.Fpca
    fit: Fit
    beta: np.ndarray  # (covariates, points)
    subjects: DataFrame  # subject, n, u (scores of its random effect)
    subject: str
    x: str | None
    n_subjects: int

    def _fixed(self):
        """The kernel of fixed-effect curves: it carries arrays only."""
        mean, beta = self.components.mean, self.beta
        return lambda x: mean + np.reshape(x, (len(x), -1)) @ beta

    def random_effects(self) -> DataFrame:
        """subject, n and effect: its random curve."""
        m = self.components
        return per_curve(self.subjects, lambda u: u @ m.loadings.T, "effect array<double>", values="u")

    def random_variance(self) -> np.ndarray:
        """Variance of the random curves over subjects at each point."""
        m = self.components
        s, u, uu = sums(self.subjects, lambda u: [np.array([len(u)]), u.sum(0), u.T @ u], ["u"])
        cov = uu / s[0] - np.outer(u, u) / s[0] ** 2
        return np.einsum("tk,kj,tj->t", m.loadings, cov, m.loadings)

    def fitted(self, c: Curves) -> DataFrame:
        """c's columns with fitted and residual curves; unknown subjects have no random effect."""
        m, k = self.components, len(self.fit.sigma2_u)
        known = self.subjects.select(F.col("subject").alias(self.subject), "u")
        rows = c.df.join(known, self.subject, "left").withColumn("u", F.coalesce("u", F.array(*[F.lit(0.0)] * k)))
        packed = F.concat(*([F.col(self.x)] if self.x else []), F.col("u"), F.col("values"))
        points, fixed = len(m.mean), self._fixed()

        def kernel(v):
            x, u, y = np.split(v, [v.shape[1] - points - k, v.shape[1] - points], 1)
            f = fixed(x) + u @ m.loadings.T
            return f, y - f

        return per_curve(rows.select(*[x for x in rows.columns if x not in ("u", "values")], packed.alias("_p")), kernel, "fitted array<double>, residual array<double>", values="_p")

    def predict(self, new: DataFrame) -> DataFrame:
        """Fixed-effect curves of a table of covariates, for subjects not seen."""
        if not self.x:
            raise ValueError("a model without covariates predicts its mean")
        return per_curve(new, self._fixed(), "values array<double>", values=self.x)


def _scored(c: Curves, subject: str, x: str | None, k: int) -> tuple[reduce.Fpca, DataFrame, int]:
    m = reduce.fpca(c, k)
    keep = [subject] + ([x] if x else [])
    scored = per_curve(c.df.select(*keep, "values"), m.project, "scores array<double>")
    p = 0
    if x:
        first = c.df.select(F.size(x)).first()
        if first is None:
            raise ValueError("an empty table has no model")
        p = first[0]
    return m, scored if x else scored.withColumn("_x", F.array().cast("array<double>")), p


def functional(c: Curves, subject: str, x: str | None = None, k: int = 3, max_iter: int = 50, tol: float = 1e-10) -> FunctionalMixed:
    """A mixed model of each of k component scores; ``x``: a column of covariate arrays."""
    m, scored, p = _scored(c, subject, x, k)
    q = m.loadings.shape[1]
    people = by_subject(scored, subject, x or "_x", "scores", p, q)
    t = totals(scored, people, x or "_x", "scores", p, q)
    f = fit(t, max_iter, tol)
    return FunctionalMixed(m, f, f.gamma @ m.loadings.T, effects(people, f, p), subject, x, int(t.subjects.sum()))


def permutation_test(c: Curves, subject: str, x: str, k: int = 3, n_perm: int = 99, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Integrated squared effect of each covariate, and its p-value over permutations of the
    covariates among rows.

    Rows meet in blocks of whole subjects, drawn by a hash, and a replicate permutes the covariates
    within each block; blocks add up all replicates' sums, so that no row is written for a
    replicate. A subject's rows lie in one block.
    """
    m, _, p = _scored(c, subject, x, k)
    q = m.loadings.shape[1]
    plain = per_curve(c.df.select(F.col("id").alias("row"), F.col(subject).alias("subject"), F.col(x).alias("x"), "values"), m.project, "scores array<double>").persist()
    t = totals(plain, by_subject(plain, "subject", "x", "scores", p, q), "x", "scores", p, q)
    gram = m.loadings.T @ m.loadings / max(len(m.mean) - 1, 1)
    statistic = lambda f: np.einsum("pk,kj,pj->p", f.gamma, gram, f.gamma)
    observed = statistic(fit(t))
    xy, sxx, sxy = permuted_sums(plain, t.size, n_perm, seed)
    plain.unpersist()
    more = np.zeros(p, int)
    for own in zip(xy, sxx, sxy, strict=True):
        more += statistic(fit(replace(t, **dict(zip(("xy", "sxx", "sxy"), own, strict=True))))) >= observed
    return observed, (more + 1) / (n_perm + 1)


def permuted_sums(df: DataFrame, sizes: np.ndarray, n_perm: int, seed: int, block: int = 16_384) -> list[np.ndarray]:
    """For each replicate: sums of x scores' over rows and, by size of a subject, of its row sums'
    products, where x is permuted within blocks; df: row, subject, x, scores."""

    def sums_of(at, _, who, x, scores):
        first = np.flatnonzero(np.append(True, who[1:] != who[:-1]))  # rows come by subject
        size = np.searchsorted(sizes, np.diff(np.append(first, len(who))))
        p, q, g = x.shape[1], scores.shape[1], len(sizes)
        sy, order = np.add.reduceat(scores, first), np.argsort(size, kind="stable")
        present, start = np.unique(size[order], return_index=True)
        xy, sxx, sxy = np.zeros((n_perm, p, q)), np.zeros((n_perm, g, p, p)), np.zeros((n_perm, g, p, q))
        for k in range(n_perm):
            new = x[np.random.default_rng([seed, at, k]).permutation(len(x))]
            sx = np.add.reduceat(new, first)
            xy[k] = new.T @ scores
            for rows, s in zip(np.split(order, start[1:]), present, strict=True):
                sxx[k, s], sxy[k, s] = sx[rows].T @ sx[rows], sx[rows].T @ sy[rows]
        return [xy, sxx, sxy]

    rows = df.select(F.col("subject").alias("id"), "row", F.col("subject").cast("string").alias("who"), "x", "scores")
    return block_sums(rows, lambda at, own, row, who, x, scores: sums_of(at, own, who, x, scores), ["row", "who", "x", "scores"], lambda counts: counts, block)


@dataclass
class Pointwise:
    """A mixed model at every grid point; effects smoothed along the grid."""

    beta: np.ndarray  # (covariates, points)
    t: np.ndarray
    p: np.ndarray
    sigma2_u: np.ndarray
    sigma2_e: np.ndarray


def pointwise(c: Curves, subject: str, x: str | None = None, window: int = 3, max_iter: int = 30, tol: float = 1e-8) -> Pointwise:
    """Massively univariate fits, a running mean of ``window`` points (made odd) over the
    effects, and Wald statistics with normal p-values."""
    if window < 1 or max_iter < 1:
        raise ValueError("a window and the iterations need to be 1 at least")
    points = len(c.grid)
    df = c.df if x else c.df.withColumn("_x", F.array().cast("array<double>"))
    x = x or "_x"
    p = df.select(F.size(x)).first()[0]
    t = totals(df, by_subject(df, subject, x, "values", p, points), x, "values", p, points)
    f = fit(t, max_iter, tol)
    half = window // 2
    beta = np.stack([f.gamma[:, max(0, k - half) : k + half + 1].mean(1) for k in range(points)], 1) if p else f.gamma
    spread = np.maximum(np.diag(np.linalg.inv(t.xx + 1e-8 * np.eye(p))), LEAST) if p else np.zeros(0)
    z = beta / np.maximum(np.sqrt(np.outer(spread, f.sigma2_e)), LEAST)
    tail = np.array([math.erfc(abs(v) / math.sqrt(2)) for v in z.ravel()]).reshape(z.shape)
    return Pointwise(beta, z, np.clip(tail, 0, 1), f.sigma2_u, f.sigma2_e)
