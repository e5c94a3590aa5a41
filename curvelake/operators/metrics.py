"""Distances between curves: kernels on blocks, and tables (i, j, d) built from them."""

from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvelake.functions import numeric as nm
from curvelake.operators.apply import WIDE, _block_count, _tiles, cross_pairs, moments, pair_rows, pair_sums, self_pairs
from curvelake.sources.curves import Curves


def squares(a, b) -> np.ndarray:
    """Squared Euclidean distances by a matrix product; where it would lose digits they are
    summed from differences, so equal curves are at 0."""
    shift = b.mean(0)
    a, b = a - shift, b - shift
    own, other = (a**2).sum(1), (b**2).sum(1)
    d = np.column_stack([-2 * a, own, np.ones(len(a))]) @ np.column_stack([b, np.ones(len(b)), other]).T
    near = 1e-5 * (own.max(initial=0.0) + other.max(initial=0.0))
    if d.min(initial=np.inf) <= near:
        i, j = np.nonzero(d <= near)
        for k in range(0, len(i), 16_384):
            x, y = i[k : k + 16_384], j[k : k + 16_384]
            d[x, y] = ((a[x] - b[y]) ** 2).sum(1)
    return d


def lp(w, p: float = 2.0):
    root = np.sqrt(np.maximum(w, 0))

    def fn(a, b):
        if p == 2 and (np.asarray(w) >= 0).all():
            return np.sqrt(squares(a * root, b * root))
        out = np.empty((len(a), len(b)))
        for k in range(0, len(a), 16):  # a few rows at a time stay in the cache
            d = np.abs(a[k : k + 16, None, :] - b[None])
            out[k : k + 16] = d @ w if p == 1 else np.sqrt(d**2 @ w) if p == 2 else (d**p @ w) ** (1 / p)
        return out

    return fn


def euclidean():
    return lambda a, b: np.sqrt(squares(a, b))


def deriv(t, order: int = 1):
    """L2 of forward-difference derivatives on midpoints."""

    def diff(v):
        g = np.asarray(t, float)
        for _ in range(order):
            v, g = np.diff(v, axis=1) / np.diff(g), (g[1:] + g[:-1]) / 2
        return v, g

    def fn(a, b):
        (x, g), (y, _) = diff(a), diff(b)
        return lp(nm.simpson_weights(g))(x, y)

    return fn


def kl(t, eps: float = 1e-10):
    """Mean of both Kullback-Leibler divergences of curves made into densities."""
    w = nm.simpson_weights(t)

    def density(v):
        v = v - np.minimum(v.min(1, keepdims=True), 0)
        for _ in range(2):
            total = (v @ w)[:, None]
            v = v / np.where(total > 0, total, 1) + (eps if _ == 0 else 0)
        return v

    def fn(a, b):
        p, q = density(a), density(b)
        lp_, lq = np.log(p), np.log(q)
        return ((p * lp_) @ w)[:, None] / 2 - ((p * w) @ lq.T) / 2 + ((q * lq) @ w)[None] / 2 - ((q * w) @ lp_.T).T / 2

    return fn


def hshift(t, max_shift: int | None = None):
    """Least weighted L2 over index shifts that keep half the points."""
    w = nm.simpson_weights(t)
    m = len(w)
    most = m // 4 if max_shift is None else max_shift

    def fn(a, b):
        best = np.full((len(a), len(b)), np.inf)
        for s in range(-most, most + 1):
            lo, hi = max(0, -s), min(m, m - s)
            if hi - lo >= (m + 1) // 2:
                root = np.sqrt(w[lo:hi])
                np.minimum(best, squares(a[:, lo:hi] * root, b[:, lo + s : hi + s] * root), out=best)
        return np.sqrt(best)

    return fn


def fourier(n: int = 5):
    """L2 of the moduli of the first Fourier coefficients."""
    mod = lambda v: np.abs(np.fft.rfft(v, axis=1)[:, : n + 1]) / v.shape[1]
    return lambda a, b: euclidean()(mod(a), mod(b))


def basis_coefficients(t, n: int = 10, kind: str = "bspline"):
    phi = nm.bspline_basis(t, max(n - 4, 2)) if kind == "bspline" else nm.fourier_basis(t, n)
    inv = np.linalg.pinv(phi)
    return lambda a, b: euclidean()(a @ inv.T, b @ inv.T)


def pca(c: Curves, k: int = 3):
    """Euclid of unweighted principal scores."""
    n, mu, scatter = moments(c.df)
    vec = np.linalg.eigh(scatter)[1][:, ::-1][:, :k]
    return lambda a, b: euclidean()((a - mu) @ vec, (b - mu) @ vec)


def dtw(p: float = 1.0, width: int | None = None):
    """Sum of |difference|^p along the cheapest path, no final root; row i of a band takes
    columns max(0, i - width) to min(n, i + width) - 1."""

    def fn(a, b):
        m, n = a.shape[1], b.shape[1]
        out = np.full((len(a), len(b)), np.inf)
        for k, x in enumerate(a):
            last = np.full((len(b), n + 1), np.inf)
            last[:, 0] = 0
            for i in range(m):
                row = np.full((len(b), n + 1), np.inf)
                lo, hi = (0, n) if width is None else (max(0, i - width), min(n, i + width))
                cost = np.abs(x[i] - b) ** p
                for j in range(lo, hi):
                    row[:, j + 1] = cost[:, j] + np.minimum(np.minimum(last[:, j + 1], row[:, j]), last[:, j])
                last = row
            out[k] = last[:, n]
        return out

    return fn


def soft_dtw_value(x, b, gamma: float) -> np.ndarray:
    """Soft-minimum DTW with squared cost of one curve against the rows of b."""
    n = b.shape[1]
    last = np.full((len(b), n + 1), np.inf)
    last[:, 0] = 0
    for v in x:
        row = np.full((len(b), n + 1), np.inf)
        cost = (v - b) ** 2
        for j in range(n):
            three = np.stack([last[:, j + 1], row[:, j], last[:, j]])
            low = three.min(0)
            with np.errstate(invalid="ignore"):
                soft = low - gamma * np.log(np.exp(-(three - low) / gamma).sum(0))
            row[:, j + 1] = cost[:, j] + np.where(np.isfinite(low), soft, np.inf)
        last = row
    return last[:, n]


def soft_dtw(gamma: float = 1.0, divergence: bool = False):
    def fn(a, b):
        d = np.array([soft_dtw_value(x, b, gamma) for x in a])
        if divergence:
            own = lambda v: np.array([soft_dtw_value(x, x[None], gamma)[0] for x in v])
            d = d - own(a)[:, None] / 2 - own(b)[None] / 2
        return d

    return fn


def soft_dtw_gradient(x, y, gamma: float) -> tuple[float, np.ndarray]:
    """Soft-DTW of two curves and its gradient in x."""
    m, n = len(x), len(y)
    r = np.full((m + 2, n + 2), np.inf)
    r[0, 0] = 0
    d = (x[:, None] - y[None]) ** 2
    for i in range(1, m + 1):
        for j in range(1, n + 1):
            three = np.array([r[i - 1, j], r[i, j - 1], r[i - 1, j - 1]])
            low = three.min()
            r[i, j] = d[i - 1, j - 1] + low - gamma * math.log(np.exp(-(three - low) / gamma).sum())
    e = np.zeros((m + 2, n + 2))
    e[m, n] = 1
    for i in range(m, 0, -1):
        for j in range(n, 0, -1):
            if i == m and j == n:
                continue
            total = 0.0
            for u, v in ((i + 1, j), (i, j + 1), (i + 1, j + 1)):
                if u <= m and v <= n:
                    total += e[u, v] * math.exp(-(d[u - 1, v - 1] + r[i, j] - r[u, v]) / gamma) if math.isfinite(r[u, v]) else 0
            e[i, j] = total
    return float(r[m, n]), (e[1 : m + 1, 1 : n + 1] * 2 * (x[:, None] - y[None])).sum(1)


def soft_dtw_barycenter(c: Curves, gamma: float = 1.0, steps: int = 50, tol: float = 1e-6) -> np.ndarray:
    """Gradient descent from the mean curve with step 1 / n."""
    from curvelake.operators.apply import sums

    n, total = sums(c.df, lambda v: [np.array([len(v)]), v.sum(0)], ["values"])
    z, last = total / n[0], math.inf
    for _ in range(steps):
        def step(v, z=z):
            got = [soft_dtw_gradient(z, x, gamma) for x in v]
            return [np.array([sum(g[0] for g in got)]), np.sum([g[1] for g in got], 0)]

        value, grad = sums(c.df, step, ["values"])
        z = z - grad / n[0]
        if abs(last - value[0]) < tol * max(1.0, abs(last if math.isfinite(last) else 1.0)):
            break
        last = value[0]
    return z


def hausdorff_graphs(*axes, part: int = 256):
    """Hausdorff distance of the graphs of functions on a lattice with these axes.

    Points meet their neighbours in rings of growing distance within the lattice; once that
    alone is no less than every nearest distance found so far, no later ring can change one.
    """
    axes = [np.asarray(x, float) for x in axes]
    shape = tuple(len(x) for x in axes)
    rings = []
    for shift in itertools.product(*(range(1 - n, n) for n in shape)):
        here = tuple(slice(max(0, -s), min(n, n - s)) for s, n in zip(shift, shape, strict=True))
        there = tuple(slice(max(0, s), min(n, n + s)) for s, n in zip(shift, shape, strict=True))
        apart = np.zeros(())
        for x, p, q in zip(axes, here, there, strict=True):
            apart = apart[..., None] + (x[q] - x[p]) ** 2
        rings.append((float(apart.min()), here, there, apart[..., None]))
    rings.sort(key=lambda r: r[0])

    def fn(a, b):
        out = np.empty((len(a), len(b)))
        for start in range(0, len(b), part):
            y = np.ascontiguousarray(b[start : start + part].T).reshape(*shape, -1)
            for k, x in enumerate(a.reshape(len(a), *shape, 1)):
                of_x, of_y = np.full(y.shape, np.inf), np.full(y.shape, np.inf)
                for step, (least, here, there, apart) in enumerate(rings):
                    if step % 4 == 3 and least >= max(of_x.max(), of_y.max()):
                        break
                    d = x[here] - y[there]
                    d *= d
                    d += apart
                    np.minimum(of_x[here], d, out=of_x[here])
                    np.minimum(of_y[there], d, out=of_y[there])
                lattice = tuple(range(len(shape)))
                out[k, start : start + part] = np.sqrt(np.maximum(of_x.max(lattice), of_y.max(lattice)))
        return out

    return fn


def hausdorff(t):
    """Hausdorff distance of the planar points (t, f(t))."""
    return hausdorff_graphs(t)


def hausdorff_points(x, y) -> float:
    """Hausdorff distance of two clouds of points."""
    d = np.sqrt(((np.asarray(x)[:, None] - np.asarray(y)[None]) ** 2).sum(2))
    return float(max(d.min(1).max(), d.min(0).max()))


def hausdorff_surfaces(s, t):
    """Hausdorff distance of the graphs of flattened surfaces, the first argument running fastest."""
    return hausdorff_graphs(t, s)


METRICS = {
    "lp": lambda c, p=2.0: lp(c.weights, p), "euclidean": lambda c: euclidean(), "deriv": lambda c, order=1: deriv(c.grid, order), "kl": lambda c: kl(c.grid),
    "hshift": lambda c, max_shift=None: hshift(c.grid, max_shift), "fourier": lambda c, n=5: fourier(n), "basis": lambda c, n=10: basis_coefficients(c.grid, n),
    "pca": lambda c, k=3: pca(c, k), "dtw": lambda c, p=1.0, width=None: dtw(p, width), "soft_dtw": lambda c, gamma=1.0: soft_dtw(gamma),
    "soft_dtw_divergence": lambda c, gamma=1.0: soft_dtw(gamma, True), "hausdorff": lambda c: hausdorff(c.grid),
}


#: Curves of a block for metrics whose pairs cost microseconds: more, smaller tasks.
COSTLY = {"hausdorff": 1024}


def self_distances(c: Curves, metric: str = "lp", places: int | None = None, **options) -> DataFrame:
    """(i, j, d) for all i < j."""
    if metric not in METRICS:
        raise ValueError(f"no metric {metric}")
    return self_pairs(c.df, METRICS[metric](c, **options), places=places, wide=COSTLY.get(metric, WIDE))


def cross_distances(a: Curves, b: Curves, metric: str = "lp", places: int | None = None, **options) -> DataFrame:
    if metric not in METRICS:
        raise ValueError(f"no metric {metric}")
    return cross_pairs(a.df, b.df, METRICS[metric](a, **options), places=places, wide=COSTLY.get(metric, WIDE))


def distance_quantiles(c: Curves, shares: list[float], metric: str = "lp", cells: int = 4096, most: int = 50_000) -> list[float]:
    """Linear quantiles of type 7 of all positive distances of pairs, exactly, without rows of pairs.

    Each pass counts distances in the ``cells`` of every bracket that holds a place, until a
    cell has ``most`` values, which come to the driver, or only one.
    """
    fn = METRICS[metric](c)
    n, low, high = (float(x) for x in _range_of_pairs(c, fn))
    at = [(n - 1) * p for p in shares]
    found, open_ = {}, {k: (low, high, 0) for x in at for k in (math.floor(x), math.ceil(x))}
    while open_:
        brackets = sorted({(lo, hi, before) for lo, hi, before in open_.values()})

        def count(d, brackets=brackets):
            out, d = np.zeros((len(brackets), cells)), _within(d, brackets, cells)
            for k, (lo, hi, _) in enumerate(brackets):
                x = d[(d >= lo) & (d <= hi) & (d > 0)]
                out[k] = np.bincount(_cell(x, lo, hi, cells), minlength=cells)
            return [out]

        counts = pair_sums(c.df, fn, count)[0].astype(np.int64)
        few = {}
        for place, bracket in open_.items():
            k, (lo, hi, before) = brackets.index(bracket), bracket
            upto = before + np.cumsum(counts[k])
            cell = int(np.searchsorted(upto, place, "right"))
            few.setdefault((lo, hi, cell, int(upto[cell] - counts[k][cell]), int(counts[k][cell])), []).append(place)
        wanted = sorted(few)
        small = [x for x in wanted if x[4] <= most]
        # cells' least and greatest values, as rows of the few pairs or of one bound a part
        bounds = _cells_of_pairs(c, fn, wanted, set(small), cells)
        open_ = {}
        for x in wanted:
            values = bounds[x]
            for place in few[x]:
                if x[4] <= most:
                    found[place] = float(values[place - x[3]])
                elif values[0] == values[-1]:
                    found[place] = float(values[0])
                else:
                    open_[place] = (float(values[0]), float(values[-1]), x[3])
    got = [(found[math.floor(x)], found[math.ceil(x)], x - math.floor(x)) for x in at]
    return [a + f * (b - a) for a, b, f in got]


def _cell(x, lo: float, hi: float, cells: int) -> np.ndarray:
    return np.minimum(((x - lo) * (cells / (hi - lo) if hi > lo else 0.0)).astype(np.int64), cells - 1)


def _within(d, brackets, cells: int) -> np.ndarray:
    """The distances that share a cell of the whole range with some bracket, and perhaps others."""
    low, high = min(x[0] for x in brackets), max(x[1] for x in brackets)
    d = d[(d >= low) & (d <= high)]
    if len(brackets) == 1 or low == high:
        return d
    keep = np.zeros(cells, bool)
    for x in brackets:
        keep[slice(*(_cell(np.array(x[:2]), low, high, cells) + [0, 1]))] = True
    return d if keep.all() else d[keep[_cell(d, low, high, cells)]]


def _range_of_pairs(c: Curves, fn) -> tuple[float, float, float]:
    """(number, least, greatest) of positive distances."""
    got = _pair_rows(c, fn, lambda d: [(0, len(d), d.min(), d.max())] if len(d) else [])
    n, lo, hi = got.agg(F.sum("n"), F.min("lo"), F.max("hi")).first()
    if not n:
        raise ValueError("no two curves differ")
    return n, lo, hi


def _cells_of_pairs(c: Curves, fn, wanted: list, small: set, cells: int) -> dict:
    """The sorted values of small cells; the least and greatest value of the others."""

    def rows(d):
        out, d = [], _within(d, wanted, cells)
        for k, x in enumerate(wanted):
            v = d[(d >= x[0]) & (d <= x[1])]
            v = v[_cell(v, x[0], x[1], cells) == x[2]]
            out += [(k, 1, float(y), float(y)) for y in v] if x in small else [(k, len(v), v.min(), v.max())] if len(v) else []
        return out

    got = _pair_rows(c, fn, rows)
    keep = [k for k, x in enumerate(wanted) if x in small]
    values = {x: [] for x in wanted}
    few = got.where(F.col("k").isin(keep)).select("k", "lo") if keep else None
    if len(keep) < len(wanted):
        for r in got.where(~F.col("k").isin(keep)).groupBy("k").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect():
            values[wanted[r["k"]]] = [r["lo"], r["hi"]]
    for r in few.collect() if few is not None else []:
        values[wanted[r["k"]]].append(r["lo"])
    return {x: np.sort(v) for x, v in values.items()}


def _pair_rows(c: Curves, fn, rows) -> DataFrame:
    """Rows (k, n, lo, hi) that rows(positive distances of a part) gives."""
    return pair_rows(c.df, fn, lambda d: rows(d[d > 0]), "k int, n long, lo double, hi double")


def mirrored(d: DataFrame) -> DataFrame:
    """Both orders of each pair."""
    return d.union(d.select(F.col("j").alias("i"), F.col("i").alias("j"), "d"))


# ---- irregular curves: rows (id, t, v) ----


def sorted_points(df: DataFrame) -> DataFrame:
    """id, t and v arrays in the order of t; a curve's points are bounded by the curve."""
    p = df.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("t", "v"))).alias("p"))
    return p.select("id", F.transform("p", lambda x: x["t"]).alias("t"), F.transform("p", lambda x: x["v"]).alias("v"))


def trapezoids(df: DataFrame, f=None) -> DataFrame:
    """(id, value): trapezoid integral of f(v) over each curve's points; 0 with fewer than two."""
    from pyspark.sql import Window

    w = Window.partitionBy("id").orderBy("t", "v")
    g = f(F.col("v")) if f else F.col("v")
    rows = df.select("id", "t", "v", g.alias("g")).withColumn("area", (F.col("t") - F.lag("t").over(w)) * (F.col("g") + F.lag("g").over(w)) / 2)
    return rows.groupBy("id").agg(F.coalesce(F.sum("area"), F.lit(0.0)).alias("value"))


def integrate_irregular(df: DataFrame) -> DataFrame:
    return trapezoids(df).withColumnRenamed("value", "integral")


def norm_irregular(df: DataFrame, p: float = 2.0) -> DataFrame:
    return trapezoids(df, lambda v: F.pow(F.abs(v), F.lit(p))).select("id", F.pow("value", F.lit(1 / p)).alias("norm"))


def mean_irregular(df: DataFrame, targets, h: float, kernel: str = "gaussian") -> DataFrame:
    """(target, mean) by kernel weights over all points: null where no weight falls."""
    x = F.explode(F.lit([float(t) for t in targets]))
    u = (F.col("t") - F.col("target")) / h
    k = F.exp(-u * u / 2) if kernel == "gaussian" else F.when(F.abs(u) <= 1, 0.75 * (1 - u * u)).otherwise(0.0)
    rows = df.select("t", "v", x.alias("target")).withColumn("k", k)
    return rows.groupBy("target").agg((F.sum(F.col("k") * F.col("v")) / F.nullif(F.sum("k"), F.lit(0.0))).alias("mean"))


def covariance_irregular(df: DataFrame, targets, h: float, mean: DataFrame) -> DataFrame:
    """(s, t, cov): product-kernel mean of products of residuals of points of one curve, the
    diagonal included. Sums of one curve are products of two sums, so no pairs are made."""
    grid = sorted(float(t) for t in targets)
    mu = {r["target"]: r["mean"] or 0.0 for r in mean.collect()}
    level = F.lit([mu[t] for t in grid])
    near = F.array_min(F.transform(F.lit(grid), lambda g: F.abs(g - F.col("t"))))
    nearest = F.get(level, (F.array_position(F.transform(F.lit(grid), lambda g: F.abs(g - F.col("t")) == near), F.lit(True)) - 1).cast("int"))
    rows = df.withColumn("r", F.col("v") - nearest).select("id", "r", "t", F.explode(F.lit(grid)).alias("g"))
    u = (F.col("t") - F.col("g")) / h
    own = rows.withColumn("k", F.exp(-u * u / 2)).groupBy("id", "g").agg(F.sum("k").alias("k"), F.sum(F.col("k") * F.col("r")).alias("kr"))
    both = own.select("id", F.col("g").alias("s"), F.col("k").alias("k1"), F.col("kr").alias("r1")).join(own.select("id", F.col("g").alias("t"), F.col("k").alias("k2"), F.col("kr").alias("r2")), "id")
    return both.groupBy("s", "t").agg((F.sum(F.col("r1") * F.col("r2")) / F.sum(F.col("k1") * F.col("k2"))).alias("cov"))


def to_regular(df: DataFrame, grid) -> DataFrame:
    """id, values on the grid by linear interpolation; NaN outside a curve's range."""
    import pyarrow as pa

    g = nm.as_grid(grid)

    def run(batches):
        for b in batches:
            out = []
            for t, v in zip(b.column("t").to_pylist(), b.column("v").to_pylist(), strict=True):
                out.append(np.interp(g, t, v, left=math.nan, right=math.nan).tolist())
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, pa.list_(pa.float64()))], names=["id", "values"])

    return sorted_points(df).mapInArrow(run, "id long, values array<double>")


def lp_irregular(t1, v1, t2, v2, p: float = 2.0) -> float:
    """Lp distance on the merged grid of the common range; NaN with fewer than two points."""
    lo, hi = max(t1[0], t2[0]), min(t1[-1], t2[-1])
    g = np.unique(np.concatenate([t1, t2]))
    g = g[(g >= lo) & (g <= hi)]
    if len(g) < 2:
        return math.nan
    return float(nm.trapz(np.abs(np.interp(g, t1, v1) - np.interp(g, t2, v2)) ** p, g) ** (1 / p))


def lp_irregular_many(t1, v1, t, v, first, p: float = 2.0) -> np.ndarray:
    """lp_irregular() of one curve and each of several: t and v hold their points one curve after
    another, curve j from first[j] to first[j + 1].

    A point's place among both curves' points is its own number and how many of the other's lie
    before it, so all merged grids are filled without sorting.
    """
    n, curves = len(t1), len(first) - 1
    of = np.repeat(np.arange(curves), np.diff(first))
    steps = lambda x, y: np.append(np.diff(y) / np.where(np.diff(x) > 0, np.diff(x), np.inf), 0.0)
    before = np.searchsorted(t1, t)  # points of t1 below each point
    upto = np.bincount(of * (n + 1) + before, minlength=curves * (n + 1)).reshape(curves, n + 1)[:, :n].cumsum(1)  # points of t at most each point of t1
    start = first[:-1, None]
    own, other = np.maximum(np.searchsorted(t1, t, "right") - 1, 0), start + np.maximum(upto - 1, 0)
    # of several values at one time the last counts
    same = np.append(t[1:] == t[:-1], False)
    same[first[1:] - 1] = False
    value = _last_of_equal(v, same)
    grid, d = np.empty(len(t) + curves * n), np.empty(len(t) + curves * n)
    at = np.arange(len(t)) + of * n + before
    grid[at], d[at] = t, v1[own] + steps(t1, v1)[own] * (t - t1[own]) - value
    slope = steps(t, v)
    slope[first[1:] - 1] = 0.0
    at = start + np.arange(curves)[:, None] * n + np.arange(n) + upto
    mine = _last_of_equal(v1, np.append(t1[1:] == t1[:-1], False))
    grid[at], d[at] = t1, mine - v[other] - slope[other] * (t1 - t[other])
    begin = first + np.arange(curves + 1) * n
    low, high = np.maximum(t1[0], t[first[:-1]]), np.minimum(t1[-1], t[first[1:] - 1])
    size = np.diff(begin)
    inside = (grid >= np.repeat(low, size)) & (grid <= np.repeat(high, size))
    power = np.where(inside, np.abs(d) ** p, 0.0)
    both = inside[1:] & inside[:-1]
    both[begin[1:-1] - 1] = False  # from one curve's last point to the next one's first
    area = np.append(np.where(both, np.diff(grid) * (power[1:] + power[:-1]) / 2, 0.0), 0.0)
    return np.where(low < high, np.add.reduceat(area, begin[:-1]) ** (1 / p), math.nan)


def _last_of_equal(v, same) -> np.ndarray:
    """v with the value of the last of a run in all of it; same: a point's successor is in its run."""
    if not same.any():
        return v
    at = np.where(same, len(v), np.arange(len(v)))
    return v[np.minimum.accumulate(at[::-1])[::-1]]


def cross_irregular(left: DataFrame, right: DataFrame, p: float = 2.0) -> DataFrame:
    """(i, j, d): lp_irregular() of curves i of left with the curves of a larger id of right, both
    (id, t, v) of sorted_points(); blocks meet in tiles, the points of a curve are sent once a block."""
    import pyarrow as pa

    n_a, n_b = _block_count(left.count(), 64, 64), _block_count(right.count(), 512, 2048)
    blocks = lambda df, n: df.groupBy(F.pmod(F.xxhash64("id"), F.lit(n)).alias("block")).agg(F.sort_array(F.collect_list(F.struct("id", "t", "v"))).alias("rows"))

    def unpack(rows):
        points = rows.field("t")
        first = points.offsets.to_numpy().astype(np.int64)
        return rows.field("id").to_numpy(zero_copy_only=False), first - first[0], *(rows.field(k).flatten().to_numpy(zero_copy_only=False) for k in ("t", "v"))

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                (ia, fa, ta, va), (ib, fb, tb, vb) = (unpack(batch.column(c)[k].values) for c in (1, 2))
                for a, i in enumerate(ia):
                    own = slice(fa[a], fa[a + 1])
                    for b in range(int(np.searchsorted(ib, i, "right")), len(ib), 512):
                        f = fb[b : b + 513]
                        d = lp_irregular_many(ta[own], va[own], tb[f[0] : f[-1]], vb[f[0] : f[-1]], f - f[0], p)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(d), i)), pa.array(ib[b : b + 512]), pa.array(d)], names=["i", "j", "d"])

    return _tiles(blocks(left, n_a), n_a, blocks(right, n_b), n_b, False).mapInArrow(run, "i long, j long, d double")
