"""Depths, boxplots and depth-based outliers.

Rank depths need, at every grid position, how many curves lie below and above.
``ranks`` gets these from windows over (position, value bucket): buckets are cut at
approximate quantiles, counts of lower buckets come from a small prefix-sum table, so
one position is not sorted in one task.  Pairwise depths are sums over blocks.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curvelake.functions import numeric as nm
from curvelake.operators.apply import BLOCK, ROWS_A_TASK, WIDE, against, against_pairs, matrix, numbered, order_statistics, per_curve, quantiles, sums
from curvelake.operators.metrics import squares
from curvelake.sources.curves import Curves


def ranks(c: Curves, buckets: int | None = None) -> DataFrame:
    """(id, pos, v, n, le, lt): curves, those at most v, and those below v, by position.

    With ``buckets`` > 1, positions are split at approximate quantiles of their values; by
    default there are as many as the number of curves needs.
    """
    rows = c.long()
    if buckets is None:
        buckets = math.ceil(c.df.count() / ROWS_A_TASK)
    if buckets <= 1:
        w = Window.partitionBy("pos")
        o = w.orderBy("v")
        return rows.select("id", "pos", "v", F.count("*").over(w).alias("n"), F.count("*").over(o.rangeBetween(Window.unboundedPreceding, 0)).alias("le"), (F.rank().over(o) - 1).alias("lt"))
    cuts = rows.groupBy("pos").agg(F.percentile_approx("v", [k / buckets for k in range(1, buckets)]).alias("cuts"))
    rows = rows.join(F.broadcast(cuts), "pos").withColumn("bucket", F.size(F.filter("cuts", lambda x: x < F.col("v")))).drop("cuts")  # a row per grid position
    counts = rows.groupBy("pos", "bucket").agg(F.count("*").alias("k"))
    w = Window.partitionBy("pos")
    counts = counts.select("pos", "bucket", F.sum("k").over(w).alias("n"), (F.sum("k").over(w.orderBy("bucket")) - F.col("k")).alias("lower"))
    o = Window.partitionBy("pos", "bucket").orderBy("v")
    rows = rows.join(F.broadcast(counts), ["pos", "bucket"])  # positions times buckets, both parameters
    return rows.select("id", "pos", "v", "n", (F.col("lower") + F.count("*").over(o.rangeBetween(Window.unboundedPreceding, 0))).alias("le"), (F.col("lower") + F.rank().over(o) - 1).alias("lt"))


def fraiman_muniz(c: Curves, scale: bool = False, buckets: int | None = None) -> DataFrame:
    f = F.col("le") / F.col("n")
    return ranks(c, buckets).groupBy("id").agg((F.avg(F.least(f, 1 - f)) * (2 if scale else 1)).alias("depth"))


def modified_band(c: Curves, buckets: int | None = None) -> DataFrame:
    n, below, above = F.col("n"), F.col("lt"), F.col("n") - F.col("le")
    pairs = lambda x: x * (x - 1) / 2
    return ranks(c, buckets).groupBy("id").agg(F.avg(1 - (pairs(below) + pairs(above)) / pairs(n)).alias("depth"))


def modified_epigraph(c: Curves, buckets: int | None = None) -> DataFrame:
    """Share of (curve, position) at or above: x_i <= x_j."""
    return ranks(c, buckets).groupBy("id").agg(F.avg((F.col("n") - F.col("lt")) / F.col("n")).alias("depth"))


def modified_hypograph(c: Curves, buckets: int | None = None) -> DataFrame:
    return ranks(c, buckets).groupBy("id").agg(F.avg(F.col("le") / F.col("n")).alias("depth"))


def modified_half_region(c: Curves, buckets: int | None = None) -> DataFrame:
    r = ranks(c, buckets)
    return r.groupBy("id").agg(F.least(F.avg((F.col("n") - F.col("lt")) / F.col("n")), F.avg(F.col("le") / F.col("n"))).alias("depth"))


def total_variation(c: Curves, buckets: int | None = None) -> DataFrame:
    """id, depth: mean of p (1 - p), p the rank over n; ranks of equal values are averaged."""
    p = (F.col("le") + F.col("lt") + 1) / (2 * F.col("n"))
    return ranks(c, buckets).groupBy("id").agg(F.avg(p * (1 - p)).alias("depth"))


def extreme_rank_length(c: Curves, buckets: int | None = None) -> DataFrame:
    """Share of curves whose sorted two-sided ranks are not greater, in lexicographic order."""
    two_sided = F.least(F.col("lt") + 1, F.col("n") - F.col("le") + 1)
    sorted_ranks = ranks(c, buckets).groupBy("id").agg(F.array_sort(F.collect_list(two_sided)).alias("r"), F.first("n").alias("n"))
    # patterns are cut into buckets by their least rank; one task orders a bucket
    # patterns are cut into parts by their least rank; one task orders a part
    patterns = sorted_ranks.groupBy("r").agg(F.count("*").alias("k")).withColumn("first", F.col("r")[0])
    lower = Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    firsts = patterns.groupBy("first").agg(F.sum("k").alias("k"))  # a number for each least rank
    firsts = firsts.select("first", F.coalesce(F.sum("k").over(lower), F.lit(0)).alias("lower"))
    order = Window.partitionBy("first").orderBy("r").rangeBetween(Window.unboundedPreceding, 0)
    places = patterns.join(firsts, "first").select("r", (F.col("lower") + F.sum("k").over(order)).alias("le"))
    return sorted_ranks.join(places, "r").select("id", (F.col("le") / F.col("n")).alias("depth"))


def extremal(c: Curves, buckets: int | None = None) -> DataFrame:
    """Rank / n of curves ordered by their least pointwise depth, then by the share of positions
    at that level (more is shallower), then by id. Ranks of equal values are averaged."""
    level = 1 - F.abs(F.col("lt") + 1 + F.col("le") - F.col("n") - 1) / F.col("n")
    found = ranks(c, buckets).select("id", "n", F.round(level, 12).alias("level")).groupBy("id", "n", "level").agg(F.count("*").alias("mass"))
    found = found.groupBy("id", "n").agg(F.min(F.struct("level", "mass")).alias("w")).select("id", "n", "w.level", "w.mass")
    return numbered(found, "level", F.desc("mass"), "id").select("id", (F.col("rank") / F.col("n")).alias("depth"))


def _shares(c: Curves, fn, name: str = "depth", rows: int = BLOCK, part: int = BLOCK) -> DataFrame:
    n = c.df.count()
    return against(c.df, c.df, fn, "total double", rows, part).select("id", (F.col("total") / n).alias(name))


def dominating(a, b, above: bool) -> np.ndarray:
    """For each row of a, the number of rows of b that lie at or above (below) it everywhere.

    For each position and place in b's order there is a set of bits of the rows of b from there
    on (up to there); a row of a has one such set for each position, and they are intersected.
    """
    n, m = b.shape
    a, b = (np.ascontiguousarray(x.T if above else -x.T) for x in (a, b))
    words, found = -(-n // 64), None
    for t in range(m):
        o = np.argsort(b[t])
        sets = np.zeros((n + 1, words), np.uint64)
        sets[n - np.arange(n), o // 64] = np.uint64(1) << (o % 64).astype(np.uint64)
        np.bitwise_or.accumulate(sets, 0, out=sets)  # row k: the k last of the order
        own = sets[n - np.searchsorted(b[t, o], a[t])]
        found = own if found is None else found & own
    return np.bitwise_count(found).sum(1).astype(float)


def epigraph(c: Curves) -> DataFrame:
    """Share of curves wholly at or above."""
    return _shares(c, lambda a, b: dominating(a, b, True), rows=WIDE, part=WIDE // 2)


def hypograph(c: Curves) -> DataFrame:
    return _shares(c, lambda a, b: dominating(a, b, False), rows=WIDE, part=WIDE // 2)


def half_region(c: Curves) -> DataFrame:
    n = c.df.count()
    out = against(c.df, c.df, lambda a, b: (dominating(a, b, True), dominating(a, b, False)), "up double, down double", WIDE, WIDE // 2)
    return out.select("id", (F.least("up", "down") / n).alias("depth"))


def largest_differences(a, b, part: int = 64) -> np.ndarray:
    """Largest absolute differences of rows of a and b, a few rows at a time in the cache."""
    out = np.zeros((len(a), len(b)))
    by_position = np.ascontiguousarray(b.T)
    for k in range(0, len(a), part):
        most, x = out[k : k + part], a[k : k + part]
        d = np.empty_like(most)
        for t in range(a.shape[1]):
            np.subtract(x[:, t, None], by_position[t], out=d)
            np.abs(d, out=d)
            np.maximum(most, d, out=most)
    return out


def sup_depth(c: Curves) -> DataFrame:
    """1 / (1 + mean largest difference)."""
    return _shares(c, lambda a, b: largest_differences(a, b).sum(1)).select("id", (1 / (1 + F.col("depth"))).alias("depth"))


def modal(c: Curves, h: float = 0.15) -> DataFrame:
    """Mean Gaussian kernel of the root mean square difference."""
    m = len(c.grid)
    return _shares(c, lambda a, b: np.exp(squares(a, b) / (-2 * m * h * h)).sum(1))


def spatial(c: Curves) -> DataFrame:
    """1 - norm of the mean unit difference, with Simpson weights."""
    w, n = c.weights, c.df.count()
    m = len(c.grid)

    def fn(a, b):
        out = np.empty((len(a), m))
        for k in range(0, len(a), 16):  # a few rows at a time stay in the cache
            d = a[k : k + 16, None, :] - b[None]
            norm = np.sqrt(d**2 @ w)
            out[k : k + 16] = (d / np.where(norm > 1e-12, norm, np.inf)[:, :, None]).sum(1)
        return tuple(out.T)

    mean = against(c.df, c.df, fn, ", ".join(f"s{k} double" for k in range(m)))
    return per_curve(mean.select("id", F.array(*[F.col(f"s{k}") for k in range(m)]).alias("values")), lambda s: 1 - np.sqrt((s / n) ** 2 @ w), "depth double")


def kernel_spatial(c: Curves, h: float, weights=None) -> DataFrame:
    """Spatial depth in the space of the kernel exp(-d^2 / h^2).

    Needs all kernel values of a curve at once, so the reference set goes to every task:
    infer.MOST_ROWS curves at most, an error beyond; ``kernel_spatial_all`` takes any number.
    """
    from curvelake.operators.infer import rows_of

    w = c.weights if weights is None else np.asarray(weights, float)
    ref = rows_of(c)[0]
    d2 = lambda a, b: np.maximum((a**2 @ w)[:, None] + (b**2 @ w)[None] - 2 * (a * w) @ b.T, 0)
    kk = np.exp(-d2(ref, ref) / h**2)

    def kernel(v):
        k = np.exp(-d2(v, ref) / h**2)
        den = np.sqrt(np.maximum(2 - 2 * k, 0))
        inv = np.where(den > 1e-7, 1 / np.maximum(den, 1e-7), 0.0)
        out = np.empty(len(v))
        for i in range(len(v)):
            g = 1 + kk - k[i][:, None] - k[i][None]
            out[i] = 1 - math.sqrt(max(inv[i] @ g @ inv[i], 0)) / len(ref)
        return out

    return per_curve(c.df.select("id", "values"), kernel, "depth double")


def band(c: Curves) -> DataFrame:
    """Share of pairs of other reference curves whose closed band holds the whole curve.

    Counted from sign patterns: pairs of curves are never made; for each curve the
    references' above/below patterns are counted by blocks of bit sets. The references go
    to every task: infer.MOST_ROWS curves at most, an error beyond; ``band_all`` takes any number.
    """
    from curvelake.operators.infer import rows_of

    ref = rows_of(c)[0]
    n = len(ref)

    def kernel(v):
        out = np.empty(len(v))
        for i, x in enumerate(v):
            up, down = (ref >= x).astype(np.float32), (ref <= x).astype(np.float32)
            # a pair holds x at t unless both are above or both below strictly
            miss = (1 - up) @ (1 - up).T + (1 - down) @ (1 - down).T
            inside = miss < 0.5
            out[i] = (np.triu(inside, 1)).sum() / (n * (n - 1) / 2)
        return out

    return per_curve(c.df.select("id", "values"), kernel, "depth double")


def kernel_spatial_all(c: Curves, h: float, weights=None) -> DataFrame:
    """``kernel_spatial`` against all curves, whatever their number: its quadratic form in the
    inverse deviations is added up over pairs of blocks of references (``against_pairs``).

    Cubic in the number of curves; a task holds the kernels of BLOCK curves and two blocks at most.
    Kernels are kept less one, where they lose no digits, and
    distances of near curves come from differences.
    """
    w, n = c.weights if weights is None else np.asarray(weights, float), c.df.count()
    root = np.sqrt(w)

    def side(x, p):
        e = np.expm1(squares(x, p) / (-h * h))
        den = np.sqrt(-2 * e)
        inv = np.where(den > 1e-7, 1 / np.maximum(den, 1e-7), 0.0)
        return inv, inv.sum(1), (inv * e).sum(1)

    def fn(x, p, q):
        x, p, q = x * root, p * root, None if q is None else q * root
        a, sa, ea = side(x, p)
        b, sb, eb = (a, sa, ea) if q is None else side(x, q)
        other, total = p if q is None else q, -(ea * sb + sa * eb)
        for i in range(0, len(p), 1024):
            for j in range(0, len(other), 1024):
                total += np.einsum("nk,nk->n", a[:, i : i + 1024] @ np.expm1(squares(p[i : i + 1024], other[j : j + 1024]) / (-h * h)), b[:, j : j + 1024])
        return total * (1 if q is None else 2)

    out = against_pairs(c.df, fn, "total double", BLOCK, WIDE)
    return out.select("id", (1 - F.sqrt(F.greatest("total", F.lit(0.0))) / n).alias("depth"))


def sides(x, ref) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x the positions where each row of ref lies below it, and above, as bits:
    two arrays (rows of x, rows of ref, words)."""
    words = -(-x.shape[1] // 64)
    wide = lambda v: np.pad(v, ((0, 0), (0, 64 * words - v.shape[1])))
    x, ref = wide(x), wide(ref)
    below, above = (np.empty((len(x), len(ref), words), np.uint64) for _ in range(2))
    for k in range(0, len(ref), 1024):  # references stay in the cache while all rows meet them
        part = ref[k : k + 1024]
        for i, v in enumerate(x):
            below[i, k : k + 1024] = np.packbits((part < v).ravel()).view(np.uint64).reshape(-1, words)
            above[i, k : k + 1024] = np.packbits((part > v).ravel()).view(np.uint64).reshape(-1, words)
    return below, above


def _opposite(below, above) -> int:
    """Pairs of a row of below and an equal row of above."""
    if below.shape[1] == 1:
        a, b = np.sort(below[:, 0]), np.sort(above[:, 0])
        return int((np.searchsorted(a, b, "right") - np.searchsorted(a, b)).sum())
    both = np.ascontiguousarray(np.concatenate([below, above])).view(f"V{8 * below.shape[1]}").ravel()
    place = np.unique(both, return_inverse=True)[1]
    k = place.max(initial=0) + 1
    return int(np.bincount(place[: len(below)], minlength=k) @ np.bincount(place[len(below) :], minlength=k))


def _free_pairs(tied, others) -> int:
    """Pairs of a reference of tied and one of others that are nowhere on the same side."""
    (a, b), (c, d), found = tied, others, 0
    nowhere = ~(a.any(1) | b.any(1))
    found += int(nowhere.sum()) * len(c)  # copies of the curve: a band with any other curve
    for u, v in zip(a[~nowhere], b[~nowhere], strict=True):
        found += int((~((c & u) | (d & v)).any(1)).sum())
    return found


def band_all(c: Curves) -> DataFrame:
    """``band`` against all curves, whatever their number, over pairs of blocks of references.

    Two references hold a curve if they are nowhere on the same side of it. Where neither
    touches the curve, one has to lie below just where the other lies above, so these pairs are
    counted by equal sets of bits; those that touch it are compared one by one.
    """
    n, m = c.df.count(), len(c.grid)
    whole = np.packbits(np.arange(64 * -(-m // 64)) < m).view(np.uint64)

    def fn(x, p, q):
        out = np.empty(len(x))
        first = sides(x, p)
        second = first if q is None else sides(x, q)
        for i in range(len(x)):
            (a, b), (c, d) = (first[0][i], first[1][i]), (second[0][i], second[1][i])
            s, t = ((a | b) == whole).all(1), ((c | d) == whole).all(1)  # touch it nowhere
            free, tied = (a[s], b[s]), (a[~s], b[~s])
            if q is None:
                k = int((~s).sum())
                # pairs of two that touch it are met twice, and each with itself
                own = int((~((tied[0] & tied[0]) | (tied[1] & tied[1])).any(1)).sum())
                out[i] = _opposite(*free) / 2 + _free_pairs(tied, free) + (_free_pairs(tied, tied) - own) / 2 if k else _opposite(*free) / 2
            else:
                other = c[~t], d[~t]
                out[i] = _opposite(free[0], d[t]) + _free_pairs(tied, (c, d)) + _free_pairs(other, free)
        return out

    out = against_pairs(c.df, fn, "total double", 16, 16 * WIDE)
    return out.select("id", (F.col("total") / max(n * (n - 1) / 2, 1)).alias("depth"))


def random_projection(c: Curves, n_proj: int = 50, seed: int = 1, how: str = "mean", derivatives: int = 0) -> DataFrame:
    """Univariate rank depth over random unit directions: their mean, or minimum (Tukey).

    With ``derivatives`` curves are joined with their derivatives first.
    """
    m = len(c.grid) * (1 + derivatives)
    dirs = np.random.default_rng(seed).standard_normal((m, n_proj))
    dirs /= np.linalg.norm(dirs, axis=0)

    def project(v):
        parts = [v]
        for k in range(derivatives):
            parts.append(nm.central_differences(parts[-1], c.grid))
        return np.hstack(parts) @ dirs

    p = per_curve(c.df.select("id", "values"), project, "values array<double>")
    r = ranks(Curves(p, np.arange(n_proj, dtype=float)))
    u = (F.least(F.col("lt"), F.col("n") - F.col("le")) + 1) / (F.col("n") + 1)
    return r.groupBy("id").agg((F.avg(u) if how == "mean" else F.min(u)).alias("depth"))


METHODS = {
    "fm": fraiman_muniz, "mbd": modified_band, "bd": band_all, "mei": modified_epigraph, "mhi": modified_hypograph, "ei": epigraph, "hi": hypograph,
    "hrd": half_region, "mhrd": modified_half_region, "sup": sup_depth, "modal": modal, "spatial": spatial, "tvd": total_variation, "erl": extreme_rank_length,
    "extremal": extremal, "rp": random_projection, "tukey": lambda c: random_projection(c, how="min"), "rpd": lambda c: random_projection(c, derivatives=1),
}


def depth(c: Curves, method: str, **options) -> DataFrame:
    if method not in METHODS:
        raise ValueError(f"no depth {method}")
    return METHODS[method](c, **options)


def boxplot(c: Curves, depths: DataFrame, factor: float = 1.5) -> tuple[DataFrame, DataFrame]:
    """(pos, lower, upper, fence_low, fence_high) and (id, depth, central, outlier).

    The central region holds the ceil(n / 2) deepest curves, equals by id; an outlier
    leaves the fences somewhere.
    """
    n = c.df.count()
    depths = depths.persist()
    central = numbered(depths.withColumn("_shallow", -F.col("depth")), "_shallow", "id").where(F.col("rank") <= math.ceil(n / 2)).select("id")
    box = c.long().join(central, "id").groupBy("pos").agg(F.min("v").alias("lower"), F.max("v").alias("upper"))
    width = F.col("upper") - F.col("lower")
    box = box.select("pos", "lower", "upper", (F.col("lower") - factor * width).alias("fence_low"), (F.col("upper") + factor * width).alias("fence_high"))
    out = c.long().join(F.broadcast(box), "pos").groupBy("id").agg(F.max((F.col("v") < F.col("fence_low")) | (F.col("v") > F.col("fence_high"))).alias("outlier"))  # a row per position
    marked = central.withColumn("central", F.lit(True))
    return box, depths.join(out, "id").join(marked, "id", "left").select("id", "depth", F.coalesce("central", F.lit(False)).alias("central"), "outlier")


# ---- outliers ----


def outliergram(c: Curves, factor: float = 1.5) -> DataFrame:
    """id, mei, mbd, distance below the quadratic of MBD on MEI, outlier: residual under Q1 - factor IQR."""
    both = modified_epigraph(c).withColumnRenamed("depth", "mei").join(modified_band(c).withColumnRenamed("depth", "mbd"), "id")
    n, s1, s2, s3, s4, y0, y1, y2 = (float(x[0]) for x in sums(both, lambda x, y: [np.array([z]) for z in (len(x), x.sum(), (x**2).sum(), (x**3).sum(), (x**4).sum(), y.sum(), (x * y).sum(), (x * x * y).sum())], ["mei", "mbd"]))
    b = np.linalg.solve([[n, s1, s2], [s1, s2, s3], [s2, s3, s4]], [y0, y1, y2])
    res = both.withColumn("residual", F.col("mbd") - (b[0] + b[1] * F.col("mei") + b[2] * F.col("mei") * F.col("mei")))
    q1, q3 = order_statistics(res, "residual", [int(n) // 4, 3 * int(n) // 4])
    return res.withColumn("outlier", F.col("residual") < q1 - factor * (q3 - q1))


def fence(df: DataFrame, column: str, factor: float = 1.5) -> tuple[float, float]:
    """Quartiles, moved out by factor times their distance."""
    q1, q3 = quantiles(df, column, [0.25, 0.75])
    return q1 - factor * (q3 - q1), q3 + factor * (q3 - q1)


def muod(c: Curves, factor: float = 1.5) -> DataFrame:
    """id, shape, magnitude, amplitude and a flag for each: |correlation - 1|, |intercept| and
    |slope - 1| of each curve's least squares on the mean curve, above the upper fence."""
    _, mu, _ = _moments(c)
    x = mu - mu.mean()
    m = len(mu)
    spread = float(x @ x) / (m - 1)

    def kernel(v):
        d = v - v.mean(1, keepdims=True)
        cov, sd = d @ x / (m - 1), np.sqrt((d**2).sum(1) / (m - 1))
        slope = cov / spread if spread >= 1e-15 else np.ones(len(v))
        root = math.sqrt(spread)
        flat = (sd < 1e-15) | (root < 1e-15)
        cor = np.where(flat, 1.0, cov / np.where(flat, 1.0, sd * root))
        return np.abs(cor - 1), np.abs(v.mean(1) - slope * mu.mean()), np.abs(slope - 1)

    out = per_curve(c.df.select("id", "values"), kernel, "shape double, magnitude double, amplitude double")
    return out.select("*", *[(F.col(k) > fence(out, k, factor)[1]).alias(f"{k}_outlier") for k in ("shape", "magnitude", "amplitude")])


def tvd_mss(c: Curves, shape_factor: float = 1.5, factor: float = 1.5) -> DataFrame:
    """id, tvd, mss, shape_outlier, magnitude_outlier: total variation depth, the rank depth of
    first differences weighted by their share of a curve's variation; curves below the lower
    fence of mss (and its mean) are shape outliers, the others go through the boxplot."""
    share = (F.col("le") + F.col("lt") + 1) / (2 * F.col("n"))
    tvd = ranks(c).groupBy("id").agg(F.avg(share * (1 - share)).alias("tvd"))
    steps = Curves(per_curve(c.df.select("id", "values"), lambda v: np.diff(v, axis=1), "values array<double>"), c.grid[:-1])
    size = F.abs(F.col("v"))
    mss = ranks(steps).groupBy("id").agg(F.sum(share * (1 - share) * size).alias("_a"), F.sum(size).alias("_b"))
    both = tvd.join(mss.select("id", F.when(F.col("_b") > 0, F.col("_a") / F.col("_b")).otherwise(0.0).alias("mss")), "id").persist()
    low = min(fence(both, "mss", shape_factor)[0], both.agg(F.avg("mss")).first()[0])
    marked = both.withColumn("shape_outlier", F.col("mss") < low)
    kept = c.with_df(c.df.join(marked.where("NOT shape_outlier").select("id"), "id", "left_semi"))
    hit = boxplot(kept, modified_band(kept), factor)[1].select("id", "outlier")
    return marked.join(hit, "id", "left").select("id", "tvd", "mss", "shape_outlier", F.coalesce("outlier", F.lit(False)).alias("magnitude_outlier"))


def depthgram(c: Curves, shape_factor: float = 1.5, factor: float = 1.5) -> DataFrame:
    """id, mbd, mei, mbd_of_mei, mei_of_mbd, shape_outlier (above the outliergram's parabola by
    more than the upper fence) and magnitude_outlier (the boxplot of mbd values)."""
    # rounded, so that equal shares of pairs are ties whatever the order of their sums
    both = modified_epigraph(c).select("id", F.round("depth", 12).alias("mei")).join(modified_band(c).select("id", F.round("depth", 12).alias("mbd")), "id").persist()
    n = both.count()
    one = lambda name: Curves(both.select("id", F.array(F.col(name)).alias("values")), np.zeros(1))
    a, b = -2.0 / (n * (n - 1)), 2.0 * (n + 1) / (n - 1)
    above = both.withColumn("_above", a + b * F.col("mei") + a * n * n * F.col("mei") * F.col("mei") - F.col("mbd"))
    above = above.withColumn("shape_outlier", F.col("_above") > fence(above, "_above", shape_factor)[1]).drop("_above")
    hit = boxplot(one("mbd"), modified_band(one("mbd")), factor)[1].select("id", F.col("outlier").alias("magnitude_outlier"))
    out = above.join(modified_band(one("mei")).withColumnRenamed("depth", "mbd_of_mei"), "id").join(modified_epigraph(one("mbd")).withColumnRenamed("depth", "mei_of_mbd"), "id")
    return out.join(hit, "id").select("id", "mbd", "mei", "mbd_of_mei", "mei_of_mbd", "shape_outlier", "magnitude_outlier")


def lrt_outliers(c: Curves, threshold: float, trim: float = 0.1) -> DataFrame:
    """id, distance to the FM-trimmed mean over the trimmed deviation (root of the mean over
    points), outlier."""
    d = fraiman_muniz(c)
    n = c.df.count()
    kept = c.with_df(c.df.join(numbered(d, "depth", "id").where(F.col("rank") <= int(trim * n)).select("id"), "id", "left_anti"))
    k, mu, scatter = _moments(kept)
    var = np.maximum(np.diag(scatter) / max(k - 1, 1), 1e-10)
    return per_curve(c.df.select("id", "values"), lambda v: np.sqrt(((v - mu) ** 2 / var).mean(1)), "distance double").withColumn("outlier", F.col("distance") > threshold)


def _moments(c: Curves):
    from curvelake.operators.apply import moments

    return moments(c.df)


#: Bytes of values that a task of ``lrt_threshold`` holds of the table, rows that it draws at once,
#: and rows that go together from task to task.
DRAWN_BYTES, DRAWN_ROWS, SENT_ROWS = 32 << 20, 16_384, 65_536


def lrt_threshold(c: Curves, n_boot: int = 100, percentile: float = 0.99, smoothing: float = 0.05, trim: float = 0.1, seed: int = 1) -> float:
    """Quantile of the largest normalised distance over smoothed bootstrap samples.

    Replicates draw from all curves, in the order of ids. A task holds a few points of all curves
    (DRAWN_BYTES, a point at least) and draws some replicates at these points, by the stream that
    all points share, so the draws don't depend on the tasks. Ranks by point add up to the depths
    that choose a replicate's trimmed rows; the tasks then draw again for the moments of the
    others, and squares by point add up to distances.
    """
    import pyarrow as pa

    n, m = c.df.count(), len(c.grid)
    if not n:
        raise ValueError("an empty table has no threshold")
    share = min(m, max(1, DRAWN_BYTES // (8 * n)))  # points of a task
    groups = math.ceil(m / share)
    turns = min(n_boot, math.ceil(2 * c.df.sparkSession.sparkContext.defaultParallelism / groups))
    tasks, dropped = groups * turns, int(trim * n)
    of_points, of_rows, of_kept, of_largest = "g int, ids binary, v binary", "b int, g int, k long, v binary", "b int, v binary", "b int, d double"
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}

    def row(schema, *values):
        return pa.RecordBatch.from_arrays([pa.array([x], kinds[k.split()[1]]) for x, k in zip(values, schema.split(", "), strict=True)], names=[k.split()[0] for k in schema.split(", ")])

    def cut(batches):
        for rows in batches:
            if rows.num_rows:
                v, ids = matrix(rows.column("values")), rows.column("id").to_numpy(zero_copy_only=False).astype(np.int64).tobytes()
                for g in range(groups):
                    yield row(of_points, g, ids, v[:, g * share : (g + 1) * share].tobytes())

    def rows_of(batches):
        for rows in batches:
            for k in range(rows.num_rows):
                yield tuple(x[k].as_buffer() if pa.types.is_binary(x.type) else x[k].as_py() for x in rows.columns)

    def points(pieces, g):
        """The task's points of all curves, in the order of ids."""
        ids = np.concatenate([np.frombuffer(i, np.int64) for i, _ in pieces])
        place, out, at = np.empty(n, np.int64), np.empty((n, min(share, m - g * share))), 0
        place[np.argsort(ids, kind="stable")] = np.arange(n)
        for i, v in pieces:
            v = np.frombuffer(v).reshape(-1, out.shape[1])
            out[place[at : at + len(v)]] = v
            at += len(v)
        return out, smoothing * out.std(0, ddof=1)

    def draw(x, sd, g, b):
        """A replicate at the task's points; numbers of all points are drawn, some rows at a time."""
        r = np.random.default_rng(seed + b)
        out = x[r.integers(0, n, n)]
        for k in range(0, n, DRAWN_ROWS):
            out[k : k + DRAWN_ROWS] += sd * r.standard_normal((min(DRAWN_ROWS, n - k), m))[:, g * share : (g + 1) * share]
        return out

    def sent(b, g, v):
        for k in range(0, n, SENT_ROWS):
            yield row(of_rows, b, g, k, v[k : k + SENT_ROWS].tobytes())

    def depths(x, sd, g, b):
        x, d, rank = draw(x, sd, g, b), np.zeros(n, np.int64), np.empty(n, np.int64)
        for p in range(x.shape[1]):
            rank[np.argsort(x[:, p])] = np.arange(1, n + 1)
            d += np.minimum(rank, n - rank)
        return d

    def distances(x, sd, g, b, kept):
        x = draw(x, sd, g, b)
        kept = np.unpackbits(np.frombuffer(kept, np.uint8), count=n).astype(float)
        x -= kept @ x / (n - dropped)
        x *= x
        return (x / np.maximum(kept @ x / (n - dropped - 1), 1e-10)).sum(1)

    def by_task(fn):
        """Sends fn(points, deviations, group, replicate[, its kept rows]) of the task's replicates."""
        def run(batches):
            pieces, left = [], n
            for task, b, ids, v in rows_of(batches):
                g = task // turns
                if b >= 0:  # after all points of the task
                    yield from sent(b, g, fn(*x, g, b, v))
                    continue
                pieces, left = [*pieces, (ids, v)], left - len(ids) // 8
                if not left:
                    x, pieces, left = points(pieces, g), [], n
                    if fn is depths:
                        for own in range(task % turns, n_boot, turns):
                            yield from sent(own, g, fn(*x, g, own))

        return run

    def trimmed(batches):
        """The kept rows of each replicate as bits: all but those of least depth, the first of equals."""
        now, d = None, None

        def kept():
            bits = np.ones(n, bool)
            bits[np.argsort(d, kind="stable")[:dropped]] = False
            return row(of_kept, now, np.packbits(bits).tobytes())

        for b, _, k, v in rows_of(batches):
            if b != now:
                if now is not None:
                    yield kept()
                now, d = b, np.zeros(n, np.int64)
            v = np.frombuffer(v, np.int64)
            d[k : k + len(v)] += v
        if now is not None:
            yield kept()

    def largest(batches):
        now, total = None, None
        for b, _, k, v in rows_of(batches):
            if (b, k) != now:
                if now is not None:
                    yield row(of_largest, now[0], float(total.max()))
                now, total = (b, k), 0.0
            total = total + np.frombuffer(v)
        if now is not None:
            yield row(of_largest, now[0], float(total.max()))

    pieces = c.df.select("id", "values").mapInArrow(cut, of_points).select(F.explode(F.sequence(F.col("g") * turns, F.col("g") * turns + turns - 1)).alias("task"), F.lit(-1).alias("b"), "ids", "v")
    by = lambda df, *order: df.repartitionById(n_boot, "b").sortWithinPartitions("b", *order)
    own = lambda df: df.repartitionById(tasks, "task").sortWithinPartitions("task", "b")
    kept = by(own(pieces).mapInArrow(by_task(depths), of_rows)).mapInArrow(trimmed, of_kept)
    again = kept.select(F.explode(F.sequence(F.col("b") % turns, F.lit(tasks - 1), F.lit(turns))).alias("task"), "b", F.lit(None).cast("binary").alias("ids"), "v")
    far = by(own(pieces.union(again)).mapInArrow(by_task(distances), of_rows), "k", "g").mapInArrow(largest, of_largest)
    found = sorted(math.sqrt(r["d"] / m) for r in far.groupBy("b").agg(F.max("d").alias("d")).collect())  # a row for each replicate
    return found[min(int(n_boot * percentile), n_boot - 1)]


def magnitude_shape(c: Curves) -> DataFrame:
    """id, magnitude (1 - MBD) and shape (distance of the unit direction to the mean one)."""
    unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-15)
    n, mu, _ = _moments(c)
    k, total = sums(c.df, lambda v: [np.array([len(v)]), unit(v - mu).sum(0)], ["values"])
    mean = total / k[0]
    shape = per_curve(c.df.select("id", "values"), lambda v: np.linalg.norm(unit(v - mu) - mean, axis=1), "shape double")
    return modified_band(c).select("id", (1 - F.col("depth")).alias("magnitude")).join(shape, "id")


def sequential_outliers(c: Curves, chain: tuple[str, ...] = ("T0", "T1", "T2", "D1"), factor: float = 1.5) -> DataFrame:
    """Ids flagged by the boxplot after some step: T0 raw, T1 minus mean, T2 over norm, D1 and D2
    first differences of what the steps before gave (a point fewer each)."""
    steps = {"T0": lambda v: v, "T1": lambda v: v - v.mean(1, keepdims=True), "T2": lambda v: v / np.linalg.norm(v, axis=1, keepdims=True), "D1": lambda v: np.diff(v, axis=1), "D2": lambda v: np.diff(v, axis=1)}
    df, grid, found = c.df.select("id", "values"), c.grid, None
    for step in chain:
        df = per_curve(df, steps[step], "values array<double>")
        grid = grid[:-1] if step in ("D1", "D2") else grid
        now = Curves(df, grid)
        hit = boxplot(now, modified_band(now), factor)[1].where("outlier").select("id", F.lit(step).alias("step"))
        found = hit if found is None else found.union(hit)
    return found.groupBy("id").agg(F.array_sort(F.collect_set("step")).alias("steps"))
