"""Seasonality, trends and decompositions of sampled series.

Kernels work on one series (an array on an even or uneven grid); ``per_series`` runs
them on every curve, ``on_mean`` on the mean curve, as dataset-level operators do.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame

from curvelake.functions import numeric as nm
from curvelake.operators.apply import per_curve, sums
from curvelake.operators.smooth import local_polynomial
from curvelake.sources.curves import Curves


def per_series(c: Curves, fn, schema: str) -> DataFrame:
    """fn(series, grid) -> a tuple of scalars or arrays, for every curve."""
    def kernel(v):
        rows = [fn(x, c.grid) for x in v]
        return tuple(zip(*rows, strict=True))

    return per_curve(c.df.select("id", "values"), kernel, schema)


def on_mean(c: Curves, fn):
    n, total = sums(c.df, lambda v: [np.array([len(v)]), v.sum(0)], ["values"])
    return fn(total / n[0], c.grid)


# ---- trends ----


def linear_trend(v, t):
    b = np.polyfit(t, v, 1)
    return np.polyval(b, t)


def polynomial_trend(v, t, degree: int = 2):
    u = (t - t[0]) / (t[-1] - t[0])
    p = np.vander(u, degree + 1)
    return p @ np.linalg.lstsq(p, v, rcond=None)[0]


def loess_trend(v, t, bandwidth: float = 0.3, degree: int = 2):
    """Tricube local polynomials; the bandwidth is a share of the grid's range."""
    return local_polynomial(t, v, t, bandwidth * (t[-1] - t[0]), degree, "tricube")


TRENDS = {"linear": (linear_trend, 2), "poly2": (lambda v, t: polynomial_trend(v, t, 2), 3), "poly3": (lambda v, t: polynomial_trend(v, t, 3), 4), "loess": (loess_trend, 4)}


def detrend(c: Curves, how: str = "linear", **options) -> DataFrame:
    """id, values (without trend), trend."""
    if how not in (*TRENDS, "polynomial", "difference"):
        raise ValueError(f"no trend {how}")
    if how == "difference":
        return per_series(c, lambda v, t: (differences(v, options.get("order", 1)), v - differences(v, options.get("order", 1))), "values array<double>, trend array<double>")
    fn = (lambda v, t: polynomial_trend(v, t, options.get("degree", 2))) if how == "polynomial" else (lambda v, t: TRENDS[how][0](v, t, **options))
    return per_series(c, lambda v, t: ((v - (f := fn(v, t))), f), "values array<double>, trend array<double>")


def differences(v, order: int = 1):
    """Differences with the first values kept."""
    for _ in range(order):
        v = np.concatenate([v[:1], np.diff(v)])
    return v


def best_trend(c: Curves) -> str:
    """Of linear, poly2, poly3 and loess the one of least mean AIC; a perfect fit wins."""
    names = list(TRENDS)

    def parts(v):
        out = np.zeros(len(names))
        for k, name in enumerate(names):
            fn, p = TRENDS[name]
            for x in v:
                rss = float(((x - fn(x, c.grid)) ** 2).sum())
                out[k] += -1e300 if rss <= 1e-15 else nm.aic(rss, len(x), p)
        return [out]

    return names[int(np.argmin(sums(c.df, parts, ["values"])[0]))]


def harmonics(v, t, period: float, n: int = 3):
    """Least squares of n harmonics without a constant."""
    x = np.hstack([np.stack([np.sin(2 * math.pi * k * t / period), np.cos(2 * math.pi * k * t / period)], 1) for k in range(1, n + 1)])
    return x @ np.linalg.lstsq(x, v, rcond=None)[0]


def decompose(c: Curves, period: float, n: int = 3, bandwidth: float = 0.3, multiplicative: bool = False) -> DataFrame:
    """id, trend, seasonal, remainder: local quadratic trend (bandwidth 0.3 at least), harmonics,
    rest. Multiplicative ones work on logs, shifted by 1 - min over the whole table if that is not positive."""
    shift = 0.0
    if multiplicative:
        from pyspark.sql import functions as F

        low = c.df.agg(F.min(F.array_min("values"))).first()[0]
        shift = 1 - low if low <= 0 else 0.0

    def one(v, t):
        x = np.log(v + shift) if multiplicative else v
        trend = loess_trend(x, t, max(bandwidth, 0.3))
        s = harmonics(x - trend, t, period, n)
        rest = x - trend - s
        return (np.exp(trend) - shift, np.exp(s), np.exp(rest)) if multiplicative else (trend, s, rest)

    return per_series(c, one, "trend array<double>, seasonal array<double>, remainder array<double>")


def stl(v, period: int, s_window: int = 7, t_window: int | None = None, robust: bool = False, inner: int = 2, outer: int = 0):
    """(seasonal, trend, remainder): cycle-subseries local lines, a low pass of three moving
    averages, a tricube trend; robustness weights by bisquare."""
    m = len(v)
    if m < 2 * period:
        raise ValueError("a decomposition needs two periods")
    t_window = t_window or (w := math.ceil(1.5 * period / (1 - 1.5 / s_window))) + (1 - w % 2)
    x, rho, trend = np.arange(m, dtype=float), np.ones(m), np.zeros(m)
    seasonal = np.zeros(m)

    def loess(t, y, w, span, new):
        out = np.empty(len(new))
        for i, u in enumerate(new):
            d = np.abs(t - u)
            h = np.sort(d)[min(span, len(t)) - 1] * max(1.0, span / len(t)) or 1.0
            k = (1 - np.minimum(d / h, 1) ** 3) ** 3 * w
            s0, s1, s2 = k.sum(), (k * (t - u)).sum(), (k * (t - u) ** 2).sum()
            den = s0 * s2 - s1 * s1
            out[i] = ((k * (s2 - s1 * (t - u))) @ y) / den if den > 1e-12 else (k @ y / s0 if s0 > 0 else y.mean())
        return out

    def average(y, k):
        return np.convolve(y, np.ones(k) / k, "valid")

    for o in range(outer + 1 if robust else 1):
        for _ in range(inner):
            y = v - trend
            c = np.empty(m + 2 * period)
            for p in range(period):
                at = np.arange(p, m, period)
                c[p :: period][: len(at) + 2] = loess(at.astype(float), y[at], rho[at], s_window, np.concatenate([[at[0] - period], at, [at[-1] + period]]))
            low = average(average(average(c, period), period), 3)
            seasonal = c[period : period + m] - low[:m]
            trend = loess(x, v - seasonal, rho, t_window, x)
        r = np.abs(v - seasonal - trend)
        h = 6 * np.median(r)
        rho = (1 - np.minimum(r / h, 1) ** 2) ** 2 if h > 0 else np.ones(m)
    return seasonal, trend, v - seasonal - trend


def stl_curves(c: Curves, period: int, **options) -> DataFrame:
    return per_series(c, lambda v, t: stl(v, period, **options), "seasonal array<double>, trend array<double>, remainder array<double>")


# ---- spectra and periods ----


def periodogram(v, t):
    """(frequencies, one-sided power): doubled for 0 < k < n // 2; no detrending."""
    n = len(v)
    p = np.abs(np.fft.rfft(v)) ** 2 / n
    p[1 : n // 2] *= 2
    return np.arange(len(p)) / (n * (t[1] - t[0])), p


def acf(v, lags: int | None = None) -> np.ndarray:
    """Biased autocorrelations over n times the variance."""
    x = v - v.mean()
    n = len(v)
    lags = n - 1 if lags is None else min(lags, n - 1)
    f = np.fft.rfft(x, 2 * n)
    r = np.fft.irfft(f * np.conj(f))[: lags + 1]
    return r / r[0] if r[0] > 1e-15 else np.zeros(lags + 1)


def period_fft(v, t):
    """(period, frequency, power, confidence): the strongest bin after DC, the first of equals;
    confidence is it over the mean."""
    f, p = periodogram(v, t)
    k = 1 + int(np.argmax(p[1:]))
    return 1 / f[k], float(f[k]), float(p[k]), float(p[k] / p[1:].mean()) if p[1:].mean() > 0 else 0.0


def period_acf(v, t, lags: int | None = None):
    """(period, correlation): the first local maximum from lag 3 on."""
    r = acf(v, lags or len(v) // 2)
    for k in range(3, len(r) - 1):
        if r[k] > r[k - 1] and r[k] > r[k + 1] and r[k] > 0:
            return k * (t[1] - t[0]), float(r[k])
    return math.nan, 0.0


def period_regression(v, t, low: float, high: float, steps: int = 100, n: int = 3):
    x = v - v.mean()
    best = min(np.linspace(low, high, steps), key=lambda p: float(((x - harmonics(x, t, p, n)) ** 2).sum()))
    return float(best), float(1 - ((x - harmonics(x, t, best, n)) ** 2).sum() / max((x**2).sum(), 1e-15))


def multiple_periods(v, t, most: int = 3, confidence: float = 3.0):
    """Periods found one after another, each sinusoid taken out."""
    x, out = v - v.mean(), []
    for _ in range(most):
        p, _, power, conf = period_fft(x, t)
        if conf < confidence or not math.isfinite(p):
            break
        out.append((float(p), power, conf))
        x = x - harmonics(x, t, p, 1)
    return out


def autoperiod(v, t, most: int = 5):
    """(period, acf): spectral peaks that lie on a hill of the autocorrelation, refined there."""
    f, p = periodogram(v - v.mean(), t)
    r, dt = acf(v), t[1] - t[0]
    threshold = p[1:].mean() * 2
    best = (math.nan, 0.0)
    for k in sorted(range(1, len(p)), key=lambda k: -p[k])[:most]:
        lag = round(1 / f[k] / dt)
        if p[k] < threshold or lag < 2 or lag >= len(r) - 1:
            continue
        lo, hi = max(1, lag - max(1, lag // 4)), min(len(r) - 2, lag + max(1, lag // 4))
        j = lo + int(np.argmax(r[lo : hi + 1]))
        if r[j] >= r[j - 1] and r[j] >= r[j + 1] and r[j] > best[1]:
            best = (j * dt, float(r[j]))
    return best


def cfd_autoperiod(v, t, tolerance: float = 0.1, most: int = 10):
    """Autoperiod of differenced data: spectral candidates are clustered, means checked on the acf."""
    d = np.diff(v)
    f, p = periodogram(d - d.mean(), t[1:])
    found = sorted(1 / f[k] for k in sorted(range(1, len(p)), key=lambda k: -p[k])[:most] if p[k] > p[1:].mean() * 2)
    clusters: list[list[float]] = []
    for x in found:
        if clusters and x - clusters[-1][-1] <= tolerance * x:
            clusters[-1].append(x)
        else:
            clusters.append([x])
    r, dt = acf(v), t[1] - t[0]
    best = (math.nan, 0.0)
    for g in clusters:
        lag = round(float(np.mean(g)) / dt)
        if 2 <= lag < len(r) - 1 and r[lag] > best[1]:
            best = (lag * dt, float(r[lag]))
    return best


def lomb_scargle(t, v, frequencies) -> tuple[np.ndarray, float, float]:
    """(normalised power, best frequency, false-alarm probability) for uneven times."""
    t, x = np.asarray(t, float), np.asarray(v, float)
    x, s2 = x - x.mean(), x.var(ddof=1)
    w = 2 * math.pi * np.asarray(frequencies)
    tau = np.arctan2(np.sin(2 * np.outer(w, t)).sum(1), np.cos(2 * np.outer(w, t)).sum(1)) / (2 * w)
    a = np.outer(w, t) - (w * tau)[:, None]
    c, s = np.cos(a), np.sin(a)
    p = ((c @ x) ** 2 / np.maximum((c**2).sum(1), 1e-15) + (s @ x) ** 2 / np.maximum((s**2).sum(1), 1e-15)) / (2 * s2)
    k = int(np.argmax(p))
    return p, float(frequencies[k]), float(1 - (1 - math.exp(-min(p[k], 700))) ** len(p))


def hilbert(v) -> np.ndarray:
    """The analytic signal, by doubling positive frequencies."""
    n = len(v)
    h = np.zeros(n)
    h[0] = 1
    h[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        h[n // 2] = 1
    return np.fft.ifft(np.fft.fft(v) * h)


def instantaneous_period(v, t):
    phase = np.unwrap(np.angle(hilbert(v - v.mean())))
    slope = nm.central_differences(phase, t)
    return np.where(np.abs(slope) > 1e-10, 2 * math.pi / np.where(np.abs(slope) > 1e-10, np.abs(slope), 1), np.inf)


def peaks(v, t, min_distance: float = 0.0, min_prominence: float = 0.0):
    """(times, values, prominences): sign changes of the derivative; prominence over the range."""
    d = nm.central_differences(v, t)
    at = [k + 1 if v[k + 1] >= v[k] else k for k in range(len(v) - 1) if d[k] > 0 >= d[k + 1]]
    span = float(np.ptp(v)) or 1.0
    found = []
    for k in sorted(set(at)):
        left = v[: k + 1][::-1]
        right = v[k:]
        lo = left[: int(np.argmax(left > v[k])) or len(left)].min()
        hi = right[: int(np.argmax(right > v[k])) or len(right)].min()
        prominence = (v[k] - max(lo, hi)) / span
        if prominence >= min_prominence:
            found.append((k, prominence))
    kept: list = []
    for k, prominence in sorted(found, key=lambda x: -v[x[0]]):
        if all(abs(t[k] - t[j]) >= min_distance for j, _ in kept):
            kept.append((k, prominence))
    kept.sort()
    return [float(t[k]) for k, _ in kept], [float(v[k]) for k, _ in kept], [float(p) for _, p in kept]


def strength_variance(v, t, period: float, n: int = 3) -> float:
    x = v - linear_trend(v, t)
    return float(min(1.0, harmonics(x, t, period, n).var() / x.var())) if x.var() > 1e-15 else 0.0


def strength_spectral(v, t, period: float, n: int = 3) -> float:
    """Share of power within 10 % of the harmonics."""
    f, p = periodogram(v - v.mean(), t)
    near = np.zeros(len(f), bool)
    for k in range(1, n + 1):
        near |= np.abs(f - k / period) <= 0.1 * k / period
    near[0] = False
    return float(p[near].sum() / p[1:].sum()) if p[1:].sum() > 1e-15 else 0.0


def morlet(v, t, period: float, omega: float = 6.0) -> np.ndarray:
    """Morlet coefficients at one period."""
    scale = omega * period / (2 * math.pi)
    u = np.subtract.outer(t, t) / scale
    psi = np.exp(1j * omega * u - u * u / 2) * math.pi**-0.25
    return (np.conj(psi) @ (v - v.mean())) * (t[1] - t[0]) / math.sqrt(scale)


def strength_wavelet(v, t, period: float) -> float:
    w = np.abs(morlet(v, t, period)) ** 2
    cut = min(len(t) // 4, max(1, round(period / (t[1] - t[0]))))
    inner = w[cut:-cut] if len(w) > 2 * cut else w
    return float(min(1.0, math.sqrt(inner.mean() / max(v.var(), 1e-15) / (period * math.sqrt(math.pi)))))


def strength_windowed(v, t, period: float, window: float, how=strength_variance) -> np.ndarray:
    """Strength in a sliding window; NaN where it holds fewer than four points."""
    out = np.full(len(t), math.nan)
    for k, u in enumerate(t):
        m = np.abs(t - u) <= window / 2
        if m.sum() >= 4:
            out[k] = how(v[m], t[m], period)
    return out


def changes(strength, t, threshold: float, min_duration: float):
    """(time, 'onset' or 'cessation') where strength crosses a threshold and stays."""
    above, out, k = np.nan_to_num(strength) > threshold, [], 1
    while k < len(t):
        if above[k] != above[k - 1]:
            end = k
            while end + 1 < len(t) and above[end + 1] == above[k]:
                end += 1
            if t[end] - t[k] >= min_duration:
                out.append((float(t[k]), "onset" if above[k] else "cessation"))
        k += 1
    return out


def otsu(x, bins: int = 64) -> float:
    x = np.asarray(x)[np.isfinite(x)]
    h, e = np.histogram(x, bins)
    p, mid = h / h.sum(), (e[1:] + e[:-1]) / 2
    w, mu = np.cumsum(p), np.cumsum(p * mid)
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (mu[-1] * w - mu) ** 2 / (w * (1 - w))
    return float(mid[int(np.nanargmax(np.where(np.isfinite(between), between, -1)))])


def amplitude_modulation(v, t, period: float, how: str = "hilbert"):
    """(score, trend, envelope): spread and correlation with time of the envelope."""
    x = v - linear_trend(v, t)
    env = np.abs(hilbert(x)) if how == "hilbert" else np.abs(morlet(x, t, period))
    cut = len(t) // 10
    inner, tt = env[cut : len(t) - cut], t[cut : len(t) - cut]
    return float(inner.std() / max(inner.mean(), 1e-15)), float(np.corrcoef(inner, tt)[0, 1]), env


def peak_timing(v, t, period: float):
    """(mean, spread, slope, score) of the peaks' share of the cycle."""
    smooth = v.mean() + harmonics(v - v.mean(), t, period, 3) + linear_trend(v, t) - linear_trend(v, t).mean()
    at = np.array(peaks(smooth, t, 0.7 * period)[0])
    if not len(at):
        return math.nan, math.nan, math.nan, 0.0
    share = np.mod(at - t[0], period) / period
    sd = float(share.std(ddof=1)) if len(share) > 1 else 0.0
    return float(share.mean()), sd, float(np.polyfit(np.arange(len(share)), share, 1)[0]) if len(share) > 1 else 0.0, min(sd / 0.1, 1.0)


def classify_seasonality(v, t, period: float) -> str:
    s = strength_variance(v, t, period)
    cycles = strength_windowed(v, t, period, period * 2)
    weak = float(np.mean(np.nan_to_num(cycles) < 0.3))
    spread = peak_timing(v, t, period)[1]
    if s < 0.3:
        return "non_seasonal"
    if weak > 0.3:
        return "intermittent"
    return "stable" if (spread if math.isfinite(spread) else 0) <= 0.05 else "variable_timing"


def sazed(v, t):
    """(period, confidence): agreement of five estimators, two at least."""
    x = v - linear_trend(v, t)
    r = acf(x)
    zero = np.flatnonzero(np.diff(np.signbit(r)))
    dt = t[1] - t[0]
    guesses = [period_fft(x, t)[0], period_acf(x, t)[0], period_fft(r, np.arange(len(r)) * dt)[0], 2 * float(np.diff(zero).mean()) * dt if len(zero) > 1 else math.nan, autoperiod(x, t)[0]]
    best = (math.nan, 0.0)
    for g in guesses:
        agree = [x for x in guesses if math.isfinite(x) and math.isfinite(g) and abs(x - g) <= 0.1 * g]
        if len(agree) >= 2 and len(agree) / 5 > best[1]:
            best = (float(np.mean(agree)), len(agree) / 5)
    return best


def ssa(v, window: int, groups: int = 3):
    """(components by diagonal averaging, singular values) of the trajectory matrix."""
    m = len(v)
    x = np.lib.stride_tricks.sliding_window_view(v, window).T
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    out = []
    for k in range(min(groups, len(s))):
        y = s[k] * np.outer(u[:, k], vt[k])
        out.append([float(np.mean(np.diagonal(y[::-1], j - window + 1))) for j in range(m)])
    return np.array(out), s


def matrix_profile(v, window: int):
    """(distance to the nearest other subsequence, its place, most common arc): z-normalised."""
    x = np.lib.stride_tricks.sliding_window_view(v, window)
    z = (x - x.mean(1, keepdims=True)) / np.maximum(x.std(1, keepdims=True), 1e-12)
    d = np.sqrt(np.maximum(2 * window - 2 * z @ z.T, 0))
    n = len(d)
    d[np.abs(np.subtract.outer(np.arange(n), np.arange(n))) < max(1, window // 2)] = np.inf
    near = d.argmin(1)
    arcs = np.abs(near - np.arange(n))
    return d.min(1), near, int(np.bincount(arcs).argmax())
