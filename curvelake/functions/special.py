"""Distribution functions and quantiles without external libraries."""

from __future__ import annotations

import math


def gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    lead = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return min(1.0, total * lead)
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > 1e-300 else 1e-300)
        c = b + an / (c if abs(c) > 1e-300 else 1e-300)
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return max(0.0, 1 - lead * h)


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_i(b, a, 1 - x)
    lead = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    h = d
    for k in range(1, 10_000):
        for top in (k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k)), -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > 1e-300 else 1e-300)
            c = 1 + top / (c if abs(c) > 1e-300 else 1e-300)
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return lead * h


def chi2_cdf(x: float, k: float) -> float:
    return gamma_p(k / 2, x / 2)


def f_cdf(x: float, a: float, b: float) -> float:
    return beta_i(a / 2, b / 2, a * x / (a * x + b)) if x > 0 else 0.0


def t_cdf(x: float, k: float) -> float:
    tail = beta_i(k / 2, 0.5, k / (k + x * x)) / 2
    return 1 - tail if x > 0 else tail


def normal_cdf(x: float) -> float:
    return math.erfc(-x / math.sqrt(2)) / 2


def inverse(cdf, p: float, low: float, high: float) -> float:
    """The point at which an increasing function reaches p, by bisection."""
    while cdf(high) < p:
        low, high = high, high * 2
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return (low + high) / 2


def chi2_quantile(p: float, k: float) -> float:
    return inverse(lambda x: chi2_cdf(x, k), p, 0.0, max(1.0, k))


def normal_quantile(p: float) -> float:
    return inverse(lambda x: normal_cdf(x - 40), p, 0.0, 80.0) - 40


def normal_quantile_rational(p: float) -> float:
    """Rational approximation with an error of about 4.5e-4; its coefficients are fixed values."""
    t = math.sqrt(-2 * math.log(min(p, 1 - p)))
    x = t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t**3)
    return x if p >= 0.5 else -x


def f_quantile(p: float, a: float, b: float) -> float:
    return inverse(lambda x: f_cdf(x, a, b), p, 0.0, 1.0)
