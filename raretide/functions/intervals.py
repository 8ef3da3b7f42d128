"""Beta quantiles and binomial intervals, without further libraries."""

from __future__ import annotations

import math


def beta_cdf(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c = 1e-300, 1.0
    d = 1 / max(1 - (a + b) * x / (a + 1), tiny)
    value = d
    for m in range(1, 10000):
        before = value
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + top * d, 1 + top / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            value *= d * c
        if abs(value - before) <= 1e-15 * abs(value):
            break
    return front * value


def beta_quantile(p: float, a: float, b: float) -> float:
    """x with beta_cdf(x, a, b) = p, by bisection."""
    low, high = 0.0, 1.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if beta_cdf(middle, a, b) < p else (low, middle)
        if high - low <= 1e-15 * high:
            break
    return (low + high) / 2


def jeffreys(errors: int, shots: int, level: float = 0.95) -> tuple[float, float]:
    """The interval of the posterior Beta(errors + 1/2, shots - errors + 1/2)."""
    a, b, tail = errors + 0.5, shots - errors + 0.5, (1 - level) / 2
    return beta_quantile(tail, a, b), beta_quantile(1 - tail, a, b)


def clopper_pearson(errors: int, shots: int, level: float = 0.95) -> tuple[float, float]:
    """The exact interval: both one-sided binomial tails at its ends hold (1 - level) / 2."""
    tail = (1 - level) / 2
    low = 0.0 if errors == 0 else beta_quantile(tail, errors, shots - errors + 1)
    return low, 1.0 if errors == shots else beta_quantile(1 - tail, errors + 1, shots - errors)
