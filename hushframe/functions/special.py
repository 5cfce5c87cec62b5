"""Special functions and one-dimensional solvers in NumPy and the standard library."""

from __future__ import annotations

import math
from collections.abc import Callable
from statistics import NormalDist

import numpy as np

_NORMAL = NormalDist()


def norm_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def norm_sf(x: float) -> float:
    return 0.5 * math.erfc(x / math.sqrt(2))


def norm_ppf(p: float) -> float:
    if p <= 0:
        return -math.inf
    return math.inf if p >= 1 else _NORMAL.inv_cdf(p)


def norm_isf(p: float) -> float:
    return -norm_ppf(p)


def norm_logcdf(x: float) -> float:
    """Log of the normal distribution function, by its asymptotic series far on the left."""
    if x > -30:
        return math.log(norm_cdf(x))
    s, term = 1.0, 1.0
    for k in range(1, 8):
        term *= -(2 * k - 1) / (x * x)
        s += term
    return -x * x / 2 - math.log(-x) - 0.5 * math.log(2 * math.pi) + math.log(s)


def logsumexp(x: np.ndarray, axis: int | None = None) -> np.ndarray:
    top = np.max(x, axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        out = np.log(np.sum(np.exp(x - top), axis=axis, keepdims=True)) + top
    return out.squeeze() if axis is None else np.squeeze(out, axis=axis)


def log_diff(x: float, y: float) -> float:
    """log(e^x - e^y) for y <= x."""
    if y > x:
        raise ValueError("log_diff needs y <= x")
    return -math.inf if x == y else x + math.log1p(-math.exp(y - x))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Lentz's evaluation of the continued fraction of the incomplete beta function."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 2000):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + top * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + top / c
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return out


def beta_cdf(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1.0 - front * _beta_fraction(b, a, 1 - x) / b


def beta_ppf(p: float, a: float, b: float) -> float:
    low, high = 0.0, 1.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if beta_cdf(mid, a, b) < p else (low, mid)
        if high - low < 1e-16 * max(high, 1e-300):
            break
    return (low + high) / 2


def binom_sf(k: float, n: int, p: float) -> float:
    """P(X > k)."""
    k = math.floor(k)
    if k < 0:
        return 1.0
    return 0.0 if k >= n else beta_cdf(p, k + 1, n - k)


def binom_logpmf(k: int, n: int, p: float) -> float:
    if p in (0.0, 1.0):
        return 0.0 if k == n * p else -math.inf
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)


def bisect(f: Callable[[float], float], low: float, high: float, *, tolerance: float = 1e-12, steps: int = 200) -> float:
    """A root of a monotone function between two signs; the nearer end if there is no change of sign."""
    a, b = f(low), f(high)
    if a == 0 or (a > 0) == (b > 0):
        return low if abs(a) <= abs(b) else high
    for _ in range(steps):
        mid = (low + high) / 2
        m = f(mid)
        if (m > 0) == (a > 0):
            low = mid
        else:
            high = mid
        if high - low <= tolerance * max(1.0, abs(mid)):
            break
    return (low + high) / 2


def golden(f: Callable[[float], float], low: float, high: float, *, steps: int = 100) -> float:
    """The minimiser of a function with one valley."""
    ratio = (math.sqrt(5) - 1) / 2
    x, y = high - ratio * (high - low), low + ratio * (high - low)
    fx, fy = f(x), f(y)
    for _ in range(steps):
        if fx < fy:
            high, y, fy = y, x, fx
            x = high - ratio * (high - low)
            fx = f(x)
        else:
            low, x, fx = x, y, fy
            y = low + ratio * (high - low)
            fy = f(y)
    return (low + high) / 2
