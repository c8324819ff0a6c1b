"""Special functions in numpy: normal, Bessel, gamma and its derivatives, chi-squared and t."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np


def _each(f, x):
    x = np.asarray(x, float)
    return np.array([f(v) for v in x.ravel().tolist()], float).reshape(x.shape)


def _erfc(x):
    return _each(math.erfc, x)


def lgamma(x):
    return _each(math.lgamma, x)


def norm_cdf(x):
    return 0.5 * _erfc(-np.asarray(x, float) / math.sqrt(2))


def norm_ppf(p: float) -> float:
    return NormalDist().inv_cdf(p)


def bessel_j0(x):
    """Trapezoid of cos(x sin t) over a period, which converges faster than any power; beyond 700 the first terms of Hankel's expansion."""
    x = np.abs(np.asarray(x, float))
    near = np.minimum(x, 700.0)
    out = np.zeros_like(near)
    n = 1024
    for k in range(n):
        out += np.cos(near * math.sin(math.pi * (k + 0.5) / n))
    out /= n
    far = np.maximum(x, 700.0)
    phase = far - math.pi / 4
    p, q = 1 - 9 / (128 * far * far), -1 / (8 * far)
    return np.where(x <= 700.0, out, np.sqrt(2 / (math.pi * far)) * (p * np.cos(phase) - q * np.sin(phase)))


def digamma(x):
    x = np.asarray(x, float).copy()
    out = np.zeros_like(x)
    for _ in range(8):
        small = x < 8
        out = np.where(small, out - 1 / np.where(small, x, 1.0), out)
        x = np.where(small, x + 1, x)
    r = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r * (1 / 240 - r / 132))))


def trigamma(x):
    x = np.asarray(x, float).copy()
    out = np.zeros_like(x)
    for _ in range(8):
        small = x < 8
        out = np.where(small, out + 1 / np.where(small, x, 1.0) ** 2, out)
        x = np.where(small, x + 1, x)
    r = 1 / (x * x)
    return out + 1 / x + r / 2 + r / x * (1 / 6 - r * (1 / 30 - r * (1 / 42 - r / 30)))


def gamma_q(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-17:
            k += 1
            term *= x / k
            total += term
        return 1 - scale * total
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return scale * h


def chi2_sf(x: float, df: float) -> float:
    return gamma_q(df / 2, x / 2)


def t_ppf(p: float, df: float) -> float:
    """Quantile of Student's t by bisection on its distribution function."""
    if p < 0.5:
        return -t_ppf(1 - p, df)
    low, high = 0.0, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_cdf(mid, df) < p else (low, mid)
    return (low + high) / 2


def t_cdf(t: float, df: float) -> float:
    tail = 0.5 * beta_inc(df / (df + t * t), df / 2, 0.5)
    return 1 - tail if t >= 0 else tail


def beta_inc(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(1 - x, b, a)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) - math.lgamma(a) - math.lgamma(b) + math.lgamma(a + b)) / a
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or 1e-300)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + num * d) or 1e-300)
            c = (1 + num / c) or 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h
