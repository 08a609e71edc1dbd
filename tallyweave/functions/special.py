"""Distribution tails and small-sample tests in plain Python; used on the driver and in grouped tasks."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import cache
from statistics import NormalDist

import numpy as np

NAN = float("nan")
_NORMAL = NormalDist()
_TINY = 1e-300


def norm_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def norm_ppf(p: float) -> float:
    return _NORMAL.inv_cdf(p)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function, by the modified Lentz method."""
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > _TINY else _TINY)
    h = d
    for m in range(1, 20_000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            d = 1 / (d if abs(d) > _TINY else _TINY)
            c = 1 + step / c
            c = c if abs(c) > _TINY else _TINY
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return h


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function."""
    if math.isnan(x) or x <= 0 or x >= 1:
        return NAN if math.isnan(x) else float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_sf2(t: float, df: float) -> float:
    """Two-sided tail of Student's t."""
    if math.isnan(t) or math.isnan(df) or df <= 0:
        return NAN
    return 0.0 if math.isinf(t) else beta_cdf(df / (df + t * t), df / 2, 0.5)


def f_sf(f: float, d1: float, d2: float) -> float:
    if math.isnan(f) or d1 <= 0 or d2 <= 0:
        return NAN
    return 0.0 if math.isinf(f) else 1.0 if f <= 0 else beta_cdf(d2 / (d2 + d1 * f), d2 / 2, d1 / 2)


def chi2_sf(x: float, df: float) -> float:
    """Upper tail of chi-square: a series below the mean, a continued fraction above."""
    if math.isnan(x) or df <= 0:
        return NAN
    if x <= 0:
        return 1.0
    a, x = df / 2, x / 2
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while term > total * 1e-17:
            k += 1
            term *= x / k
            total += term
        return 1 - front * total
    b = x + 1 - a
    c, d = 1 / _TINY, 1 / b
    h = d
    for i in range(1, 100_000):
        n = -i * (i - a)
        b += 2
        d = 1 / (n * d + b)
        c = b + n / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def fisher_2x2(a: int, b: int, c: int, d: int) -> float:
    """Two-sided exact p of a 2 x 2 table: all tables no likelier than the one seen."""
    rows, cols, n = a + b, a + c, a + b + c + d
    if n == 0 or 0 in (rows, c + d, cols, b + d):
        return 1.0
    log_choose = lambda m, k: math.lgamma(m + 1) - math.lgamma(k + 1) - math.lgamma(m - k + 1)
    logp = lambda k: log_choose(cols, k) + log_choose(n - cols, rows - k) - log_choose(n, rows)
    seen = logp(a) + 1e-7
    return min(1.0, sum(math.exp(p) for k in range(max(0, rows + cols - n), min(rows, cols) + 1) if (p := logp(k)) <= seen))


@cache
def _rank_sum_counts(m: int, n: int) -> tuple[int, ...]:
    """Ways to reach each U of two samples without ties."""
    counts = [1] + [0] * (m * n)
    for i in range(1, m + 1):  # multiply by (1 - q^(n+i)), divide by (1 - q^i)
        for u in range(m * n, n + i - 1, -1):
            counts[u] -= counts[u - n - i]
        for u in range(i, m * n + 1):
            counts[u] += counts[u - i]
    return tuple(counts)


def mann_whitney_p(u: float, m: int, n: int, tie_sum: float) -> float:
    """Two-sided p of U of the first sample; tie_sum is the sum of t^3 - t over ties. Exact up to 8 without ties."""
    if min(m, n) == 0:
        return NAN
    top = max(u, m * n - u)
    if min(m, n) <= 8 and tie_sum == 0:
        counts = _rank_sum_counts(min(m, n), max(m, n))
        return min(1.0, 2 * sum(counts[math.ceil(top) :]) / math.comb(m + n, m))
    size = m + n
    var = m * n / 12 * (size + 1 - tie_sum / (size * (size - 1)))
    return min(1.0, 2 * norm_sf((top - m * n / 2 - 0.5) / math.sqrt(var))) if var > 0 else 1.0 if u == m * n / 2 else NAN


def shapiro(values: Sequence[float]) -> tuple[float, float]:
    """W and p of the Shapiro-Wilk test by Royston's 1995 approximation, for 3 to 5000 values."""
    x = np.sort(np.asarray(values, float))
    n = len(x)
    if not 3 <= n <= 5000 or not np.isfinite(x).all():
        return NAN, NAN
    if x[0] == x[-1]:
        return 1.0, 1.0
    x = x - np.median(x)
    if n == 3:
        a = np.array([-math.sqrt(0.5), 0.0, math.sqrt(0.5)])
    else:
        m = np.array([norm_ppf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
        size, u = float(m @ m), 1 / math.sqrt(n)
        c = m / math.sqrt(size)
        last = c[-1] + u * (0.221157 + u * (-0.147981 + u * (-2.071190 + u * (4.434685 - 2.706056 * u))))
        a = np.empty(n)
        if n > 5:
            second = c[-2] + u * (0.042981 + u * (-0.293762 + u * (-1.752461 + u * (5.682633 - 3.582633 * u))))
            phi = (size - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2)
            a[2:-2] = m[2:-2] / math.sqrt(phi)
            a[1], a[-2] = -second, second
        else:
            phi = (size - 2 * m[-1] ** 2) / (1 - 2 * last**2)
            a[1:-1] = m[1:-1] / math.sqrt(phi)
        a[0], a[-1] = -last, last
    squares = float(((x - x.mean()) ** 2).sum())
    if squares <= 0:  # differences too small to square
        return 1.0, 1.0
    w = min(1.0, float((a @ x) ** 2 / squares))
    if n == 3:
        return w, max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    if w >= 1:
        return w, 1.0
    y, log_n = math.log1p(-w), math.log(n)
    if n <= 11:
        g = -2.273 + 0.459 * n
        if y >= g:
            return w, 1e-99
        y = -math.log(g - y)
        mean = 0.5440 + n * (-0.39978 + n * (0.025054 - 6.714e-4 * n))
        sd = math.exp(1.3822 + n * (-0.77857 + n * (0.062767 - 0.0020322 * n)))
    else:
        mean = -1.5861 + log_n * (-0.31082 + log_n * (-0.083751 + 0.0038915 * log_n))
        sd = math.exp(-0.4803 + log_n * (-0.082676 + 0.0030302 * log_n))
    return w, norm_sf((y - mean) / sd)


def pearson_p(r: float | None, n: int) -> float:
    if r is None or math.isnan(r) or n < 3:
        return NAN
    room = (1 - r) * (1 + r)
    return t_sf2(math.inf if room <= 0 else r * math.sqrt((n - 2) / room), n - 2)
